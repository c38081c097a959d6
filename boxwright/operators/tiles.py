"""Sliding tiles, pyramid crops, polygon clipping and tile merging."""

from __future__ import annotations

from pyspark.sql import DataFrame

from boxwright.functions import geometry as G
from boxwright.operators.boxes import bound
from boxwright.operators.nms import rotated_nms
from boxwright.operators.overlap import touch_join


def _starts(length: str, size: int, step: int) -> str:
    """Tile starts along one side; the last tile is pulled back to the edge."""
    n = f"if({length} <= {size}, 1, cast(ceil(({length} - {size}) / {step} + 1) as int))"
    return f"transform(sequence(0, {n} - 1), i -> if(i > 0 and i * {step} + {size} > {length}, cast({length} - {size} as bigint), cast(i * {step} as bigint)))"


def tile_plan(images: DataFrame, sizes: list[int], gaps: list[int], rates: list[float] = [1.0], min_rate: float = 0.6) -> DataFrame:
    """Tiles of every image (columns width, height) at each crop size and rate.

    Tiles with more than ``min_rate`` of their area inside the image are kept; where none qualifies, those with
    the largest share are. The maximum is taken over the short list of one image's tiles, inside the row.
    """
    plans = [(int(s / r), int(g / r)) for r in rates for s, g in zip(sizes, gaps)]
    lists = []
    for size, gap in plans:
        if size <= gap:
            raise ValueError(f"crop size {size} must exceed gap {gap}")
        xs, ys = _starts("width", size, size - gap), _starts("height", size, size - gap)
        inside = f"(least(x + {size}, width) - least(x, width)) * (least(y + {size}, height) - least(y, height)) / {float(size) ** 2}D"
        lists.append(f"flatten(transform({xs}, x -> transform({ys}, y -> struct(x as tx1, y as ty1, x + {size} as tx2, y + {size} as ty2, {inside} as rate))))")
    tiles = images.selectExpr("*", f"concat({', '.join(lists)}) as _t").selectExpr("*", "array_max(_t.rate) as _m")
    keep = f"filter(_t, t -> t.rate > {min_rate}D or (_m <= {min_rate}D and abs(t.rate - _m) < 0.01D))"
    return tiles.selectExpr(*images.columns, f"explode({keep}) as _t").selectExpr(*images.columns, "_t.*")


def pyramid_plan(images: DataFrame, layers: int, overlap: float = 512 / 1500) -> DataFrame:
    """The whole image, then layer i with 2^i crops per side."""
    parts = ["array(struct(0 as layer, 0L as cx1, 0L as cy1, cast(width as bigint) as cx2, cast(height as bigint) as cy2))"]
    for layer in range(1, layers + 1):
        n = 2**layer
        lap = f"cast(floor({overlap!r}D * least(width, height) * {2 / n!r}D) as bigint)"
        cw, ch = (f"cast(ceil(({lap} * {n - 1} + {side}) / {n}) as bigint)" for side in ("width", "height"))
        parts.append(
            f"flatten(transform(sequence(0, {n - 1}), i -> transform(sequence(0, {n - 1}), j -> struct({layer} as layer, ({cw} - {lap}) * i as cx1, ({ch} - {lap}) * j as cy1,"
            f" least(({cw} - {lap}) * i + {cw}, width) as cx2, least(({ch} - {lap}) * j + {ch}, height) as cy2))))"
        )
    return images.selectExpr(*images.columns, f"explode(concat({', '.join(parts)})) as c").selectExpr(*images.columns, "c.*")


def polygon_area(points: str) -> str:
    """Shoelace area of an array of x, y structs."""
    following = f"if(size({points}) = 0, {points}, concat(slice({points}, 2, size({points})), slice({points}, 1, 1)))"
    return f"abs(aggregate(zip_with({points}, {following}, (a, b) -> a.x * b.y - b.x * a.y), 0D, (s, v) -> s + v)) / 2"


def clip_to_tile(points: str = "polygon", tile: str = "r_t", hull: str | None = None) -> str:
    """Polygon cut to the columns {tile}x1.. of its row: one fold over the four half-planes n.p >= c, with the prefix of its hull's columns only over those that cut it."""
    sides = [("x1", "1D", "0D", ""), ("x2", "-1D", "0D", "-"), ("y1", "0D", "1D", ""), ("y2", "0D", "-1D", "-")]
    cuts = {c: "true" if hull is None else f"{hull}{c} {'<' if sign == '' else '>'} {tile}{c}" for c, _, _, sign in sides}
    planes = ", ".join(f"struct({nx} as nx, {ny} as ny, cast({sign}{tile}{c} as double) as c, {cuts[c]} as cuts)" for c, nx, ny, sign in sides)
    planes = f"array({planes})" if hull is None else f"filter(array({planes}), h -> h.cuts)"
    measured = "transform(pts, p -> struct(p.x as x, p.y as y, h.nx * p.x + h.ny * p.y - h.c as d))"
    meet = "struct(a.x + (b.x - a.x) * (a.d / (a.d - b.d)) as x, a.y + (b.y - a.y) * (a.d / (a.d - b.d)) as y)"
    edges = f"transform({measured}, (p, i) -> struct(p as a, struct(pts[(i + 1) % size(pts)].x as x, pts[(i + 1) % size(pts)].y as y, h.nx * pts[(i + 1) % size(pts)].x + h.ny * pts[(i + 1) % size(pts)].y - h.c as d) as b))"
    pieces = (
        f"case when e.a.d >= 0 and e.b.d >= 0 then array(struct(e.b.x as x, e.b.y as y)) when e.a.d >= 0 then array({meet.replace('a.', 'e.a.').replace('b.', 'e.b.')})"
        f" when e.b.d >= 0 then array({meet.replace('a.', 'e.a.').replace('b.', 'e.b.')}, struct(e.b.x as x, e.b.y as y)) else slice(array(struct(e.b.x as x, e.b.y as y)), 1, 0) end"
    )
    return f"aggregate({planes}, transform({points}, p -> struct(cast(p.x as double) as x, cast(p.y as double) as y)), (pts, h) -> flatten(transform({edges}, e -> {pieces})))"


def tiles_with_objects(tiles: DataFrame, objects: DataFrame, min_share: float = 0.7) -> DataFrame:
    """Objects of each tile: at least ``min_share`` of the polygon lies in it. Hulls meet tiles on a grid, the exact clip decides.

    A polygon of n corners winds at most (n - 1) / 2 times round a point, so what a tile holds of it has at most that many times the common area of tile and hull.
    """
    ends = {f"{a}{i}": f"array_{f}(polygon.{a})" for i, f in ((1, "min"), (2, "max")) for a in ("x", "y")}
    hull = bound(bound(objects, polygon="polygon"), **ends, _area=f"greatest({polygon_area('polygon')}, 1e-6D)", _turns="greatest((size(polygon) - 1) div 2, 1)")
    boxes = tiles.selectExpr("*", *[f"cast(t{c} as double) as {c}" for c in ("x1", "y1", "x2", "y2")])
    # A hull inside the tile needs no clip; the others need one only where the hull leaves enough room.
    whole = "x1 >= r_tx1 and y1 >= r_ty1 and x2 <= r_tx2 and y2 <= r_ty2"
    roomy = f"_turns * {G.intersection()} >= {min_share * (1 - 1e-6)!r}D * _area"
    met = touch_join(hull, boxes, ["image_id"], f"({whole} or {roomy})", cell=512.0)
    part = f"transform(array({clip_to_tile(hull='')}), c -> {polygon_area('c')})[0] / _area"
    rest = [c for c in objects.columns if c != "image_id"]
    names = [f"r_{c} as {c}" for c in tiles.columns if c != "image_id"]
    return bound(met, share=f"if({whole}, 1D, {part})").selectExpr("image_id", *rest, *names, "share").where(f"share >= {min_share}D")


def merge_tiles(det: DataFrame, iou: float = 0.3) -> DataFrame:
    """Move tile detections (tile_name scene__size__x___y, rotated boxes) to their scene and suppress there."""
    moved = det.selectExpr(
        *[c for c in det.columns if c not in ("cx", "cy", "tile_name")], "split(tile_name, '__')[0] as image_id",
        r"cx + cast(regexp_extract(tile_name, '(\\d+)___(\\d+)', 1) as double) as cx",
        r"cy + cast(regexp_extract(tile_name, '(\\d+)___(\\d+)', 2) as double) as cy",
    )
    return rotated_nms(moved, iou)

