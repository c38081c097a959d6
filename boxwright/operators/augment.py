"""Label side of image augmentations as table jobs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.operators.boxes import bound, candidates, clip, replace_columns
from boxwright.operators.datasets import ranked_quota
from boxwright.operators.overlap import touch_join

BOX = G.CORNERS
STITCH_CELLS = 4_000_000  # distances between corners that are held at once


def affine_boxes(df: DataFrame, width: str, height: str) -> DataFrame:
    """Boxes through the row's 2x3 matrix (a, b, tx, c, d, ty): hull of the moved corners, clipped, filtered."""
    xs = [f"(a * {x} + b * {y} + tx)" for x in ("x1", "x2") for y in ("y1", "y2")]
    ys = [f"(c * {x} + d * {y} + ty)" for x in ("x1", "x2") for y in ("y1", "y2")]
    scaled = df.selectExpr("*", *[f"{v} as o_{v}" for v in BOX])
    moved = replace_columns(
        scaled, x1=f"least({', '.join(xs)})", x2=f"greatest({', '.join(xs)})", y1=f"least({', '.join(ys)})", y2=f"greatest({', '.join(ys)})"
    )
    return candidates(clip(moved, width, height)).drop(*[f"o_{v}" for v in BOX])


def flip_horizontal(df: DataFrame, width: str, flip_idx: list[int]) -> DataFrame:
    """Mirror boxes and keypoints; keypoints change places by the permutation."""
    order = ", ".join(map(str, flip_idx))
    return replace_columns(
        df, x1=f"{width} - x2", x2=f"{width} - x1",
        kpts=f"transform(array({order}), i -> struct({width} - kpts[i].x as x, kpts[i].y as y, kpts[i].v as v))",
    )


def mosaic_plan(patches: DataFrame, size: int) -> DataFrame:
    """Paste rectangle and shift of four patches around a centre (columns slot 0..3, w, h, xc, yc)."""
    full = 2 * size
    left, top = "slot in (0, 2)", "slot in (0, 1)"
    placed = patches.selectExpr(
        "*", f"if({left}, greatest(xc - w, 0), xc) as x1a", f"if({left}, xc, least(xc + w, {full})) as x2a",
        f"if({top}, greatest(yc - h, 0), yc) as y1a", f"if({top}, yc, least(yc + h, {full})) as y2a",
    )
    return placed.selectExpr(
        "*", f"x1a - if({left}, w - (x2a - x1a), 0) as padw", f"y1a - if({top}, h - (y2a - y1a), 0) as padh"
    )


def mosaic_grid_plan(patches: DataFrame, n: int, size: int) -> DataFrame:
    """Shift of each patch (mosaic_id, slot, w, h) of a row of three or a ring of nine around slot 0; mosaics that are not full go.

    A patch stands beside the centre or beside the patch before it, so sizes may differ. The result shows 2 * size pixels a side, from half a size in.
    """
    own = "partition by mosaic_id order by slot"
    known = patches.selectExpr(
        "*", f"first(w) over ({own}) as _w0", f"first(h) over ({own}) as _h0", f"lag(w) over ({own}) as _wp", f"lag(h) over ({own}) as _hp", "count(*) over (partition by mosaic_id) as _n"
    ).where(f"_n = {n}")
    # clockwise from the centre: above, and on round to the upper left
    ring = [("0", "0"), ("0", "-h"), ("_wp", "-h"), ("_w0", "0"), ("_w0", "_hp"), ("_w0 - w", "_h0"), ("_w0 - _wp - w", "_h0"), ("-w", "_h0 - h"), ("-w", "_h0 - _hp - h")]
    places = ring if n == 9 else [ring[0], ring[3], ring[7]]
    dx, dy = (f"case slot {' '.join(f'when {i} then {place[k]}' for i, place in enumerate(places))} end" for k in (0, 1))
    return known.selectExpr(*patches.columns, f"{size} - {size // 2} + {dx} as padw", f"{size} - {size // 2} + {dy} as padh")


def mosaic_labels(objects: DataFrame, plan: DataFrame, full: int) -> DataFrame:
    """Labels shifted into the mosaic, clipped to it, empty ones dropped."""
    moved = objects.join(plan.select("image_id", "mosaic_id", "padw", "padh"), "image_id")
    moved = replace_columns(moved, x1="x1 + padw", x2="x2 + padw", y1="y1 + padh", y2="y2 + padh").drop("padw", "padh")
    return clip(moved, f"{full}D", f"{full}D").where("x2 > x1 and y2 > y1")


def cut_mix(objects: DataFrame, areas: DataFrame, partners: DataFrame, min_ioa: float = 0.1) -> DataFrame:
    """Partner boxes pasted into the first free area of each image.

    areas: image_id, area_no and corners; partners: image_id, partner_id. An area is free when it overlaps no
    object of the image; partner boxes need ``min_ioa`` of their area inside and are clipped to it.
    """
    busy = touch_join(areas, objects.select("image_id", *BOX), ["image_id"]).select("image_id", "area_no").distinct()
    free = areas.join(busy, ["image_id", "area_no"], "left_anti")
    chosen = free.groupBy("image_id").agg(F.expr(f"min_by(struct({', '.join(BOX)}), area_no) as a"))
    target = chosen.join(partners, "image_id").selectExpr("image_id as target_id", "partner_id as image_id", *[f"a.{c} as a_{c}" for c in BOX])
    met = objects.join(target, "image_id").where(f"{G.ioa('a_', '')} >= {min_ioa}D")
    return met.selectExpr(
        "target_id as image_id", "gt_id", "cls", "greatest(x1, a_x1) as x1", "greatest(y1, a_y1) as y1", "least(x2, a_x2) as x2", "least(y2, a_y2) as y2"
    )


def copy_paste(objects: DataFrame, width: str, share: float, limit: float = 0.3) -> DataFrame:
    """Mirrored copies that overlap no object by ``limit`` of its area or more; the least overlapping share is kept."""
    mirrored = replace_columns(objects, x1=f"{width} - x2", x2=f"{width} - x1")
    met = touch_join(mirrored, objects, ["image_id"]).groupBy("image_id", "gt_id").agg(F.expr(f"max({G.ioa('', 'r_')}) as ioa"))
    scored = mirrored.join(met, ["image_id", "gt_id"], "left").selectExpr(*objects.columns, "coalesce(ioa, 0D) as ioa").where(f"ioa < {limit}D")
    picked = ranked_quota(scored, "image_id", "gt_id", f"rint({share}D * n)", order=f"(ioa / {limit}D * 0.999999D)")
    return picked.where("picked").drop("picked")


def text_prompts(objects: DataFrame, num_classes: int, negatives: int, max_samples: int) -> DataFrame:
    """Sampled class list of each image: a hash-ordered sample of its own classes, in order, then hash-ordered negatives; class lists are short."""
    drawn = "transform(array_sort(transform(own, c -> struct((image_id * 17 + c * 6007) % 1013 as k, c as c))), s -> s.c)"
    sampled = f"array_sort(slice({drawn}, 1, {max_samples})) as pos"
    own = objects.groupBy("image_id").agg(F.expr(f"collect_set(cls) as own")).selectExpr("image_id", sampled)
    rest = f"array_except(sequence(0, {num_classes - 1}), pos)"
    ordered = f"transform(array_sort(transform({rest}, c -> struct((image_id * 31 + c * 7919) % 1009 as k, c as c))), s -> s.c)"
    return own.selectExpr("image_id", "pos", f"slice({ordered}, 1, greatest(least({min(num_classes, max_samples)} - size(pos), {negatives}), 0)) as neg").selectExpr(
        "image_id", "pos", "concat(pos, neg) as classes"
    )


def padded_prompts(prompts: DataFrame, size: int) -> DataFrame:
    """Adds ``prompts``, the class list filled up with -1 (the empty prompt) to ``size``."""
    return prompts.selectExpr("*", f"concat(classes, array_repeat(-1, greatest({size} - size(classes), 0))) as prompts")


def reindex_classes(objects: DataFrame, prompts: DataFrame) -> DataFrame:
    """Objects of sampled classes, with the class replaced by its place in the image's list."""
    joined = objects.join(prompts.select("image_id", "classes"), "image_id").selectExpr(*objects.columns, "cast(array_position(classes, cls) - 1 as int) as new_cls")
    return joined.where("new_cls >= 0")


def resample_polygon(points: str, n: int) -> str:
    """Closed polygon resampled to n points by linear interpolation; original vertices stay when there are fewer than n."""
    closed = f"concat({points}, slice({points}, 1, 1))"
    size = f"(size({points}) + 1)"
    lin = f"transform(sequence(0, if({size} < {n}, {n} - {size}, {n}) - 1), i -> cast(i as double) * (({size} - 1) / (if({size} < {n}, {n} - {size}, {n}) - 1)))"
    at = f"if({size} < {n}, array_sort(concat({lin}, transform(sequence(0, {size} - 1), i -> cast(i as double)))), {lin})"
    lo = f"cast(least(floor(t), {size} - 2) as int)"
    moved = ", ".join(f"{closed}[{lo}].{a} + ({closed}[{lo} + 1].{a} - {closed}[{lo}].{a}) * (t - {lo}) as {a}" for a in "xy")
    return f"if(size({points}) = {n}, {points}, transform({at}, t -> struct({moved})))"


def stitch_parts(parts: DataFrame) -> DataFrame:
    """Join the polygon parts of each object at their closest vertices, out and back, into one outline.

    parts: object_id, part_no, xs, ys. An object has a handful of parts; objects are what is distributed.
    """

    grouped = parts.groupBy("object_id").agg(F.expr("array_sort(collect_list(struct(part_no, xs, ys))) as p")).selectExpr("object_id", "p.xs as xs", "p.ys as ys")

    def run(batches):
        for batch in batches:
            objects, xs, ys = (batch.column(i) for i in range(3))
            parts = np.diff(np.asarray(xs.offsets))
            corners = np.diff(np.asarray(xs.flatten().offsets))
            points = np.stack([np.asarray(c.flatten().flatten().to_numpy(zero_copy_only=False), float) for c in (xs, ys)], axis=1)
            first_part, first_point = np.cumsum(parts) - parts, np.concatenate([[0], np.cumsum(corners)])
            # objects whose parts have the same numbers of corners are stitched together
            alike: dict[tuple[int, ...], list[int]] = {}
            sizes = corners.tolist()
            for k, (at, n) in enumerate(zip(first_part.tolist(), parts.tolist())):
                alike.setdefault(tuple(sizes[at : at + n]), []).append(k)
            for shape, members in alike.items():
                step = max(1, STITCH_CELLS // max([a * b for a, b in zip(shape, shape[1:])] + [sum(shape), 1]))
                for members_now in (members[i : i + step] for i in range(0, len(members), step)):
                    at = first_point[first_part[members_now]]
                    outlines = stitch_all([points[(at + shift)[:, None] + np.arange(n)] for n, shift in zip(shape, np.cumsum(shape) - shape)])
                    count, length = outlines.shape[:2]
                    offsets = pa.array(np.arange(count + 1, dtype=np.int32) * length, pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(outlines[:, :, a].ravel(), pa.float64(), from_pandas=True)) for a in (0, 1)]
                    yield pa.RecordBatch.from_arrays([objects.take(pa.array(members_now)), *lists], ["object_id", "xs", "ys"])

    return grouped.mapInArrow(run, "object_id bigint, xs array<double>, ys array<double>")


def stitch(rings: list[np.ndarray]) -> np.ndarray:
    """One outline through all rings of an object."""
    return stitch_all([ring[None] for ring in rings])[0]


def stitch_all(rings: list[np.ndarray]) -> np.ndarray:
    """For each object one outline through all its rings, linked where consecutive rings are nearest. A ring is an array (object, corner, 2).

    The walk goes out through all rings and comes back through those between the first and the last. On the way out it takes such a ring
    from its lower to its higher link, on the way back the rest of it, so the seams are drawn twice and enclose nothing. A ring whose link
    to its predecessor has the higher number is turned round first; its link numbers then count from the other end.
    """
    if len(rings) == 1:
        return rings[0]
    links = []
    for a, b in zip(rings, rings[1:]):
        gap = ((a[:, :, None] - b[:, None]) ** 2).sum(-1)
        links.append(np.divmod(gap.reshape(len(gap), -1).argmin(axis=1), b.shape[1]))

    def walked(ring: np.ndarray, first: np.ndarray, turned: np.ndarray | bool = False) -> np.ndarray:
        """The closed ring from a corner on, the other way round where it is turned."""
        size = ring.shape[1]
        corner = (first[:, None] + np.arange(size + 1)) % size
        corner = np.where(np.asarray(turned).reshape(-1, 1), size - 1 - corner, corner)
        return np.take_along_axis(ring, corner[:, :, None], axis=1)

    def whole(ring: np.ndarray) -> np.ndarray:
        return np.ones((len(ring), ring.shape[1] + 1), bool)

    out, back = [(walked(rings[0], links[0][0]), whole(rings[0]))], []
    for ring, before, after in zip(rings[1:], links, links[1:]):
        low, span = np.minimum(before[1], after[0]), np.abs(before[1] - after[0])[:, None]
        walk, step = walked(ring, low, before[1] > after[0]), np.arange(ring.shape[1] + 1)
        out.append((walk, step <= span))
        back.append((walk, step >= span))
    pieces = [*out, (walked(rings[-1], links[-1][1]), whole(rings[-1])), *back[::-1]]
    walk, used = (np.concatenate(part, axis=1) for part in zip(*pieces))
    return walk[used].reshape(len(walk), -1, 2)


def projected(points: str, matrix: str = "m", more: str = "") -> str:
    """Points (array of structs) through a 3x3 matrix (array of nine, row by row), with the perspective divide."""
    row = lambda i: f"({matrix}[{i}] * p.x + {matrix}[{i + 1}] * p.y + {matrix}[{i + 2}])"
    return f"transform({points}, p -> struct({row(0)} / {row(6)} as x, {row(3)} / {row(6)} as y{more}))"


def perspective_outlines(df: DataFrame, width: str, height: str, min_share: float = 0.01) -> DataFrame:
    """Polygons through the row's matrix ``m``; each box is the hull of the points inside the image, and its polygon is clipped to it.

    An outline that leaves the image on three sides or more is clipped to the image first. Boxes without area, of less than ``min_share`` of the old
    area, or too narrow go.
    """
    scaled = df.selectExpr("*", *[f"{v} as o_{v}" for v in BOX])
    moved = bound(bound(scaled, polygon="polygon", m="m"), polygon=projected("polygon"))
    ends = ("array_min(polygon.x) < 0", "array_min(polygon.y) < 0", f"array_max(polygon.x) > {width}", f"array_max(polygon.y) > {height}")
    held = f"transform(polygon, p -> struct({G.clamp('p.x', '0D', width)} as x, {G.clamp('p.y', '0D', height)} as y))"
    sides = f"{' + '.join(f'int(coalesce({e}, false))' for e in ends)} >= 3"
    inside = f"filter(if({sides}, {held}, polygon), p -> p.x > 0 and p.y > 0 and p.x < {width} and p.y < {height})"
    boxed = bound(bound(moved, _in=inside), **{f"{a}{i}": f"coalesce(array_{f}(_in.{a}), 0D)" for a in "xy" for i, f in ((1, "min"), (2, "max"))})
    cut = f"transform(polygon, p -> struct({G.clamp('p.x', 'x1', 'x2')} as x, {G.clamp('p.y', 'y1', 'y2')} as y))"
    return bound(candidates(boxed.drop("_in"), min_area=min_share), polygon=cut).drop(*[f"o_{v}" for v in BOX])


def perspective_keypoints(df: DataFrame, width: str, height: str) -> DataFrame:
    """Keypoints (x, y, v) through the row's matrix ``m``; those outside the image are no longer visible."""
    moved = replace_columns(df, kpts=projected("kpts", more=", p.v as v"))
    gone = f"p.x < 0 or p.y < 0 or p.x > {width} or p.y > {height}"
    return replace_columns(moved, kpts=f"transform(kpts, p -> struct(p.x as x, p.y as y, if({gone}, 0, p.v) as v))")


def mix_up(objects: DataFrame, partners: DataFrame) -> DataFrame:
    """Labels of an image and of its partner together (image_id, partner_id); ``part`` says whose they are."""
    other = objects.withColumnRenamed("image_id", "partner_id").join(partners, "partner_id").drop("partner_id")
    return objects.selectExpr("*", "0 as part").unionByName(other.selectExpr(*objects.columns, "1 as part"))
