"""Masks as run rows (image_id, mask_id, start, len), column-major; never dense arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.operators.overlap import by_crowd

STRETCH = 64
COLUMNS = 8  # of a grid that a packed mask's row covers


def box_runs(boxes: DataFrame, id_col: str, width: int, height: int, stride: int) -> DataFrame:
    """Filled boxes on a coarse mask grid, one run per grid column."""
    rest = [c for c in boxes.columns if c not in ("x1", "y1", "x2", "y2")]
    cells = boxes.selectExpr(
        *rest, f"least(greatest(cast(floor(x1 / {stride}) as int), 0), {width}) as a", f"least(greatest(cast(floor(x2 / {stride}) as int), 0), {width}) as b",
        f"least(greatest(cast(floor(y1 / {stride}) as int), 0), {height}) as c", f"least(greatest(cast(floor(y2 / {stride}) as int), 0), {height}) as d",
    ).where("a < b and c < d")
    return cells.selectExpr(*[c for c in rest], "explode(sequence(a, b - 1)) as _x", "c", "d").selectExpr(
        *rest, f"cast(_x as bigint) * {height} + c as start", "cast(d - c as bigint) as len"
    )


def box_masks(boxes: DataFrame, id_col: str, width: int, height: int, stride: int) -> DataFrame:
    """The masks of ``box_runs`` packed: one row each, its runs (start, len) in the list ``runs``, so that they move together."""
    rest = [c for c in boxes.columns if c not in ("x1", "y1", "x2", "y2")]
    cells = boxes.selectExpr(
        *rest, f"least(greatest(cast(floor(x1 / {stride}) as int), 0), {width}) as a", f"least(greatest(cast(floor(x2 / {stride}) as int), 0), {width}) as b",
        f"least(greatest(cast(floor(y1 / {stride}) as int), 0), {height}) as c", f"least(greatest(cast(floor(y2 / {stride}) as int), 0), {height}) as d",
    ).where("a < b and c < d")
    return cells.selectExpr(*rest, f"transform(sequence(a, b - 1), x -> struct(cast(x as bigint) * {height} + c as start, cast(d - c as bigint) as len)) as runs")


def mask_areas(runs: DataFrame, *keys: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.expr("sum(len) as area"))


def mask_iou(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, height: int, eps: float = 1e-7) -> DataFrame:
    """Overlap of masks that share keys: runs meet where they share a stretch of a column, then lengths add up.

    A run stands in every stretch of ``STRETCH`` pixels it reaches; a pair counts in the stretch where its common part begins.
    """
    cells = f"explode(sequence(start div {STRETCH}, (start + len - 1) div {STRETCH})) as _cell"
    l = left.where("len > 0").selectExpr(*keys, left_id, "start as ls", "start + len as le", f"start div {height} as _col", cells)
    r = right.where("len > 0").selectExpr(*keys, right_id, "start as rs", "start + len as re", f"start div {height} as _col", cells)
    met = l.join(r, [*keys, "_col", "_cell"]).where(f"least(le, re) > greatest(ls, rs) and _cell = greatest(ls, rs) div {STRETCH}")
    inter = met.groupBy(*keys, left_id, right_id).agg(F.expr("sum(least(le, re) - greatest(ls, rs)) as inter"))
    la = mask_areas(left, *keys, left_id).withColumnRenamed("area", "la")
    ra = mask_areas(right, *keys, right_id).withColumnRenamed("area", "ra")
    return inter.join(la, [*keys, left_id]).join(ra, [*keys, right_id]).selectExpr(
        *keys, left_id, right_id, "inter", f"inter / (la + ra - inter + {eps}D) as iou"
    )


def packed_iou(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, height: int, eps: float = 1e-7) -> DataFrame:
    """``mask_iou`` of packed masks: those of a key meet behind one exchange a side as blocks of equal runs; crowded keys are spread over tiles."""

    def together(one: DataFrame, two: DataFrame) -> DataFrame:
        return _met_by_key(one, two, keys, left_id, right_id, height, eps)

    def spread(one: DataFrame, two: DataFrame) -> DataFrame:
        return _met_in_tiles(one, two, keys, left_id, right_id, height, eps)

    return by_crowd(left, right, keys, together, spread)


def _blocks(height: int) -> str:
    """The list ``runs`` without loss as blocks of equal runs in neighbouring columns, two numbers each: where it starts, and columns and rows."""
    columns = f"sequence(r.start div {height}, (r.start + r.len - 1) div {height})"
    cut = f"struct(greatest(r.start - x * {height}, 0L) as a, least(r.start + r.len - x * {height}, {height}L) as b, x)"
    pieces = f"array_sort(flatten(transform(filter(runs, r -> r.len > 0), r -> transform({columns}, x -> {cut}))))"
    heads = "filter(sequence(0, size(s) - 1), i -> i = 0 or s[i].a <> s[i - 1].a or s[i].b <> s[i - 1].b or s[i].x <> s[i - 1].x + 1)"
    block = f"array(s[i].x * {height} + s[i].a, shiftleft(cast(if(n + 1 < size(h), h[n + 1], size(s)) - i as bigint), 32) | (s[i].b - s[i].a))"
    made = f"flatten(transform(array({heads}), h -> flatten(transform(h, (i, n) -> {block}))))"
    return f"flatten(transform(array({pieces}), s -> if(size(s) = 0, cast(array() as array<bigint>), {made})))"


def _met_by_key(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, height: int, eps: float) -> DataFrame:
    """``packed_iou`` of masks that are dealt by their keys alone: areas, pairs and repeated ids need no other exchange."""

    def packed(masks: DataFrame, id_col: str, side: str) -> DataFrame:
        whole = " and ".join(f"{c} is not null" for c in (*keys, id_col))
        rows = masks.where(whole).selectExpr(*keys, id_col, "aggregate(runs, 0L, (s, r) -> s + r.len) as _area", f"{_blocks(height)} as _{side}").repartition(*keys)
        return rows.selectExpr(*keys, id_col, f"_{side}", f"sum(_area) over (partition by {', '.join((*keys, id_col))}) as {side}a")

    def common(i: str, j: str) -> str:
        x, y = (f"(_l[{i}] div {height})", f"(_r[{j}] div {height})"), (f"(_l[{i}] % {height})", f"(_r[{j}] % {height})")
        shape = f"_l[{i} + 1]", f"_r[{j} + 1]"
        wide = f"least({', '.join(f'{a} + shiftright({b}, 32)' for a, b in zip(x, shape, strict=True))}) - greatest({', '.join(x)})"
        high = f"least({', '.join(f'{a} + ({b} & 4294967295L)' for a, b in zip(y, shape, strict=True))}) - greatest({', '.join(y)})"
        return f"greatest({wide}, 0L) * greatest({high}, 0L)"

    ends = {side: f"if(size(_{side}) = 0, cast(array() as array<int>), sequence(0, size(_{side}) - 1, 2))" for side in "lr"}
    many = f"aggregate({ends['l']}, 0L, (s, i) -> s + aggregate({ends['r']}, 0L, (t, j) -> t + {common('i', 'j')}))"
    pairs = packed(left, left_id, "l").join(packed(right, right_id, "r").hint("merge"), keys)
    # worked out once a pair; most masks of boxes are one block
    met = pairs.selectExpr(*keys, left_id, right_id, "la", "ra", f"inline(array(struct(if(size(_l) = 2 and size(_r) = 2, {common('0', '0')}, {many}) as inter)))").where("inter > 0")
    inter = met.groupBy(*keys, left_id, right_id).agg(F.expr("sum(inter) as inter"), F.expr("first(la) as la"), F.expr("first(ra) as ra"))
    return inter.selectExpr(*keys, left_id, right_id, "inter", f"inter / (la + ra - inter + {eps}D) as iou")


def _met_in_tiles(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, height: int, eps: float) -> DataFrame:
    """``packed_iou`` of masks that meet where they share ``COLUMNS`` columns, and there run by run.

    A row holds the parts of its runs inside those columns, places counted from the first, begin and end in one number each.
    """
    area = height * COLUMNS

    def tiled(masks: DataFrame, id_col: str, side: str) -> DataFrame:
        tiles = f"array_distinct(flatten(transform(filter(runs, r -> r.len > 0), r -> sequence(r.start div {area}, (r.start + r.len - 1) div {area}))))"
        inside = f"filter(runs, r -> r.len > 0 and r.start < (_tile + 1) * {area} and r.start + r.len > _tile * {area})"
        part = f"shiftleft(greatest(r.start - _tile * {area}, 0L), 32) | least(r.start + r.len - _tile * {area}, {area}L)"
        rows = masks.selectExpr(*keys, id_col, "runs", f"explode({tiles}) as _tile")
        return rows.selectExpr(*keys, id_col, "_tile", f"transform({inside}, r -> {part}) as {side}")

    first, last = "shiftright(array_min({0}), 32)", "array_max(transform({0}, p -> p & 4294967295L))"
    hulls = f"{first.format('_l')} < {last.format('_r')} and {first.format('_r')} < {last.format('_l')}"
    met = tiled(left, left_id, "_l").join(tiled(right, right_id, "_r"), [*keys, "_tile"]).where(hulls)
    begin, end = "greatest(shiftright(p, 32), shiftright(q, 32))", "least(p & 4294967295L, q & 4294967295L)"
    runs = met.selectExpr(*keys, left_id, right_id, "_r", "explode(_l) as p").selectExpr(*keys, left_id, right_id, "p", "explode(_r) as q").where(f"{end} > {begin}")
    inter = runs.groupBy(*keys, left_id, right_id).agg(F.expr(f"sum({end} - {begin}) as inter"))
    areas = "sum(aggregate(runs, 0L, (s, r) -> s + r.len)) as {0}"
    la = left.groupBy(*keys, left_id).agg(F.expr(areas.format("la")))
    ra = right.groupBy(*keys, right_id).agg(F.expr(areas.format("ra")))
    return inter.join(la, [*keys, left_id]).join(ra, [*keys, right_id]).selectExpr(
        *keys, left_id, right_id, "inter", f"inter / (la + ra - inter + {eps}D) as iou"
    )


def mask_boxes(runs: DataFrame, keys: list[str], height: int) -> DataFrame:
    """Tight box (inclusive edges) of each mask from its runs."""
    return runs.groupBy(*keys).agg(
        F.expr(f"min(start div {height}) as left"), F.expr(f"min(start % {height}) as top"),
        F.expr(f"max(start div {height}) as right"), F.expr(f"max((start + len - 1) % {height}) as bottom"),
    )


def _touching(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces (start, len) of each key, those that touch as one."""
    k = ", ".join(keys)
    marked = pieces.selectExpr(*keys, "start", "len", f"lag(start + len) over (partition by {k} order by start) as _end")
    heads = marked.selectExpr(*keys, "start", "len", f"sum(if(_end = start, 0, 1)) over (partition by {k} order by start) as _h")
    return heads.groupBy(*keys, "_h").agg(F.expr("min(start) as start"), F.expr("sum(len) as len")).drop("_h")


def pixel_runs(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive positions become runs; a position may come several times.

    Positions set bits of 64-bit words, so single ones are neither sorted nor moved. Words are blocked, so a large mask is several windows;
    a run across a block edge is joined afterwards.
    """
    words = pixels.groupBy(*keys, F.expr("shiftright(cast(pos as bigint), 6) as _w")).agg(F.expr("bit_or(shiftleft(1L, cast(pos & 63 as int))) as bits"))
    bits = "filter(sequence(0, 63), i -> shiftrightunsigned({0}, i) & 1L = 1L)"
    ends = words.selectExpr(*keys, "_w", f"{bits.format('(bits & ~shiftleft(bits, 1))')} as s", f"{bits.format('(bits & ~shiftrightunsigned(bits, 1))')} as e")
    pieces = ends.selectExpr(*keys, "shiftright(_w, 10) as _b", "inline(transform(s, (i, n) -> struct(_w * 64 + i as start, cast(e[n] - i + 1 as bigint) as len)))")
    return _touching(_touching(pieces, [*keys, "_b"]).drop("_b"), keys)


def counts_text(counts: str = "counts") -> str:
    """SQL text of compressed counts. From the fourth on a count is written as its difference to the second before it.

    A signed value takes the fewest five-bit groups of two's complement that hold it, lowest first; all but the last are
    marked with 32, and 48 makes them printable.
    """
    steps = f"transform({counts}, (c, i) -> if(i > 2, c - {counts}[i - 2], c))"
    groups = "ceil((1 + if(d in (0, -1), 0, length(bin(if(d < 0, -d - 1, d))))) / 5D)"
    digits = "transform(sequence(1, cast(n as int)), g -> chr(48 + (shiftright(d, 5 * (g - 1)) & 31) + if(g < n, 32, 0)))"
    # most differences take one or two groups, which need no list of digits
    one, two = "chr(48 + (d & 31))", "concat(chr(80 + (d & 31)), chr(48 + (shiftright(d, 5) & 31)))"
    many = f"array_join(transform(array({groups}), n -> array_join({digits}, '')), '')"
    return f"array_join(transform({steps}, d -> case when d between -16 and 15 then {one} when d between -512 and 511 then {two} else {many} end), '')"


def run_length_text(runs: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Alternating zero / one counts of each mask, and their compressed text.

    A mask has at most ``total`` positions, which bounds the collected runs.
    """
    # packed masks have their runs in a list, so one row of a mask moves
    held = "flatten(collect_list(runs))" if "runs" in runs.columns else "collect_list(struct(start, len))"
    lists = runs.groupBy(*keys).agg(F.expr(f"array_sort({held}) as r"))
    gaps = "transform(r, (x, i) -> array(if(i = 0, x.start, x.start - r[i - 1].start - r[i - 1].len), x.len))"
    counted = lists.selectExpr(*keys, f"concat(flatten({gaps}), filter(array({total} - element_at(r, -1).start - element_at(r, -1).len), v -> v > 0)) as counts")

    return counted.selectExpr("*", f"{counts_text()} as rle")


def overlap_index(runs: DataFrame, areas: DataFrame, height: int) -> DataFrame:
    """Which mask shows at each position when larger masks are drawn first: the smallest area, then the highest id.

    Run boundaries cut a column into pieces (a column has at most ``height`` of them), so pixels are never expanded.
    """
    spans = runs.join(areas, ["image_id", "mask_id"]).selectExpr("image_id", f"start div {height} as col", "start as s", "start + len as e", "area", "mask_id")
    distinct = spans.groupBy("image_id", "col", "s", "e").agg(F.expr("max(struct(-area as k, mask_id)) as top"))
    # a column holds no more than height * (height + 1) / 2 different runs, so its list is bounded
    listed = distinct.groupBy("image_id", "col").agg(F.expr("collect_list(struct(s, e, top)) as runs")).selectExpr(
        "image_id", "col", "inline(array(struct(runs, array_sort(array_distinct(concat(runs.s, runs.e))) as cuts)))"
    )
    over = "filter(runs, r -> r.s <= c and r.e >= cuts[i + 1])"
    pieces = f"transform(slice(cuts, 1, size(cuts) - 1), (c, i) -> struct(c as s0, cuts[i + 1] as e0, array_max({over}.top).mask_id as mask_id))"
    return listed.selectExpr("image_id", "col", f"inline(filter({pieces}, p -> p.mask_id is not null))")
