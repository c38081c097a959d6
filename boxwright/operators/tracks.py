"""Track analytics over (stream_id, track_id, frame_no, cx, cy, ...) rows; every per-track scan is blocked by frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.operators.scans import blocked_scan, rolling_history, running_changes, salted_top_k

KEYS = ("stream_id", "track_id")
FRAME_BLOCK = "frame_no div 1000000"
Points = Sequence[tuple[float, float]]


def with_previous(obs: DataFrame) -> DataFrame:
    """Previous point of the same track and the running observation number."""
    return blocked_scan(obs, KEYS, ["frame_no"], FRAME_BLOCK, lags={"px": "cx", "py": "cy"}, sums={"obs_no": "1L"})


def in_regions(obs: DataFrame, regions: Mapping[str, Points], edge: bool = False) -> DataFrame:
    """One row per (observation, region that holds its centre); regions are configuration, so this is a projection."""
    tests = ", ".join(f"if({G.in_polygon('cx', 'cy', pts, edge)}, '{name}', null)" for name, pts in regions.items())
    return obs.selectExpr("*", f"explode(filter(array({tests}), r -> r is not null)) as region")


def crossings(obs: DataFrame, region: Points) -> DataFrame:
    """First qualifying crossing of each track, IN or OUT along the region's dominant axis."""
    moved = with_previous(obs).where("px is not null")
    xs, ys = [p[0] for p in region], [p[1] for p in region]
    if len(region) == 2:
        ends = [(f"{x}D", f"{y}D") for x, y in region]
        test = G.segments_cross(("px", "py"), ("cx", "cy"), *ends)
        vertical = abs(xs[0] - xs[1]) < abs(ys[0] - ys[1])
    else:
        test = G.in_polygon("cx", "cy", region)
        vertical = max(xs) - min(xs) < max(ys) - min(ys)
    direction = f"if({'cx > px' if vertical else 'cy > py'}, 'IN', 'OUT')"
    hits = moved.where(test)
    return hits.groupBy(*KEYS).agg(F.expr(f"min_by(struct(frame_no, cls, {direction} as direction), frame_no) as c")).select(*KEYS, "c.*")


def speed_lock(obs: DataFrame, points: int = 5, fps: float = 30.0, metre_per_pixel: float = 0.05, top: float = 120) -> DataFrame:
    """Speed over the first ``points`` observations of a track, whole km/h, never updated."""
    numbered = blocked_scan(obs, KEYS, ["frame_no"], FRAME_BLOCK, sums={"obs_no": "1L"}).where(f"obs_no in (1, {points})")
    ends = numbered.groupBy(*KEYS).agg(
        F.expr("min_by(struct(cx, cy, frame_no), obs_no) as a"), F.expr("max_by(struct(cx, cy, frame_no), obs_no) as b"), F.expr("count(*) as n")
    ).where("n = 2 and b.frame_no > a.frame_no")
    metres = f"sqrt(pow(b.cx - a.cx, 2) + pow(b.cy - a.cy, 2)) * {metre_per_pixel}D"
    return ends.selectExpr(*KEYS, f"cast(least({metres} / ((b.frame_no - a.frame_no) / {fps}D) * 3.6D, {top}D) as int) as speed")


def joint_angle(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str]) -> str:
    """Angle at b in degrees, at most 180."""
    raw = f"abs((atan2({c[1]} - {b[1]}, {c[0]} - {b[0]}) - atan2({a[1]} - {b[1]}, {a[0]} - {b[0]})) * 180 / pi())"
    return f"if({raw} <= 180, {raw}, 360 - {raw})"


def repetitions(obs: DataFrame, angle: str = "angle", up: float = 145, down: float = 90) -> DataFrame:
    """Stage (carried over undecided frames) and running count of up-to-down changes."""
    stage = f"case when {angle} < {down} then 'down' when {angle} > {up} then 'up' end"
    return running_changes(obs, KEYS, ["frame_no"], FRAME_BLOCK, stage, "_p = 'up' and _v = 'down'", "reps", "stage")


def history(obs: DataFrame, n: int = 30) -> DataFrame:
    return rolling_history(obs, KEYS, ["frame_no"], FRAME_BLOCK, "struct(cx as x, cy as y)", n)


def clip_windows(obs: DataFrame, skip: int, samples: int) -> DataFrame:
    """Full windows of ``samples`` crops, one crop every ``skip`` frames."""
    kept = obs.where(f"pmod(frame_no, {skip}) = 0")
    return rolling_history(kept, KEYS, ["frame_no"], FRAME_BLOCK, "frame_no", samples, "frames").where(f"size(frames) = {samples}")


def frame_counts(obs: DataFrame) -> DataFrame:
    """Objects per class and frame, with the share of the frame's total."""
    per = obs.groupBy("stream_id", "frame", "cls").agg(F.expr("count(*) as n"))
    totals = per.groupBy("stream_id", "frame").agg(F.expr("sum(n) as total"))
    return per.join(totals, ["stream_id", "frame"]).selectExpr("*", "n / total * 100 as pct")


def chart_series(points: DataFrame, last: int = 45) -> DataFrame:
    """The last points of each (stream, class) series."""
    return salted_top_k(points, ["stream_id", "cls"], "frame desc", last, "pmod(frame, 64)")


def frame_totals(obs: DataFrame, every: int = 30) -> DataFrame:
    """Objects per sampled frame: the points of a line chart."""
    return obs.where(f"frame % {every} = 0").groupBy("stream_id", "frame").agg(F.expr("count(*) as total"))


def chart_grid(points: DataFrame, last: int = 45) -> DataFrame:
    """Every class of a stream at the stream's last frames, zero where a class was not seen (late classes start with zeros)."""
    frames = salted_top_k(points.select("stream_id", "frame").distinct(), ["stream_id"], "frame desc", last, "pmod(frame, 64)").drop("rank")
    grid = frames.join(points.select("stream_id", "cls").distinct(), "stream_id")
    return grid.join(points, ["stream_id", "cls", "frame"], "left").selectExpr("stream_id", "cls", "frame", "coalesce(n, 0L) as n")


def sticky_gauge(counts: DataFrame) -> DataFrame:
    """Region counts per frame (n may be 0) with the last non-zero value carried on."""
    return blocked_scan(counts, ["stream_id", "region"], ["frame"], "frame div 1000000", lasts={"sticky": "nullif(n, 0)"})


def heat_rows(obs: DataFrame, width: int, height: int) -> DataFrame:
    """Heat per pixel row span: each box adds 2 inside its inscribed disc.

    A disc row is one span, entered as +2 at its start and -2 past its end, so work grows with box height, not
    area; spans are summed before any shuffle.
    """
    box = obs.selectExpr(
        "stream_id", "cast(cx - w / 2 as int) as x0", "cast(cy - h / 2 as int) as y0", "cast(cx + w / 2 as int) as x1", "cast(cy + h / 2 as int) as y1"
    ).selectExpr("*", "least(x1 - x0, y1 - y0) div 2 as r", "cast(floor((x0 + x1) / 2) as int) as mx", "cast(floor((y0 + y1) / 2) as int) as my")
    rows = box.where("x1 > x0 and y1 > y0").selectExpr("*", f"explode(sequence(y0, y1 - 1)) as y").where(f"y >= 0 and y < {height} and abs(y - my) <= r")
    spans = rows.selectExpr("*", "cast(floor(sqrt(r * r - (y - my) * (y - my))) as int) as half").selectExpr(
        "stream_id", "y", "greatest(mx - half, x0, 0) as a", f"least(mx + half, x1 - 1, {width - 1}) as b"
    ).where("a <= b")
    edges = spans.selectExpr("stream_id", "y", "inline(array(struct(a as x, 2L as d), struct(b + 1 as x, -2L as d)))")
    summed = edges.groupBy("stream_id", "y", "x").agg(F.expr("sum(d) as d"))
    # One row of pixels per window: bounded by the image width.
    return summed.selectExpr("stream_id", "y", "x", "sum(d) over (partition by stream_id, y order by x) as heat", "lead(x) over (partition by stream_id, y order by x) - x as len").where("len > 0")


def first_alarm(obs: DataFrame, records: int = 5) -> DataFrame:
    """First frame of each stream with at least ``records`` objects."""
    totals = obs.groupBy("stream_id", "frame").agg(F.expr("count(*) as total")).where(f"total >= {records}")
    return totals.groupBy("stream_id").agg(F.expr("min(frame) as frame"), F.expr("min_by(total, frame) as total"))


def pair_distance(obs: DataFrame, first: str, second: str) -> DataFrame:
    """Distance of two selected tracks in the frames both appear in; centres are whole pixels."""
    centre = ("stream_id", "frame", "floor((cx - w / 2 + cx + w / 2) / 2) as x", "floor((cy - h / 2 + cy + h / 2) / 2) as y")
    a, b = (obs.where(t).selectExpr(*centre).groupBy("stream_id", "frame").agg(F.expr("max(struct(x, y)) as p")) for t in (first, second))
    return a.withColumnRenamed("p", "a").join(b.withColumnRenamed("p", "b"), ["stream_id", "frame"]).selectExpr(
        "stream_id", "frame", "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as distance"
    )


def sessions(obs: DataFrame, gap: int) -> DataFrame:
    """A track's visits: a new one starts after more than ``gap`` frames without it."""
    numbered = running_changes(obs, KEYS, ["frame_no"], FRAME_BLOCK, "frame_no", f"_p is null or _v - _p > {gap}", "visit", "_last_frame")
    return numbered.groupBy(*KEYS, "visit").agg(F.expr("min(frame_no) as first_frame"), F.expr("max(frame_no) as last_frame"), F.expr("count(*) as n"))


def in_region_table(obs: DataFrame, regions: DataFrame) -> DataFrame:
    """One row per (observation, region that holds its centre), regions being rows: stream_id, region, points, edge (whether the border counts).

    Streams join their own regions; the hull of a region is tested before its outline.
    """
    hulls = regions.selectExpr("stream_id as _s", "region", "points", "edge", *[f"array_{f}(points.{a}) as _{a}{i}" for a in "xy" for i, f in ((1, "min"), (2, "max"))])
    test = f"stream_id = _s and cx between _x1 and _x2 and cy between _y1 and _y2 and {G.in_polygon_column('cx', 'cy', 'points', 'edge')}"
    return obs.join(hulls, F.expr(test)).select(*obs.columns, "region")
