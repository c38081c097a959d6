"""Track analytics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.operators import tracks as T
from boxwright.plans.bridge import table, v_track
from boxwright.plans.registry import query

# Regions used by the queries: a polygon, a horizontal and a vertical line.
POLYGON = [(20, 40), (400, 60), (380, 360), (40, 300)]
SQUARES = {"left": [(0, 0), (320, 0), (320, 480), (0, 480)], "middle": [(160, 120), (480, 120), (480, 360), (160, 360)], "tri": POLYGON[:3]}
HORIZONTAL, VERTICAL = [(20, 240), (620, 240)], [(320, 0), (320, 400)]


def framed(spark: SparkSession, d: str) -> DataFrame:
    """Forty consecutive events share a frame."""
    return v_track(spark, d).selectExpr("*", "frame_no div 40 as frame")


def in_polygon_sql(points, edge: bool) -> str:
    n, flips, borders = len(points), [], []
    for i, (ax, ay) in enumerate(points):
        bx, by = points[(i + 1) % n]
        if ay != by:
            flips.append(f"CASE WHEN (({ay} > cy) <> ({by} > cy)) AND cx < ({bx} - {ax}) * (cy - {ay}) / ({by} - {ay}.0E0) + {ax} THEN 1 ELSE 0 END")
        borders.append(f"(({bx} - {ax}) * (cy - {ay}) - ({by} - {ay}) * (cx - {ax}) = 0 AND cx BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND cy BETWEEN {min(ay, by)} AND {max(ay, by)})")
    inside, on = f"(({' + '.join(flips)}) % 2 = 1)", f"({' OR '.join(borders)})"
    return f"({inside} OR {on})" if edge else f"({inside} AND NOT {on})"


def regions_sql(edge: bool) -> str:
    return " UNION ALL ".join(f"SELECT *, '{n}' AS region FROM f WHERE {in_polygon_sql(p, edge)}" for n, p in SQUARES.items())


_F = "f AS (SELECT *, frame_no // 40 AS frame FROM v_track)"
_P = "p AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py, row_number() OVER w AS obs_no FROM v_track WINDOW w AS (PARTITION BY stream_id, track_id ORDER BY frame_no))"


@query("jon_09_region_join", f"WITH {_F} SELECT frame_no, region FROM ({regions_sql(False)})")
def region_join(spark: SparkSession, d: str) -> DataFrame:
    return T.in_regions(framed(spark, d), SQUARES).select("frame_no", "region")


@query("jon_09_region_table", """
WITH r AS (SELECT n_nationkey AS k, n_nationkey % 4 AS stream_id, n_name AS region, 20 * n_nationkey AS x0, 10 * n_nationkey AS y0, n_nationkey % 2 = 0 AS edge FROM nation)
SELECT frame_no, region FROM v_track v JOIN r ON r.stream_id = v.stream_id
WHERE CASE WHEN edge THEN cx BETWEEN x0 AND x0 + 150 AND cy BETWEEN y0 AND y0 + 200 ELSE cx > x0 AND cx < x0 + 150 AND cy > y0 AND cy < y0 + 200 END""")
def region_table(spark: SparkSession, d: str) -> DataFrame:
    """Regions as rows of a table, some with their border, some without it."""
    corner = "struct({} as x, {} as y)"
    x, y = "20D * n_nationkey", "10D * n_nationkey"
    points = ", ".join(corner.format(f"{x} + {a}", f"{y} + {b}") for a, b in ((0, 0), (150, 0), (150, 200), (0, 200)))
    regions = table(spark, d, "nation").selectExpr("n_nationkey % 4 as stream_id", "n_name as region", f"array({points}) as points", "n_nationkey % 2 = 0 as edge")
    return T.in_region_table(v_track(spark, d), regions).select("frame_no", "region")


@query("jon_17_previous_position", f"WITH {_P} SELECT track_id, frame_no, px, py, obs_no FROM p")
def previous_position(spark: SparkSession, d: str) -> DataFrame:
    return T.with_previous(v_track(spark, d)).select("track_id", "frame_no", "px", "py", "obs_no")


_CROSS = "(px <> 320 OR cx <> 320) AND least(px, cx) <= 320 AND greatest(px, cx) >= 320 AND CASE WHEN px = cx THEN false ELSE py + (cy - py) * (320 - px) / (cx - px) BETWEEN 0 AND 400 END"


@query("jon_10_line_crossing", f"WITH {_P} SELECT track_id, frame_no FROM p WHERE px IS NOT NULL AND {_CROSS}")
def line_crossing(spark: SparkSession, d: str) -> DataFrame:
    """Movements that meet the vertical line (collinear movements, absent in this data, would count too)."""
    from boxwright.functions.geometry import segments_cross

    ends = [(f"{x}D", f"{y}D") for x, y in VERTICAL]
    moved = T.with_previous(v_track(spark, d)).where("px is not null")
    return moved.where(segments_cross(("px", "py"), ("cx", "cy"), *ends)).select("track_id", "frame_no")


@query("win_09_line_counter", f"""WITH {_P}, h AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_no) AS k FROM p WHERE px IS NOT NULL AND {_CROSS})
SELECT cls, CASE WHEN cx > px THEN 'IN' ELSE 'OUT' END AS direction, count(*) AS n FROM h WHERE k = 1 GROUP BY ALL""")
def line_counter(spark: SparkSession, d: str) -> DataFrame:
    """In and out per class over the vertical line; a track counts once."""
    return T.crossings(v_track(spark, d), VERTICAL).groupBy("cls", "direction").agg(F.expr("count(*) as n"))


@query("win_09_area_counter", f"""WITH {_P}, h AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_no) AS k FROM p WHERE px IS NOT NULL AND {in_polygon_sql(POLYGON, False)})
SELECT track_id, frame_no, CASE WHEN cy > py THEN 'IN' ELSE 'OUT' END AS direction FROM h WHERE k = 1""")
def area_counter(spark: SparkSession, d: str) -> DataFrame:
    return T.crossings(v_track(spark, d), POLYGON).select("track_id", "frame_no", "direction")


@query("win_08_track_history", """
WITH h AS (SELECT track_id, frame_no, list(cx) OVER (PARTITION BY stream_id, track_id ORDER BY frame_no ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS hx FROM v_track)
SELECT track_id, frame_no, CAST(len(hx) AS INT) AS n, hx[1] AS oldest, list_sum(hx) AS total FROM h""")
def track_history(spark: SparkSession, d: str) -> DataFrame:
    """Last thirty centres of each track."""
    return T.history(v_track(spark, d)).selectExpr(
        "track_id", "frame_no", "size(history) as n", "history[0].x as oldest", "aggregate(history, 0D, (s, p) -> s + p.x) as total"
    )


@query("win_10_speed_lock", f"""WITH {_P}, n AS (SELECT * FROM p WHERE obs_no IN (1, 5)),
e AS (SELECT track_id, arg_min(cx, obs_no) AS ax, arg_min(cy, obs_no) AS ay, min(frame_no) AS af, arg_max(cx, obs_no) AS ex, arg_max(cy, obs_no) AS ey, max(frame_no) AS bf FROM n GROUP BY track_id HAVING count(*) = 2)
SELECT track_id, CAST(trunc(least(sqrt((ex - ax) ** 2 + (ey - ay) ** 2) * 0.05E0 / ((bf - af) / 30.0E0) * 3.6E0, 120)) AS INT) AS speed FROM e""")
def speed_lock(spark: SparkSession, d: str) -> DataFrame:
    return T.speed_lock(v_track(spark, d)).select("track_id", "speed")


@query("win_11_repetition_counter", """
WITH a AS (SELECT track_id, frame_no, frame_no * 67 % 181 AS angle FROM v_track),
s AS (SELECT *, last_value(CASE WHEN angle < 90 THEN 'down' WHEN angle > 145 THEN 'up' END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame_no) AS stage FROM a),
t AS (SELECT *, lag(stage) OVER (PARTITION BY track_id ORDER BY frame_no) AS prev FROM s)
SELECT track_id, frame_no, stage, CAST(sum(CASE WHEN stage = 'down' AND prev = 'up' THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame_no) AS BIGINT) AS reps FROM t""")
def repetition_counter(spark: SparkSession, d: str) -> DataFrame:
    obs = v_track(spark, d).selectExpr("*", "frame_no * 67 % 181 as angle")
    return T.repetitions(obs).select("track_id", "frame_no", "stage", "reps")


@query("win_11_joint_angle", "SELECT track_id, frame_no, round(CASE WHEN a <= 180 THEN a ELSE 360 - a END, 6) AS angle FROM (SELECT *, abs((atan2(240 - cy, 320 - cx) - atan2(h - cy, w - cx)) * 180 / pi()) AS a FROM v_track WHERE NOT (cx = 320 AND cy = 240) AND NOT (cx = w AND cy = h))")
def joint_angle(spark: SparkSession, d: str) -> DataFrame:
    obs = v_track(spark, d).where("not (cx = 320 and cy = 240) and not (cx = w and cy = h)")
    angle = T.joint_angle(("w", "h"), ("cx", "cy"), ("320", "240"))
    return obs.selectExpr("track_id", "frame_no", f"round({angle}, 6) as angle")


@query("win_12_chart_series", f"""WITH {_F}, c AS (SELECT stream_id, cls, frame, count(*) AS n FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, cls ORDER BY frame DESC) AS k FROM c) SELECT stream_id, cls, frame, n FROM r WHERE k <= 45""")
def chart_series(spark: SparkSession, d: str) -> DataFrame:
    counts = framed(spark, d).groupBy("stream_id", "cls", "frame").agg(F.expr("count(*) as n"))
    return T.chart_series(counts).select("stream_id", "cls", "frame", "n")


@query("win_16_clip_windows", """
WITH k AS (SELECT track_id, frame_no, list(frame_no) OVER (PARTITION BY stream_id, track_id ORDER BY frame_no ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS fs FROM v_track WHERE frame_no % 2 = 0)
SELECT track_id, frame_no, fs[1] AS first_frame FROM k WHERE len(fs) = 8""")
def clip_windows(spark: SparkSession, d: str) -> DataFrame:
    return T.clip_windows(v_track(spark, d), 2, 8).selectExpr("track_id", "frame_no", "frames[0] as first_frame")


@query("agg_12_frame_counts", f"""WITH {_F}, c AS (SELECT stream_id, frame, cls, count(*) AS n FROM f GROUP BY ALL)
SELECT stream_id, frame, cls, n, round(n / sum(n) OVER (PARTITION BY stream_id, frame) * 100, 6) AS pct FROM c""")
def frame_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.frame_counts(framed(spark, d)).selectExpr("stream_id", "frame", "cls", "n", "round(pct, 6) as pct")


def region_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per frame and region, zero where a frame has objects but none inside."""
    obs = framed(spark, d)
    inside = T.in_regions(obs, SQUARES).groupBy("stream_id", "frame", "region").agg(F.expr("count(*) as n"))
    names = ", ".join(f"'{n}'" for n in SQUARES)
    frames = obs.select("stream_id", "frame").distinct().selectExpr("*", f"explode(array({names})) as region")
    return frames.join(inside, ["stream_id", "frame", "region"], "left").selectExpr("stream_id", "frame", "region", "coalesce(n, 0L) as n")


@query("agg_13_region_counts", f"""WITH {_F}, i AS (SELECT stream_id, frame, region, count(*) AS n FROM ({regions_sql(False)}) GROUP BY ALL),
a AS (SELECT DISTINCT stream_id, frame, r.region FROM f, (SELECT unnest(['left', 'middle', 'tri']) AS region) r),
c AS (SELECT a.*, coalesce(n, 0) AS n FROM a LEFT JOIN i USING (stream_id, frame, region))
SELECT stream_id, frame, region, n, last_value(nullif(n, 0) IGNORE NULLS) OVER (PARTITION BY stream_id, region ORDER BY frame) AS sticky FROM c""")
def sticky_counts(spark: SparkSession, d: str) -> DataFrame:
    """True gauge next to the value that keeps the last non-zero count."""
    return T.sticky_gauge(region_counts(spark, d)).select("stream_id", "frame", "region", "n", "sticky")


@query("agg_14_parking_occupancy", f"""WITH {_F}, o AS (SELECT stream_id, frame, count(DISTINCT region) AS occupied FROM ({regions_sql(True)}) GROUP BY ALL)
SELECT DISTINCT f.stream_id, f.frame, coalesce(occupied, 0) AS occupied, 3 - coalesce(occupied, 0) AS available FROM f LEFT JOIN o USING (stream_id, frame)""")
def parking_occupancy(spark: SparkSession, d: str) -> DataFrame:
    """Regions with at least one centre inside or on the edge."""
    obs = framed(spark, d)
    held = T.in_regions(obs, SQUARES, edge=True).groupBy("stream_id", "frame").agg(F.expr("count(distinct region) as occupied"))
    return obs.select("stream_id", "frame").distinct().join(held, ["stream_id", "frame"], "left").selectExpr(
        "stream_id", "frame", "coalesce(occupied, 0L) as occupied", f"{len(SQUARES)} - coalesce(occupied, 0L) as available"
    )


@query("agg_15_queue_length", f"WITH {_P} SELECT stream_id, frame_no // 40 AS frame, count(*) AS n FROM p WHERE px IS NOT NULL AND {in_polygon_sql(POLYGON, False)} GROUP BY ALL")
def queue_length(spark: SparkSession, d: str) -> DataFrame:
    seen = T.with_previous(v_track(spark, d)).where("px is not null").selectExpr("*", "frame_no div 40 as frame")
    return T.in_regions(seen, {"queue": POLYGON}).groupBy("stream_id", "frame").agg(F.expr("count(*) as n"))


@query("agg_16_heat_map", """
WITH b AS (SELECT stream_id, CAST(trunc(cx - w / 2) AS INT) AS x0, CAST(trunc(cy - h / 2) AS INT) AS y0, CAST(trunc(cx + w / 2) AS INT) AS x1, CAST(trunc(cy + h / 2) AS INT) AS y1 FROM v_track),
c AS (SELECT *, least(x1 - x0, y1 - y0) // 2 AS r, CAST(floor((x0 + x1) / 2) AS INT) AS mx, CAST(floor((y0 + y1) / 2) AS INT) AS my FROM b),
q AS (SELECT *, unnest(range(y0, y1)) AS y FROM c), p AS (SELECT *, unnest(range(x0, x1)) AS x FROM q WHERE y BETWEEN 0 AND 479),
h AS (SELECT stream_id, y, x, 2 * count(*) AS heat FROM p WHERE x BETWEEN 0 AND 639 AND (x - mx) ** 2 + (y - my) ** 2 <= r * r GROUP BY ALL)
SELECT stream_id, CAST(y AS INT) AS y, CAST(sum(heat) AS BIGINT) AS total, max(heat) AS peak, round(max(heat) * 255 / max(max(heat)) OVER (PARTITION BY stream_id), 6) AS scaled FROM h GROUP BY stream_id, y""")
def heat_map(spark: SparkSession, d: str) -> DataFrame:
    """Heat per pixel row: total, peak, and the peak on a 0-255 scale of the stream's maximum."""
    rows = T.heat_rows(v_track(spark, d), 640, 480).groupBy("stream_id", "y").agg(F.expr("sum(heat * len) as total"), F.expr("max(heat) as peak")).where("peak > 0")
    return rows.selectExpr("stream_id", "y", "total", "peak", "round(peak * 255 / max(peak) over (partition by stream_id), 6) as scaled")


@query("str_08_first_alarm", f"WITH {_F}, t AS (SELECT stream_id, frame, count(*) AS total FROM f GROUP BY ALL HAVING count(*) >= 14) SELECT stream_id, min(frame) AS frame, arg_min(total, frame) AS total FROM t GROUP BY stream_id")
def first_alarm(spark: SparkSession, d: str) -> DataFrame:
    return T.first_alarm(framed(spark, d), 14)


@query("str_09_zone_tracking", f"SELECT stream_id, frame_no, track_id FROM v_track WHERE {in_polygon_sql(POLYGON, True)}")
def zone_tracking(spark: SparkSession, d: str) -> DataFrame:
    """Observations whose centre lies in the zone, the input of zone-limited tracking."""
    return T.in_regions(v_track(spark, d), {"zone": POLYGON}, edge=True).select("stream_id", "frame_no", "track_id")


@query("str_09_zone_hull", f"SELECT stream_id, frame_no, track_id FROM v_track WHERE {in_polygon_sql(POLYGON, True)}")
def zone_hull(spark: SparkSession, d: str) -> DataFrame:
    """A zone drawn with a dent is its convex hull."""
    from boxwright.functions.geometry import convex_hull

    dented = [POLYGON[0], (200, 200), *POLYGON[1:]]
    return T.in_regions(v_track(spark, d), {"zone": convex_hull(dented)}, edge=True).select("stream_id", "frame_no", "track_id")


@query("str_10_pair_distance", f"""WITH {_F},
a AS (SELECT stream_id, frame, max({{'x': floor(cx), 'y': floor(cy)}}) AS p FROM f WHERE cls = 0 GROUP BY ALL), b AS (SELECT stream_id, frame, max({{'x': floor(cx), 'y': floor(cy)}}) AS p FROM f WHERE cls = 1 GROUP BY ALL)
SELECT stream_id, frame, round(sqrt((a.p.x - b.p.x) ** 2 + (a.p.y - b.p.y) ** 2), 6) AS distance FROM a JOIN b USING (stream_id, frame)""")
def pair_distance(spark: SparkSession, d: str) -> DataFrame:
    return T.pair_distance(framed(spark, d), "cls = 0", "cls = 1").selectExpr("stream_id", "frame", "round(distance, 6) as distance")


@query("str_11_vantage_lines", "SELECT track_id, frame_no, round(sqrt((cx - 320) ** 2 + (cy - 480) ** 2), 6) AS distance, round(atan2(cy - 480, cx - 320), 6) AS angle FROM v_track")
def vantage_lines(spark: SparkSession, d: str) -> DataFrame:
    """Distance and angle from one viewpoint to every object centre."""
    return v_track(spark, d).selectExpr(
        "track_id", "frame_no", "round(sqrt(pow(cx - 320, 2) + pow(cy - 480, 2)), 6) as distance", "round(atan2(cy - 480, cx - 320), 6) as angle"
    )


@query("str_12_redaction_manifest", "SELECT track_id, frame_no, CAST(greatest(trunc(cx - w / 2), 0) AS INT) AS x1, CAST(greatest(trunc(cy - h / 2), 0) AS INT) AS y1, CAST(least(trunc(cx + w / 2), 640) AS INT) AS x2, CAST(least(trunc(cy + h / 2), 480) AS INT) AS y2 FROM v_track WHERE cls IN (0, 2)")
def redaction_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Whole-pixel rectangles to blur for the listed classes."""
    return v_track(spark, d).where("cls in (0, 2)").selectExpr(
        "track_id", "frame_no", "greatest(cast(cx - w / 2 as int), 0) as x1", "greatest(cast(cy - h / 2 as int), 0) as y1",
        "least(cast(cx + w / 2 as int), 640) as x2", "least(cast(cy + h / 2 as int), 480) as y2",
    )


@query("str_12_redaction_masks", """
WITH b AS (SELECT track_id, frame_no, least(greatest(floor((cx - w / 2) / 8), 0), 80) AS a, least(greatest(floor((cx + w / 2) / 8), 0), 80) AS b, least(greatest(floor((cy - h / 2) / 8), 0), 60) AS c, least(greatest(floor((cy + h / 2) / 8), 0), 60) AS d FROM v_track WHERE cls IN (0, 2))
SELECT track_id, frame_no, CAST(b - a AS BIGINT) AS runs, CAST((b - a) * (d - c) AS BIGINT) AS pixels, CAST(a * 60 + c AS BIGINT) AS first FROM b WHERE a < b AND c < d""")
def redaction_masks(spark: SparkSession, d: str) -> DataFrame:
    """The same as mask runs on a coarse grid."""
    from boxwright.operators.masks import box_runs

    boxes = v_track(spark, d).where("cls in (0, 2)").selectExpr("track_id", "frame_no", "cx - w / 2 as x1", "cy - h / 2 as y1", "cx + w / 2 as x2", "cy + h / 2 as y2")
    runs = box_runs(boxes, "frame_no", 80, 60, 8)
    return runs.groupBy("track_id", "frame_no").agg(F.expr("count(*) as runs"), F.expr("sum(len) as pixels"), F.expr("min(start) as first"))


@query("str_14_track_sessions", """
WITH m AS (SELECT *, CASE WHEN frame_no - lag(frame_no) OVER w <= 100 THEN 0 ELSE 1 END AS s FROM v_track WINDOW w AS (PARTITION BY stream_id, track_id ORDER BY frame_no)),
v AS (SELECT *, sum(s) OVER (PARTITION BY stream_id, track_id ORDER BY frame_no) AS visit FROM m)
SELECT track_id, CAST(visit AS BIGINT) AS visit, min(frame_no) AS first_frame, max(frame_no) AS last_frame, count(*) AS n FROM v GROUP BY ALL""")
def track_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Visits of a track, split where it is lost for more than the buffer."""
    return T.sessions(v_track(spark, d), 100).select("track_id", "visit", "first_frame", "last_frame", "n")
