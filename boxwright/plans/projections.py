"""Projection, filter and set queries over the bridge views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.functions.text import clean_stream
from boxwright.operators import boxes as B
from boxwright.plans import sqltext as S
from boxwright.plans.bridge import table, v_det, v_gt, v_image
from boxwright.plans.registry import query


def rounded(*columns: str, digits: int = 6) -> list[str]:
    return [f"round({c}, {digits}) as {c}" for c in columns]


BOX = ("x1", "y1", "x2", "y2")


@query("prj_01_box_formats", """
SELECT image_id, det_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h,
       round((x1 + x2) / 2 / 640, 9) AS cxn, round((y1 + y2) / 2 / 480, 9) AS cyn, round((x2 - x1) / 640, 9) AS wn, round((y2 - y1) / 480, 9) AS hn,
       least(greatest(x1, 0), 640) AS x1, least(greatest(y1, 0), 480) AS y1, least(greatest(x2, 0), 640) AS x2, least(greatest(y2, 0), 480) AS y2
FROM v_det""")
def box_formats(spark: SparkSession, d: str) -> DataFrame:
    forms = B.clip(B.all_formats(v_det(spark, d), "640D", "480D"), "640D", "480D")
    return forms.selectExpr("image_id", "det_id", "cx", "cy", "w", "h", *rounded("cxn", "cyn", "wn", "hn", digits=9), *BOX)


V_ROT = """SELECT image_id, det_id, cls, conf, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h, (det_id % 157) / 100.0E0 AS r FROM v_det"""


def v_rot(spark: SparkSession, d: str) -> DataFrame:
    """Detections with an angle in [0, pi/2)."""
    return v_det(spark, d).selectExpr(
        "image_id", "det_id", "cls", "conf", "(x1 + x2) / 2 as cx", "(y1 + y2) / 2 as cy",
        "x2 - x1 as w", "y2 - y1 as h", "(det_id % 157) / 100D as r",
    )


@query("prj_01_rotated_boxes", f"""
WITH rot AS ({V_ROT})
SELECT image_id, det_id, round(cx + w / 2 * cos(r) - h / 2 * sin(r), 6) AS px1, round(cy + w / 2 * sin(r) + h / 2 * cos(r), 6) AS py1,
       round(cx + w / 2 * cos(r) + h / 2 * sin(r), 6) AS px2, round(cy + w / 2 * sin(r) - h / 2 * cos(r), 6) AS py2,
       round(greatest(w, h), 6) AS w, round(least(w, h), 6) AS h,
       round(CASE WHEN w > h THEN CASE WHEN r >= 0.75E0 * pi() THEN r - pi() ELSE r END
                  ELSE CASE WHEN r + pi() / 2 >= 0.75E0 * pi() THEN r - pi() / 2 ELSE r + pi() / 2 END END, 6) AS r
FROM rot WHERE w <> h""")
def rotated_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Rotated box to corners and back."""
    names = [f"p{a}{i}" for i in range(1, 5) for a in "xy"]
    corners = v_rot(spark, d).where("w <> h").selectExpr("image_id", "det_id", *[f"{e} as {n}" for e, n in zip(G.rotated_corners(), names)])
    back = B.from_corners(corners)
    return back.selectExpr("image_id", "det_id", *rounded("px1", "py1", "px2", "py2", "w", "h", "r"))


@query("prj_02_letterbox", """
WITH s AS (SELECT d.*, 500 + d.image_id % 700 AS w0, 300 + d.image_id % 500 AS h0 FROM v_det d),
g AS (SELECT *, least(640.0E0 / h0, 640.0E0 / w0) AS g FROM s),
p AS (SELECT *, round_even((640 - round_even(w0 * g, 0)) / 2 - 0.1E0, 0) AS px, round_even((640 - round_even(h0 * g, 0)) / 2 - 0.1E0, 0) AS py FROM g)
SELECT image_id, det_id, round(x1 * g + px, 8) AS fx1, round(y1 * g + py, 8) AS fy1,
       round(least(greatest((x1 - px) / g, 0), w0), 8) AS x1, round(least(greatest((y1 - py) / g, 0), h0), 8) AS y1,
       round(least(greatest((x2 - px) / g, 0), w0), 8) AS x2, round(least(greatest((y2 - py) / g, 0), h0), 8) AS y2,
       round(least(greatest((x1 - (640 - round_even(w0 * g, 0)) / 2) / g, 0), w0), 8) AS kx FROM p""")
def letterbox(spark: SparkSession, d: str) -> DataFrame:
    """Forward map, inverse map, and the keypoint inverse with its unrounded pad; sizes vary per image."""
    sized = v_det(spark, d).selectExpr("*", "500 + image_id % 700 as w0", "300 + image_id % 500 as h0")
    gain, px, py = G.letterbox("w0", "h0", 640.0, 640.0)
    kx, _ = B.point_unmap("kx", "y1", "w0", "h0", 640.0, 640.0)
    forward = sized.selectExpr("*", f"x1 * {gain} + {px} as fx1", f"y1 * {gain} + {py} as fy1", "x1 as kx")
    back = B.letterbox_unmap(forward, "w0", "h0", 640.0, 640.0)
    return back.selectExpr("image_id", "det_id", *rounded("fx1", "fy1", *BOX, digits=8), f"round({kx}, 8) as kx")


@query("prj_03_instance_transforms", """
WITH k AS (SELECT *, unnest([0, 1, 2]) AS k FROM v_det),
p AS (SELECT image_id, det_id, k, x1, x2, x1 + k * 70.5E0 - 20 AS kx, y1 + k * 40 AS ky, CASE WHEN (det_id + k) % 4 = 0 THEN 0.0 ELSE 2.0 END AS v FROM k)
SELECT image_id, det_id, k, 640 - least(greatest(x2, 0), 640) AS fx1, 640 - least(greatest(x1, 0), 640) AS fx2, 640 - least(greatest(kx, 0), 640) AS kx, least(greatest(ky, 0), 480) AS ky,
       CASE WHEN kx < 0 OR kx > 640 OR ky < 0 OR ky > 480 THEN 0.0 ELSE v END AS v FROM p""")
def instance_transforms(spark: SparkSession, d: str) -> DataFrame:
    """Clip then mirror boxes and keypoints; keypoints outside the frame lose visibility."""
    keyed = v_det(spark, d).selectExpr(
        "*", "transform(sequence(0, 2), k -> struct(x1 + k * 70.5D - 20 as x, y1 + k * 40 as y, if((det_id + k) % 4 = 0, 0D, 2D) as v)) as kpts"
    )
    clipped = B.replace_columns(B.clip(keyed, "640D", "480D"), kpts="""transform(kpts, p -> struct(least(greatest(p.x, 0D), 640D) as x,
        least(greatest(p.y, 0D), 480D) as y, if(p.x < 0 or p.x > 640 or p.y < 0 or p.y > 480, 0D, p.v) as v))""")
    flipped = B.replace_columns(clipped, x1="640D - x2", x2="640D - x1", kpts="transform(kpts, p -> struct(640D - p.x as x, p.y as y, p.v as v))")
    return flipped.selectExpr("image_id", "det_id", "x1 as fx1", "x2 as fx2", "posexplode(kpts) as (k, p)").selectExpr(
        "image_id", "det_id", "k", "fx1", "fx2", "p.x as kx", "p.y as ky", "p.v as v"
    )


@query("prj_04_candidate_boxes", """
WITH c AS (SELECT image_id, det_id, (x2 - x1) * (y2 - y1) AS a, x2 - x1 AS bw, greatest(0, least(640, x1 * 1.1E0)) AS x1, greatest(0, least(640, x2 * 1.1E0)) AS x2, greatest(0, least(480, y1 * 1.2E0)) AS y1, greatest(0, least(480, y2 * 1.2E0)) AS y2 FROM v_det)
SELECT image_id, det_id, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM c
WHERE x2 - x1 > 2 AND y2 - y1 > 2 AND (x2 - x1) * (y2 - y1) / (a + 1e-16) > 0.1E0 AND greatest((x2 - x1) / (y2 - y1 + 1e-16), (y2 - y1) / (x2 - x1 + 1e-16)) < 100""")
def candidate_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Scale, clip, and keep the boxes that remain useful."""
    grown = v_det(spark, d).selectExpr(
        "image_id", "det_id", *[f"{c} as o_{c}" for c in BOX],
        "x1 * 1.1D as x1", "y1 * 1.2D as y1", "x2 * 1.1D as x2", "y2 * 1.2D as y2",
    )
    return B.candidates(B.clip(grown, "640D", "480D")).selectExpr("image_id", "det_id", *rounded("x1", "x2"))


_SCORES = "list_transform(range(5), lambda k: ((det_id // 7 + k * 1237 + (k + 1) * (det_id % 1009)) % 1000) / 1000.0E0)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return v_det(spark, d).selectExpr(
        "image_id", "det_id",
        "transform(sequence(0, 4), k -> ((det_id div 7 + k * 1237 + (k + 1) * (det_id % 1009)) % 1000) / 1000D) as scores",
    )


@query("prj_05_best_class", f"""
WITH s AS (SELECT image_id, det_id, {_SCORES} AS s FROM v_det)
SELECT image_id, det_id, CAST(list_position(s, list_max(s)) - 1 AS INT) AS cls, list_max(s) AS conf FROM s WHERE list_max(s) > 0.9E0""")
def best_class(spark: SparkSession, d: str) -> DataFrame:
    return B.score_rows(scored(spark, d), "scores", 0.9, multi_label=False)


@query("prj_05_multi_label", f"""
WITH s AS (SELECT image_id, det_id, {_SCORES} AS s FROM v_det)
SELECT image_id, det_id, CAST(cls AS INT) AS cls, s[cls + 1] AS conf FROM s, (SELECT unnest(range(5)) AS cls) WHERE s[cls + 1] > 0.9E0""")
def multi_label(spark: SparkSession, d: str) -> DataFrame:
    return B.score_rows(scored(spark, d), "scores", 0.9, multi_label=True)


@query("prj_06_class_filter", "SELECT image_id, det_id, 0 AS cls FROM v_det WHERE cls IN (1, 3, 5)")
def class_filter(spark: SparkSession, d: str) -> DataFrame:
    return B.keep_classes(v_det(spark, d), [1, 3, 5], single=True).select("image_id", "det_id", "cls")


_FULL = "(ix * iy / ((x2 - x1) * (y2 - y1) + 307200 - ix * iy + 1e-7) > 0.9E0)"


@query("prj_09_border_snap", f"""
WITH big AS (SELECT image_id, det_id, CASE WHEN det_id % 11 = 0 THEN 15.0 ELSE x1 - 20 END AS x1, CASE WHEN det_id % 11 = 0 THEN 5.0 ELSE y1 - 10 END AS y1,
   CASE WHEN det_id % 11 = 0 THEN 600.0 + det_id % 40 ELSE x2 END AS x2, CASE WHEN det_id % 11 = 0 THEN 450.0 + det_id % 30 ELSE y2 END AS y2 FROM v_det),
s AS (SELECT image_id, det_id, CASE WHEN x1 < 20 THEN 0.0 ELSE x1 END AS x1, CASE WHEN y1 < 20 THEN 0.0 ELSE y1 END AS y1, CASE WHEN x2 > 620 THEN 640.0 ELSE x2 END AS x2, CASE WHEN y2 > 460 THEN 480.0 ELSE y2 END AS y2 FROM big),
f AS (SELECT *, greatest(least(x2, 640) - greatest(x1, 0), 0) AS ix, greatest(least(y2, 480) - greatest(y1, 0), 0) AS iy FROM s)
SELECT image_id, det_id, CASE WHEN {_FULL} THEN 0.0 ELSE x1 END AS x1, CASE WHEN {_FULL} THEN 0.0 ELSE y1 END AS y1,
       CASE WHEN {_FULL} THEN 640.0 ELSE x2 END AS x2, CASE WHEN {_FULL} THEN 480.0 ELSE y2 END AS y2 FROM f""")
def border_snap(spark: SparkSession, d: str) -> DataFrame:
    big = v_det(spark, d).selectExpr(
        "image_id", "det_id", "if(det_id % 11 = 0, 15D, x1 - 20) as x1", "if(det_id % 11 = 0, 5D, y1 - 10) as y1",
        "if(det_id % 11 = 0, 600D + det_id % 40, x2) as x2", "if(det_id % 11 = 0, 450D + det_id % 30, y2) as y2",
    )
    return B.border_snap(big, "640", "480")


@query("prj_10_tile_edge_filter", """
SELECT image_id, det_id, 320 * tx AS tile_x FROM v_det, (SELECT unnest([0, 1]) AS tx)
WHERE (x1 + x2) / 2 >= 320 * tx AND (x1 + x2) / 2 < 320 * tx + 320
  AND NOT ((abs(x1 - 320 * tx) <= 20 AND NOT abs(x1) <= 20) OR (abs(x2 - 320 * tx - 320) <= 20 AND NOT abs(x2 - 640) <= 20))""")
def tile_edge_filter(spark: SparkSession, d: str) -> DataFrame:
    """Two tiles side by side; boxes cut by the inner edge are dropped."""
    placed = v_det(spark, d).selectExpr(
        "*", "cast(floor((x1 + x2) / 640) as int) as tx", "0D as i_x1", "0D as i_y1", "640D as i_x2", "480D as i_y2"
    ).where("tx between 0 and 1").selectExpr(
        "*", "320 * tx as tile_x", "320D * tx as t_x1", "0D as t_y1", "320D * tx + 320 as t_x2", "480D as t_y2"
    )
    return placed.where(f"not {B.near_tile_edge()}").select("image_id", "det_id", "tile_x")


@query("prj_11_clean_names", r"""
WITH n AS (SELECT DISTINCT p_type || CASE WHEN p_size % 3 = 0 THEN '-' WHEN p_size % 3 = 1 THEN ' ' ELSE '_' END || p_brand AS name FROM part),
c AS (SELECT name, regexp_replace(name, '[^a-zA-Z0-9_]', '_', 'g') AS clean FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(clean) ORDER BY name) - 1 AS k FROM c)
SELECT name, CASE WHEN k = 0 THEN clean ELSE clean || '_' || k END AS clean, regexp_replace(name || '?&x', '[|@#!¡·$€%&()=?¿^*;:,¨´`><+]', '_', 'g') AS stream FROM r""")
def clean_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").selectExpr(
        "concat(p_type, case when p_size % 3 = 0 then '-' when p_size % 3 = 1 then ' ' else '_' end, p_brand) as name"
    ).distinct()
    stream = clean_stream("concat(name, '?&x')")
    return B.unique_clean_names(names, order="name").selectExpr("name", "clean", f"{stream} as stream")


_IMAGES = "SELECT image_id, array_to_string(list_sort(list_distinct(list(cls))), ',') AS labels, count(*) AS n FROM v_det GROUP BY image_id"


@query("prj_12_dataset_sql", f"WITH images AS ({_IMAGES}) SELECT image_id, labels, n FROM images WHERE labels LIKE '%3%' AND n > 30")
def dataset_sql(spark: SparkSession, d: str) -> DataFrame:
    """A user's WHERE clause over the image table."""
    images = v_det(spark, d).groupBy("image_id").agg(
        F.expr("array_join(array_sort(collect_set(cls)), ',') as labels"), F.expr("count(*) as n")
    )
    return sql_query(spark, images, "WHERE labels LIKE '%3%' AND n > 30").select("image_id", "labels", "n")


def sql_query(spark: SparkSession, images: DataFrame, text: str) -> DataFrame:
    """Run user SQL over a table named ``images``; a bare WHERE clause selects every column."""
    statement = f"SELECT * FROM images {text}" if text.strip().lower().startswith("where") else text
    images.createOrReplaceTempView("images")
    return spark.sql(statement)


# Set operations


@query("set_01_dataset_concat", "SELECT image_id, det_id AS ann_id, cls, conf FROM v_det UNION ALL SELECT image_id, gt_id, cls, NULL FROM v_gt")
def dataset_concat(spark: SparkSession, d: str) -> DataFrame:
    left = v_det(spark, d).selectExpr("image_id", "det_id as ann_id", "cls", "conf")
    return left.unionByName(v_gt(spark, d).selectExpr("image_id", "gt_id as ann_id", "cls"), allowMissingColumns=True)


_LISTS = """
a AS (SELECT track_id, min(frame_no) AS first_frame, max(frame_no) AS last_frame, 'tracked' AS src FROM v_track WHERE frame_no % 3 = 0 GROUP BY track_id),
b AS (SELECT track_id, min(frame_no) AS first_frame, max(frame_no) AS last_frame, 'lost' AS src FROM v_track WHERE frame_no % 11 = 1 GROUP BY track_id)"""


def track_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from boxwright.plans.bridge import v_track

    def part(test: str, src: str) -> DataFrame:
        return v_track(spark, d).where(test).groupBy("track_id").agg(
            F.expr("min(frame_no) as first_frame"), F.expr("max(frame_no) as last_frame"), F.expr(f"'{src}' as src")
        )

    return part("frame_no % 3 = 0", "tracked"), part("frame_no % 11 = 1", "lost")


@query("set_02_track_union_difference", f"""WITH {_LISTS}
SELECT 'union' AS op, track_id, src FROM a UNION ALL SELECT 'union', track_id, src FROM b ANTI JOIN a USING (track_id)
UNION ALL SELECT 'difference', track_id, src FROM a ANTI JOIN b USING (track_id)""")
def track_union_difference(spark: SparkSession, d: str) -> DataFrame:
    """Union keeps the first list's entry per id; difference removes ids of the second list."""
    a, b = track_lists(spark, d)
    union = a.unionByName(b.join(a.select("track_id"), "track_id", "left_anti"))
    minus = a.join(b.select("track_id"), "track_id", "left_anti")
    return union.selectExpr("'union' as op", "track_id", "src").unionByName(minus.selectExpr("'difference' as op", "track_id", "src"))


@query("set_03_duplicate_tracks", f"""
WITH t AS (SELECT image_id, det_id, x1, y1, x2, y2, det_id % 50 AS age, det_id % 2 AS lost FROM v_det),
p AS (SELECT a.image_id, a.det_id AS a_id, b.det_id AS b_id, a.age > b.age AS keep_a FROM t a JOIN t b ON a.image_id = b.image_id AND a.lost = 0 AND b.lost = 1 WHERE {S.iou("a.", "b.")} > 0.85E0)
SELECT image_id, det_id FROM t WHERE (image_id, det_id) NOT IN (SELECT image_id, CASE WHEN keep_a THEN b_id ELSE a_id END FROM p)""")
def duplicate_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Tracked and lost entries that nearly coincide: the longer-lived stays, a tie drops the tracked one.

    Exact copies collapse first: against tracked boxes only the oldest lost copy matters, and the other way round.
    """
    from boxwright.operators.overlap import iou_join

    t = v_det(spark, d).selectExpr("image_id", "det_id", *BOX, "det_id % 50 as age", "det_id % 2 as lost")
    tracked, lost = t.where("lost = 0"), t.where("lost = 1")
    oldest = lambda df: df.groupBy("image_id", *BOX).agg(F.expr("max(age) as age"))
    kept_a = iou_join(tracked, oldest(lost), ["image_id"], 0.85, "left_anti", strict=True, extra="age <= r_age")
    kept_b = iou_join(lost, oldest(tracked), ["image_id"], 0.85, "left_anti", strict=True, extra="r_age > age")
    return kept_a.select("image_id", "det_id").unionByName(kept_b.select("image_id", "det_id"))


@query("set_04_orphan_files", """
SELECT 'images/' || image_id || '.jpg' AS path FROM v_image WHERE image_id % 4 <> 0 EXCEPT ALL SELECT DISTINCT 'images/' || image_id || '.jpg' FROM v_det WHERE image_id % 3 <> 0""")
def orphan_files(spark: SparkSession, d: str) -> DataFrame:
    """Files present but not expected."""
    path = "concat('images/', image_id, '.jpg') as path"
    present = v_image(spark, d).where("image_id % 4 <> 0").selectExpr(path)
    return present.exceptAll(v_det(spark, d).where("image_id % 3 <> 0").selectExpr(path).distinct())
