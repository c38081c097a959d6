"""Suppression, spatial joins, tiles, masks and search queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.operators import masks as K
from boxwright.operators import nms as N
from boxwright.operators import search as Q
from boxwright.operators import tiles as T
from boxwright.operators.assignment import best_pairs
from boxwright.operators.keypoints import oks_join
from boxwright.operators.overlap import iou_join
from boxwright.operators.scans import ordered_map, salted_top_k
from boxwright.plans import sqltext as S
from boxwright.plans.bridge import table, v_det, v_gt, v_image
from boxwright.plans.projections import V_ROT, v_rot
from boxwright.plans.registry import query


def _greedy_sql(group: str, thr: float, source: str = "v_det") -> str:
    on = " AND ".join(f"s.{c.strip()} = r.{c.strip()}" for c in group.split(","))
    keys = ", ".join(f"s.{c.strip()}" for c in group.split(","))
    i = "(greatest(least(s.x2, k.x2) - greatest(s.x1, k.x1), 0) * greatest(least(s.y2, k.y2) - greatest(s.y1, k.y1), 0))"
    return f"""
s AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY conf DESC, det_id) AS n FROM {source}),
r AS (SELECT {keys}, n, [{{'det_id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM s WHERE n = 1
  UNION ALL SELECT {keys}, s.n, CASE WHEN len(list_filter(r.kept, lambda k: {i} / ((s.x2 - s.x1) * (s.y2 - s.y1) + (k.x2 - k.x1) * (k.y2 - k.y1) - {i}) > {thr}E0)) = 0
     THEN list_append(r.kept, {{'det_id': s.det_id, 'x1': s.x1, 'y1': s.y1, 'x2': s.x2, 'y2': s.y2}}) ELSE r.kept END FROM r JOIN s ON {on} AND s.n = r.n + 1),
kept AS (SELECT image_id, unnest(list_transform(arg_max(kept, n), lambda k: k.det_id)) AS det_id FROM r GROUP BY {group})"""


@query("win_01_greedy_nms", f"WITH {_greedy_sql('image_id, cls', 0.3)} SELECT image_id, det_id FROM kept")
def greedy_nms(spark: SparkSession, d: str) -> DataFrame:
    return N.greedy_nms(v_det(spark, d), 0.3).select("image_id", "det_id")


@query("win_01_greedy_nms_agnostic", f"WITH {_greedy_sql('image_id', 0.45)} SELECT image_id, det_id FROM kept")
def greedy_nms_agnostic(spark: SparkSession, d: str) -> DataFrame:
    return N.greedy_nms(v_det(spark, d), 0.45, keys=("image_id",)).select("image_id", "det_id")


_FAST = f"""
SELECT image_id, det_id FROM v_det a WHERE NOT EXISTS (SELECT 1 FROM v_det b WHERE b.image_id = a.image_id AND b.cls = a.cls AND b.det_id < a.det_id AND {S.iou("a.", "b.")} >= 0.3E0)"""


@query("win_02_fast_nms", _FAST)
def fast_nms(spark: SparkSession, d: str) -> DataFrame:
    return N.fast_nms(v_det(spark, d), 0.3).select("image_id", "det_id")


def _probiou_sql(a: str, b: str) -> str:
    sa, sb, sc = (f"({a}{v} + {b}{v})" for v in ("va", "vb", "vc"))
    det = f"({sa} * {sb} - {sc} * {sc})"
    d1, d2 = (f"greatest({p}va * {p}vb - {p}vc * {p}vc, 0)" for p in (a, b))
    return f"""(1 - sqrt(1 - exp(-least(greatest(({sa} * ({a}cy - {b}cy) ** 2 + {sb} * ({a}cx - {b}cx) ** 2) / ({det} + 1e-7) * 0.25E0
      + {sc} * ({b}cx - {a}cx) * ({a}cy - {b}cy) / ({det} + 1e-7) * 0.5E0 + ln({det} / (4 * sqrt({d1} * {d2}) + 1e-7) + 1e-7) * 0.5E0, 1e-7), 100)) + 1e-7))"""


_COV = f"""rot AS ({V_ROT}),
g AS (SELECT *, w * w / 12 * cos(r) ** 2 + h * h / 12 * sin(r) ** 2 AS va, w * w / 12 * sin(r) ** 2 + h * h / 12 * cos(r) ** 2 AS vb, (w * w / 12 - h * h / 12) * cos(r) * sin(r) AS vc FROM rot)"""


@query("jon_03_rotated_overlap", f"WITH {_COV} SELECT a.image_id, a.det_id, b.det_id AS other, round({_probiou_sql('a.', 'b.')}, 6) AS sim FROM g a JOIN g b ON a.image_id = b.image_id AND a.cls = b.cls AND b.det_id < a.det_id WHERE {_probiou_sql('a.', 'b.')} >= 0.5E0")
def rotated_overlap(spark: SparkSession, d: str) -> DataFrame:
    rot = v_rot(spark, d)
    pairs = N.rotated_join(rot, rot, ["image_id", "cls"], 0.5, extra="r_det_id < det_id")
    return pairs.selectExpr("image_id", "det_id", "r_det_id as other", "round(iou, 6) as sim")


@query("win_03_rotated_nms", f"WITH {_COV} SELECT image_id, det_id FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE a.image_id = b.image_id AND a.cls = b.cls AND b.det_id < a.det_id AND {_probiou_sql('a.', 'b.')} >= 0.3E0)")
def rotated_nms(spark: SparkSession, d: str) -> DataFrame:
    return N.rotated_nms(v_rot(spark, d), 0.3).select("image_id", "det_id")


_TILED = _COV.replace("SELECT image_id, det_id, cls", "SELECT image_id // 4 AS image_id, det_id, cls").replace("(x1 + x2) / 2 AS cx", "(x1 + x2) / 2 + (image_id % 4) * 100 AS cx")


@query("win_04_tile_merge", f"WITH {_TILED} SELECT 'scene' || image_id AS scene, det_id FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE a.image_id = b.image_id AND a.cls = b.cls AND b.det_id < a.det_id AND {_probiou_sql('a.', 'b.')} >= 0.3E0)")
def tile_merge(spark: SparkSession, d: str) -> DataFrame:
    """Four neighbouring tiles of a scene, merged in scene coordinates."""
    det = v_rot(spark, d).selectExpr(
        "det_id", "cls", "conf", "cx", "cy", "w", "h", "r", "concat('scene', image_id div 4, '__640__', (image_id % 4) * 100, '___0') as tile_name"
    )
    return T.merge_tiles(det).selectExpr("image_id as scene", "det_id")


_TILES = """
dims AS (SELECT image_id, 600 + image_id * 37 % 900 AS width, 500 + image_id * 91 % 800 AS height FROM v_image),
xs AS (SELECT image_id, CASE WHEN i > 0 AND i * 412 + 512 > width THEN width - 512 ELSE i * 412 END AS tx1 FROM dims, (SELECT unnest(range(6)) AS i) WHERE i < CASE WHEN width <= 512 THEN 1 ELSE ceil((width - 512) / 412 + 1) END),
ys AS (SELECT image_id, CASE WHEN i > 0 AND i * 412 + 512 > height THEN height - 512 ELSE i * 412 END AS ty1 FROM dims, (SELECT unnest(range(6)) AS i) WHERE i < CASE WHEN height <= 512 THEN 1 ELSE ceil((height - 512) / 412 + 1) END),
tiles AS (SELECT image_id, tx1, ty1, tx1 + 512 AS tx2, ty1 + 512 AS ty2, (least(tx1 + 512, width) - tx1) * (least(ty1 + 512, height) - ty1) / (512.0E0 * 512) AS rate FROM dims JOIN xs USING (image_id) JOIN ys USING (image_id)),
plan AS (SELECT * FROM (SELECT *, max(rate) OVER (PARTITION BY image_id) AS m FROM tiles) WHERE rate > 0.6E0 OR (m <= 0.6E0 AND abs(rate - m) < 0.01E0))"""


def dims(spark: SparkSession, d: str) -> DataFrame:
    return v_image(spark, d).selectExpr("image_id", "600 + image_id * 37 % 900 as width", "500 + image_id * 91 % 800 as height")


@query("top_06_tile_plan", f"WITH {_TILES} SELECT image_id, CAST(tx1 AS BIGINT) AS tx1, CAST(ty1 AS BIGINT) AS ty1, round(rate, 6) AS rate FROM plan")
def tile_plan(spark: SparkSession, d: str) -> DataFrame:
    return T.tile_plan(dims(spark, d), [512], [100]).selectExpr("image_id", "tx1", "ty1", "round(rate, 6) as rate")


@query("top_06_tile_plan_scales", """
WITH dims AS (SELECT image_id, 600 + image_id * 37 % 900 AS width, 500 + image_id * 91 % 800 AS height FROM v_image),
p(size, gap) AS (VALUES (512, 100), (256, 50), (1024, 200), (512, 100)),
xs AS (SELECT image_id, n, size, CASE WHEN i > 0 AND i * (size - gap) + size > width THEN width - size ELSE i * (size - gap) END AS tx1 FROM dims, (SELECT *, row_number() OVER () AS n FROM p), (SELECT unnest(range(10)) AS i)
  WHERE i < CASE WHEN width <= size THEN 1 ELSE ceil((width - size) / (size - gap) + 1) END),
ys AS (SELECT image_id, n, CASE WHEN i > 0 AND i * (size - gap) + size > height THEN height - size ELSE i * (size - gap) END AS ty1 FROM dims, (SELECT *, row_number() OVER () AS n FROM p), (SELECT unnest(range(10)) AS i)
  WHERE i < CASE WHEN height <= size THEN 1 ELSE ceil((height - size) / (size - gap) + 1) END),
t AS (SELECT image_id, tx1, ty1, tx1 + size AS tx2, (least(tx1 + size, width) - tx1) * (least(ty1 + size, height) - ty1) / (size * size * 1.0E0) AS rate FROM dims JOIN xs USING (image_id) JOIN ys USING (image_id, n)),
m AS (SELECT *, max(rate) OVER (PARTITION BY image_id) AS m FROM t)
SELECT image_id, CAST(tx1 AS BIGINT) AS tx1, CAST(ty1 AS BIGINT) AS ty1, CAST(tx2 AS BIGINT) AS tx2, round(rate, 6) AS rate FROM m WHERE rate > 0.6E0 OR (m <= 0.6E0 AND abs(rate - m) < 0.01E0)""")
def tile_plan_scales(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of two crop sizes at two rates."""
    return T.tile_plan(dims(spark, d), [512, 256], [100, 50], [1.0, 0.5]).selectExpr("image_id", "tx1", "ty1", "tx2", "round(rate, 6) as rate")


@query("jon_11_tile_objects", f"""WITH {_TILES}
SELECT g.image_id, gt_id, CAST(tx1 AS BIGINT) AS tx1, CAST(ty1 AS BIGINT) AS ty1, round({S.inter("g.", "t.t")} / {S.box_area("g.")}, 6) AS share
FROM v_gt g JOIN plan t ON g.image_id = t.image_id WHERE {S.inter("g.", "t.t")} / {S.box_area("g.")} >= 0.7E0""")
def tile_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects (as polygons) of each tile, by exact clip."""
    polygons = v_gt(spark, d).selectExpr(
        "image_id", "gt_id", "array(struct(x1 as x, y1 as y), struct(x2 as x, y1 as y), struct(x2 as x, y2 as y), struct(x1 as x, y2 as y)) as polygon"
    )
    plan = T.tile_plan(dims(spark, d), [512], [100]).drop("width", "height")
    return T.tiles_with_objects(plan, polygons).selectExpr("image_id", "gt_id", "tx1", "ty1", "round(share, 6) as share")


@query("top_07_pyramid_plan", """
WITH d AS (SELECT image_id, 600 + image_id * 37 % 900 AS width, 500 + image_id * 91 % 800 AS height FROM v_image),
l AS (SELECT *, k AS layer, CAST(2 ** k AS BIGINT) AS n FROM d, (SELECT unnest([1, 2]) AS k)),
o AS (SELECT *, CAST(floor(0.25E0 * least(width, height) * (2 / n)) AS BIGINT) AS lap FROM l),
c AS (SELECT *, CAST(ceil((lap * (n - 1) + width) / n) AS BIGINT) AS cw, CAST(ceil((lap * (n - 1) + height) / n) AS BIGINT) AS ch FROM o)
SELECT image_id, CAST(layer AS INT) AS layer, (cw - lap) * i AS cx1, (ch - lap) * j AS cy1, least((cw - lap) * i + cw, width) AS cx2, least((ch - lap) * j + ch, height) AS cy2
FROM c, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j) WHERE i < n AND j < n UNION ALL SELECT image_id, 0, 0, 0, width, height FROM d""")
def pyramid_plan(spark: SparkSession, d: str) -> DataFrame:
    return T.pyramid_plan(dims(spark, d), 2, 0.25).drop("width", "height")


_SLICED = "sl AS (SELECT image_id // 4 AS image_id, det_id, cls, conf, x1 + (image_id % 4) * 100 AS x1, y1, x2 + (image_id % 4) * 100 AS x2, y2 FROM v_det)"


@query("top_08_sliced_merge", f"WITH {_SLICED}, {_greedy_sql('image_id, cls', 0.45, 'sl')} SELECT image_id, det_id FROM kept")
def sliced_merge(spark: SparkSession, d: str) -> DataFrame:
    """Slice detections shifted to the scene, then greedy suppression there."""
    scene = v_det(spark, d).selectExpr(
        "image_id div 4 as image_id", "det_id", "cls", "conf", "x1 + (image_id % 4) * 100 as x1", "y1", "x2 + (image_id % 4) * 100 as x2", "y2"
    )
    return N.greedy_nms(scene, 0.45).select("image_id", "det_id")


_PRIOR = "pr AS (SELECT image_id, det_id, cls, conf, x1, y1, x2, y2 FROM v_det UNION ALL SELECT image_id, -gt_id - 1, cls, 1.0E0, x1, y1, x2, y2 FROM v_gt)"


@query("set_05_prior_labels", f"WITH {_PRIOR}, {_greedy_sql('image_id, cls', 0.5, 'pr')} SELECT image_id, det_id FROM kept")
def prior_labels(spark: SparkSession, d: str) -> DataFrame:
    """Known labels enter suppression as certain candidates."""
    det = v_det(spark, d).select("image_id", "det_id", "cls", "conf", "x1", "y1", "x2", "y2")
    prior = v_gt(spark, d).selectExpr("image_id", "-gt_id - 1 as det_id", "cls", "1D as conf", "x1", "y1", "x2", "y2")
    return N.greedy_nms(det.unionByName(prior), 0.5).select("image_id", "det_id")


_GRID = "least(greatest(floor({c} / 8), 0), {m})"


def _mask_sql(t: str, i: str) -> str:
    a, b = _GRID.format(c="x1", m=80), _GRID.format(c="x2", m=80)
    c, d = _GRID.format(c="y1", m=60), _GRID.format(c="y2", m=60)
    return f"(SELECT image_id, cls, {i}, {a} AS x1, {b} AS x2, {c} AS y1, {d} AS y2 FROM {t} WHERE {a} < {b} AND {c} < {d})"


@query("jon_04_mask_overlap", f"""
SELECT d.image_id, d.det_id, g.gt_id, CAST({S.inter("d.", "g.")} AS BIGINT) AS inter, round({S.iou("d.", "g.")}, 6) AS iou
FROM {_mask_sql("v_det", "det_id")} d JOIN {_mask_sql("v_gt", "gt_id")} g ON d.image_id = g.image_id AND d.cls = g.cls WHERE {S.inter("d.", "g.")} > 0""")
def mask_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Filled boxes on an 80x60 mask grid, compared run by run."""
    left = K.box_masks(v_det(spark, d).drop("conf"), "det_id", 80, 60, 8)
    right = K.box_masks(v_gt(spark, d), "gt_id", 80, 60, 8)
    out = K.packed_iou(left, right, ["image_id", "cls"], "det_id", "gt_id", 60)
    return out.selectExpr("image_id", "det_id", "gt_id", "inter", "round(iou, 6) as iou")


@query("agg_27_mask_boxes", f"""
SELECT image_id, det_id, CAST(x1 AS BIGINT) AS "left", CAST(y1 AS BIGINT) AS top, CAST(x2 - 1 AS BIGINT) AS "right", CAST(y2 - 1 AS BIGINT) AS bottom FROM {_mask_sql("v_det", "det_id")}""")
def mask_boxes(spark: SparkSession, d: str) -> DataFrame:
    return K.mask_boxes(K.box_runs(v_det(spark, d).drop("conf"), "det_id", 80, 60, 8), ["image_id", "det_id"], 60)


@query("agg_27_stability_score", "SELECT vec_id, round(len(list_filter(embedding, lambda v: v > 0.05)) / len(list_filter(embedding, lambda v: v > -0.05)), 6) AS stability FROM embeddings")
def stability_score(spark: SparkSession, d: str) -> DataFrame:
    """Pixels above the high threshold over pixels above the low one (vector values as mask scores)."""
    return table(spark, d, "embeddings").selectExpr(
        "vec_id", "round(size(filter(embedding, v -> v > 0.05D)) / size(filter(embedding, v -> v > -0.05D)), 6) as stability"
    )


_SIGMAS = [0.05, 0.07, 0.1]


@query("jon_05_keypoint_similarity", f"""
WITH dk AS (SELECT image_id, cls, det_id, k, x1 + k * 20 AS x, y1 + k * 15 AS y FROM v_det, (SELECT unnest([0, 1, 2]) AS k)),
gk AS (SELECT image_id, cls, gt_id, k, x1 + k * 20 AS x, y1 + k * 15 AS y, CASE WHEN (gt_id + k) % 4 = 0 THEN 0 ELSE 2 END AS v, {S.box_area("")} * 0.53E0 AS area FROM v_gt, (SELECT unnest([0, 1, 2]) AS k)),
p AS (SELECT d.image_id, d.det_id, g.gt_id, sum(CASE WHEN v <> 0 THEN exp(-((d.x - g.x) ** 2 + (d.y - g.y) ** 2) / ((2 * ([0.05E0, 0.07E0, 0.1E0])[d.k + 1]) ** 2 * (area + 1e-7) * 2)) ELSE 0 END) / (count(*) FILTER (v <> 0) + 1e-7) AS oks
  FROM dk d JOIN gk g ON d.image_id = g.image_id AND d.cls = g.cls AND d.k = g.k GROUP BY ALL)
SELECT image_id, det_id, gt_id, round(oks, 6) AS oks FROM p WHERE oks >= 0.5E0""")
def keypoint_similarity(spark: SparkSession, d: str) -> DataFrame:
    pts = "transform(sequence(0, 2), k -> struct(x1 + k * 20 as x, y1 + k * 15 as y, {v} as v)) as kpts"
    det = v_det(spark, d).selectExpr("image_id", "cls", "det_id", pts.format(v="2"))
    gt = v_gt(spark, d).selectExpr("image_id", "cls", "gt_id", pts.format(v="if((gt_id + k) % 4 = 0, 0, 2)"), "(x2 - x1) * (y2 - y1) * 0.53D as area")
    return oks_join(det, gt, ["image_id", "cls"], _SIGMAS, 0.5).selectExpr("image_id", "det_id", "r_gt_id as gt_id", "round(oks, 6) as oks")


def assigned(spark: SparkSession, d: str) -> DataFrame:
    pairs = iou_join(v_det(spark, d), v_gt(spark, d), ["image_id", "cls"], 0.5)
    return best_pairs(pairs.selectExpr("image_id", "cls", "det_id as u", "r_gt_id as v", "iou as score"), ["image_id", "cls"])


@query("jon_08_optimal_assignment")
def optimal_assignment(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one pairs with the largest total overlap per image and class."""
    return assigned(spark, d).selectExpr("image_id", "u as det_id", "v as gt_id", "score as iou")


@query("jon_08_assignment_total", f"""
WITH pairs AS MATERIALIZED (SELECT d.image_id, d.cls, d.det_id, g.gt_id, {S.iou("d.", "g.")} AS s FROM v_det d JOIN v_gt g ON d.image_id = g.image_id AND d.cls = g.cls WHERE {S.iou("d.", "g.")} >= 0.5E0),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY det_id) AS n FROM (SELECT image_id, cls, det_id, list({{'g': gt_id, 's': s}}) AS c FROM pairs GROUP BY image_id, cls, det_id)),
r(image_id, cls, n, used, total) AS (SELECT DISTINCT image_id, cls, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), 0E0 FROM o
  UNION ALL SELECT r.image_id, r.cls, o.n, CASE WHEN x.g IS NULL THEN used ELSE list_append(used, x.g) END, total + coalesce(x.s, 0)
    FROM r JOIN o ON o.image_id = r.image_id AND o.cls = r.cls AND o.n = r.n + 1, unnest(list_append(o.c, NULL)) t(x) WHERE x.g IS NULL OR NOT list_contains(used, x.g))
SELECT image_id, cls, round(max(total), 6) AS total FROM r GROUP BY image_id, cls""")
def assignment_total(spark: SparkSession, d: str) -> DataFrame:
    """The largest total overlap of one-to-one pairs; chosen pairs themselves may tie."""
    return assigned(spark, d).groupBy("image_id", "cls").agg(F.expr("round(sum(score), 6) as total"))


@query("jon_13_prompt_selection", f"""
WITH p AS (SELECT image_id, 100.0 + image_id % 300 AS px1, 80.0 + image_id % 200 AS py1, 220.0 + image_id % 300 AS px2, 180.0 + image_id % 200 AS py2 FROM v_image),
b AS (SELECT d.image_id, d.det_id, i / (a + {S.box_area("d.")} - i) AS s, ax, inb FROM (SELECT d.*, {S.inter("d.", "p.p")} AS i, (px2 - px1) * (py2 - py1) AS a, px1 AS ax,
    px1 >= x1 AND px1 < x2 AND py1 >= y1 AND py1 < y2 AS inb FROM v_det d JOIN p USING (image_id)) d),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, det_id) AS k FROM b)
SELECT image_id, det_id, k = 1 AS by_box, inb AS by_point FROM r WHERE k = 1 OR inb""")
def prompt_selection(spark: SparkSession, d: str) -> DataFrame:
    """Box prompt: the object with the largest overlap share; point prompt: every object under the point."""
    from boxwright.operators.prompts import box_prompt, point_prompts

    det = v_det(spark, d)
    prompts = v_image(spark, d).selectExpr(
        "image_id", "100D + image_id % 300 as p_x1", "80D + image_id % 200 as p_y1", "220D + image_id % 300 as p_x2", "180D + image_id % 200 as p_y2"
    )
    boxed = box_prompt(det, prompts)
    pointed = point_prompts(det, prompts.selectExpr("image_id", "array(struct(p_x1 as x, p_y1 as y, 1 as label)) as points"))
    both = boxed.selectExpr("image_id", "det_id", "true as by_box", "false as by_point").unionByName(
        pointed.selectExpr("image_id", "det_id", "false as by_box", "true as by_point")
    )
    return both.groupBy("image_id", "det_id").agg(F.expr("bool_or(by_box) as by_box"), F.expr("bool_or(by_point) as by_point"))


@query("jon_13_ordered_points", """
WITH p AS (SELECT image_id, 100.0 + image_id % 300 AS ax, 80.0 + image_id % 200 AS ay, 160.0 + image_id % 300 AS qx, 120.0 + image_id % 200 AS qy, CASE WHEN image_id % 3 = 0 THEN 0 ELSE 1 END AS la FROM v_image),
h AS (SELECT d.image_id, d.det_id, la, ax >= x1 AND ax < x2 AND ay >= y1 AND ay < y2 AS ha, qx >= x1 AND qx < x2 AND qy >= y1 AND qy < y2 AS hb FROM v_det d JOIN p USING (image_id))
SELECT image_id, det_id FROM h WHERE CASE WHEN hb THEN false WHEN ha THEN la = 1 ELSE la = 0 END""")
def ordered_points(spark: SparkSession, d: str) -> DataFrame:
    """A point and a negative point behind it; where both are negative, all objects start selected."""
    from boxwright.operators.prompts import point_prompts

    first = "struct(100D + image_id % 300 as x, 80D + image_id % 200 as y, if(image_id % 3 = 0, 0, 1) as label)"
    second = "struct(160D + image_id % 300 as x, 120D + image_id % 200 as y, 0 as label)"
    return point_prompts(v_det(spark, d), v_image(spark, d).selectExpr("image_id", f"array({first}, {second}) as points"))


# Search


def class_queries(spark: SparkSession, d: str) -> DataFrame:
    """One query per declared class: its mean vector (ten rows, whatever the data)."""
    classes = spark.range(10).selectExpr("cast(id as int) as cls")
    proto = Q.prototypes(table(spark, d, "embeddings").selectExpr("label as cls", "embedding"), classes, 64)
    return proto.selectExpr("cast(cls as bigint) as qid", "vector as q")


_QUERIES = """
m AS (SELECT label AS qid, i, avg(embedding[i]) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
q AS (SELECT qid, list(v / nm ORDER BY i) AS q FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY qid)) AS nm FROM m) GROUP BY qid),
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


@query("jon_14_nearest_neighbours", f"""WITH {_QUERIES},
s AS (SELECT CAST(qid AS BIGINT) AS qid, vec_id, list_cosine_similarity(v, q) AS score FROM e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s WHERE score >= 0.1E0)
SELECT qid, vec_id, round(score, 6) AS score FROM r WHERE rank <= 30""")
def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Cosine top 30 per class query, scores of at least 0.1."""
    out = Q.nearest(table(spark, d, "embeddings"), class_queries(spark, d), 30, 0.1)
    return out.selectExpr("qid", "vec_id", "round(score, 6) as score")


@query("jon_15_filtered_search", f"""WITH {_QUERIES},
s AS (SELECT CAST(qid AS BIGINT) AS qid, vec_id, label, list_distance(v, q) AS score FROM e, q WHERE label <> qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9), vec_id) AS rank FROM s)
SELECT qid, vec_id, label, round(score, 6) AS score FROM r WHERE rank <= 10""")
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """Euclidean top 10 among vectors of another label."""
    out = Q.nearest(table(spark, d, "embeddings"), class_queries(spark, d), 10, metric="l2", where="label <> qid")
    return out.selectExpr("qid", "vec_id", "label", "round(score, 6) as score")


@query("jon_16_similarity_index", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT vec_id, least(count(*) FILTER (d < 1.2E0), 20) AS n_similar, round(min(d) FILTER (d < 1.2E0), 6) AS nearest_dist FROM p GROUP BY vec_id""")
def similarity_index(spark: SparkSession, d: str) -> DataFrame:
    out = Q.similarity_counts(table(spark, d, "embeddings"), 1.2, 20)
    return out.selectExpr("vec_id", "n_similar", "round(nearest_dist, 6) as nearest_dist")


@query("jon_16_similarity_lists", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS other, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_distance(a.v, b.v) < 1.2E0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), other) AS k FROM p)
SELECT e.vec_id, coalesce(string_agg(CAST(other AS VARCHAR), ',' ORDER BY k) FILTER (k <= 20), '') AS similar FROM e LEFT JOIN r ON r.vec_id = e.vec_id GROUP BY e.vec_id""")
def similarity_lists(spark: SparkSession, d: str) -> DataFrame:
    """The nearest files of every file, as lists of ids."""
    out = Q.similarity_lists(table(spark, d, "embeddings"), 1.2, 20)
    return out.selectExpr("vec_id", "array_join(transform(similar, i -> string(i)), ',') as similar")


@query("win_15_appearance_ema", """
WITH s AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT label, vec_id, n, list_transform(e, lambda v: v / sqrt(list_inner_product(e, e))) AS f FROM s),
r AS (SELECT label, vec_id, n, f AS s FROM u WHERE n = 1
  UNION ALL SELECT label, vec_id, n, list_transform(m, lambda v: v / sqrt(list_inner_product(m, m))) FROM
    (SELECT u.label, u.vec_id, u.n, list_transform(list_zip(r.s, u.f), lambda z: 0.9E0 * z[1] + 0.1E0 * z[2]) AS m FROM r JOIN u ON u.label = r.label AND u.n = r.n + 1))
SELECT label AS track_id, vec_id, round(s[1], 6) AS s0, round(s[64], 6) AS s63 FROM r""")
def appearance_ema(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed unit appearance vector per track, renormalised at every step."""

    def step(state: dict, row) -> list[tuple]:
        f = np.asarray(row.embedding, dtype=float)
        f = f / np.linalg.norm(f)
        s = f if state.get("s") is None else 0.9 * state["s"] + 0.1 * f
        state["s"] = s = s / np.linalg.norm(s)
        return [(row.track_id, row.vec_id, float(s[0]), float(s[-1]))]

    vectors = table(spark, d, "embeddings").selectExpr("label as track_id", "vec_id", "embedding")
    out = ordered_map(vectors, ["track_id"], ["vec_id"], lambda key: {}, step, "track_id int, vec_id bigint, s0 double, s63 double")
    return out.selectExpr("track_id", "vec_id", "round(s0, 6) as s0", "round(s63, 6) as s63")
