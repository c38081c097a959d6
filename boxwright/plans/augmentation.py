"""Queries for label-side augmentations, mask conversions and model plug-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.operators import augment as A
from boxwright.operators import masks as K
from boxwright.plans import sqltext as S
from boxwright.plans.bridge import table, v_det, v_gt, v_image
from boxwright.plans.projections import rounded
from boxwright.plans.registry import query
from boxwright.session import shared_folder
from boxwright.sinks.exports import manifest_key
from boxwright.streaming import plugins

BOX = ("x1", "y1", "x2", "y2")


@query("aug_01_affine_labels", """
WITH m AS (SELECT *, 0.8E0 + (image_id % 5) * 0.1E0 AS a, 0.05E0 AS b, (image_id % 7) * 10.0E0 - 30 AS tx, -0.03E0 AS c, 0.9E0 AS d, (image_id % 3) * 15.0E0 AS ty FROM v_gt),
h AS (SELECT image_id, gt_id, (x2 - x1) * (y2 - y1) AS area0, a * x1 + least(b * y1, b * y2) + tx AS hx1, a * x2 + greatest(b * y1, b * y2) + tx AS hx2, d * y1 + least(c * x1, c * x2) + ty AS hy1, d * y2 + greatest(c * x1, c * x2) + ty AS hy2 FROM m),
k AS (SELECT image_id, gt_id, area0, least(greatest(hx1, 0), 640) AS x1, least(greatest(hx2, 0), 640) AS x2, least(greatest(hy1, 0), 480) AS y1, least(greatest(hy2, 0), 480) AS y2 FROM h)
SELECT image_id, gt_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM k
WHERE x2 - x1 > 2 AND y2 - y1 > 2 AND (x2 - x1) * (y2 - y1) / (area0 + 1e-16) > 0.1E0 AND greatest((x2 - x1) / (y2 - y1 + 1e-16), (y2 - y1) / (x2 - x1 + 1e-16)) < 100""")
def affine_labels(spark: SparkSession, d: str) -> DataFrame:
    moved = v_gt(spark, d).selectExpr(
        "*", "0.8D + (image_id % 5) * 0.1D as a", "0.05D as b", "(image_id % 7) * 10D - 30 as tx", "-0.03D as c", "0.9D as d", "(image_id % 3) * 15D as ty"
    )
    return A.affine_boxes(moved, "640D", "480D").selectExpr("image_id", "gt_id", *rounded(*BOX))


# Row by row: a matrix that scales, shears, moves and tilts by the image's number.
_MATRIX = ("0.8E0 + (image_id % 5) * 0.1E0", "0.05E0", "(image_id % 7) * 10.0E0 - 30", "-0.03E0", "0.9E0", "(image_id % 3) * 15.0E0", "(image_id % 4) * 0.0001E0", "(image_id % 3) * -0.0001E0", "1.0E0")
_TILT = ", ".join(f"{e} AS m{i}" for i, e in enumerate(_MATRIX))
_PX, _PY = (f"(m{i} * x + m{i + 1} * y + m{i + 2}) / (m6 * x + m7 * y + m8)" for i in (0, 3))


def tilted(spark: SparkSession, d: str) -> DataFrame:
    return v_gt(spark, d).selectExpr(
        "*", f"array({', '.join(e.replace('E0', 'D') for e in _MATRIX)}) as m",
        "array(struct(x1 as x, y1 as y), struct(x2 as x, y1 as y), struct(x2 as x, y2 as y), struct(x1 as x, y2 as y)) as polygon",
        "transform(sequence(0, 2), k -> struct(x1 + k * 20 as x, y1 + k * 15 as y, 2 as v)) as kpts",
    )


@query("aug_01_perspective_outlines", f"""
WITH p AS (SELECT image_id, gt_id, (x2 - x1) * (y2 - y1) AS area0, k, CASE WHEN k IN (0, 3) THEN x1 ELSE x2 END AS x, CASE WHEN k < 2 THEN y1 ELSE y2 END AS y, {_TILT} FROM v_gt, (SELECT unnest(range(4)) AS k)),
q AS (SELECT image_id, gt_id, area0, {_PX} AS x, {_PY} AS y FROM p),
s AS (SELECT *, CAST(min(x) OVER w < 0 AS INT) + CAST(min(y) OVER w < 0 AS INT) + CAST(max(x) OVER w > 640 AS INT) + CAST(max(y) OVER w > 480 AS INT) AS sides FROM q WINDOW w AS (PARTITION BY image_id, gt_id)),
c AS (SELECT image_id, gt_id, area0, x, y, CASE WHEN sides >= 3 THEN least(greatest(x, 0), 640) ELSE x END AS cx, CASE WHEN sides >= 3 THEN least(greatest(y, 0), 480) ELSE y END AS cy FROM s),
b AS (SELECT image_id, gt_id, any_value(area0) AS area0, coalesce(min(cx) FILTER (i), 0) AS x1, coalesce(min(cy) FILTER (i), 0) AS y1, coalesce(max(cx) FILTER (i), 0) AS x2, coalesce(max(cy) FILTER (i), 0) AS y2
  FROM (SELECT *, cx > 0 AND cy > 0 AND cx < 640 AND cy < 480 AS i FROM c) GROUP BY image_id, gt_id)
SELECT b.image_id, b.gt_id, round(any_value(x1), 6) AS x1, round(any_value(y1), 6) AS y1, round(any_value(x2), 6) AS x2, round(any_value(y2), 6) AS y2, round(sum(least(greatest(x, x1), x2)), 4) AS sum_x, round(sum(least(greatest(y, y1), y2)), 4) AS sum_y
FROM b JOIN c USING (image_id, gt_id) WHERE x2 - x1 > 2 AND y2 - y1 > 2 AND (x2 - x1) * (y2 - y1) / (b.area0 + 1e-16) > 0.01E0 AND greatest((x2 - x1) / (y2 - y1 + 1e-16), (y2 - y1) / (x2 - x1 + 1e-16)) < 100
GROUP BY b.image_id, b.gt_id""")
def perspective_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Outlines through a perspective matrix, boxed again and clipped."""
    out = A.perspective_outlines(tilted(spark, d), "640D", "480D")
    total = lambda a: f"round(aggregate(polygon, 0D, (s, p) -> s + p.{a}), 4) as sum_{a}"
    return out.selectExpr("image_id", "gt_id", *rounded(*BOX), total("x"), total("y"))


@query("aug_01_perspective_keypoints", f"""
WITH p AS (SELECT image_id, gt_id, k, x1 + k * 20 AS x, y1 + k * 15 AS y, {_TILT} FROM v_gt, (SELECT unnest(range(3)) AS k)),
q AS (SELECT image_id, gt_id, k, {_PX} AS x, {_PY} AS y FROM p)
SELECT image_id, gt_id, CAST(k AS INT) AS k, round(x, 6) AS x, round(y, 6) AS y, CASE WHEN x < 0 OR y < 0 OR x > 640 OR y > 480 THEN 0 ELSE 2 END AS v FROM q""")
def perspective_keypoints(spark: SparkSession, d: str) -> DataFrame:
    """Keypoints through a perspective matrix; those that leave the image are hidden."""
    out = A.perspective_keypoints(tilted(spark, d), "640D", "480D")
    return out.selectExpr("image_id", "gt_id", "posexplode(kpts) as (k, p)").selectExpr("image_id", "gt_id", "k", "round(p.x, 6) as x", "round(p.y, 6) as y", "p.v as v")


_GRID9 = """
p AS (SELECT image_id, image_id // 9 AS mosaic_id, image_id % 9 AS slot, 400 + image_id * 37 % 240 AS w, 300 + image_id * 91 % 340 AS h FROM v_image),
q AS (SELECT *, first_value(w) OVER m AS w0, first_value(h) OVER m AS h0, lag(w) OVER m AS wp, lag(h) OVER m AS hp, count(*) OVER (PARTITION BY mosaic_id) AS n FROM p WINDOW m AS (PARTITION BY mosaic_id ORDER BY slot)),
s AS (SELECT *, 640 + CASE slot WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN wp WHEN 3 THEN w0 WHEN 4 THEN w0 WHEN 5 THEN w0 - w WHEN 6 THEN w0 - wp - w ELSE -w END - 320 AS padw,
  640 + CASE slot WHEN 0 THEN 0 WHEN 1 THEN -h WHEN 2 THEN -h WHEN 3 THEN 0 WHEN 4 THEN hp WHEN 5 THEN h0 WHEN 6 THEN h0 WHEN 7 THEN h0 - h ELSE h0 - hp - h END - 320 AS padh FROM q WHERE n = 9)"""


@query("aug_03_mosaic_grid", f"""WITH {_GRID9},
m AS (SELECT mosaic_id, gt_id, least(greatest(x1 + padw, 0), 1280) AS x1, least(greatest(y1 + padh, 0), 1280) AS y1, least(greatest(x2 + padw, 0), 1280) AS x2, least(greatest(y2 + padh, 0), 1280) AS y2 FROM v_gt JOIN s USING (image_id))
SELECT * FROM m WHERE x2 > x1 AND y2 > y1""")
def mosaic_grid(spark: SparkSession, d: str) -> DataFrame:
    """Nine images of different sizes per mosaic."""
    patches = v_image(spark, d).selectExpr(
        "image_id", "image_id div 9 as mosaic_id", "cast(image_id % 9 as int) as slot", "400 + image_id * 37 % 240 as w", "300 + image_id * 91 % 340 as h"
    )
    return A.mosaic_labels(v_gt(spark, d), A.mosaic_grid_plan(patches, 9, 640), 1280).select("mosaic_id", "gt_id", *BOX)


@query("aug_06_prompt_classes", """
WITH c AS (SELECT DISTINCT image_id, cls FROM v_gt),
s AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (image_id * 17 + cls * 6007) % 1013, cls) AS k FROM c),
n AS (SELECT image_id, cls, row_number() OVER (PARTITION BY image_id ORDER BY cls) - 1 AS new_cls FROM s WHERE k <= 4)
SELECT g.image_id, g.gt_id, CAST(n.new_cls AS INT) AS new_cls, CAST(6 AS INT) AS n_prompts FROM v_gt g JOIN n ON n.image_id = g.image_id AND n.cls = g.cls""")
def prompt_classes(spark: SparkSession, d: str) -> DataFrame:
    """Objects whose class was sampled, with its place in the padded prompt list."""
    prompts = A.padded_prompts(A.text_prompts(v_gt(spark, d), 20, 2, 4), 6)
    out = A.reindex_classes(v_gt(spark, d), prompts).join(prompts.selectExpr("image_id", "size(prompts) as n_prompts"), "image_id")
    return out.select("image_id", "gt_id", "new_cls", "n_prompts")


@query("aug_04_mix_up", "SELECT image_id, gt_id, cls, 0 AS part FROM v_gt UNION ALL SELECT i.image_id, gt_id, cls, 1 FROM v_gt g JOIN v_image i ON g.image_id = (i.image_id * 7 + 3) % 150")
def mix_up(spark: SparkSession, d: str) -> DataFrame:
    """Labels of two images together."""
    partners = v_image(spark, d).selectExpr("image_id", "(image_id * 7 + 3) % 150 as partner_id")
    return A.mix_up(v_gt(spark, d), partners).select("image_id", "gt_id", "cls", "part")


@query("aug_02_flip_labels", "SELECT image_id, gt_id, 640 - x2 AS x1, 640 - x1 AS x2, 640 - (x1 + 20) AS k0x, 640 - x1 AS k1x, 640 - (x1 + 40) AS k2x FROM v_gt")
def flip_labels(spark: SparkSession, d: str) -> DataFrame:
    keyed = v_gt(spark, d).selectExpr("*", "transform(sequence(0, 2), k -> struct(x1 + k * 20 as x, y1 as y, 2 as v)) as kpts")
    flipped = A.flip_horizontal(keyed, "640D", [1, 0, 2])
    return flipped.selectExpr("image_id", "gt_id", "x1", "x2", "kpts[0].x as k0x", "kpts[1].x as k1x", "kpts[2].x as k2x")


@query("aug_03_mosaic_plan", """
WITH p AS (SELECT image_id, image_id // 4 AS mosaic_id, image_id % 4 AS slot, 640 AS w, 480 AS h, 320 + (image_id // 4) * 37 % 640 AS xc, 320 + (image_id // 4) * 91 % 640 AS yc FROM v_image),
s AS (SELECT *, CASE WHEN slot IN (0, 2) THEN xc - 640 ELSE xc END AS padw, CASE WHEN slot IN (0, 1) THEN yc - 480 ELSE yc END AS padh FROM p),
m AS (SELECT mosaic_id, gt_id, least(greatest(x1 + padw, 0), 1280) AS x1, least(greatest(y1 + padh, 0), 1280) AS y1, least(greatest(x2 + padw, 0), 1280) AS x2, least(greatest(y2 + padh, 0), 1280) AS y2 FROM v_gt JOIN s USING (image_id))
SELECT * FROM m WHERE x2 > x1 AND y2 > y1""")
def mosaic(spark: SparkSession, d: str) -> DataFrame:
    """Four images per mosaic, labels shifted, clipped, empty ones dropped."""
    patches = v_image(spark, d).selectExpr(
        "image_id", "image_id div 4 as mosaic_id", "cast(image_id % 4 as int) as slot", "width as w", "height as h",
        "320 + (image_id div 4) * 37 % 640 as xc", "320 + (image_id div 4) * 91 % 640 as yc",
    )
    out = A.mosaic_labels(v_gt(spark, d), A.mosaic_plan(patches, 640), 1280)
    return out.select("mosaic_id", "gt_id", *BOX)


@query("aug_04_cut_mix", f"""
WITH a AS (SELECT image_id, k AS area_no, CAST((image_id * 53 + k * 211) % 560 AS DOUBLE) AS x1, CAST((image_id * 29 + k * 97) % 420 AS DOUBLE) AS y1 FROM v_image, (SELECT unnest([0, 1, 2]) AS k)),
b AS (SELECT image_id, area_no, x1, y1, x1 + 70 AS x2, y1 + 50 AS y2 FROM a),
f AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM v_gt g WHERE g.image_id = b.image_id AND {S.inter("g.", "b.")} > 0)),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area_no) AS k FROM f) WHERE k = 1)
SELECT c.image_id, g.gt_id, g.cls, greatest(g.x1, c.x1) AS x1, greatest(g.y1, c.y1) AS y1, least(g.x2, c.x2) AS x2, least(g.y2, c.y2) AS y2
FROM c JOIN v_gt g ON g.image_id = c.image_id + 1 WHERE {S.inter("c.", "g.")} / ({S.box_area("g.")} + 1e-7) >= 0.1E0""")
def cut_mix(spark: SparkSession, d: str) -> DataFrame:
    areas = v_image(spark, d).selectExpr("image_id", "explode(array(0, 1, 2)) as area_no").selectExpr(
        "image_id", "area_no", "cast((image_id * 53 + area_no * 211) % 560 as double) as x1", "cast((image_id * 29 + area_no * 97) % 420 as double) as y1"
    ).selectExpr("*", "x1 + 70 as x2", "y1 + 50 as y2")
    partners = v_image(spark, d).selectExpr("image_id", "image_id + 1 as partner_id")
    return A.cut_mix(v_gt(spark, d), areas, partners)


@query("aug_05_copy_paste", f"""
WITH m AS (SELECT image_id, gt_id, 640 - x2 AS x1, y1, 640 - x1 AS x2, y2 FROM v_gt),
s AS (SELECT m.image_id, m.gt_id, max({S.inter("m.", "g.")} / ({S.box_area("g.")} + 1e-7)) AS ioa FROM m JOIN v_gt g ON m.image_id = g.image_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ioa, gt_id) AS k, count(*) OVER (PARTITION BY image_id) AS n FROM s WHERE ioa < 0.3E0)
SELECT image_id, gt_id, round(ioa, 6) AS ioa FROM r WHERE k <= round_even(0.5E0 * n, 0)""")
def copy_paste(spark: SparkSession, d: str) -> DataFrame:
    return A.copy_paste(v_gt(spark, d), "640D", 0.5).selectExpr("image_id", "gt_id", "round(ioa, 6) as ioa")


@query("aug_06_text_prompts", """
WITH p AS (SELECT image_id, list_sort(list(DISTINCT cls)) AS pos FROM v_gt GROUP BY image_id),
n AS (SELECT image_id, c, row_number() OVER (PARTITION BY image_id ORDER BY (image_id * 31 + c * 7919) % 1009, c) AS k, len(pos) AS np FROM p, (SELECT unnest(range(20)) AS c) WHERE NOT list_contains(pos, CAST(c AS INT))),
l AS (SELECT image_id, CAST(c AS INT) AS cls, CAST(np + k - 1 AS INT) AS new_cls FROM n WHERE k <= greatest(least(16 - np, 5), 0) UNION ALL SELECT image_id, unnest(pos), unnest(range(len(pos))) FROM p)
SELECT image_id, cls, CAST(new_cls AS INT) AS new_cls FROM l""")
def text_prompts(spark: SparkSession, d: str) -> DataFrame:
    prompts = A.text_prompts(v_gt(spark, d), 20, 5, 16)
    return prompts.selectExpr("image_id", "posexplode(classes) as (new_cls, cls)").select("image_id", "cls", "new_cls")


@query("aug_07_polygon_resampling", """
WITH g AS (SELECT image_id, gt_id, [x1, x2, x2, x1, x1] AS xs, [y1, y1, y2, y2, y1] AS ys FROM v_gt),
t AS (SELECT unnest(list_sort(list_concat(list_transform(range(7), lambda i: i * (4 / 6.0E0)), [0.0E0, 1, 2, 3, 4]))) AS t),
k AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS pos, CAST(least(floor(t), 3) AS INT) AS lo FROM t)
SELECT image_id, gt_id, CAST(pos AS INT) AS pos, round(xs[lo + 1] + (xs[lo + 2] - xs[lo + 1]) * (t - lo), 6) AS x, round(ys[lo + 1] + (ys[lo + 2] - ys[lo + 1]) * (t - lo), 6) AS y FROM g, k""")
def polygon_resampling(spark: SparkSession, d: str) -> DataFrame:
    polygons = v_gt(spark, d).selectExpr(
        "image_id", "gt_id", "array(struct(x1 as x, y1 as y), struct(x2 as x, y1 as y), struct(x2 as x, y2 as y), struct(x1 as x, y2 as y)) as polygon"
    )
    out = polygons.selectExpr("image_id", "gt_id", f"posexplode({A.resample_polygon('polygon', 12)}) as (pos, p)")
    return out.selectExpr("image_id", "gt_id", "pos", "round(p.x, 6) as x", "round(p.y, 6) as y")


@query("aug_08_polygon_stitching", "SELECT gt_id AS object_id, CAST(16 AS INT) AS n, x2 AS first_x, round(3 * (x2 - x1) * (y2 - y1), 3) AS area FROM v_gt")
def polygon_stitching(spark: SparkSession, d: str) -> DataFrame:
    """Three shifted copies of each box as parts of one object: the seams add vertices and no area."""
    parts = v_gt(spark, d).selectExpr("gt_id as object_id", "explode(array(0, 1, 2)) as part_no", *BOX).selectExpr(
        "object_id", "part_no", "array(x1 + part_no * 200, x2 + part_no * 200, x2 + part_no * 200, x1 + part_no * 200) as xs", "array(y1, y1, y2, y2) as ys"
    )
    shoelace = "abs(aggregate(sequence(0, size(xs) - 1), 0D, (s, i) -> s + xs[i] * ys[(i + 1) % size(xs)] - xs[(i + 1) % size(xs)] * ys[i])) / 2"
    return A.stitch_parts(parts).selectExpr("object_id", "size(xs) as n", "xs[0] as first_x", f"round({shoelace}, 3) as area")


def class_pixels(spark: SparkSession, d: str) -> DataFrame:
    runs = K.box_runs(v_gt(spark, d), "gt_id", 20, 15, 32)
    return runs.selectExpr("image_id", "cls", "explode(sequence(start, start + len - 1)) as pos")


@query("aug_09_class_mask_runs", """
WITH b AS (SELECT image_id, cls, CAST(least(greatest(floor(x1 / 32), 0), 20) AS BIGINT) AS a, CAST(least(greatest(floor(x2 / 32), 0), 20) AS BIGINT) AS b, CAST(least(greatest(floor(y1 / 32), 0), 15) AS BIGINT) AS c, CAST(least(greatest(floor(y2 / 32), 0), 15) AS BIGINT) AS d FROM v_gt),
x AS (SELECT image_id, cls, unnest(range(a, b)) AS x, c, d FROM b WHERE a < b AND c < d), p AS (SELECT DISTINCT image_id, cls, x * 15 + y AS pos FROM (SELECT *, unnest(range(c, d)) AS y FROM x)),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY image_id, cls ORDER BY pos) AS g FROM p)
SELECT image_id, cls, min(pos) AS start, count(*) AS len FROM g GROUP BY image_id, cls, g""")
def class_mask_runs(spark: SparkSession, d: str) -> DataFrame:
    """Class-mask pixels to runs (value v is class v - 1; here classes are given)."""
    return K.pixel_runs(class_pixels(spark, d), ["image_id", "cls"]).select("image_id", "cls", "start", "len")


@query("aug_09_run_length_text")
def run_length_text(spark: SparkSession, d: str) -> DataFrame:
    """Run-length counts and their compressed text per image and class."""
    runs = K.pixel_runs(class_pixels(spark, d), ["image_id", "cls"])
    return K.run_length_text(runs, ["image_id", "cls"], 300).selectExpr("image_id", "cls", "size(counts) as n_counts", "rle")


@query("aug_10_overlap_index", """
WITH b AS (SELECT image_id, gt_id, CAST(least(greatest(floor(x1 / 32), 0), 20) AS BIGINT) AS a, CAST(least(greatest(floor(x2 / 32), 0), 20) AS BIGINT) AS b, CAST(least(greatest(floor(y1 / 32), 0), 15) AS BIGINT) AS c, CAST(least(greatest(floor(y2 / 32), 0), 15) AS BIGINT) AS d FROM v_gt),
x AS (SELECT *, unnest(range(a, b)) AS x, (b - a) * (d - c) AS area FROM b WHERE a < b AND c < d), p AS (SELECT *, unnest(range(c, d)) AS y FROM x),
w AS (SELECT image_id, x, y, arg_max(gt_id, {'k': -area, 'i': gt_id}) AS mask_id FROM p GROUP BY ALL) SELECT image_id, mask_id, count(*) AS pixels FROM w GROUP BY ALL""")
def overlap_index(spark: SparkSession, d: str) -> DataFrame:
    """Visible positions of each mask when larger ones are drawn first."""
    runs = K.box_runs(v_gt(spark, d).drop("cls"), "gt_id", 20, 15, 32).withColumnRenamed("gt_id", "mask_id")
    shown = K.overlap_index(runs, K.mask_areas(runs, "image_id", "mask_id"), 15)
    return shown.groupBy("image_id", "mask_id").agg(F.expr("sum(e0 - s0) as pixels"))


# Plug-ins with a deterministic scorer in place of a model


@query("udf_01_scoring_plugin", "SELECT image_id, CAST(k AS INT) AS slot, CAST((image_id * 7 + k * 3) % 10 AS INT) AS cls, ((image_id * 7919 + k * 104729) % 1000) / 1000.0E0 AS conf FROM v_image, (SELECT unnest([0, 1, 2]) AS k)")
def scoring_plugin(spark: SparkSession, d: str) -> DataFrame:
    """Batches of image rows to detection rows through the plug-in surface."""
    return plugins.score(v_image(spark, d).select("image_id", "width", "height"), plugins.stub_scorer).select("image_id", "slot", "cls", "conf")


_SHARES = ", ".join(f"round(CAST(CAST((len(text) - len(regexp_replace(text, '[{c}]', '', 'g'))) / greatest(len(text), 1.0E0) AS FLOAT) AS DOUBLE), 6) AS e{i}" for i, c in enumerate(("a-m", "n-z", "A-Z", "0-9")))


@query("udf_02_embedding_plugin", f"SELECT doc_id, {_SHARES} FROM documents")
def embedding_plugin(spark: SparkSession, d: str) -> DataFrame:
    rows = plugins.embed(table(spark, d, "documents").select("doc_id", "text"), "text", plugins.stub_embedder)
    return rows.selectExpr("doc_id", *[f"round(cast(embedding[{i}] as double), 6) as e{i}" for i in range(4)])


@query("src_18_embedding_table", f"SELECT doc_id, {_SHARES} FROM documents")
def embedding_table(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of whole texts built once per (dataset, model) into a partitioned table and read back.

    The dataset name carries a key of its files' contents, so changed content is never answered from an old table.
    """
    rows = table(spark, d, "documents").select("doc_id", "text")
    key = manifest_key(rows.selectExpr("cast(doc_id as string) as path", "xxhash64(text) as length")).first().key
    path = f"{shared_folder(spark)}/embeddings"
    out = plugins.embedding_table(rows, "text", plugins.stub_embedder, path, dataset=f"documents-{key[:16]}", model="stub")
    return out.selectExpr("doc_id", *[f"round(cast(embedding[{i}] as double), 6) as e{i}" for i in range(4)])


@query("udf_04_aggregators", "SELECT cls, count(*) AS n, round(avg(conf), 6) AS mean_conf FROM v_det GROUP BY cls")
def aggregators(spark: SparkSession, d: str) -> DataFrame:
    """Accumulate-then-reduce metrics are built-in partial and final aggregates."""
    return v_det(spark, d).groupBy("cls").agg(F.expr("count(*) as n"), F.expr("round(avg(conf), 6) as mean_conf"))


@query("udf_05_tile_function", """
WITH d AS (SELECT image_id, 600 + image_id * 37 % 900 AS w FROM v_image)
SELECT image_id, CAST(CASE WHEN i > 0 AND i * 412 + 512 > w THEN w - 512 ELSE i * 412 END AS BIGINT) AS tx1 FROM d, (SELECT unnest(range(6)) AS i) WHERE i < CASE WHEN w <= 512 THEN 1 ELSE ceil((w - 512) / 412 + 1) END""")
def tile_function(spark: SparkSession, d: str) -> DataFrame:
    """Tile starts as a table function that SQL users call with LATERAL."""
    plugins.register_table_functions(spark)
    v_image(spark, d).selectExpr("image_id", "cast(600 + image_id * 37 % 900 as int) as width").createOrReplaceTempView("tile_images")
    return spark.sql("SELECT image_id, start AS tx1 FROM tile_images, LATERAL tile_starts(width, 512, 100)")


@query("udf_05_mosaic_function", """
WITH d AS (SELECT image_id, 320 + image_id * 37 % 640 AS xc, 320 + image_id * 91 % 640 AS yc FROM v_image)
SELECT image_id, CAST(s AS INT) AS slot, CAST(CASE WHEN s IN (0, 2) THEN greatest(xc - 640, 0) ELSE xc END AS INT) AS x1, CAST(CASE WHEN s IN (0, 1) THEN yc ELSE least(yc + 480, 1280) END AS INT) AS y2 FROM d, (SELECT unnest(range(4)) AS s)""")
def mosaic_function(spark: SparkSession, d: str) -> DataFrame:
    """Paste places of a mosaic as a table function."""
    plugins.register_table_functions(spark)
    v_image(spark, d).selectExpr("image_id", "cast(320 + image_id * 37 % 640 as int) as xc", "cast(320 + image_id * 91 % 640 as int) as yc").createOrReplaceTempView("mosaic_images")
    return spark.sql("SELECT image_id, slot, x1, y2 FROM mosaic_images, LATERAL mosaic_places(xc, yc, 640, 480, 640)")


@query("aug_11_auto_annotate", "SELECT image_id, CAST((image_id * 7 + k * 3) % 10 AS INT) AS cls, CAST(4 AS INT) AS n_points FROM v_image, (SELECT unnest([0, 1, 2]) AS k)")
def auto_annotate(spark: SparkSession, d: str) -> DataFrame:
    """Detections from one plug-in feed a second that returns outlines; empty outlines are skipped."""
    det = plugins.score(v_image(spark, d).select("image_id", "width", "height"), plugins.stub_scorer)
    return plugins.outline(det, plugins.stub_outliner).where("size(polygon) > 0").selectExpr("image_id", "cls", "size(polygon) as n_points")
