"""Dataset statistics, exports, splits and benchmark queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.operators import boxes as B
from boxwright.operators import datasets as D
from boxwright.operators import evaluation as E
from boxwright.operators import matching as M
from boxwright.plans import sqltext as S
from boxwright.plans.bridge import table, v_det, v_gt, v_image
from boxwright.plans.evaluation import cumulative
from boxwright.plans.projections import v_rot, V_ROT
from boxwright.plans.registry import query
from boxwright.session import materialize
from boxwright.sinks import exports


def u(key: str, seed: int = 0) -> str:
    """The arithmetic draw in DuckDB SQL (keys are not negative)."""
    return f"(((({key}) % 1000003) * 7919 + {seed} * 104729 + (({key}) % 8191) * 131071) % 1000000) / 1000000.0E0"


def split_objects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    images = v_image(spark, d).selectExpr("image_id", "split_hint as split")
    objects = v_gt(spark, d).where("image_id % 6 <> 0").join(images, "image_id")
    return objects, images, spark.range(12).selectExpr("cast(id as int) as cls")


_STATS = """
o AS (SELECT g.cls, g.image_id, split_hint AS split FROM v_gt g JOIN v_image USING (image_id) WHERE image_id % 6 <> 0),
t AS (SELECT split_hint AS split, count(*) AS total FROM v_image GROUP BY 1),
l AS (SELECT split, count(DISTINCT image_id) AS labelled FROM o GROUP BY 1),
st AS (SELECT t.split, CAST(c.cls AS INT) AS cls, count(o.image_id) AS instances, count(DISTINCT o.image_id) AS images, any_value(total) AS total,
       any_value(total) - coalesce(any_value(labelled), 0) AS unlabelled
FROM t CROSS JOIN (SELECT unnest(range(12)) AS cls) c LEFT JOIN l ON l.split = t.split LEFT JOIN o ON o.split = t.split AND o.cls = c.cls GROUP BY t.split, c.cls)"""


@query("agg_01_dataset_statistics", f"WITH {_STATS} SELECT * FROM st")
def dataset_statistics(spark: SparkSession, d: str) -> DataFrame:
    return D.statistics(*split_objects(spark, d))


@query("snk_06_statistics_json", f"""WITH {_STATS}
SELECT split, '{{"instance_stats":{{"total":' || CAST(sum(instances) AS BIGINT) || ',"per_class":[' || string_agg(instances, ',' ORDER BY cls) || ']}},"image_stats":{{"total":' || any_value(total)
  || ',"unlabelled":' || any_value(unlabelled) || ',"per_class":[' || string_agg(images, ',' ORDER BY cls) || ']}}}}' AS stats FROM st GROUP BY split""")
def statistics_json(spark: SparkSession, d: str) -> DataFrame:
    return D.statistics_json(D.statistics(*split_objects(spark, d)))


@query("agg_03_label_distribution", """
WITH c AS (SELECT (x1 + x2) / 1280 AS x, (y1 + y2) / 960 AS y FROM v_gt), r AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by FROM c)
SELECT CAST(least(floor((x - ax) / (bx - ax) * 50), 49) AS INT) AS bx, CAST(least(floor((y - ay) / (r.by - ay) * 50), 49) AS INT) AS by, count(*) AS n FROM c, r GROUP BY ALL""")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Two-dimensional histogram of box centres over all boxes."""
    centres = v_gt(spark, d).selectExpr("(x1 + x2) / 1280 as x", "(y1 + y2) / 960 as y")
    return D.grid_histogram(centres, "x", "y")


@query("agg_04_category_frequency", """
WITH n AS (SELECT p_type || '/' || split_part(p_name, ' ', 2) AS name, count(*) AS n FROM part GROUP BY 1),
f AS (SELECT trim(unnest(string_split(name, '/'))) AS name, n FROM n), g AS (SELECT name, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY name)
SELECT name, n, n >= (SELECT least(max(n), 100) FROM g) AS negative FROM g""")
def category_frequency(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").groupBy(F.expr("concat(p_type, '/', split(p_name, ' ')[1]) as name")).agg(F.expr("count(*) as n"))
    freq = D.category_frequency(names)
    marked = D.negative_names(freq).selectExpr("name", "true as negative")
    return freq.join(marked, "name", "left").selectExpr("name", "n", "coalesce(negative, false) as negative")


_PROBS = "((doc_id * (k + 3) * 37 + k * 101 + doc_id % 91) % 997) / 997.0E0"


@query("agg_08_classification_accuracy", f"""
WITH p AS (SELECT doc_id, CAST(substr(source, 4) AS INT) % 10 AS truth, k, {_PROBS} AS p FROM documents, (SELECT unnest(range(10)) AS k)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, k) AS rk FROM p)
SELECT round(count(*) FILTER (rk = 1 AND k = truth) / count(DISTINCT doc_id), 6) AS top1, round(count(*) FILTER (rk <= 5 AND k = truth) / count(DISTINCT doc_id), 6) AS top5,
       round((count(*) FILTER (rk = 1 AND k = truth) + count(*) FILTER (rk <= 5 AND k = truth)) / 2 / count(DISTINCT doc_id), 6) AS fitness FROM r""")
def classification_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Top-1 and top-5 accuracy; the ranking of a fixed-length probability vector stays inside the row."""
    top = "transform(slice(array_sort(transform(sequence(0, 9), k -> struct(-((doc_id * (k + 3) * 37 + k * 101 + doc_id % 91) % 997) / 997D as p, k as k))), 1, 5), s -> s.k)"
    ranked = table(spark, d, "documents").selectExpr("cast(substring(source, 4) as int) % 10 as truth", f"{top} as top5")
    return ranked.agg(F.expr("avg(if(top5[0] = truth, 1D, 0D)) as t1"), F.expr("avg(if(array_contains(top5, truth), 1D, 0D)) as t5")).selectExpr(
        "round(t1, 6) as top1", "round(t5, 6) as top5", "round((t1 + t5) / 2, 6) as fitness"
    )


_SLICED = f"""{S.match_ctes()},
bg AS (SELECT d.image_id, d.det_id, g.gt_id, row_number() OVER (PARTITION BY d.image_id, d.det_id ORDER BY {S.iou("d.", "g.")} DESC, g.gt_id) AS k, {S.box_area("g.")} AS ga
   FROM v_det d JOIN v_gt g ON d.image_id = g.image_id AND d.cls = g.cls WHERE {S.iou("d.", "g.")} >= 0.5E0),
s_det AS (SELECT d.image_id, d.det_id, d.conf, d.cls * 4 + CASE WHEN coalesce(ga, {S.box_area("d.")}) < 5000 THEN 0 WHEN coalesce(ga, {S.box_area("d.")}) < 9216 THEN 1 ELSE 2 END AS cls
   FROM v_det d LEFT JOIN bg ON bg.k = 1 AND bg.image_id = d.image_id AND bg.det_id = d.det_id),
s_gt AS (SELECT image_id, gt_id, cls * 4 + CASE WHEN {S.box_area("")} < 5000 THEN 0 WHEN {S.box_area("")} < 9216 THEN 1 ELSE 2 END AS cls FROM v_gt)"""


@query("agg_11_size_slices", f"""WITH {_SLICED}, {S.ap_ctes("s_det", "s_gt")}
SELECT CAST(cls % 4 AS INT) AS size_slice, round(avg(ap), 6) AS ap, round(avg(CASE WHEN level = 50 THEN ap END), 6) AS ap50, round(0.9E0 * avg(ap) + 0.1E0 * avg(CASE WHEN level = 50 THEN ap END), 6) AS fitness FROM ap GROUP BY cls % 4""")
def size_slices(spark: SparkSession, d: str) -> DataFrame:
    """AP by object size: a detection belongs to the slice of its best truth, or of its own area without one.

    Class and slice become one composite class, so all slices share one pass.
    """
    size = lambda a: D.size_slice(a, small=5000)  # boxes of these tables are larger than the published 1,024
    area = "((x2 - x1) * (y2 - y1))"
    gt = v_gt(spark, d)
    best = M.best_truth(v_det(spark, d), gt, ["image_id", "cls"], 0.5)
    tagged = M.match_levels(best).join(gt.selectExpr("image_id", "gt_id", f"{area} as ga"), ["image_id", "gt_id"], "left")
    area_of = f"coalesce(ga, {area})"
    sliced = B.replace_columns(tagged, cls=f"cls * 4 + {size(area_of)}")
    truths = E.class_truths(gt.selectExpr(f"cls * 4 + {size(area)} as cls"))
    ap = E.average_precision(E.cumulative_counts(materialize(E.confidence_histogram(sliced))), truths)
    per = ap.groupBy(F.expr("cls % 4 as size_slice")).agg(F.expr("avg(ap) as ap"), F.expr("avg(case when level = 50 then ap end) as ap50"))
    return per.selectExpr("size_slice", "round(ap, 6) as ap", "round(ap50, 6) as ap50", "round(0.9D * ap + 0.1D * ap50, 6) as fitness")


@query("agg_11_rarity_slices", f"""WITH {S.match_ctes()}, {S.ap_ctes()},
f AS (SELECT cls, count(DISTINCT image_id) AS n FROM v_gt GROUP BY cls), m AS (SELECT median(n) AS m FROM f)
SELECT CASE WHEN n <= 10 THEN 'rare' WHEN n <= 100 THEN 'common' ELSE 'frequent' END AS rarity, round(avg(ap), 6) AS ap FROM ap JOIN f USING (cls) GROUP BY 1""")
def rarity_slices(spark: SparkSession, d: str) -> DataFrame:
    """AP by how many images a class appears in."""
    gt = v_gt(spark, d)
    ap = E.average_precision(cumulative(spark, d), E.class_truths(gt))
    freq = gt.groupBy("cls").agg(F.expr("count(distinct image_id) as n"))
    return ap.join(freq, "cls").groupBy(F.expr("case when n <= 10 then 'rare' when n <= 100 then 'common' else 'frequent' end as rarity")).agg(
        F.expr("round(avg(ap), 6) as ap")
    )


@query("agg_17_speed_rollup", """
SELECT l_returnflag AS model, l_linestatus AS format, round(avg(l_quantity), 6) AS ms, round(1000 / avg(l_quantity), 6) AS fps, avg(l_quantity) >= 20 AS passes FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def speed_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Mean milliseconds and frames per second per model and format, with totals and a floor check."""
    rolled = table(spark, d, "lineitem").rollup(F.expr("l_returnflag as model"), F.expr("l_linestatus as format")).agg(F.expr("avg(l_quantity) as m"))
    return rolled.selectExpr("model", "format", "round(m, 6) as ms", "round(1000 / m, 6) as fps", "m >= 20 as passes")


def _clip_sql(rounds: int) -> str:
    ctes = ["c0 AS (SELECT event_type, value FROM events)"]
    for i in range(rounds):
        ctes.append(f"c{i + 1} AS (SELECT c.event_type, value FROM c{i} c JOIN (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM c{i} GROUP BY 1) b USING (event_type) WHERE s = 0 OR abs(value - m) < 2 * s)")
    return "WITH " + ", ".join(ctes) + f" SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM c{rounds} GROUP BY event_type"


@query("agg_18_sigma_clip", _clip_sql(3))
def sigma_clip(spark: SparkSession, d: str) -> DataFrame:
    kept = D.sigma_clip(table(spark, d, "events").select("event_type", "value"), "event_type", "value")
    return kept.groupBy("event_type").agg(F.expr("count(*) as n"), F.expr("round(avg(value), 6) as mean"))


@query("agg_19_fold_balance", f"""
WITH g AS (SELECT cls, CAST(floor({u("image_id")} * 5) AS INT) AS home FROM v_gt)
SELECT CAST(fold AS INT) AS fold, cls, count(*) FILTER (home = fold) AS n_val, round(count(*) FILTER (home = fold) / (count(*) FILTER (home <> fold) + 1e-7), 6) AS ratio FROM g, (SELECT unnest(range(5)) AS fold) GROUP BY ALL""")
def fold_balance(spark: SparkSession, d: str) -> DataFrame:
    """Validation to training label ratio per fold and class, from one pass of counts."""
    counts = v_gt(spark, d).groupBy("cls", F.expr(f"{D.fold_of('image_id', 5)} as home")).agg(F.expr("count(*) as n"))
    return counts.selectExpr("*", "explode(sequence(0, 4)) as fold").groupBy("fold", "cls").agg(
        F.expr("sum(if(home = fold, n, 0)) as n_val"), F.expr("sum(if(home <> fold, n, 0)) as n_train")
    ).selectExpr("fold", "cls", "n_val", "round(n_val / (n_train + 1e-7D), 6) as ratio")


@query("agg_20_storage_profile", "SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS sd, CAST(sum(n_chars) AS BIGINT) AS total, round(sum(n_chars) * 1.5E0, 3) AS needed FROM documents GROUP BY source")
def storage_profile(spark: SparkSession, d: str) -> DataFrame:
    """File size statistics and the cache size they imply (half again as a margin)."""
    return table(spark, d, "documents").groupBy("source").agg(
        F.expr("count(*) as n"), F.expr("round(avg(n_chars), 6) as mean"), F.expr("round(stddev_samp(n_chars), 6) as sd"),
        F.expr("sum(n_chars) as total"), F.expr("round(sum(n_chars) * 1.5D, 3) as needed"),
    )


@query("agg_21_keypoint_shape", """
WITH s AS (SELECT det_id, x1 FROM v_det), v AS (SELECT det_id, i, CASE WHEN i % 3 = 2 THEN (det_id + i) % 3 ELSE x1 + i END AS v FROM s, (SELECT unnest(range(51)) AS i)),
l AS (SELECT det_id, max(i) + 1 AS n, bool_and(i % 3 <> 2 OR v IN (0, 1, 2)) AS flags FROM v GROUP BY det_id)
SELECT CAST(max(n) // 3 AS INT) AS points, CAST(CASE WHEN bool_and(flags) THEN 3 END AS INT) AS dims FROM l HAVING count(DISTINCT n) = 1""")
def keypoint_shape(spark: SparkSession, d: str) -> DataFrame:
    """Shape from all flat keypoint lists (51 numbers, every third a visibility flag)."""
    rows = v_det(spark, d).selectExpr("det_id as id", "transform(sequence(0, 50), i -> if(i % 3 = 2, cast((det_id + i) % 3 as double), x1 + i)) as values")
    return D.keypoint_shape(rows)


@query("agg_21_pose_shape", "SELECT CAST(17 AS INT) AS points, CAST(2 AS INT) AS dims FROM v_gt LIMIT 1")
def pose_shape(spark: SparkSession, d: str) -> DataFrame:
    """Shape of the keypoints in whole label lines, behind class and box."""
    line = "concat(array(double(cls), x1, y1, x2, y2), transform(sequence(0, 33), i -> x1 + i / 7D)) as values"
    return D.keypoint_shape(v_gt(spark, d).selectExpr(line), offset=5, strict=True)


@query("agg_22_benchmark_rollup", f"""
WITH m AS (SELECT DISTINCT image_id, CASE WHEN image_id % 3 = 0 THEN 'aerial' WHEN image_id % 3 = 1 THEN 'street' ELSE 'indoor' END AS dataset FROM v_gt)
SELECT coalesce(dataset, 'all') AS dataset, coalesce(CAST(cls AS VARCHAR), 'all') AS class, count(DISTINCT image_id) AS images, count(*) AS targets FROM v_gt JOIN m USING (image_id)
GROUP BY GROUPING SETS ((), (dataset), (dataset, cls))""")
def benchmark_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Targets and images per dataset and class, with 'all' rows; images are counted once per grouping set."""
    named = v_gt(spark, d).selectExpr("image_id", "case when image_id % 3 = 0 then 'aerial' when image_id % 3 = 1 then 'street' else 'indoor' end as dataset", "cls")
    named.createOrReplaceTempView("bench_targets")
    return spark.sql("""SELECT coalesce(dataset, 'all') AS dataset, coalesce(cast(cls AS string), 'all') AS class, count(DISTINCT image_id) AS images, count(*) AS targets
        FROM bench_targets GROUP BY GROUPING SETS ((), (dataset), (dataset, cls))""")


@query("agg_23_drift_summary", """
WITH a AS (SELECT floor(value / 10) AS bucket, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT floor(value / 10) AS bucket, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1),
j AS (SELECT coalesce(a.bucket, b.bucket) AS bucket, coalesce(a.n / (SELECT sum(n) FROM a), 0) AS p, coalesce(b.n / (SELECT sum(n) FROM b), 0) AS q FROM a FULL JOIN b ON a.bucket = b.bucket)
SELECT CAST(bucket AS BIGINT) AS bucket, round(p, 6) AS p, round(q, 6) AS q, round((q - p) * ln((q + 1e-6) / (p + 1e-6)), 6) AS term FROM j""")
def drift_summary(spark: SparkSession, d: str) -> DataFrame:
    """Training against live distribution: share per bucket and stability terms."""
    events = table(spark, d, "events")
    out = D.population_stability(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "cast(floor(value / 10) as bigint)")
    return out.selectExpr("bucket", "round(p, 6) as p", "round(q, 6) as q", "round(term, 6) as term")


@query("agg_24_embedding_pca")
def embedding_pca(spark: SparkSession, d: str) -> DataFrame:
    """Three principal components of the vector table (the Gramian is accumulated in partitions)."""
    from boxwright.operators.search import pca

    return pca(table(spark, d, "embeddings"), 3)


@query("agg_25_box_polygon_consistency", """
WITH o AS (SELECT image_id, gt_id, gt_id % 97 <> 0 AS has_poly FROM v_gt), t AS (SELECT count(*) AS boxes, count(*) FILTER (has_poly) AS polys FROM o)
SELECT image_id, count(*) AS boxes, count(*) FILTER (has_poly AND NOT (polys > 0 AND t.boxes <> polys)) AS polygons FROM o, t GROUP BY image_id""")
def box_polygon_consistency(spark: SparkSession, d: str) -> DataFrame:
    """If polygons exist but not for every box of the dataset, all polygons are dropped."""
    objects = v_gt(spark, d).selectExpr("image_id", "if(gt_id % 97 <> 0, array(x1, y1), null) as polygon")
    # One row of totals, so the broadcast is bounded.
    totals = F.broadcast(objects.agg(F.expr("count(*) as boxes_all"), F.expr("count(polygon) as polys_all")))
    kept = objects.crossJoin(totals).selectExpr("image_id", "if(polys_all > 0 and boxes_all <> polys_all, null, polygon) as polygon")
    return kept.groupBy("image_id").agg(F.expr("count(*) as boxes"), F.expr("count(polygon) as polygons"))


@query("agg_26_instance_count_check", """
WITH e AS (SELECT 'file' || o_orderkey % 7 AS file, count(*) AS expected FROM orders GROUP BY 1)
SELECT file, expected, expected AS actual, true AS ok FROM e""")
def instance_count_check(spark: SparkSession, d: str) -> DataFrame:
    """Counted instances against an expectation table; a mismatch would read ok = false."""
    orders = table(spark, d, "orders")
    actual = orders.groupBy(F.expr("concat('file', o_orderkey % 7) as file")).agg(F.expr("count(*) as actual"))
    expected = orders.selectExpr("concat('file', o_orderkey % 7) as file").groupBy("file").agg(F.expr("count(*) as expected"))
    return expected.join(actual, "file", "left").selectExpr("file", "expected", "coalesce(actual, 0) as actual", "expected <=> actual as ok")


@query("agg_28_class_prototypes", """
WITH e AS (SELECT label AS cls, i, avg(embedding[i]) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
n AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY cls)) AS nm FROM e)
SELECT CAST(c.cls AS INT) AS cls, CAST(g.i - 1 AS INT) AS pos, round(coalesce(v / nm, 0), 6) AS v FROM (SELECT unnest(range(12)) AS cls) c CROSS JOIN (SELECT unnest(range(1, 65)) AS i) g LEFT JOIN n ON n.cls = c.cls AND n.i = g.i""")
def class_prototypes(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector per class, scaled to unit length; zeros for classes without vectors."""
    from boxwright.operators.search import prototypes

    classes = spark.range(12).selectExpr("cast(id as int) as cls")
    proto = prototypes(table(spark, d, "embeddings").selectExpr("label as cls", "embedding"), classes, 64)
    return proto.selectExpr("cls", "posexplode(vector) as (pos, v)").selectExpr("cls", "pos", "round(v, 6) as v")


@query("snk_02_detection_summary", """
SELECT image_id, det_id, 'class_' || cls AS name, cls AS class, round(conf, 5) AS confidence, round(x1 / 640, 9) AS bx1, round(y2 / 480, 9) AS by2 FROM v_det""")
def detection_summary(spark: SparkSession, d: str) -> DataFrame:
    named = v_det(spark, d).selectExpr("*", "concat('class_', cls) as name")
    rows = exports.summary_rows(named, "640", "480", decimals=9)
    return rows.selectExpr("image_id", "det_id", "name", "class", "confidence", "box.x1 as bx1", "box.y2 as by2")


@query("snk_03_nested_to_text", """
SELECT image_id, det_id, '{"cx":' || CAST((x1 + x2) / 2 AS VARCHAR) || ',"cy":' || CAST((y1 + y2) / 2 AS VARCHAR) || '}' AS centre FROM v_det""")
def nested_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Nested columns as text, ready for CSV."""
    nested = v_det(spark, d).selectExpr("image_id", "det_id", "struct((x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy) as centre")
    return exports.nested_to_text(nested)


@query("snk_04_prediction_json", """
SELECT det_id, CASE WHEN image_id % 2 = 0 THEN CAST(image_id AS VARCHAR) ELSE 'img_' || image_id END AS image_id, CAST(cls + 1 AS INT) AS category_id, round(x1, 3) AS b0, round(y2 - y1, 3) AS b3, round(conf, 5) AS score FROM v_det""")
def prediction_json(spark: SparkSession, d: str) -> DataFrame:
    rows = exports.prediction_rows(v_det(spark, d), "if(image_id % 2 = 0, lpad(image_id, 12, '0'), concat('img_', image_id))", "cls + 1")
    return rows.selectExpr("det_id", "image_id", "category_id", "bbox[0] as b0", "bbox[3] as b3", "score")


@query("snk_05_oriented_json", f"""
WITH rot AS ({V_ROT}) SELECT det_id, 'class-' || cls AS class, round(r, 3) AS r, round(cx + w / 2 * cos(r) - h / 2 * sin(r), 3) AS p1 FROM rot""")
def oriented_json(spark: SparkSession, d: str) -> DataFrame:
    rows = exports.oriented_rows(v_rot(spark, d))
    return rows.selectExpr("det_id", "concat('class-', cls) as class", "rbox[4] as r", "poly[0] as p1")


@query("snk_07_manifest_key")
def manifest_key(spark: SparkSession, d: str) -> DataFrame:
    """Cache key of the file manifest (documents as files)."""
    return exports.manifest_key(table(spark, d, "documents").selectExpr("concat(source, '/', doc_id) as path", "n_chars as length"))


@query("snk_08_sync_actions", """
WITH e AS (SELECT image_id AS file, split_hint AS split, n_src AS h FROM v_image WHERE image_id % 5 <> 0),
a AS (SELECT image_id AS file, CASE WHEN image_id % 4 = 0 THEN 'old' ELSE split_hint END AS split, n_src + CASE WHEN image_id % 9 = 0 THEN 1 ELSE 0 END AS h FROM v_image WHERE image_id % 3 <> 0)
SELECT coalesce(e.file, a.file) AS file, CASE WHEN e.file IS NULL THEN 'delete' WHEN a.file IS NULL THEN 'write' WHEN a.h <> e.h THEN 'write' WHEN a.split <> e.split THEN 'move' ELSE 'skip' END AS action FROM e FULL JOIN a ON e.file = a.file""")
def sync_actions(spark: SparkSession, d: str) -> DataFrame:
    """Upsert and orphan actions from content hashes."""
    images = v_image(spark, d)
    expected = exports.content_hash(images.where("image_id % 5 <> 0").selectExpr("image_id as file", "split_hint as split", "n_src"), "file", "n_src")
    held = images.where("image_id % 3 <> 0").selectExpr(
        "image_id as file", "if(image_id % 4 = 0, 'old', split_hint) as split", "n_src + if(image_id % 9 = 0, 1, 0) as n_src"
    )
    return exports.sync_actions(expected, exports.content_hash(held, "file", "n_src"))


@query("snk_09_crop_manifest", """
WITH c AS (SELECT *, (x2 - x1) * 1.02E0 + 10 AS w, (y2 - y1) * 1.02E0 + 10 AS h, row_number() OVER (PARTITION BY image_id, cls ORDER BY det_id) AS crop_no FROM v_det)
SELECT image_id, det_id, crop_no, CAST(least(greatest(trunc((x1 + x2) / 2 - w / 2), 0), 640) AS BIGINT) AS crop_x1, CAST(least(greatest(trunc((y1 + y2) / 2 - h / 2), 0), 480) AS BIGINT) AS crop_y1,
       CAST(least(greatest(trunc((x1 + x2) / 2 + w / 2), 0), 640) AS BIGINT) AS crop_x2, CAST(least(greatest(trunc((y1 + y2) / 2 + h / 2), 0), 480) AS BIGINT) AS crop_y2 FROM c""")
def crop_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Crop rectangles with a running number per image and class (blocked by confidence, so hot images split)."""
    from boxwright.operators.scans import blocked_scan

    crops = B.crop_rectangle(v_det(spark, d), "640", "480")
    numbered = blocked_scan(crops, ["image_id", "cls"], ["det_id"], "floor((1 - conf) * 4096)", sums={"crop_no": "1L"})
    return numbered.select("image_id", "det_id", "crop_no", "crop_x1", "crop_y1", "crop_x2", "crop_y2")


@query("snk_10_run_logs", """
SELECT 'run' || user_id % 20 AS run_id, count(*) AS epochs, round(max(CAST(printf('%.6g', value) AS DOUBLE)), 6) AS best FROM events GROUP BY 1""")
def run_logs(spark: SparkSession, d: str) -> DataFrame:
    """Per-run CSV lines read back with their types and collected per run."""
    lines = table(spark, d, "events").selectExpr("concat('run', user_id % 20) as run_id", "concat_ws(',', event_id, value) as line")
    rows = lines.selectExpr("run_id", "from_csv(line, 'epoch bigint, fitness double') as r").selectExpr("run_id", "r.*")
    return rows.groupBy("run_id").agg(F.expr("count(*) as epochs"), F.expr("round(max(fitness), 6) as best"))


# Splits and limits


@query("top_01_top_k_per_image", "SELECT image_id, det_id, rank FROM (SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS rank FROM v_det) WHERE rank <= 5")
def top_k_per_image(spark: SparkSession, d: str) -> DataFrame:
    from boxwright.operators.nms import top_candidates

    return top_candidates(v_det(spark, d), 5).select("image_id", "det_id", "rank")


@query("top_02_weighted_split", f"SELECT o_orderkey, CASE WHEN {u('o_orderkey')} < 0.9E0 THEN 'train' WHEN {u('o_orderkey')} < 1.0E0 THEN 'val' ELSE 'test' END AS split FROM orders")
def weighted_split(spark: SparkSession, d: str) -> DataFrame:
    return D.weighted_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("top_03_stratified_split", f"""
SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {u('o_orderkey', 3)}, o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderpriority) * 0.8E0) AS picked FROM orders""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """Exactly floor(0.8 n) rows of each class go to training; classes are few, so their rows are never ranked whole."""
    return D.ranked_quota(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", "floor(n * 0.8D)", 3)


@query("top_04_auto_validation", f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {u('o_orderkey', 4)}, o_orderkey) <= greatest(1, count(*) OVER () // 10) AS picked FROM orders""")
def auto_validation(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the training rows, at least one, when a dataset has no validation split."""
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "0 as one")
    return D.ranked_quota(rows, "one", "o_orderkey", "if(n >= 2, greatest(1, n div 10), 0)", 4).select("o_orderkey", "picked")


@query("top_05_fold_assignment", f"SELECT o_orderkey, CAST(floor({u('o_orderkey', 5)} * 5) AS INT) AS fold FROM orders")
def fold_assignment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey", f"{D.fold_of('o_orderkey', 5, 5)} as fold")


@query("top_09_top_trials", "SELECT o_orderkey AS trial, o_totalprice AS fitness FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_trials(spark: SparkSession, d: str) -> DataFrame:
    trials = table(spark, d, "orders").selectExpr("o_orderkey as trial", "o_totalprice as fitness")
    return trials.orderBy(F.desc("fitness"), "trial").limit(100)


@query("top_11_direct_predictions", "SELECT image_id, det_id, rank FROM (SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS rank FROM v_det WHERE conf > 0.25E0) WHERE rank <= 10")
def direct_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Suppression-free path: strict confidence filter, then the first detections per image."""
    from boxwright.operators.nms import top_candidates

    return top_candidates(v_det(spark, d).where("conf > 0.25D"), 10).select("image_id", "det_id", "rank")


@query("win_13_rect_batches", """
WITH i AS (SELECT image_id, (300 + image_id * 37 % 700) / (300.0E0 + image_id * 91 % 650) AS ar FROM v_image),
r AS (SELECT image_id, ar, (row_number() OVER (ORDER BY ar, image_id % 64, image_id) - 1) // 16 AS batch FROM i),
s AS (SELECT batch, CASE WHEN max(ar) < 1 THEN max(ar) ELSE 1 END AS sh, CASE WHEN min(ar) > 1 THEN 1 / min(ar) ELSE 1 END AS sw FROM r GROUP BY batch)
SELECT image_id, batch, CAST(ceil(sh * 640 / 32 + 0.5E0) * 32 AS INT) AS height, CAST(ceil(sw * 640 / 32 + 0.5E0) * 32 AS INT) AS width FROM r JOIN s USING (batch)""")
def rect_batches(spark: SparkSession, d: str) -> DataFrame:
    images = v_image(spark, d).selectExpr("image_id", "300 + image_id * 37 % 700 as height", "300 + image_id * 91 % 650 as width")
    return D.rect_batches(images, 16).select("image_id", "batch", "height", "width")


@query("win_14_best_epoch", """
WITH l AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, value AS fitness, event_id FROM events),
b AS (SELECT *, max(fitness) OVER (PARTITION BY run ORDER BY epoch) AS best, max(fitness) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM l),
e AS (SELECT *, max(CASE WHEN prev IS NULL OR fitness > prev OR prev = 0 THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS best_epoch FROM b)
SELECT run, min(epoch) FILTER (epoch - best_epoch >= 20) AS stop_epoch, CAST(max(best_epoch) AS BIGINT) AS best_epoch, max(best) AS best FROM e GROUP BY run""")
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    """Best value so far, its epoch, and the first epoch that is ``patience`` epochs past it."""
    logs = table(spark, d, "events").selectExpr("user_id as run", "event_id as step", "value as fitness")
    return D.best_epochs(logs, 20, "step div 1000000")
