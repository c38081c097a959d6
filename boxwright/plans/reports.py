"""Distributions, classifier cells, slices, drift and chart queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.operators import boxes as B
from boxwright.operators import datasets as D
from boxwright.operators import evaluation as E
from boxwright.operators import tracks as T
from boxwright.plans import sqltext as S
from boxwright.plans.bridge import table, v_det, v_gt
from boxwright.plans.evaluation import match_table
from boxwright.plans.projections import rounded
from boxwright.plans.registry import query
from boxwright.plans.tracking import _F, framed
from boxwright.session import materialize

BOX = ("x1", "y1", "x2", "y2")


@query("prj_01_inverse_formats", """
SELECT image_id, det_id, form, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM v_det, (SELECT unnest(['centre', 'normalised', 'top_left']) AS form)""")
def inverse_formats(spark: SparkSession, d: str) -> DataFrame:
    """Centre, normalised and top-left forms back to corners."""
    forms = B.centre_to_top_left(B.all_formats(v_det(spark, d), "640D", "480D")).drop(*BOX)
    back = {
        "centre": B.from_centre(forms), "normalised": B.from_centre(forms, "640D", "480D", ("cxn", "cyn", "wn", "hn")), "top_left": B.from_top_left(forms),
    }
    one, *rest = [df.selectExpr("image_id", "det_id", f"'{name}' as form", *rounded(*BOX)) for name, df in back.items()]
    for df in rest:
        one = one.unionByName(df)
    return one


@query("agg_03_class_histogram", "SELECT cls, count(*) AS n FROM v_gt GROUP BY cls")
def class_histogram(spark: SparkSession, d: str) -> DataFrame:
    return v_gt(spark, d).groupBy("cls").agg(F.expr("count(*) as n"))


@query("agg_03_size_distribution", """
WITH c AS (SELECT (x2 - x1) / 640 AS w, (y2 - y1) / 480 AS h FROM v_gt), r AS (SELECT min(w) AS aw, max(w) AS bw, min(h) AS ah, max(h) AS bh FROM c)
SELECT CAST(least(floor((w - aw) / (bw - aw) * 50), 49) AS INT) AS bx, CAST(least(floor((h - ah) / (bh - ah) * 50), 49) AS INT) AS by, count(*) AS n FROM c, r GROUP BY ALL""")
def size_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Two-dimensional histogram of box sizes over all boxes."""
    return D.grid_histogram(v_gt(spark, d).selectExpr("(x2 - x1) / 640 as w", "(y2 - y1) / 480 as h"), "w", "h")


@query("agg_08_class_confusion", """
WITH p AS (SELECT doc_id, CAST(substr(source, 4) AS INT) % 10 AS truth, k, ((doc_id * (k + 3) * 37 + k * 101 + doc_id % 91) % 997) / 997.0E0 AS p FROM documents, (SELECT unnest(range(10)) AS k)),
b AS (SELECT doc_id, any_value(truth) AS truth, arg_min(k, {'p': -p, 'k': k}) AS pred FROM p GROUP BY doc_id)
SELECT CAST(pred AS INT) AS pred, truth, count(*) AS n FROM b GROUP BY ALL""")
def class_confusion(spark: SparkSession, d: str) -> DataFrame:
    """matrix[pred][truth] of a classifier."""
    best = "array_min(transform(sequence(0, 9), k -> struct(-((doc_id * (k + 3) * 37 + k * 101 + doc_id % 91) % 997) / 997D as p, k as k))).k"
    return D.class_confusion(table(spark, d, "documents").selectExpr(f"{best} as pred", "cast(substring(source, 4) as int) % 10 as truth"))


_FINE = "CASE WHEN image_id % 50 = 0 THEN cls + 10 WHEN image_id % 500 = 1 THEN cls + 20 ELSE cls END"


@query("agg_11_rarity_spread", f"""WITH {S.match_ctes()},
s_det AS (SELECT image_id, det_id, conf, {_FINE} AS cls FROM v_det), s_gt AS (SELECT image_id, gt_id, {_FINE} AS cls FROM v_gt), {S.ap_ctes("s_det", "s_gt")},
f AS (SELECT cls, count(DISTINCT image_id) AS n FROM s_gt GROUP BY cls)
SELECT CASE WHEN n <= 10 THEN 'rare' WHEN n <= 100 THEN 'common' ELSE 'frequent' END AS rarity, count(*) AS n_ap, round(avg(ap), 6) AS ap FROM ap JOIN f USING (cls) GROUP BY 1""")
def rarity_spread(spark: SparkSession, d: str) -> DataFrame:
    """AP by rarity where classes differ in it: some live in a fiftieth or a five hundredth of the images."""
    fine = B.replace_columns(v_gt(spark, d), cls=_FINE)
    tagged = B.replace_columns(match_table(spark, d), cls=_FINE)
    ap = E.average_precision(E.cumulative_counts(materialize(E.confidence_histogram(tagged))), E.class_truths(fine))
    freq = fine.groupBy("cls").agg(F.expr("count(distinct image_id) as n"))
    return ap.join(freq, "cls").groupBy(F.expr("case when n <= 10 then 'rare' when n <= 100 then 'common' else 'frequent' end as rarity")).agg(
        F.expr("count(*) as n_ap"), F.expr("round(avg(ap), 6) as ap")
    )


@query("agg_11_size_counts", "SELECT CAST(CASE WHEN a < 1024 THEN 0 WHEN a < 9216 THEN 1 ELSE 2 END AS INT) AS size_slice, count(*) AS n FROM (SELECT (x2 - x1) * (y2 - y1) / 4 AS a FROM v_gt) GROUP BY 1")
def size_counts(spark: SparkSession, d: str) -> DataFrame:
    """Objects per size slice with the published bounds, at half resolution."""
    return v_gt(spark, d).groupBy(F.expr(f"{D.size_slice('((x2 - x1) * (y2 - y1) / 4)')} as size_slice")).agg(F.expr("count(*) as n"))


@query("agg_12_frame_totals", f"WITH {_F} SELECT stream_id, frame, count(*) AS total FROM f WHERE frame % 30 = 0 GROUP BY ALL")
def frame_totals(spark: SparkSession, d: str) -> DataFrame:
    """Line totals of the sampled frames."""
    return T.frame_totals(framed(spark, d))


@query("win_12_chart_grid", f"""WITH {_F}, c AS (SELECT stream_id, cls, frame, count(*) AS n FROM f WHERE NOT (cls = 4 AND frame % 3 > 0) GROUP BY ALL),
k AS (SELECT stream_id, frame, row_number() OVER (PARTITION BY stream_id ORDER BY frame DESC) AS r FROM (SELECT DISTINCT stream_id, frame FROM c))
SELECT k.stream_id, s.cls, k.frame, coalesce(n, 0) AS n FROM k JOIN (SELECT DISTINCT stream_id, cls FROM c) s ON s.stream_id = k.stream_id
LEFT JOIN c ON c.stream_id = k.stream_id AND c.cls = s.cls AND c.frame = k.frame WHERE r <= 45""")
def chart_grid(spark: SparkSession, d: str) -> DataFrame:
    """The last 45 points of every class, zero where it was not seen."""
    counts = framed(spark, d).where("not (cls = 4 and frame % 3 > 0)").groupBy("stream_id", "cls", "frame").agg(F.expr("count(*) as n"))
    return T.chart_grid(counts)


@query("agg_23_drift_test", """
WITH v AS (SELECT value AS v, count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b FROM events WHERE value IS NOT NULL GROUP BY 1),
c AS (SELECT sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb FROM v WINDOW w AS (ORDER BY v)),
s AS (SELECT floor(value / 10) AS bucket, count(*) FILTER (event_id % 2 = 0) / (SELECT sum(a) FROM v) AS p, count(*) FILTER (event_id % 2 = 1) / (SELECT sum(b) FROM v) AS q FROM events GROUP BY 1)
SELECT round((SELECT max(abs(fa - fb)) FROM c), 9) AS ks, CAST((SELECT sum(a) FROM v) AS BIGINT) AS n_train, CAST((SELECT sum(b) FROM v) AS BIGINT) AS n_live,
  (SELECT round(sum((q - p) * ln((q + 1e-6) / (p + 1e-6))), 6) FROM s) AS stability""")
def drift_test(spark: SparkSession, d: str) -> DataFrame:
    """Kolmogorov-Smirnov statistic and stability index of training against live values."""
    events = table(spark, d, "events")
    train, seen = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    total = D.population_stability(train, seen, "cast(floor(value / 10) as bigint)").agg(F.expr("round(sum(term), 6) as stability"))
    # both sides are one row
    return D.ks_statistic(train, seen, "value").selectExpr("round(ks, 9) as ks", "n_train", "n_live").crossJoin(total)


@query("agg_26_instance_mismatch", """
WITH e AS (SELECT 'file' || o_orderkey % 7 AS file, count(*) AS expected FROM orders GROUP BY 1),
a AS (SELECT 'file' || l_orderkey % 7 AS file, count(DISTINCT l_orderkey) AS actual FROM lineitem WHERE l_orderkey % 7 <> 5 GROUP BY 1)
SELECT file, expected, coalesce(actual, 0) AS actual, expected = coalesce(actual, 0) AS ok FROM e LEFT JOIN a USING (file)""")
def instance_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Instances found in the data against a manifest counted from another table: files that miss some are not ok."""
    expected = table(spark, d, "orders").groupBy(F.expr("concat('file', o_orderkey % 7) as file")).agg(F.expr("count(*) as expected"))
    found = table(spark, d, "lineitem").where("l_orderkey % 7 <> 5").groupBy(F.expr("concat('file', l_orderkey % 7) as file")).agg(F.expr("count(distinct l_orderkey) as actual"))
    return expected.join(found, "file", "left").selectExpr("file", "expected", "coalesce(actual, 0L) as actual", "expected = coalesce(actual, 0L) as ok")
