"""Evaluation queries: overlap joins, matching, average precision, confusion, curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.operators import evaluation as E
from boxwright.operators import matching as M
from boxwright.operators.overlap import iou_join
from boxwright.operators.scans import blocked_scan
from boxwright.plans import sqltext as S
from boxwright.plans.bridge import CLASSES, table, v_det, v_gt
from boxwright.plans.registry import query
from boxwright.session import materialize


def r6(*columns: str) -> list[str]:
    """Round columns to six places under their own names."""
    return [f"round({c}, 6) as {c}" for c in columns]


@query("jon_02_overlap_join", f"""
SELECT d.image_id, d.cls, d.det_id, g.gt_id, round({S.iou("d.", "g.")}, 6) AS iou
FROM v_det d JOIN v_gt g ON d.image_id = g.image_id AND d.cls = g.cls WHERE {S.iou("d.", "g.")} >= 0.5E0""")
def overlap_join(spark: SparkSession, d: str) -> DataFrame:
    pairs = iou_join(v_det(spark, d), v_gt(spark, d), ["image_id", "cls"], 0.5)
    return pairs.selectExpr("image_id", "cls", "det_id", "r_gt_id as gt_id", *r6("iou"))


_FAMILY = """
SELECT image_id, det_id, gt_id, round(giou, 6) AS giou, round(iou - rho / diag, 6) AS diou,
       round(iou - (rho / diag + v * (v / (v - iou + 1 + 1e-7))), 6) AS ciou
FROM (SELECT *, i / u AS iou, i / u - (hull - u) / hull AS giou, 4 / pi() ** 2 * (atan(w2 / h2) - atan(w1 / h1)) ** 2 AS v
  FROM (SELECT *, w1 * h1 + w2 * h2 - i + 1e-7 AS u, cw * ch + 1e-7 AS hull, cw ** 2 + ch ** 2 + 1e-7 AS diag
    FROM (SELECT d.image_id, d.det_id, g.gt_id, {inter} AS i, d.x2 - d.x1 AS w1, d.y2 - d.y1 + 1e-7 AS h1,
             g.x2 - g.x1 AS w2, g.y2 - g.y1 + 1e-7 AS h2, greatest(d.x2, g.x2) - least(d.x1, g.x1) AS cw,
             greatest(d.y2, g.y2) - least(d.y1, g.y1) AS ch,
             ((g.x1 + g.x2 - d.x1 - d.x2) ** 2 + (g.y1 + g.y2 - d.y1 - d.y2) ** 2) / 4 AS rho
      FROM v_det d JOIN v_gt g ON d.image_id = g.image_id AND d.cls = g.cls WHERE {iou} >= 0.5E0)))"""


@query("jon_02_overlap_family", _FAMILY.format(inter=S.inter("d.", "g."), iou=S.iou("d.", "g.")))
def overlap_family(spark: SparkSession, d: str) -> DataFrame:
    """Generalised, distance and complete overlap of the qualifying pairs."""
    pairs = iou_join(v_det(spark, d), v_gt(spark, d), ["image_id", "cls"], 0.5)
    scores = G.iou_family()
    return pairs.selectExpr(
        "image_id", "det_id", "r_gt_id as gt_id", *[f"round({scores[n]}, 6) as {n}" for n in ("giou", "diou", "ciou")]
    )


@query("jon_06_greedy_match", f"""
WITH {S.match_ctes()}
SELECT d.image_id, d.det_id, """ + ", ".join(
    f"CAST(coalesce(max(CASE WHEN t.p = {p} THEN 1 END), 0) AS INT) AS tp{p}" for p in M.LEVELS
) + " FROM v_det d LEFT JOIN tp t USING (image_id, det_id) GROUP BY d.image_id, d.det_id")
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    return match_table(spark, d).select("image_id", "det_id", *M.level_columns())


def match_table(spark: SparkSession, d: str) -> DataFrame:
    return M.match_predictions(v_det(spark, d), v_gt(spark, d))


_CONFUSION = f"""
pairs AS (SELECT d.image_id, d.det_id, d.cls AS pred, g.gt_id, g.cls AS truth, {S.iou("d.", "g.")} AS iou
          FROM v_det d JOIN v_gt g ON d.image_id = g.image_id WHERE d.conf > 0.25E0),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, gt_id) AS k
        FROM pairs WHERE iou > 0.45E0) WHERE k = 1),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, gt_id ORDER BY iou DESC, det_id) AS k2 FROM one) WHERE k2 = 1)"""


@query("jon_07_confusion_match", f"WITH {_CONFUSION} SELECT image_id, gt_id, det_id, pred, truth, round(iou, 6) AS iou FROM m")
def confusion_match(spark: SparkSession, d: str) -> DataFrame:
    pairs = M.confusion_pairs(v_det(spark, d), v_gt(spark, d))
    return pairs.selectExpr("image_id", "gt_id", "det_id", "pred", "truth", *r6("iou"))


@query("agg_09_confusion_matrix", f"""WITH {_CONFUSION},
cells AS (SELECT pred, truth FROM m
  UNION ALL SELECT d.cls, 10 FROM v_det d ANTI JOIN m ON d.image_id = m.image_id AND d.det_id = m.det_id WHERE d.conf > 0.25E0
  UNION ALL SELECT 10, g.cls FROM v_gt g ANTI JOIN m ON g.image_id = m.image_id AND g.gt_id = m.gt_id),
c AS (SELECT pred, truth, count(*) AS n FROM cells GROUP BY pred, truth)
SELECT pred, truth, n, round(n / (sum(n) OVER (PARTITION BY truth) + 1e-9), 6) AS share FROM c""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Matrix cells with the share of their truth column; index 10 is background."""
    cells = M.confusion_counts(v_det(spark, d), v_gt(spark, d), CLASSES)
    return cells.selectExpr("pred", "truth", "n", "round(n / (sum(n) over (partition by truth) + 1e-9D), 6) as share")


def cumulative(spark: SparkSession, d: str) -> DataFrame:
    return E.cumulative_counts(materialize(E.confidence_histogram(match_table(spark, d))))


@query("agg_05_average_precision", f"WITH {S.match_ctes()}, {S.ap_ctes()} SELECT cls, level, round(ap, 6) AS ap FROM ap")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    ap = E.average_precision(cumulative(spark, d), E.class_truths(v_gt(spark, d)))
    return ap.selectExpr("cls", "level", *r6("ap"))


@query("agg_06_summary_metrics", f"""WITH {S.match_ctes()}, {S.ap_ctes()},
per AS (SELECT cls, max(CASE WHEN level = 50 THEN ap END) AS ap50, max(CASE WHEN level = 75 THEN ap END) AS ap75, avg(ap) AS ap50_95 FROM ap GROUP BY cls)
SELECT CAST(c.cls AS INT) AS cls, round(coalesce(ap50, (SELECT avg(ap50) FROM per)), 6) AS ap50, round(coalesce(ap75, (SELECT avg(ap75) FROM per)), 6) AS ap75,
       round(coalesce(ap50_95, (SELECT avg(ap50_95) FROM per)), 6) AS ap50_95, round((SELECT avg(ap50_95) FROM per), 6) AS fitness
FROM (SELECT unnest(range(12)) AS cls) c LEFT JOIN per ON per.cls = c.cls""")
def summary_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per-class metrics over the declared classes; a class without truth takes the overall mean."""
    per = E.summarize(E.average_precision(cumulative(spark, d), E.class_truths(v_gt(spark, d))))
    every = spark.range(CLASSES + 2).selectExpr("cast(id as int) as cls")
    names = ("ap50", "ap75", "ap50_95")
    # One row of means, so the broadcast is bounded.
    means = F.broadcast(per.agg(*[F.expr(f"avg({c}) as mean_{c}") for c in names]))
    return every.join(per, "cls", "left").crossJoin(means).selectExpr(
        "cls", *[f"round(coalesce({c}, mean_{c}), 6) as {c}" for c in names], "round(coalesce(nanvl(mean_ap50_95, 0D), 0D), 6) as fitness"
    )


_SHRUNK = """
s_det AS (SELECT image_id, det_id, cls, conf, x1 + 0.1E0 * (x2 - x1) AS x1, y1, x2 - 0.1E0 * (x2 - x1) AS x2, y2 FROM v_det),
s_gt AS (SELECT image_id, gt_id, cls, x1 + 0.1E0 * (x2 - x1) AS x1, y1, x2 - 0.1E0 * (x2 - x1) AS x2, y2 FROM v_gt)"""


@query("agg_07_two_part_metrics", f"""WITH {_SHRUNK}, {S.match_ctes()}, {S.ap_ctes()}, {S.match_ctes("s_det", "s_gt", "s_")}, {S.ap_ctes("s_det", "s_gt", "s_")}
SELECT a.cls, round(avg(a.ap), 6) AS box_map, round(avg(b.ap), 6) AS part_map, round(avg(a.ap) + avg(b.ap), 6) AS fitness
FROM ap a JOIN s_ap b ON a.cls = b.cls AND a.level = b.level GROUP BY a.cls""")
def two_part_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Box metrics next to a second overlap set (here: the inner 80% of each box); fitness is the sum."""

    def inner(df: DataFrame) -> DataFrame:
        moved = {"x1": "x1 + 0.1D * (x2 - x1) as x1", "x2": "x2 - 0.1D * (x2 - x1) as x2"}
        return df.selectExpr(*[moved.get(c, c) for c in df.columns])

    truths = E.class_truths(v_gt(spark, d))
    box = E.summarize(E.average_precision(cumulative(spark, d), truths)).selectExpr("cls", "ap50_95 as b")
    shrunk = M.match_predictions(inner(v_det(spark, d)), inner(v_gt(spark, d)))
    part = E.average_precision(E.cumulative_counts(materialize(E.confidence_histogram(shrunk))), truths)
    part = E.summarize(part).selectExpr("cls", "ap50_95 as p")
    return box.join(part, "cls").selectExpr("cls", "round(b, 6) as box_map", "round(p, 6) as part_map", "round(b + p, 6) as fitness")


@query("win_05_cumulative_counts", f"""WITH {S.match_ctes()}, {S.ap_ctes()}
SELECT cls, conf, CAST(max(c) AS BIGINT) AS tp, CAST(max(r) - max(c) AS BIGINT) AS fp FROM cum WHERE p = 50 GROUP BY cls, conf""")
def cumulative_counts(spark: SparkSession, d: str) -> DataFrame:
    return cumulative(spark, d).selectExpr("cls", "conf", "cum_tp50 as tp", "cum_n - cum_tp50 as fp")


@query("win_06_precision_envelope", f"""WITH {S.match_ctes()}, {S.ap_ctes()},
ends AS (SELECT cls, conf, max(c) / max(r) AS prec FROM cum WHERE p = 50 GROUP BY cls, conf)
SELECT cls, conf, round(max(prec) OVER (PARTITION BY cls ORDER BY conf), 6) AS envelope FROM ends""")
def precision_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Running maximum of precision from the low-confidence end."""
    cum = cumulative(spark, d).selectExpr("cls", "conf", "cum_tp50 / cum_n as prec")
    env = blocked_scan(cum, ["cls"], ["conf"], f"floor(conf * {E.CONF_BLOCKS})", maxs={"envelope": "prec"})
    return env.selectExpr("cls", "conf", *r6("envelope"))


_CURVES = f"""
{S.match_ctes()}, {S.ap_ctes()},
ends AS (SELECT cls, conf, max(r) AS r, max(c) AS c, min(r) AS r_first, min(c) AS c_first FROM cum WHERE p = 50 GROUP BY cls, conf),
lines AS (SELECT e.*, n_gt, lead(conf) OVER w AS conf2, lead(r_first) OVER w AS r2, lead(c_first) OVER w AS c2 FROM ends e JOIN truth USING (cls) WINDOW w AS (PARTITION BY cls ORDER BY conf DESC)),
axis AS (SELECT cls, k, k * (1.0E0 / 999) AS x, n_gt FROM truth, (SELECT unnest(range(1000)) AS k)),
curve AS (SELECT a.cls, a.k, a.n_gt,
   coalesce(CASE WHEN l.conf2 IS NULL THEN l.c / l.r ELSE l.c / l.r + (l.c2 / l.r2 - l.c / l.r) * (l.conf - a.x) / (l.conf - l.conf2) END, 1.0) AS prec,
   coalesce(CASE WHEN l.conf2 IS NULL THEN l.c ELSE l.c + (l.c2 - l.c) * (l.conf - a.x) / (l.conf - l.conf2) END, 0.0) / (a.n_gt + 1e-16) AS rec
   FROM axis a ASOF LEFT JOIN lines l ON a.cls = l.cls AND a.x <= l.conf)"""


def curves(spark: SparkSession, d: str) -> DataFrame:
    return E.precision_curve(cumulative(spark, d), E.class_truths(v_gt(spark, d)))


@query("win_07_curve_resampling", f"WITH {_CURVES} SELECT cls, k, round(prec, 6) AS p, round(rec, 6) AS r FROM curve")
def curve_resampling(spark: SparkSession, d: str) -> DataFrame:
    return curves(spark, d).selectExpr("cls", "k", *r6("p", "r"))


@query("agg_10_operating_point", f"""WITH {_CURVES},
f AS (SELECT *, 2 * prec * rec / (prec + rec + 1e-16) AS f1 FROM curve),
mf AS (SELECT k, avg(f1) AS f1 FROM f GROUP BY k),
smooth AS (SELECT j.k, sum(m.f1) / 101 AS s FROM (SELECT unnest(range(1000)) AS k) j, (SELECT unnest(range(-50, 51)) AS o) o2
           JOIN mf m ON m.k = greatest(0, least(999, j.k + o)) GROUP BY j.k),
best AS (SELECT k FROM smooth ORDER BY round(s, 12) DESC, k LIMIT 1)
SELECT f.cls, f.k, round(prec, 6) AS p, round(rec, 6) AS r, round(f1, 6) AS f1, round_even(rec * n_gt, 0) AS tp,
       round_even(round_even(rec * n_gt, 0) / (prec + 1e-16) - round_even(rec * n_gt, 0), 0) AS fp FROM f JOIN best USING (k)""")
def operating_point(spark: SparkSession, d: str) -> DataFrame:
    op = E.operating_point(curves(spark, d))
    return op.selectExpr("cls", "k", *r6("p", "r", "f1"), "tp", "fp")
