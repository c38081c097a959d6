"""Precision, recall and average precision from a match table.

Detections are first counted per (class, confidence). Every later step works on those counts, so equal
confidences, however many, cost one row. Among equal confidences true positives come first (the order there is
unspecified in the published method); all curves follow that rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.operators.matching import LEVELS, level_columns
from boxwright.operators.scans import blocked_scan

CURVE = 999  # intervals of the 1000-point confidence axis
CONF_BLOCKS = 1024


def confidence_histogram(match: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """Detections and true positives per (class, confidence)."""
    sums = [F.expr(f"sum({c}) as {c}") for c in level_columns(levels)]
    return match.groupBy("cls", "conf").agg(F.expr("count(*) as n"), *sums)


def cumulative_counts(hist: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """Running detections and true positives in descending confidence, with the previous confidence."""
    return blocked_scan(
        hist.selectExpr("*", "-conf as _desc"), ["cls"], ["_desc"], f"floor((1 - conf) * {CONF_BLOCKS})",
        lags={"prev_conf": "conf"},
        sums={"cum_n": "n", **{f"cum_{c}": c for c in level_columns(levels)}},
    ).drop("_desc")


def class_truths(gt: DataFrame) -> DataFrame:
    return gt.groupBy("cls").agg(F.expr("count(*) as n_gt"))


def average_precision(cum: DataFrame, truths: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """101-point interpolated AP per (class, level); classes are those of the truth table.

    Only the knots around the 101 recall points matter: for a recall x, c is the number of true positives it
    allows, ``ahead`` the detections before the next true positive, and ``e`` the envelope from there on.
    """
    wide = ", ".join(f"{p}, tp{p}, cum_tp{p}" for p in levels)
    long = cum.join(truths, "cls").selectExpr(
        "cls", "n_gt", "n_gt + 1e-16D as m", "n", "cum_n", f"stack({len(levels)}, {wide}) as (level, tp, cum_tp)"
    )
    points = long.where("tp > 0").selectExpr(
        "*", "(cum_tp - tp) / m as rec0", "cum_tp / m as rec1", "cum_tp / (cum_n - n + tp) as p_end"
    ).selectExpr(
        "*",
        "filter(sequence(greatest(cast(floor(rec0 * 100) as int) - 1, 0), least(cast(floor(rec1 * 100) as int) + 1, 100)),"
        " k -> k * 0.01D < rec1) as reached",
    ).selectExpr("*", "array_max(reached) as k_max", "filter(reached, k -> k * 0.01D >= rec0) as ks")
    tops = points.where("k_max is not null").groupBy("cls", "level", F.expr("k_max as k")).agg(F.expr("max(p_end) as p_top"))
    knots = points.selectExpr("cls", "level", "m", "cum_n - n - (cum_tp - tp) as shift", "explode(ks) as k", "n_gt").selectExpr(
        "*", "floor(k * 0.01D * n_gt) as g"
    ).selectExpr(
        "cls", "level", "k", "shift",
        "case when (g + 1) / m <= k * 0.01D then g + 1 when g / m <= k * 0.01D then g else g - 1 end as c",
    ).selectExpr("cls", "level", "k", "c", "shift + c as ahead")
    totals = long.groupBy("cls", "level").agg(F.expr("sum(n) as n_det"), F.expr("sum(tp) as n_tp"))
    frame = truths.selectExpr("cls", "n_gt", f"explode(array({', '.join(map(str, levels))})) as level").join(
        totals, ["cls", "level"], "left"
    ).selectExpr("*", "n_gt + 1e-16D as m", "explode(sequence(0, 100)) as k", ).selectExpr("*", "k * 0.01D as x")
    on = ["cls", "level", "k"]
    curve = frame.join(knots, on, "left").join(tops, on, "left").selectExpr(
        "*", "max(p_top) over (partition by cls, level order by k rows between current row and unbounded following) as e"
    ).selectExpr("*", "case when ahead = 0 then 1D else greatest(c / ahead, e) end as at")
    y = """case when n_det is null or k = 100 then 0D
        when c is not null then at + (e - at) * (x - c / m) / ((c + 1) / m - c / m)
        else n_tp / n_det * (1 - (x - n_tp / m) / (1 - n_tp / m)) end"""
    return curve.selectExpr("cls", "level", "n_gt", f"{y} * if(k in (0, 100), 0.005D, 0.01D) as part").groupBy("cls", "level").agg(
        F.expr("sum(part) as ap"), F.expr("first(n_gt) as n_gt")
    )


def precision_curve(cum: DataFrame, truths: DataFrame, level: int = 50) -> DataFrame:
    """Precision, recall and F1 of each class at 1000 confidence points (linear between rows)."""
    step = 1.0 / CURVE
    steps = cum.join(truths, "cls").selectExpr(
        "cls", "conf", "prev_conf", "n_gt + 1e-16D as m", "cum_n - n as n0", f"cum_tp{level} - tp{level} as c0",
        f"least(tp{level}, 1) as hit",
        f"""explode(filter(sequence(greatest(cast(floor(conf * {CURVE}) as int) - 1, 0),
            least(cast(floor(coalesce(prev_conf, 1D) * {CURVE}) as int) + 1, {CURVE})),
            k -> k * {step!r}D > conf and (prev_conf is null or k * {step!r}D <= prev_conf))) as k""",
    ).selectExpr("*", f"(prev_conf - k * {step!r}D) / (prev_conf - conf) as share")
    known = steps.selectExpr(
        "cls", "k",
        "case when prev_conf is null then 1D else c0 / n0 + ((c0 + hit) / (n0 + 1) - c0 / n0) * share end as p",
        "case when prev_conf is null then 0D else (c0 + hit * share) / m end as r",
    )
    ends = cum.groupBy("cls").agg(F.expr("sum(n) as n_det"), F.expr(f"sum(tp{level}) as n_tp"))
    frame = truths.join(ends, "cls", "left").selectExpr("*", f"explode(sequence(0, {CURVE})) as k")
    return frame.join(known, ["cls", "k"], "left").selectExpr(
        "cls", "n_gt", "k",
        "if(n_det is null, 0D, coalesce(p, n_tp / n_det)) as p",
        "if(n_det is null, 0D, coalesce(r, n_tp / (n_gt + 1e-16D))) as r",
    ).selectExpr("*", "2 * p * r / (p + r + 1e-16D) as f1")


def best_f1_point(curve: DataFrame, taps: int = 101) -> DataFrame:
    """Index of the smoothed mean-F1 maximum (box filter, edge values repeated), one row."""
    mean = curve.groupBy("k").agg(F.expr("avg(f1) as f1"))
    half = taps // 2
    # The axis has 1000 points whatever the data, so this single-partition window is bounded.
    whole = "partition by 0 order by k rows between"
    smooth = mean.selectExpr(
        "k", f"sum(f1) over ({whole} {half} preceding and {half} following) as s",
        f"first(f1) over ({whole} unbounded preceding and unbounded following) as head",
        f"last(f1) over ({whole} unbounded preceding and unbounded following) as tail",
    ).selectExpr("k", f"(s + greatest({half} - k, 0) * head + greatest(k + {half} - {CURVE}, 0) * tail) / {taps} as s")
    return smooth.agg(F.expr("max_by(k, struct(round(s, 12), -k)) as k"))


def operating_point(curve: DataFrame) -> DataFrame:
    """Precision, recall, F1 and whole TP / FP counts of each class at the best smoothed F1."""
    # One row, so the broadcast is bounded.
    at = curve.join(F.broadcast(best_f1_point(curve)), "k").selectExpr("*", "rint(r * n_gt) as tp")
    return at.selectExpr("cls", "k", "p", "r", "f1", "tp", "rint(tp / (p + 1e-16D) - tp) as fp")


def summarize(ap: DataFrame) -> DataFrame:
    """Per-class AP50, AP75 and AP50-95."""
    return ap.groupBy("cls").agg(
        F.expr("max(case when level = 50 then ap end) as ap50"), F.expr("max(case when level = 75 then ap end) as ap75"),
        F.expr("avg(ap) as ap50_95"), F.expr("first(n_gt) as n_gt"),
    )
