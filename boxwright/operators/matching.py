"""Prediction-to-truth matching for average precision and for the confusion matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.operators.overlap import by_crowd, distinct_boxes, iou_join, prefixed

# The ten overlap levels, in percent.
LEVELS = (50, 55, 60, 65, 70, 75, 80, 85, 90, 95)


def level_columns(levels: Sequence[int] = LEVELS) -> list[str]:
    return [f"tp{p}" for p in levels]


def pick_best_truth(pairs: DataFrame, columns: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Per detection, the pair with the highest ``iou`` (lowest truth id on ties); null where there is none.

    A detection meets its candidates in one task, so the map side of the aggregation already leaves one row
    per detection.
    """
    keep = [c for c in columns if c not in ("image_id", "det_id")]
    extra = "".join(f", r_{c} as gt_{c}" for c in carry)
    # The whole payload sits in one aggregate, so every consumer asks for the same exchange and shares it.
    best = pairs.groupBy("image_id", "det_id").agg(F.expr(
        f"max_by(struct({', '.join(keep)}, r_gt_id as gt_id, iou{extra}), struct(coalesce(iou, -1D), -coalesce(r_gt_id, 0L))) as _b"
    ))
    return best.selectExpr("image_id", "det_id", "_b.*")


def best_truth(det: DataFrame, gt: DataFrame, keys: Sequence[str], min_iou: float, strict: bool = False) -> DataFrame:
    """Each detection with its best-overlap truth; truth copies are collapsed before the join."""
    carry = [c for c in ("cls",) if c not in keys]
    pairs = iou_join(det, distinct_boxes(gt, keys, "gt_id", *carry), keys, min_iou, "left_outer", strict)
    return pick_best_truth(pairs, det.columns, carry)


def match_levels(best: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """True-positive flags per level from best-truth rows.

    The best truth of a detection is the same at every level it reaches; at each level a truth accepts the
    detection with the lowest id. So ten conditional minimums per truth replace ten ranked copies of the data.
    """
    firsts = best.where("gt_id is not null").groupBy("image_id", F.expr("gt_id as _g")).agg(
        *[F.expr(f"min(case when iou >= {p / 100}D then det_id end) as _f{p}") for p in levels]
    )
    # Detections without a truth get a private negative key instead of null, so they spread over tasks.
    keyed = best.selectExpr("*", "coalesce(gt_id, -1 - det_id) as _g")
    flags = [f"cast(coalesce(iou >= {p / 100}D and _f{p} = det_id, false) as int) as tp{p}" for p in levels]
    # A null-safe join infers no filter on one side, so both sides keep one plan and the match is worked out once.
    other = firsts.withColumnsRenamed({"image_id": "_image", "_g": "_truth"})
    return keyed.join(other, F.expr("image_id <=> _image and _g <=> _truth"), "left").selectExpr(*best.columns, *flags)


def match_images(det: DataFrame, gt: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """``match_levels`` of ``best_truth`` inside (image_id, cls), image by image: each box moves once and all steps share that exchange."""
    truth = prefixed(distinct_boxes(gt.repartition("image_id"), ["image_id", "cls"], "gt_id"), [])
    # the classes' test is no join key, so that both sides are dealt by their image alone
    test = f"image_id = r_image_id and cls >= r_cls and cls <= r_cls and {G.iou()} >= {min(levels) / 100}D"
    best = pick_best_truth(det.join(truth, F.expr(test), "left").selectExpr(*det.columns, "r_gt_id", f"{G.iou()} as iou"), det.columns)
    same = "partition by image_id, coalesce(gt_id, -1 - det_id)"
    firsts = [f"min(case when gt_id is not null and iou >= {p / 100}D then det_id end) over ({same}) as _f{p}" for p in levels]
    flags = [f"cast(coalesce(iou >= {p / 100}D and _f{p} = det_id, false) as int) as tp{p}" for p in levels]
    return best.selectExpr("*", *firsts).selectExpr(*best.columns, *flags)


def match_predictions(det: DataFrame, gt: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """Match table: one row per detection with a flag per overlap level. Images of many boxes are spread over tasks."""

    def spread(some: DataFrame, truths: DataFrame) -> DataFrame:
        return match_levels(best_truth(some, truths, ["image_id", "cls"], min(levels) / 100), levels)

    return by_crowd(det, gt, ["image_id"], lambda some, truths: match_images(some, truths, levels), spread)


def _conf_floor(conf: float | None, oriented: bool) -> float:
    """The validation defaults stand for 0.25 in the confusion matrix."""
    return 0.25 if conf is None or conf == (0.01 if oriented else 0.001) else conf


def confusion_pairs(det: DataFrame, gt: DataFrame, conf: float | None = 0.25, iou: float = 0.45) -> DataFrame:
    """Class-agnostic one-to-one pairs: best truth per detection, then best overlap per truth."""
    kept = det.where(f"conf > {_conf_floor(conf, False)}D")
    best = best_truth(kept, gt, ["image_id"], iou, strict=True)
    return (
        best.where("gt_id is not null").groupBy("image_id", "gt_id")
        .agg(F.expr("max_by(struct(det_id, iou, cls, gt_cls), struct(iou, -det_id)) as m"))
        .selectExpr("image_id", "gt_id", "m.det_id", "m.iou", "m.cls as pred", "m.gt_cls as truth")
    )


def confusion_counts(det: DataFrame, gt: DataFrame, nc: int, conf: float | None = 0.25, iou: float = 0.45) -> DataFrame:
    """Cells of the (nc+1)^2 matrix; index nc is background.

    Misses and false alarms are class totals minus matched totals, so no anti-join over the data is needed.
    """
    cells = confusion_pairs(det, gt, conf, iou).groupBy("pred", "truth").agg(F.expr("count(*) as n"))
    spread = cells.selectExpr(
        f"explode(array(struct(pred, truth, n), struct(pred, {nc} as truth, -n as n), struct({nc} as pred, truth, -n as n))) as c"
    ).selectExpr("c.*")
    seen = det.where(f"conf > {_conf_floor(conf, False)}D").groupBy("cls").agg(F.expr("count(*) as n"))
    truth = gt.groupBy("cls").agg(F.expr("count(*) as n"))
    every = spread.unionByName(seen.selectExpr("cls as pred", f"{nc} as truth", "n")).unionByName(
        truth.selectExpr(f"{nc} as pred", "cls as truth", "n")
    )
    return every.groupBy("pred", "truth").agg(F.expr("sum(n) as n")).where("n <> 0")
