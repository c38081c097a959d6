"""Keypoint similarity join."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.operators.overlap import by_crowd, keyed_join, prefixed


def oks_join(det: DataFrame, gt: DataFrame, keys: list[str], sigmas: list[float], min_oks: float, cell: float = 64.0) -> DataFrame:
    """Pairs (image_id, det_id, r_gt_id, oks) with object-keypoint similarity >= min_oks; ``keys`` hold image_id.

    Objects of an image meet behind one exchange a side, where pairs of repeated ids are brought together as well; crowded images are met by cells.
    """

    def together(some: DataFrame, truths: DataFrame) -> DataFrame:
        return _met_by_image(some, truths, keys, sigmas, min_oks)

    def spread(some: DataFrame, truths: DataFrame) -> DataFrame:
        return _met_by_cell(some, truths, keys, sigmas, min_oks, cell)

    return by_crowd(det, gt, ["image_id"], together, spread)


def _met_by_image(det: DataFrame, gt: DataFrame, keys: list[str], sigmas: list[float], min_oks: float) -> DataFrame:
    """``oks_join`` of objects dealt by their image alone; only coordinates and what is labelled move."""
    sig = f"array({', '.join(f'{s}D' for s in sigmas)})"
    points = "flatten(transform(kpts, p -> array(p.x, p.y)))"
    lhs = det.selectExpr(*keys, "det_id", f"{points} as _p")
    labelled = f"size(filter(kpts, (q, i) -> q.v <> 0 and {sig}[i] >= 0D))"
    rhs = gt.selectExpr(*[f"{c} as r_{c}" for c in (*keys, "gt_id", "area")], f"{points} as r_p", "transform(kpts, q -> coalesce(q.v <> 0, false)) as r_seen", f"{labelled} as r_n")

    def term(i: int, s: float) -> str:
        d = " + ".join(f"pow(get(_p, {k}) - get(r_p, {k}), 2)" for k in (2 * i, 2 * i + 1))
        return f"if(get(r_seen, {i}), exp(-({d}) / (pow(2 * {s}D, 2) * (r_area + 1e-7D) * 2)), 0D)"

    score = f"((0D + {' + '.join(term(i, s) for i, s in enumerate(sigmas))}) / (r_n + 1e-7D))"
    # the other keys' tests are no join keys, so that both sides are dealt by their image alone
    same = " and ".join(["image_id = r_image_id", *[f"{k} >= r_{k} and {k} <= r_{k}" for k in keys if k != "image_id"]])
    met = lhs.join(rhs.hint("merge"), F.expr(f"{same} and {score} >= {min_oks}D"))
    return met.groupBy("image_id", "det_id", "r_gt_id").agg(F.expr(f"max({score}) as oks"))


def _met_by_cell(det: DataFrame, gt: DataFrame, keys: list[str], sigmas: list[float], min_oks: float, cell: float) -> DataFrame:
    """``oks_join`` by cells. The similarity is a mean over labelled points, so some labelled point scores at least min_oks; that bounds its
    distance by the truth's size. Points meet on (keys, point number, cell); the full score is computed once met.
    """
    sig = f"array({', '.join(f'{s}D' for s in sigmas)})"
    lhs = det.selectExpr("*", "posexplode(kpts) as (_i, _p)").selectExpr(
        *det.columns, "_i", f"cast(floor(_p.x / {cell}D) as int) as _gx", f"cast(floor(_p.y / {cell}D) as int) as _gy"
    )
    reach = f"(sqrt({-math.log(min_oks) * 8 + 1e-9}D * (area + 1e-7D)) * {sig}[_i] + 1e-6D)"
    rhs = gt.selectExpr("*", "posexplode(kpts) as (_i, _p)").where("_p.v <> 0")
    for a in ("x", "y"):
        rhs = rhs.selectExpr("*", f"explode(sequence(cast(floor((_p.{a} - {reach}) / {cell}D) as int), cast(floor((_p.{a} + {reach}) / {cell}D) as int))) as _g{a}")
    rhs = prefixed(rhs.drop("_p"), [*keys, "_i", "_gx", "_gy"])
    terms = (
        f"aggregate(zip_with(zip_with(kpts, r_kpts, (p, q) -> struct(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) as d, q.v as v)), {sig},"
        " (t, s) -> if(t.v <> 0, exp(-t.d / (pow(2 * s, 2) * (r_area + 1e-7D) * 2)), 0D)), 0D, (a, b) -> a + b)"
    )
    score = f"({terms} / (size(filter(r_kpts, q -> q.v <> 0)) + 1e-7D))"
    met = keyed_join(lhs, rhs, [*keys, "_i", "_gx", "_gy"], f"{score} >= {min_oks}D", "inner")
    return met.groupBy("image_id", "det_id", "r_gt_id").agg(F.expr(f"max({score}) as oks"))
