"""Non-maximum suppression: greedy, fast and rotated variants."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.operators.groups import components, large_groups, of_groups
from boxwright.operators.overlap import DENSE, by_density, distinct_boxes, iou_join, keyed_join, near_pairs, prefixed, touch_join
from boxwright.operators.scans import salted_top_k
from boxwright.session import materialize

SALTS = 512
SMALL = 2048  # boxes a task folds at once
PEELS = 4  # rounds between two searches for components



def top_candidates(det: DataFrame, k: int, group: str = "image_id", rank: str = "rank") -> DataFrame:
    """First k rows per image by confidence, ties by id; a hot image is ranked in salted parts first."""
    return salted_top_k(det, [group], "conf desc, det_id", k, f"pmod(xxhash64(det_id), {SALTS})", rank)


def suppression_links(det: DataFrame, iou: float, keys: Sequence[str]) -> DataFrame:
    """Pairs (image_id, hi, lo): box ``hi`` comes before ``lo`` and overlaps it by more than ``iou``."""
    # At a small limit the reach of a box outgrows its image, so every touching pair is tested instead.
    before = f"(r_conf > conf or r_conf = conf and r_det_id < det_id) and {G.iou_above(iou, '', 'r_')}"
    if iou < 0.1:
        pairs = touch_join(det, det, keys, extra=before)
    else:
        pairs = near_pairs(det, det, keys, iou, before)
    return pairs.selectExpr("image_id", "r_det_id as hi", "det_id as lo")


def _kept_places(limit: float):
    """Places of the boxes of a group that greedy suppression keeps, as a column function over arrays."""

    @F.pandas_udf("array<int>")
    def places(conf: pd.Series, det_id: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
        out: list = [None] * len(conf)
        # lists with a null id come as floats; they stay apart, so that the other ids keep all their digits
        for whole in (True, False):
            picked = [k for k, d in enumerate(det_id) if (d.dtype.kind in "iu") == whole]
            if picked:
                stay = kept_places(*[[column.iat[k] for k in picked] for column in (conf, det_id, x1, y1, x2, y2)], limit)
                for k, found in zip(picked, stay, strict=True):
                    out[k] = found
        return pd.Series(out)

    return places


def kept_places(conf: list, det_id: list, x1: list, y1: list, x2: list, y2: list, limit: float) -> list[np.ndarray]:
    """Places of the boxes that greedy suppression keeps in each group (a list of arrays a column, an array a group).

    All groups go together: in a round the first box left of every group stays, and what it overlaps goes.
    """
    sizes = np.array([len(c) for c in conf])
    group = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort([np.concatenate(det_id), -np.concatenate(conf), group])
    a, b, e, f = (np.concatenate(c)[order] for c in (x1, y1, x2, y2))
    area, left, stay = (e - a) * (f - b), np.arange(len(order)), []
    while len(left):
        new = np.append(True, group[left[1:]] != group[left[:-1]])
        heads = left[new]
        stay.append(heads)
        i, left = heads[np.cumsum(new) - 1][~new], left[~new]
        wide = np.minimum(e[i], e[left]) - np.maximum(a[i], a[left])
        high = np.minimum(f[i], f[left]) - np.maximum(b[i], b[left])
        shared = np.where((wide > 0) & (high > 0), wide * high, 0.0)
        left = left[~(shared / (area[i] + area[left] - shared) > limit)]
    kept = np.sort(np.concatenate(stay))
    first = np.cumsum(sizes) - sizes
    return np.split((order[kept] - first[group[kept]]).astype(np.int32), np.cumsum(np.bincount(group[kept], minlength=len(sizes)))[:-1])


def folded(boxes: DataFrame, iou: float, keys: Sequence[str]) -> DataFrame:
    """Greedy suppression of groups that are small enough for one row each."""
    packed = boxes.groupBy(*keys).agg(F.collect_list(F.struct(*boxes.columns)).alias("_rows"))
    places = _kept_places(iou)(*[F.col(f"_rows.{c}") for c in ("conf", "det_id", *G.CORNERS)])
    return packed.select("_rows", places.alias("_at")).selectExpr("inline(transform(_at, i -> _rows[i]))")


def greedy_nms(
    det: DataFrame, iou: float, keys: Sequence[str] = ("image_id", "cls"),
    max_nms: int | None = None, max_det: int | None = None, small: int = SMALL,
) -> DataFrame:
    """Keep a box unless a kept box of its group overlaps it by more than ``iou`` (equal is kept).

    ``det_id`` is unique inside an image, and image_id is among the keys. Nothing is capped by default; with ``max_det`` the kept
    boxes carry their ``rank``. A group of up to ``small`` boxes is folded in its task. A larger one falls into the connected
    components of its overlaps, which are folded by the same bound; what is larger still is decided in rounds.
    """
    det = det if max_nms is None else top_candidates(det, max_nms).drop("rank")
    solid = f"{G.area()} > 0"
    boxes = det.where(solid)
    large = large_groups(boxes, keys, small)
    kept = folded(boxes if large is None else of_groups(boxes, large, keys, False), iou, keys)
    if large is not None:
        dense = of_groups(boxes, large, keys, True)
        kept = kept.union(dense.join(_kept_of_large(dense, iou, keys, small), ["image_id", "det_id"], "left_semi").select(*det.columns))
    kept = kept.union(det.where(f"not coalesce({solid}, false)"))
    return kept if max_det is None else top_candidates(kept, max_det)


def _kept_of_large(boxes: DataFrame, iou: float, keys: Sequence[str], small: int) -> DataFrame:
    """(image_id, det_id) of the boxes that stay. Of exact copies only the first can.

    In a round, components of up to ``small`` boxes are folded. In the others a box that none before it overlaps any more stays and
    what it overlaps goes, ``PEELS`` times, which breaks them up.
    """
    first = F.expr("min(struct(-conf as c, det_id as d)) as _first")
    distinct = materialize(boxes.groupBy(*keys, *G.CORNERS).agg(first).selectExpr(*keys, *G.CORNERS, "-_first.c as conf", "_first.d as det_id"))
    links = materialize(suppression_links(distinct, iou, keys))
    gone: list[DataFrame] = []
    while not links.isEmpty():
        roots = materialize(components(links.selectExpr("image_id", "hi as u", "lo as v"), ["image_id"]).withColumnRenamed("node", "det_id"))
        dense = large_groups(roots, ["image_id", "root"], small)
        whole = roots if dense is None else of_groups(roots, dense, ["image_id", "root"], False)
        stay = folded(distinct.join(whole, ["image_id", "det_id"]), iou, ["image_id", "root"])
        gone.append(materialize(whole.join(stay, ["image_id", "det_id"], "left_anti").selectExpr("image_id", "det_id as lo")))
        if dense is None:
            break
        rest = of_groups(roots, dense, ["image_id", "root"], True).selectExpr("image_id", "det_id as hi")
        links = materialize(links.join(rest, ["image_id", "hi"], "left_semi"))
        for _ in range(PEELS):
            new = materialize(links.join(links.selectExpr("image_id", "lo as hi"), ["image_id", "hi"], "left_anti").select("image_id", "lo").distinct())
            gone.append(new)
            links = links.join(new, ["image_id", "lo"], "left_anti").join(new.selectExpr("image_id", "lo as hi"), ["image_id", "hi"], "left_anti")
            links = materialize(links)
    stay = distinct.select("image_id", "det_id")
    return stay.join(reduce(DataFrame.union, gone).withColumnRenamed("lo", "det_id"), ["image_id", "det_id"], "left_anti") if gone else stay


def fast_nms(det: DataFrame, iou: float, keys: Sequence[str] = ("image_id", "cls"), max_det: int | None = None) -> DataFrame:
    """Drop a box when any higher-ranked box, dropped or not, overlaps it by ``iou`` or more (anti-join).

    det_id must ascend with descending confidence. Copies collapse to their highest rank before the join. With ``max_det`` the kept
    boxes carry their ``rank``.
    """
    higher = distinct_boxes(det, keys, "det_id")
    kept = iou_join(det, higher, keys, iou, "left_anti", extra="r_det_id < det_id")
    return kept if max_det is None else top_candidates(kept, max_det)


def with_covariance(df: DataFrame) -> DataFrame:
    return df.selectExpr("*", *[f"{e} as {n}" for n, e in G.covariance("").items()])


def rotated_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], min_iou: float,
    how: str = "inner", extra: str = "true", cell: float = 256.0, small: int = DENSE,
) -> DataFrame:
    """Rotated-box similarity join; right columns carry the prefix ``r_``. Keys of more than ``small`` right boxes meet on a grid.

    similarity >= t bounds the Bhattacharyya distance by D = -ln(1 - (1 - t)^2). Along an axis, centres are then at most sqrt(8 D) apart in
    units of the mean variance, and the two variances differ at most by the factor v with v + 1/v + 2 = 4 exp(4 D); both
    together bound the distance by the right box's own variance along that axis.
    """
    bound = -math.log(1 - (1 - min_iou) ** 2) + 1e-6
    m = 2 * math.exp(4 * bound) - 1
    factor = math.sqrt(8 * bound * (1 + m + math.sqrt(m * m - 1)) / 2)
    test = f"{G.probiou()} >= {min_iou}D and {extra}"

    def plain(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
        return keyed_join(lhs, rhs, list(keys), test, how)

    def grid(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
        lhs = lhs.selectExpr("*", *[f"cast(floor(c{a} / {cell}D) as int) as _g{a}" for a in "xy"])
        for axis, variance in (("x", "r_va"), ("y", "r_vb")):
            far = f"(sqrt({variance}) * {factor}D + 1e-6D)"
            lo, hi = (f"cast(floor((r_c{axis} {s} {far}) / {cell}D) as int)" for s in "-+")
            rhs = rhs.selectExpr("*", f"explode(sequence({lo}, {hi})) as _g{axis}")
        return keyed_join(lhs, rhs, [*keys, "_gx", "_gy"], test, how).drop("_gx", "_gy")

    joined = by_density(with_covariance(left), prefixed(with_covariance(right), keys), keys, plain, grid, small)
    if how not in ("left_semi", "left_anti"):
        joined = joined.selectExpr("*", f"{G.probiou()} as iou").drop("r_va", "r_vb", "r_vc")
    return joined.drop("va", "vb", "vc")


def rotated_nms(det: DataFrame, iou: float, keys: Sequence[str] = ("image_id", "cls"), max_det: int | None = None) -> DataFrame:
    """Fast rule with rotated-box similarity; copies collapse to their highest rank first."""
    higher = det.groupBy(*keys, "cx", "cy", "w", "h", "r").agg(F.expr("min(det_id) as det_id"))
    kept = rotated_join(det, higher, keys, iou, "left_anti", extra="r_det_id < det_id")
    return kept if max_det is None else top_candidates(kept, max_det)
