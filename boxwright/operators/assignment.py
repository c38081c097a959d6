"""One-to-one assignment of the largest total score, over a table of scored pairs.

Pairs fall into connected components, and those are independent. A group (say a class of an image) of a few pairs is solved where it is
grouped; a larger one is cut into its components by Spark first. A component of any size is left to bidding rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.operators.groups import components, large_groups, of_groups
from boxwright.session import materialize

SMALL = 20_000  # pairs that a task solves at once
SCORE = 1e-9  # a pair of no more than this is as good as none


def solve_pairs(left: np.ndarray, right: np.ndarray, score: np.ndarray) -> list[int]:
    """Places of the chosen pairs: largest total score, shortest augmenting paths over the pairs that exist.

    Every left end may stay free for nothing. Each adds itself by the cheapest path of changes (Dijkstra on reduced costs); the path may end
    at a free right end or by leaving some left end free.
    """
    rows, cols = np.unique(left, return_inverse=True)[1], np.unique(right, return_inverse=True)[1]
    n, m = int(rows.max(initial=-1)) + 1, int(cols.max(initial=-1)) + 1
    pairs: list[dict[int, tuple[float, int]]] = [{} for _ in range(n)]
    top = float(score.max(initial=0.0))
    for k, (i, j, s) in enumerate(zip(rows.tolist(), cols.tolist(), score.tolist(), strict=True)):
        if s > SCORE and (j not in pairs[i] or s > -pairs[i][j][0]):
            pairs[i][j] = (-s, k)
    # column m + i stands for leaving row i free, at no cost; costs are shifted to be at least 0
    for i in range(n):
        pairs[i] = {j: (c + top, k) for j, (c, k) in pairs[i].items()} | {m + i: (top, -1)}
    u, v = [0.0] * n, [0.0] * (m + n)
    owner, mate = [-1] * (m + n), [-1] * n
    for start in range(n):
        best, came, done, heap = {}, {}, set(), []
        row, base = start, 0.0
        while True:
            for j, (c, _) in pairs[row].items():
                if j not in done:
                    d = base + c - u[row] - v[j]
                    if d < best.get(j, np.inf) - 1e-15:
                        best[j], came[j] = d, row
                        heappush(heap, (d, j))
            while True:
                base, at = heappop(heap)
                if at not in done:
                    break
            done.add(at)
            if owner[at] < 0:
                break
            row = owner[at]
        # new prices keep reduced costs at least 0 and those of chosen pairs at 0
        u[start] += base
        for j in done:
            if j != at:
                u[owner[j]] += base - best[j]
                v[j] -= base - best[j]
        while True:
            row = came[at]
            owner[at], mate[row], at = row, at, mate[row]
            if row == start:
                break
    return sorted(pairs[i][mate[i]][1] for i in range(n) if mate[i] < m)


def solve(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs (row, column) of the cheapest assignment of a cost matrix in which leaving a row and a column free costs ``limit``."""
    i, j = np.nonzero(cost <= limit)
    chosen = solve_pairs(i, j, limit - cost[i, j])
    return sorted((int(i[k]), int(j[k])) for k in chosen)


def _solved(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chosen pairs of groups that are small enough for one row each."""

    @F.pandas_udf("array<int>")
    def places(u: pd.Series, v: pd.Series, score: pd.Series) -> pd.Series:
        out = []
        for a, b, s in zip(u, v, score, strict=True):
            out.append(None if a is None else solve_pairs(a, b, s))
        return pd.Series(out)

    packed = pairs.groupBy(*keys).agg(F.collect_list(F.struct(*pairs.columns)).alias("_rows"))
    # Where no two pairs share an end there is nothing to choose; such a group is not sent to Python.
    ends = [f"size(array_distinct(_rows.{c})) = size(_rows)" for c in ("u", "v")]
    marked = packed.selectExpr("_rows", f"size(_rows) = 1 or {' and '.join(ends)} as _free")
    at = places(*[F.expr(f"if(_free, null, _rows.{c})") for c in ("u", "v", "score")])
    chosen = f"if(_free, filter(_rows, r -> r.score > {SCORE}D and not isnan(r.score)), transform(_at, i -> _rows[i]))"
    return marked.select("_rows", "_free", at.alias("_at")).selectExpr(f"inline({chosen})")


def bid(pairs: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """Chosen pairs (keys, u, v, score) within ``least`` an end of the largest total, by auction in rounds over tables.

    The problem is doubled into one in which everyone finds a partner: each end may also take its own mirror for nothing. In a
    round every free bidder raises the price of its best item by what it is worth above the second best, and an item goes to
    its highest bid. Steps are scaled: prices of a coarse auction start the next finer one. Each round is written.
    """
    keys = list(keys)
    session: SparkSession = pairs.sparkSession
    mirror = pairs.selectExpr(*keys, "struct(1 as side, v as id) as b", "struct(1 as side, u as id) as i", "score as w")
    real = pairs.selectExpr(*keys, "struct(0 as side, u as id) as b", "struct(0 as side, v as id) as i", "score as w")
    stay_u = pairs.selectExpr(*keys, "struct(0 as side, u as id) as b", "struct(1 as side, u as id) as i", "0D as w").distinct()
    stay_v = pairs.selectExpr(*keys, "struct(1 as side, v as id) as b", "struct(0 as side, v as id) as i", "0D as w").distinct()
    edges = materialize(real.union(mirror).union(stay_u).union(stay_v).where(f"w > {SCORE}D or w = 0D").groupBy(*keys, "b", "i").agg(F.max("w").alias("w")))
    bidders = materialize(edges.select(*keys, "b").distinct())
    owners = materialize(edges.select(*keys, "i").distinct().selectExpr(*keys, "i", f"cast(null as {bidders.schema['b'].dataType.simpleString()}) as b", "0D as price"))
    step = 0.25
    while True:
        step = max(step / 5, least)
        owners = materialize(owners.withColumn("b", F.lit(None).cast(bidders.schema["b"].dataType)))
        free = bidders
        while not free.isEmpty():
            worth = edges.join(free, [*keys, "b"]).join(owners.select(*keys, "i", "price"), [*keys, "i"])
            value = worth.selectExpr(*keys, "b", "i", "price", "w - price as gain")
            best = value.groupBy(*keys, "b").agg(F.expr("max(struct(gain, i, price)) as x"), F.expr("slice(sort_array(collect_list(gain), false), 1, 2) as two"))
            bids = best.selectExpr(*keys, "x.i as i", "b", f"x.price + x.gain - coalesce(get(two, 1), x.gain - 1D) + {step}D as price")
            won = bids.groupBy(*keys, "i").agg(F.expr("max(struct(price, b)) as x")).selectExpr(*keys, "i", "x.b as nb", "x.price as np")
            after = materialize(owners.join(won, [*keys, "i"], "left").selectExpr(*keys, "i", "b as old", "nb", "coalesce(nb, b) as b", "coalesce(np, price) as price"))
            # a bidder stays free unless it won; one that lost its item is free again
            lost = after.where("nb is not null and old is not null").selectExpr(*keys, "old as b")
            free = materialize(free.join(after.where("nb is not null").selectExpr(*keys, "nb as b"), [*keys, "b"], "left_anti").union(lost))
            owners = after.select(*keys, "i", "b", "price")
        if step <= least:
            break
    held = owners.where("b.side = 0 and i.side = 0").selectExpr(*keys, "b.id as u", "i.id as v")
    return pairs.join(held, [*keys, "u", "v"])


def best_pairs(pairs: DataFrame, keys: Sequence[str], small: int = SMALL, least: float = 1e-4) -> DataFrame:
    """One-to-one pairs of the largest total score per key, from rows (keys, u, v, score); (u, v) is unique in a key.

    Exact up to components of ``small`` pairs; larger components come within ``least`` for each of their ends.
    """
    # Pairs often come out of a join, which is not to run once more for the sizes of the groups.
    keys, rows = list(keys), materialize(pairs.select(*keys, "u", "v", "score"))
    large = large_groups(rows, keys, small)
    if large is None:
        return _solved(rows, keys)
    out = _solved(of_groups(rows, large, keys, False), keys)
    dense = materialize(of_groups(rows, large, keys, True))
    # both sides' ends are one kind of node: left ends even, right ends odd
    ends = dense.selectExpr(*keys, "u * 2 as u", "v * 2 + 1 as v")
    rooted = materialize(dense.withColumn("node", F.expr("u * 2")).join(components(ends, keys), [*keys, "node"]).drop("node"))
    big = large_groups(rooted, [*keys, "root"], small)
    if big is None:
        return out.union(_solved(rooted, [*keys, "root"]).select(*rows.columns))
    whole, rest = (of_groups(rooted, big, [*keys, "root"], inside) for inside in (False, True))
    return out.union(_solved(whole, [*keys, "root"]).select(*rows.columns)).union(bid(rest, [*keys, "root"], least).select(*rows.columns))
