"""Group helpers: rows of small and of large groups, and connected components of links inside a key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.session import materialize


def large_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys that hold more than ``limit`` rows (fewer than rows / limit of them); None where there is none.

    The counts are summed on the map side, so this moves one row a group, and a hot group costs no more than another.
    """
    found = materialize(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).drop("_n"))
    return None if found.isEmpty() else found


def crowded_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], most_left: int, most_right: int) -> DataFrame | None:
    """Keys that hold more than ``most_left`` left rows or ``most_right`` right ones; None where there is none."""
    sides = [side.select(*keys, F.lit(1 - k).alias("_l"), F.lit(k).alias("_r")) for k, side in enumerate((left, right))]
    counts = sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    found = materialize(counts.where(f"_l > {most_left} or _r > {most_right}").select(*keys))
    return None if found.isEmpty() else found


def of_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], inside: bool) -> DataFrame:
    """Rows of the listed groups, or all others; null keys are groups as well."""
    named = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    return df.join(named, same, "left_semi" if inside else "left_anti")


def components(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, root) for every end of ``links`` (keys, u, v); the root is the least node that links reach.

    Alternating star steps; each round is written, and rounds grow with the logarithm of the longest path.
    """
    keys = list(keys)
    edges = materialize(links.where("u <> v").selectExpr(*keys, "greatest(u, v) as u", "least(u, v) as v").distinct())
    mark = None
    while True:
        both = edges.union(edges.selectExpr(*keys, "v as u", "u as v"))
        least = both.groupBy(*keys, "u").agg(F.expr("least(min(v), u) as m"))
        large = both.where("v > u").join(least, [*keys, "u"]).selectExpr(*keys, "v as u", "m as v")
        down = large.selectExpr(*keys, "greatest(u, v) as u", "least(u, v) as v")
        least = down.groupBy(*keys, "u").agg(F.expr("min(v) as m"))
        small = down.join(least, [*keys, "u"]).where("v <> m").selectExpr(*keys, "v as u", "m as v")
        edges = materialize(small.union(least.selectExpr(*keys, "u", "m as v")).where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64(*edges.columns).cast("decimal(38, 0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.selectExpr(*keys, "u as node", "v as root").union(edges.selectExpr(*keys, "v as node", "v as root").distinct())
