"""Overlap joins: an equi-join on the keys where they are small, on (keys, level, cell) where they are dense, never a cross join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.functions import geometry as G
from boxwright.operators.groups import crowded_groups, large_groups, of_groups

CELL = 256.0
DENSE = 512  # right boxes of a key that a left box may meet without a grid
CROWD = 4096  # left boxes of a key that one task may hold


def _cells(lo: str, hi: str, cell: float) -> str:
    return f"explode(sequence(cast(floor(({lo}) / {cell}D) as int), cast(floor(({hi}) / {cell}D) as int)))"


def cover_cells(df: DataFrame, p: str = "", cell: float = CELL) -> DataFrame:
    """Register each box in every cell it touches."""
    return df.selectExpr("*", _cells(f"{p}x1", f"{p}x2", cell) + " as _gx").selectExpr(
        "*", _cells(f"{p}y1", f"{p}y2", cell) + " as _gy"
    )


def prefixed(df: DataFrame, keys: Sequence[str], prefix: str = "r_") -> DataFrame:
    """Prefix the columns outside the keys."""
    return df.selectExpr(*[c if c in keys else f"{c} as {prefix}{c}" for c in df.columns])


def keyed_join(left: DataFrame, right: DataFrame, on: Sequence[str], test: str, how: str) -> DataFrame:
    """Equi-join on same-named keys plus a SQL test over both sides' other columns."""
    renamed = right.selectExpr(*[f"{c} as _k_{c}" if c in on else c for c in right.columns])
    equi = " and ".join(f"{c} = _k_{c}" for c in on)
    joined = left.join(renamed, F.expr(f"{equi} and ({test})"), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_k_{c}" for c in on])


def by_density(left: DataFrame, right: DataFrame, keys: Sequence[str], plain, grid, small: int) -> DataFrame:
    """``plain(left, right)`` on the keys of up to ``small`` right rows, ``grid(left, right)`` on the others.

    A left row of a small key meets ``small`` candidates at most, so an equi-join is bounded there and nothing is replicated.
    """
    dense = large_groups(right, keys, small)
    if dense is None:
        return plain(left, right)
    one, two = ((of_groups(left, dense, keys, inside), of_groups(right, dense, keys, inside)) for inside in (False, True))
    return plain(*one).unionByName(grid(*two))


def by_crowd(left: DataFrame, right: DataFrame, keys: Sequence[str], together, spread) -> DataFrame:
    """``together(left, right)``, which deals both sides by ``keys`` alone, on the keys of few rows, ``spread(left, right)`` on the others."""
    crowd = crowded_groups(left, right, keys, CROWD, DENSE)
    if crowd is None:
        return together(left, right)
    one, two = ((of_groups(left, crowd, keys, inside), of_groups(right, crowd, keys, inside)) for inside in (False, True))
    return together(*one).unionByName(spread(*two))


LEVEL = 16.0  # a level's long sides differ by this factor at most; its cells are 2 to 2 * LEVEL times as long


def _level(long_side: str) -> str:
    return f"cast(floor(ln(greatest({long_side}, 1e-9D)) / ln({LEVEL}D)) as int)"


def levelled_left(df: DataFrame) -> DataFrame:
    """Register each box once: at the level of its long side, in the cell of its centre; the cell's side follows the level."""
    side = f"(2 * pow({LEVEL}D, _level + 1))"
    return df.selectExpr("*", f"{_level('greatest(x2 - x1, y2 - y1)')} as _level").selectExpr(
        "*", f"cast(floor((x1 + x2) / 2 / {side}) as bigint) as _gx", f"cast(floor((y1 + y2) / 2 / {side}) as bigint) as _gy"
    )


def levelled_right(df: DataFrame, min_iou: float, p: str = "r_") -> DataFrame:
    """Register each box at the levels and in the cells that can hold a partner with IoU >= min_iou.

    Two intervals with one-dimensional IoU >= t have lengths that differ by the factor t at most, and centres at most w * (1 - t) / (2t) apart, w
    being the length of either; the two-dimensional IoU never exceeds the one-dimensional one. The long sides obey the same factor.
    """
    reach = (1 - min_iou) / (2 * min_iou) * (1 + 1e-9)
    long_side = f"greatest({p}x2 - {p}x1, {p}y2 - {p}y1)"
    lowest, highest = _level(f"{long_side} * {min_iou * (1 - 1e-9)}D"), _level(f"{long_side} / {min_iou * (1 - 1e-9)}D")
    side = f"(2 * pow({LEVEL}D, _level + 1))"

    def span(a: str, b: str) -> str:
        mid, far = f"({p}{a} + {p}{b}) / 2", f"(({p}{b} - {p}{a}) * {reach}D + 1e-6D)"
        lo, hi = (f"cast(floor(({mid} {sign} {far}) / {side}) as bigint)" for sign in "-+")
        return f"explode(sequence({lo}, {hi}))"

    return df.selectExpr("*", f"explode(sequence({lowest}, {highest})) as _level").selectExpr("*", span("x1", "x2") + " as _gx").selectExpr("*", span("y1", "y2") + " as _gy")


def near_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], min_iou: float, test: str, how: str = "inner", small: int = DENSE) -> DataFrame:
    """Rows that pass ``test``, which implies an overlap of ``min_iou`` or more; right columns come out with prefix ``r_``."""

    def plain(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
        return keyed_join(lhs, rhs, list(keys), test, how)

    def grid(lhs: DataFrame, rhs: DataFrame) -> DataFrame:
        return keyed_join(levelled_left(lhs), levelled_right(rhs, min_iou), [*keys, "_level", "_gx", "_gy"], test, how).drop("_level", "_gx", "_gy")

    return by_density(left, prefixed(right, keys), keys, plain, grid, small)


def iou_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], min_iou: float,
    how: str = "inner", strict: bool = False, extra: str = "true", small: int = DENSE,
) -> DataFrame:
    """Pairs with IoU >= min_iou (> when strict). Right columns come out with prefix ``r_`` next to ``iou``.

    The left side has one row per box, so outer, semi and anti joins keep their meaning.
    """
    test = f"{G.iou()} {'>' if strict else '>='} {min_iou}D and {extra}"
    joined = near_pairs(left, right, keys, min_iou, test, how, small)
    return joined if how in ("left_semi", "left_anti") else joined.selectExpr("*", f"{G.iou()} as iou")


def touch_join(left: DataFrame, right: DataFrame, keys: Sequence[str], extra: str = "true", cell: float = CELL) -> DataFrame:
    """All pairs with positive overlap; a pair is emitted only in the cell of its overlap's first corner."""
    lhs = cover_cells(left, "", cell)
    rhs = cover_cells(prefixed(right, keys), "r_", cell)
    test = (
        f"{G.intersection()} > 0 and {extra} and _gx = cast(floor(greatest(x1, r_x1) / {cell}D) as int)"
        f" and _gy = cast(floor(greatest(y1, r_y1) / {cell}D) as int)"
    )
    return keyed_join(lhs, rhs, [*keys, "_gx", "_gy"], test, "inner").drop("_gx", "_gy")


def distinct_boxes(df: DataFrame, keys: Sequence[str], id_col: str, *carry: str) -> DataFrame:
    """Collapse exact copies of a box inside its keys to the lowest id, before any join."""
    return df.groupBy(*keys, *G.CORNERS).agg(
        F.expr(f"min({id_col}) as {id_col}"), *[F.expr(f"min_by({c}, {id_col}) as {c}") for c in carry]
    )
