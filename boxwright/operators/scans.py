"""Ordered scans (lag, running sum, running max, last known value) that survive a hot partition key.

A plain window hands a whole key to one task. Here rows are windowed inside (key, block), where block is a
monotone function of the order; block totals are scanned on their own, and the carry is joined back. The rows
are shuffled once; the totals are small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocked_scan(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    block: str,
    lags: Mapping[str, str] | None = None,
    sums: Mapping[str, str] | None = None,
    maxs: Mapping[str, str] | None = None,
    tops: Mapping[str, str] | None = None,
    lasts: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add scan columns to ``df``; every expression is SQL text.

    lags: value of the previous row; sums and maxs: running value including the row; lasts: latest non-null
    value including the row; tops: running value without the row, null for the first. ``block`` must not decrease along ``order`` within ``part``; ``order`` must be a
    total order inside ``part``.
    """
    keys, key = ", ".join(part), f"struct({', '.join(order)})"
    inside = f"partition by {keys}, _block order by {', '.join(order)}"
    upto = f"{inside} rows between unbounded preceding and current row"
    before = f"partition by {keys} order by _block"
    earlier = f"{before} rows between unbounded preceding and 1 preceding"
    rows, totals, carry, final = [], [], [], []
    for name, e in (lags or {}).items():
        rows.append(f"lag(struct({e} as v)) over ({inside}) as _i_{name}")
        totals.append(f"max_by(struct({e} as v), {key}) as _t_{name}")
        carry.append(f"lag(_t_{name}) over ({before}) as _c_{name}")
        final.append(f"coalesce(_i_{name}, _c_{name}).v as {name}")
    for name, e in (sums or {}).items():
        rows.append(f"sum({e}) over ({upto}) as _i_{name}")
        totals.append(f"sum({e}) as _t_{name}")
        carry.append(f"sum(_t_{name}) over ({earlier}) as _c_{name}")
        final.append(f"coalesce(_c_{name}, 0) + coalesce(_i_{name}, 0) as {name}")
    for name, e in (maxs or {}).items():
        rows.append(f"max({e}) over ({upto}) as _i_{name}")
        totals.append(f"max({e}) as _t_{name}")
        carry.append(f"max(_t_{name}) over ({earlier}) as _c_{name}")
        final.append(f"greatest(_c_{name}, _i_{name}) as {name}")
    for name, e in (tops or {}).items():
        rows.append(f"max({e}) over ({inside} rows between unbounded preceding and 1 preceding) as _i_{name}")
        totals.append(f"max({e}) as _t_{name}")
        carry.append(f"max(_t_{name}) over ({earlier}) as _c_{name}")
        final.append(f"greatest(_c_{name}, _i_{name}) as {name}")
    for name, e in (lasts or {}).items():
        rows.append(f"last({e}) ignore nulls over ({upto}) as _i_{name}")
        totals.append(f"max_by({e}, case when ({e}) is not null then {key} end) as _t_{name}")
        carry.append(f"last(_t_{name}) ignore nulls over ({earlier}) as _c_{name}")
        final.append(f"coalesce(_i_{name}, _c_{name}) as {name}")
    base = df.selectExpr("*", f"{block} as _block")
    carried = base.groupBy(*part, "_block").agg(*[F.expr(t) for t in totals]).selectExpr(*part, "_block", *carry)
    inner = base.selectExpr("*", *rows)
    return inner.join(carried, [*part, "_block"], "left").selectExpr(*df.columns, *final)


def running_changes(df: DataFrame, part: Sequence[str], order: Sequence[str], block: str, item: str, test: str, changes: str, last: str) -> DataFrame:
    """Adds ``last``, the latest non-null ``item`` so far, and ``changes``, how many items so far passed ``test``.

    ``test`` is SQL over ``_v`` (the item) and ``_p`` (the non-null item before it, null for the first). One pass: rows are shuffled once, to
    (key, block), where all but a block's first test are decided; that one is decided when the totals of the blocks before are joined back.
    """
    keys = ", ".join(part)
    inside = f"partition by {keys}, _block order by {', '.join(order)}"
    upto, earlier = f"{inside} rows between unbounded preceding and current row", f"{inside} rows between unbounded preceding and 1 preceding"
    base = df.selectExpr("*", f"{block} as _block", f"{item} as _v")
    seen = base.selectExpr("*", f"last(_v) ignore nulls over ({upto}) as _last", f"last(_v) ignore nulls over ({earlier}) as _p", f"first(_v) ignore nulls over ({upto}) as _first")
    hit = seen.selectExpr("*", f"if(_v is not null and _p is not null and ({test}), 1L, 0L) as _hit")
    inner = hit.selectExpr("*", f"sum(_hit) over ({upto}) as _n")
    key = f"struct({', '.join(order)})"
    totals = hit.groupBy(*part, "_block").agg(
        F.expr(f"min_by(_v, case when _v is not null then {key} end) as _f"), F.expr(f"max_by(_v, case when _v is not null then {key} end) as _l"), F.expr("sum(_hit) as _h")
    )
    before = f"partition by {keys} order by _block rows between unbounded preceding and 1 preceding"
    carried = totals.selectExpr(*part, "_block", "_f as _v", "_h", f"last(_l) ignore nulls over ({before}) as _p")
    carried = carried.selectExpr(*part, "_block", "_h", "_p as _c", f"if(_v is not null and ({test}), 1L, 0L) as _edge")
    carried = carried.selectExpr(*part, "_block", "_c", "_edge", f"coalesce(sum(_h + _edge) over ({before}), 0L) as _sum")
    joined = inner.drop("_v", "_p", "_hit").join(carried, [*part, "_block"], "left")
    return joined.selectExpr(*df.columns, f"coalesce(_last, _c) as {last}", f"_sum + _n + if(_first is not null, _edge, 0L) as {changes}")


def salted_top_k(df: DataFrame, part: Sequence[str], order: str, k: int, salt: str, rank: str = "rank") -> DataFrame:
    """Exact first ``k`` rows of each group: first inside (group, salt), then across salts."""
    keys = ", ".join(part)
    local = f"row_number() over (partition by {keys}, {salt} order by {order}) as _local"
    return (
        df.selectExpr("*", local).where(f"_local <= {k}").drop("_local")
        .selectExpr("*", f"row_number() over (partition by {keys} order by {order}) as {rank}")
        .where(f"{rank} <= {k}")
    )


def rolling_history(df: DataFrame, part: Sequence[str], order: Sequence[str], block: str, item: str, n: int, name: str = "history") -> DataFrame:
    """The last ``n`` items up to each row, oldest first, windowed inside (key, block).

    The tail of the n - 1 previous non-empty blocks always covers what a block's first rows still need.
    """
    keys, sort = ", ".join(part), ", ".join(order)
    back = ", ".join(f"{c} desc" for c in order)
    base = df.selectExpr("*", f"{block} as _block", f"{item} as _item")
    inner = base.selectExpr("*", f"collect_list(_item) over (partition by {keys}, _block order by {sort} rows between {n - 1} preceding and current row) as _h")
    tail = base.selectExpr(*part, "_block", *[c for c in order if c not in part], "_item", f"row_number() over (partition by {keys}, _block order by {back}) as _r").where(f"_r < {n}")
    tails = tail.groupBy(*part, "_block").agg(F.expr("array_sort(collect_list(struct(-_r as k, _item as v))) as t")).selectExpr(
        *part, "_block", f"flatten(collect_list(t.v) over (partition by {keys} order by _block rows between {n - 1} preceding and 1 preceding)) as _c"
    )
    joined = inner.join(tails, [*part, "_block"], "left").selectExpr(*df.columns, f"if(size(_h) >= {n}, _h, concat(coalesce(_c, slice(_h, 1, 0)), _h)) as _a")
    return joined.selectExpr(*df.columns, f"slice(_a, greatest(size(_a) - {n} + 1, 1), {n}) as {name}")


def ordered_map(df: DataFrame, keys: Sequence[str], order: Sequence[str], start, step, schema: str, finish=None) -> DataFrame:
    """Sequential recurrence per key over ordered rows, streamed: only the current state is held in memory.

    ``start(key)`` makes a state; ``step(state, row)`` and ``finish(state)`` return output tuples. A recurrence is sequential by
    nature, so parallelism comes from the number of keys; rows of a key never pile up in memory.
    """
    import pandas as pd

    columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches):
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    if finish and current is not None:
                        out.extend(finish(state))
                    current, state = key, start(key)
                out.extend(step(state, row))
            yield pd.DataFrame(out, columns=columns)
        if finish and current is not None:
            yield pd.DataFrame(finish(state), columns=columns)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
