"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1], a line from ``start`` to ``end``. Its integral,
scaled to the source's target, is the source's cumulative word demand. The documents of a source are laid out in
hash order as intervals of words; a demand of T words over a source of S words runs T / S times through them. The word
offset of each copy is turned into a training position by inverting the demand, and the mix is range-sorted by position.

Only DataFrame operations are used. A source is split into buckets of its hash order, so a source that holds a third of
all rows is many window partitions; bucket totals are summed before anything is ordered.

Defined results: a null source is a source of its own and comes last; null or empty texts have size 0 and are not taken;
repeated rows are taken independently; an empty table gives an empty result; columns of ``docs`` pass through (names that
clash with the operator's columns are replaced).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwright.llm.text import word_count

BUCKET_BITS = 12  # parts of a source's hash order
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))  # weight at the start and the end of training, repeating like the weights


def targets(sizes: DataFrame, weights: Sequence[float], ramps: Sequence[tuple[float, float]] = RAMPS, multiple: float = 3.0, share: float = 1.0) -> DataFrame:
    """Target words per source: share by weight, at most ``multiple`` times the source, the excess reshared by weight.

    ``sizes`` has one row per source (source, source_size). With sources ordered by limit / weight those at their limit
    come first, so one running sum finds the level at which the rest share by weight.
    """
    every = Window.partitionBy()
    ranked = sizes.withColumn("rk", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("rk") % len(values) + 1).cast("int"))
    limits = ranked.select(
        "source", "source_size", "rk", pick(weights).alias("weight"), pick([a for a, _ in ramps]).alias("ramp_start"),
        pick([b for _, b in ramps]).alias("ramp_end"), (F.col("source_size") * multiple).alias("limit"),
    ).withColumn("turn", F.col("limit") / F.col("weight"))
    up, down = (every.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for order in (("turn", "rk"), (F.desc("turn"), F.desc("rk"))))
    levels = limits.select(
        "*", ((F.sum("source_size").over(every) * share - (F.sum("limit").over(up) - F.col("limit"))) / F.sum("weight").over(down)).alias("level")
    )
    top = F.max("level").over(every)
    return levels.select("source", "source_size", "rk", "ramp_start", "ramp_end", F.least(F.col("limit"), F.col("weight") * top).alias("target"))


def invert_demand(share: F.Column, start: F.Column, end: F.Column) -> F.Column:
    """Time at which a source with a linear weight schedule has met the given share of its demand."""
    root = (F.sqrt(start * start + (end * end - start * start) * share) - start) / (end - start)
    return F.when(start == end, share).otherwise(root)


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), ramps: Sequence[tuple[float, float]] = RAMPS, multiple: float = 3.0,
    share: float = 1.0, size: F.Column | None = None, order: F.Column | None = None, ordered: bool = True,
) -> DataFrame:
    """Documents with size, source_size, target, copies, taken and positions, range-sorted by first position if ``ordered``.

    ``positions`` holds one training position per copy; documents not taken have none and come last. A copy is taken when
    the middle of its interval lies below the demand, so a source misses its target by half a document at most.
    """
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    spread = order if order is not None else F.xxhash64("doc_id", "text")
    count = size if size is not None else word_count(F.col("text"))
    rows = docs.withColumns({"size": count.cast("long"), "_key": key, "_hash": spread}).withColumn(
        "_part", F.shiftrightunsigned("_hash", 64 - BUCKET_BITS)
    )
    parts = rows.groupBy("_key", "_part").agg(F.sum("size").alias("part_size"), F.first("source").alias("source"))
    per_source = parts.groupBy("_key").agg(F.sum("part_size").alias("source_size"), F.first("source").alias("source"))
    plan = targets(per_source, weights, ramps, multiple, share).withColumn(
        "_key", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    ).drop("source", "rk")
    along = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = parts.select("_key", "_part", (F.sum("part_size").over(along) - F.col("part_size")).alias("_before")).join(plan, "_key")
    clash = [c for c in docs.columns if c in ("source_size", "target", "ramp_start", "ramp_end", "copies", "taken", "positions", "position")]
    placed = rows.drop(*clash).join(offsets, ["_key", "_part"])
    inside = Window.partitionBy("_key", "_part").orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("_before") + F.sum("size").over(inside) - F.col("size")
    whole = F.greatest(F.col("source_size"), F.lit(1))
    turns = F.ceil((F.col("target") - F.col("_start") - F.col("size") / 2) / whole)
    taken = placed.withColumn("_start", start).withColumn(
        "copies", F.when(F.col("size") > 0, F.greatest(F.lit(0).cast("long"), turns)).otherwise(F.lit(0).cast("long"))
    )
    when = lambda j: invert_demand(
        F.least(F.lit(1.0), (F.col("_start") + j * F.col("source_size")) / F.col("target")), F.col("ramp_start"), F.col("ramp_end")
    )
    none = F.array().cast("array<double>")
    out = taken.withColumns({
        "taken": F.col("copies") * F.col("size"),
        "positions": F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), when)).otherwise(none),
    })
    first = F.when(F.col("copies") > 0, F.col("positions")[0]).otherwise(1 + F.col("_start") / whole)
    out = out.withColumn("_first", first)
    return (out.orderBy("_first", "_hash") if ordered else out).drop("_key", "_part", "_hash", "_before", "_start", "_first", "ramp_start", "ramp_end")


def copies(mixed: DataFrame) -> DataFrame:
    """One row per copy in training order, with its position; the mix need not be ordered."""
    return mixed.withColumn("position", F.explode("positions")).orderBy("position")
