"""Minimax contiguous sharding of atomic groups.

Groups of equal texts stay together. Groups are ordered by their digest and cut into contiguous shards so that the
largest shard is as small as this order allows: the smallest feasible capacity is searched, each candidate being tested
by greedy filling. A greedy step is one aggregate over the groups' running sizes (the last group end within reach), taken
for many candidate capacities at once, so a search is a few dozen narrow scans whatever the number of groups.

Only DataFrame operations are used; the driver sees one row of limits per step. Running sums are taken inside blocks of
the digest order and carried across block totals. Slots are numbered inside (shard, hash part) and carried likewise, so
a group of copies that holds a third of all rows is not one task's work.

Defined results: null text is an empty text of size 1, in the group of empty texts; repeated rows get slots of their own;
an empty table gives an empty result; further columns pass through, clashing names are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwright.llm.text import body
from boxwright.session import materialize

BLOCK_DIGITS = 3  # hex digits of the digest that name a block
SLOT_PARTS = 1024
PROBES = 48  # capacities tested at once


def running(df: DataFrame, keys: list[str], part: str, order: list, sums: dict[str, str]) -> DataFrame:
    """Running sums (value included) over (keys, part, order), windowed inside a part and carried across parts."""
    totals = df.groupBy(*keys, part).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    across = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    carried = totals.select(*keys, part, *[(F.sum(f"_t_{n}").over(across) - F.col(f"_t_{n}")).alias(f"_c_{n}") for n in sums])
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(carried, [*keys, part])
    return joined.withColumns({n: F.col(f"_c_{n}") + F.sum(v).over(inside) for n, v in sums.items()}).drop(*[f"_c_{n}" for n in sums])


def smallest_capacity(ends: DataFrame, shards: int, total: int, largest: int) -> tuple[int, list[int]]:
    """Smallest capacity for which greedy filling of ``ends`` (running group ends, column ``end``) needs at most ``shards``
    shards, and the shards' ends. Filling up to total / shards plus the largest group always suffices, which bounds the search.
    """
    low, high = max(largest, -(-total // shards)), max(largest, -(-total // shards)) + largest
    found: list[int] = []
    while True:
        step = max(1, -(-(high - low + 1) // PROBES))
        capacities = list(range(low, high, step)) + [high]
        filled = [[0] for _ in capacities]
        for _ in range(shards):
            reach = [min(total, cuts[-1] + c) for c, cuts in zip(capacities, filled, strict=True)]
            row = ends.where(F.col("end").between(min(c[-1] for c in filled), max(reach))).agg(
                *[F.max(F.when(F.col("end") <= r, F.col("end"))).alias(f"r{i}") for i, r in enumerate(reach)]
            ).first()
            for cuts, end in zip(filled, row, strict=True):
                cuts.append(max(cuts[-1], end or 0))
        best = next(i for i, cuts in enumerate(filled) if cuts[-1] == total)
        found = filled[best][1:]
        if best == 0 or step == 1:
            return capacities[best], found
        low, high = capacities[best - 1] + 1, capacities[best]


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Documents with size, text_crc32, shard and slot; groups are equal texts, sizes UTF-8 bytes plus one."""
    text = body(F.col("text"))
    rows = docs.withColumns({
        "size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text), "_digest": F.sha2(text, 256), "_spread": F.xxhash64("doc_id", "text"),
    }).drop("text", "shard", "slot")
    rows = materialize(rows)
    groups = rows.groupBy("_digest").agg(F.sum("size").alias("group_size")).withColumn("_block", F.substring("_digest", 1, BLOCK_DIGITS))
    ends = materialize(running(groups, [], "_block", ["_digest"], {"end": "group_size"}).select("_digest", "group_size", "end"))
    total, largest = ends.agg(F.max("end"), F.max("group_size")).first()
    cuts = smallest_capacity(ends, shards, total, largest)[1] if total else []
    shard = sum([F.when(F.col("end") > c, 1).otherwise(0) for c in cuts[:-1]], F.lit(0)).cast("int")
    placed = rows.join(ends.select("_digest", shard.alias("shard")), "_digest").withColumns({
        "_part": F.pmod("_spread", F.lit(SLOT_PARTS)), "_one": F.lit(1).cast("long"),
    })
    numbered = running(placed, ["shard"], "_part", ["_spread", "doc_id", "_digest"], {"_rank": "_one"})
    return numbered.withColumn("slot", F.col("_rank") - 1).drop("_digest", "_spread", "_part", "_one", "_rank")
