"""Exact top-k search by integer inner product: tiled matrix products, partial selection, tree merging.

Candidates are packed into tiles of a few thousand vectors inside their scan tasks. Queries are packed into blocks of
bounded size; a bounded number of blocks at a time is broadcast and met by every tile. Each (tile, block) is one matrix
product, of which the k best per query are kept. The lists of a query are then merged in a tree of fixed fan-in.

Components are floor(scale * x). Products are exact in 64-bit floats while dim * max^2 < 2^53, else integers are used.

Defined results: vectors that are null or hold null or non-finite components take no part, neither do null ids; vectors of
another length than the queries' take no part in their blocks; ties go to the smaller id; repeated ids are ranked as rows of
their own except that a query never meets rows of its own id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwright.session import materialize, shared_folder

TILE = 4096  # candidate vectors a tile
BLOCK = 512  # query vectors a block
BLOCKS_AT_ONCE = 16  # blocks broadcast together: 16 * 512 vectors
FAN_IN = 16  # lists merged by one step of the tree
PACKED = "dim int, ids binary, vectors binary"


def integer_vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and integer components of the rows that take part."""
    good = "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return rows.where(good).selectExpr("vec_id", f"transform(embedding, x -> cast(floor({scale} * cast(x as double)) as bigint)) as v")


def packed(rows: DataFrame, limit: int) -> DataFrame:
    """Pack each task's vectors into rows of at most ``limit`` vectors of one length."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}

        def give(dim: int) -> pd.DataFrame:
            ids, vectors = held.pop(dim)
            return pd.DataFrame({"dim": [dim], "ids": [np.array(ids, "<i8").tobytes()], "vectors": [np.stack(vectors).astype("<i8").tobytes()]})

        for batch in batches:
            for i, v in zip(batch["vec_id"], batch["v"], strict=True):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == limit:
                    yield give(len(v))
        for dim in list(held):
            yield give(dim)

    return rows.mapInPandas(pack, PACKED)


def block_products(k: int):
    """Per (tile, block): the k best candidates of every query of the block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tile, ids, vectors, q_ids, q_vectors, dim in batch[["tile", "ids", "vectors", "q_ids", "q_vectors", "dim"]].itertuples(index=False):
                c, q = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                x, y = np.frombuffer(vectors, "<i8").reshape(-1, dim), np.frombuffer(q_vectors, "<i8").reshape(-1, dim)
                order = np.argsort(c, kind="stable")
                c, x = c[order], x[order]
                exact = float(np.abs(x).max()) * float(np.abs(y).max()) * dim < 2.0**53
                scores = (y.astype("f8") @ x.T.astype("f8")).astype("i8") if exact else y @ x.T
                # candidates ascend by id, so the cut keeps all above the k-th score and the first of those equal to it
                scores[q[:, None] == c[None, :]] = np.iinfo("i8").min
                m = min(k, len(c))
                least = np.partition(scores, len(c) - m, axis=1)[:, len(c) - m]
                above, level = scores > least[:, None], scores == least[:, None]
                room = m - above.sum(1)
                level &= np.cumsum(level, 1) <= room[:, None]
                r, j = np.nonzero(above | level)
                keep = c[j] != q[r]
                r, j = r[keep], j[keep]
                yield pd.DataFrame({"query_id": q[r], "vec_id": c[j], "score": scores[r, j], "tile": tile})

    return run


def merged(lists: DataFrame, k: int, lists_per_query: int) -> DataFrame:
    """Merge per-tile lists of a query in a tree; the last step ranks."""
    level = lists.withColumn("tile", F.pmod("tile", F.lit(max(1, lists_per_query))))
    width = lists_per_query
    while width > FAN_IN:
        width = -(-width // FAN_IN)
        level = level.withColumn("tile", F.pmod("tile", F.lit(width)))
        best = Window.partitionBy("query_id", "tile").orderBy(F.desc("score"), "vec_id")
        level = level.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return level.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """k best candidates of each distinct query; both sides come from ``integer_vectors``."""
    session = candidates.sparkSession
    tiles = materialize(packed(candidates, TILE).withColumn("tile", F.monotonically_increasing_id()))
    blocks = packed(queries.dropDuplicates(["vec_id"]), BLOCK).withColumn("_at", F.monotonically_increasing_id())
    # one row per block: a thousandth of a hundredth of the vectors
    at = Window.partitionBy("_part").orderBy("_at")
    blocks = materialize(blocks.withColumn("_part", F.shiftright("_at", 33)).withColumn("_nth", F.row_number().over(at)))
    heads = blocks.groupBy("_part").agg(F.max("_nth").alias("n")).withColumn("_base", F.sum("n").over(Window.partitionBy().orderBy("_part")) - F.col("n"))
    blocks = materialize(blocks.join(heads, "_part").select((F.col("_base") + F.col("_nth") - 1).alias("block"), "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))
    n_blocks, n_tiles = blocks.count(), tiles.count()
    path = f"{shared_folder(session)}/topk-{uuid.uuid4().hex}"
    schema = "query_id long, vec_id long, score long, tile long"
    session.createDataFrame([], schema).write.parquet(path)
    for first in range(0, n_blocks, BLOCKS_AT_ONCE):
        some = blocks.where(F.col("block").between(first, first + BLOCKS_AT_ONCE - 1))
        meet = tiles.repartition("tile").withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(min(n_blocks, first + BLOCKS_AT_ONCE) - 1))))
        pairs = meet.join(F.broadcast(some), ["block", "dim"])
        pairs.mapInPandas(block_products(k), schema).write.mode("append").parquet(path)
    return merged(session.read.schema(schema).parquet(path), k, n_tiles)
