"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine verification, components.

Vectors meet only within a label and a length. Copies (equal components) are one vector with a weight, so they cost nothing. A table's key is
the sign pattern of ``bits`` fixed random projections; vectors at the threshold angle a agree on one sign with 1 - a / pi, so ``tables``
follows from ``bits`` and the wanted recall at the threshold (closer pairs are found more surely). ``bits`` grows with the logarithm of
the largest label, which keeps the number of unrelated vectors in a bucket constant.

A bucket's vectors are dealt to tiles of about ``TILE`` and every pair of its tiles is one matrix product, so a bucket of any size is
many small tasks. A pair counts in the first table whose keys agree and in no later one, which makes the sums of links exact without
a list of pairs: a product gives one number of links and one link of a spanning forest for each vector. In later tables the tiles of a
bucket hold one key of the first table each, so tiles of a dense ball that the first table did already are not met again.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with nothing, nor does one whose label is
null; rows of the same id are vectors of their own; a null id is in a component by its links but never its name unless all are null;
``kept`` is false for it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import acos, ceil, log, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.components import components
from boxwright.session import materialize

TILE = 1024
RECALL = 0.9999
MOST_BITS = 40


def plan(largest: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for labels of up to ``largest`` distinct vectors."""
    bits = min(MOST_BITS, max(8, ceil(log(max(largest, 2), 2)) + 1))
    hit = (1 - acos(threshold) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - hit)))


def _vectors(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, double components) of the lists that can link."""
    flat = column.values
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.to_numpy(zero_copy_only=False).astype("f8")
    bad |= ~np.isfinite(values)
    values = np.where(bad, 0.0, values) + 0.0  # -0.0 is 0.0
    first = column.offsets.to_numpy()
    some = column.is_valid().to_numpy(zero_copy_only=False)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    for i in np.flatnonzero(some):
        a, b = first[i], first[i + 1]
        if a < b and wrong[a] == wrong[b] and values[a:b].any():
            yield i, values[a:b]


def named(rows: DataFrame) -> DataFrame:
    """(vec_id, label, name, vector): a digest and the little-endian doubles of the vectors that take part, else null."""
    read = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, vectors = [None] * batch.num_rows, [None] * batch.num_rows
            labelled = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for i, v in _vectors(batch.column(2)):
                if labelled[i]:
                    vectors[i] = v.astype("<f8").tobytes()
                    names[i] = hashlib.blake2b(vectors[i], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "label", "name", "vector"])

    types = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return read.mapInArrow(run, f"vec_id {types[0]}, label {types[1]}, name binary, vector binary")


def with_keys(groups: DataFrame, bits: int, tables: int, seed: int = 42) -> DataFrame:
    """Adds ``keys``, the sign patterns by table. The projections of a length are drawn from the seed and the length."""

    @F.pandas_udf("array<long>")
    def keys(vectors: pd.Series) -> pd.Series:
        out, lengths = [None] * len(vectors), vectors.str.len()
        for length in lengths.unique():
            at = np.flatnonzero(lengths == length)
            v = np.stack([np.frombuffer(x, "<f8") for x in vectors.iloc[at]])
            planes = np.random.default_rng([seed, int(length) // 8]).standard_normal((bits * tables, int(length) // 8))
            signs = ((v / np.abs(v).max(1, keepdims=True)) @ planes.T > 0).reshape(len(at), tables, bits)
            for i, k in zip(at, signs @ (1 << np.arange(bits, dtype=np.int64)), strict=True):
                out[i] = k
        return pd.Series(out)

    return groups.withColumn("keys", keys("vector"))


def cells(groups: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows of (cell, t, side, ...) for every pair of tiles of a bucket; a tile meets itself in a cell of one side.

    A bucket of one vector makes no cell.
    """
    bucket = ["label", "dim", "t", "key"]
    keyed = groups.select("g", "label", "dim", F.posexplode("keys").alias("t", "key"), F.expr("keys[0]").alias("first"))
    sizes = keyed.groupBy(*bucket, "first").agg(F.count("*").alias("n"))
    whole = sizes.groupBy(*bucket).agg(F.sum("n").alias("all")).where("all > 1")
    # a small bucket is one tile; a large one has tiles of its own for every key of the first table
    cut = sizes.join(whole, bucket).select(*bucket, "first", F.expr(f"if(all <= {tile}, 0L, cast(ceil(n / {tile}) as bigint)) as cuts"))
    cut = materialize(cut)
    at = keyed.join(cut, [*bucket, "first"]).select(
        *bucket, "g", F.expr("if(cuts = 0, struct(0L as own, 0L as cut), struct(first as own, pmod(xxhash64(g), cuts) as cut)) as tile")
    )
    tiles = cut.select(*bucket, "cuts", F.explode(F.expr("if(cuts = 0, array(struct(0L as own, 0L as cut)), transform(sequence(0L, cuts - 1), i -> struct(first as own, i as cut)))")).alias("tile"))
    one = tiles.select(*bucket, (F.col("cuts") == 0).alias("small"), F.col("tile").alias("a")).distinct()
    # in later tables two tiles of the same first key hold only pairs that the first table counted
    met = one.join(one.select(*bucket, F.col("a").alias("b")), bucket).where("a <= b and (small or t = 0 or a.own <> b.own)")
    cell = F.concat_ws("|", *bucket, "a.own", "a.cut", "b.own", "b.cut").alias("cell")
    sides = F.expr("if(a = b, array(struct(0 as side, a as tile)), array(struct(0 as side, a as tile), struct(1 as side, b as tile)))")
    return at.join(met.select(*bucket, cell, F.explode(sides).alias("x")).select(*bucket, "cell", "x.*"), [*bucket, "tile"]).select("cell", "t", "side", "g")


def _forest(near: np.ndarray) -> np.ndarray:
    """Least reachable place for every place of a symmetric boolean matrix."""
    at = np.arange(len(near))
    while True:
        least = np.where(near, at[None, :], len(near)).min(1)
        new = np.minimum(at, least)
        new = new[new]
        if (new == at).all():
            return at
        at = new


def _products(threshold: float):
    """Per cell: links of every vector that has one, and its link of a spanning forest."""

    def solve(t: int, side: np.ndarray, g: np.ndarray, w: np.ndarray, vectors: list, keys: list):
        x, k = np.stack([np.frombuffer(v, "<f8") for v in vectors]), np.array(keys)
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if side.any() else a
        near = x[a] @ x[b].T >= threshold
        for s in range(t):
            near &= k[a, s][:, None] != k[b, s][None, :]
        if a is b:
            np.fill_diagonal(near, False)
        if not near.any():
            return None
        links = np.zeros(len(g), np.int64)
        links[a] += near @ w[b]
        if a is not b:
            links[b] += w[a] @ near
        whole = np.zeros((len(g), len(g)), bool)
        whole[np.ix_(a, b)] = near
        whole |= whole.T
        root = _forest(whole)
        some = np.flatnonzero(whole.any(1))
        return g[some], g[root[some]], links[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def give() -> None:
            if len(held) > 1:
                t, side, g, w, vectors, keys = zip(*held, strict=True)
                found = solve(t[0], np.array(side), np.array(g), np.array(w), vectors, keys)
                if found is not None:
                    out.append(found)

        def packed() -> pa.RecordBatch:
            u, v, n = (np.concatenate(c) for c in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["u", "v", "links"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cell", "t", "side", "g", "w", "vector", "keys")]
            for cell, *row in zip(*columns, strict=True):
                if cell != now:
                    give()
                    now, held = cell, []
                held.append(row)
            if out:
                yield packed()
                out = []
        give()
        if out:
            yield packed()

    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.98, recall: float = RECALL, tile: int = TILE, plan_of=plan) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row (vec_id, label, embedding)."""
    read = materialize(named(rows))
    groups = read.where("name is not null").groupBy("label", "name").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    groups = materialize(groups.withColumns({"g": F.monotonically_increasing_id(), "dim": F.length("vector")}))
    largest = groups.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    groups = materialize(with_keys(groups, *plan_of(largest, threshold, recall)))
    met = cells(groups.select("g", "label", "dim", "keys"), tile).join(groups.select("g", "w", "vector", "keys"), "g")
    laid = met.repartition("cell").sortWithinPartitions("cell")
    found = materialize(laid.mapInArrow(_products(threshold), "u long, v long, links long"))
    degree = found.groupBy(F.col("u").alias("g")).agg(F.sum("links").alias("links"))
    roots = components(found.select("u", "v")).select(F.col("node").alias("g"), "root")
    placed = groups.select("g", "label", "name", "w", "least").join(degree, "g", "left").join(roots, "g", "left").withColumn("root", F.coalesce("root", "g"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_name = placed.join(least, "root").select("label", "name", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = read.select("vec_id", "label", "name").join(by_name, ["label", "name"], "left")
    component = F.when(F.col("name").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
