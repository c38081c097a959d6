"""Embedding search: nearest neighbours, filtered search, similarity counts, prototypes, PCA."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.operators.scans import salted_top_k
from boxwright.session import materialize


def unit(column: str) -> str:
    """Vector scaled to unit length."""
    norm = f"sqrt(aggregate({column}, 0D, (s, v) -> s + cast(v as double) * v))"
    return f"transform({column}, v -> cast(v as double) / {norm})"


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (p, q) -> cast(p as double) * q), 0D, (s, v) -> s + v)"


def distance(a: str, b: str) -> str:
    return f"sqrt(aggregate(zip_with({a}, {b}, (p, q) -> pow(cast(p as double) - q, 2)), 0D, (s, v) -> s + v))"


def prototypes(vectors: DataFrame, classes: DataFrame, dims: int) -> DataFrame:
    """Unit mean vector per class (cls, embedding), zeros where a class has none.

    One average per dimension keeps the aggregation partial on the map side.
    """
    means = vectors.groupBy("cls").agg(*[F.expr(f"avg(embedding[{i}]) as m{i}") for i in range(dims)])
    packed = means.selectExpr("cls", f"array({', '.join(f'm{i}' for i in range(dims))}) as m").selectExpr("cls", f"{unit('m')} as vector")
    return classes.join(packed, "cls", "left").selectExpr("cls", f"coalesce(vector, array_repeat(0D, {dims})) as vector")


def pca(vectors: DataFrame, k: int) -> DataFrame:
    """Projection on the first principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    prepared = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(prepared)
    out = model.transform(prepared).select("vec_id", vector_to_array("pc").alias("pc"))
    return out.selectExpr("vec_id", *[f"pc[{i}] as pc{i + 1}" for i in range(k)])


def scored(vectors: DataFrame, queries: DataFrame, metric: str = "cosine") -> DataFrame:
    """Score every vector against a short list of queries (qid, q), broadcast because the caller bounds it."""
    score = dot("v", "q") if metric == "cosine" else distance("v", "q")
    prepared = vectors.selectExpr("*", f"{unit('embedding') if metric == 'cosine' else 'embedding'} as v")
    return prepared.join(F.broadcast(queries)).selectExpr(*[c for c in vectors.columns if c != "embedding"], *[c for c in queries.columns if c != "q"], f"{score} as score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 30, floor: float = 0.1, metric: str = "cosine", where: str | None = None) -> DataFrame:
    """First k vectors per query, best first. ``where`` filters before scoring (it may name query columns)."""
    out = scored(vectors, queries, metric)
    if where:
        out = out.where(where)
    order = "score desc, vec_id" if metric == "cosine" else "score, vec_id"
    if metric == "cosine":
        out = out.where(f"score >= {floor}D")
    return salted_top_k(out, ["qid"], order, k, "pmod(xxhash64(vec_id), 256)")


def mean_query(queries: DataFrame) -> DataFrame:
    """Several query vectors as one: their mean, dimension by dimension."""
    flat = queries.selectExpr("posexplode(q) as (i, v)").groupBy("i").agg(F.expr("avg(v) as v"))
    return flat.agg(F.expr("transform(array_sort(collect_list(struct(i, v))), s -> s.v) as q")).selectExpr("0L as qid", "q")


FAN = 16  # children of a cell
LEAF = 1500  # a cell of so many vectors a side is compared as it is
LEVELS = 12
SPREAD = 4  # copies of a right row that splits may make in all, on average
BLOCK = 4096  # left rows of a tile, of a larger cell more
TILES = 8  # tiles of a cell, to each of which its right rows are sent, until tiles of WIDE blocks fill them
WIDE = 16
STRIP = 512  # right rows of a matrix product
PAIRS = 8192  # pairs whose differences are summed at once
HELD = 500_000  # pairs a task keeps before it drops all but the nearest


def _sizes(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    one, two = (side.groupBy(*by).agg(F.expr(f"count(*) as {n}")) for side, n in ((left, "l"), (right, "r")))
    return one.join(two, list(by))


def pivot_tree(unique: DataFrame, radius: float, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(left, right) rows (rep, n, v, cell) of a table that can be read again: any two vectors closer than ``radius`` meet in the left one's cell.

    A cell of many vectors is split by pivots of its own: a left row goes to the nearest, a right row to every pivot at most twice the radius
    further than its nearest, which is where its partners can be. The tree grows with the data; a split that does not halve the comparisons
    of a cell, or that would copy right rows more than ``SPREAD`` times in all, is not made. Splits are weighed by counts alone, so only rows of cells
    that are split are written.
    """
    columns = ["rep", "n", "v", "cell"]
    left = right = unique.selectExpr("rep", "n", "v", "0L as cell")
    cells = unique.sparkSession.range(1).selectExpr("id as cell", "1D as spread")
    done: list[tuple[DataFrame, DataFrame]] = []
    for _ in range(LEVELS):
        big = materialize(_sizes(left, right, "cell").where(f"l * r > {leaf * leaf}").join(cells, "cell"))
        if big.isEmpty():
            break
        done.append((left.join(big, "cell", "left_anti"), right.join(big, "cell", "left_anti")))
        left, right = (side.join(big.select("cell"), "cell", "left_semi") for side in (left, right))
        chosen = salted_top_k(left.selectExpr("cell", "v", "xxhash64(rep, cell) as h"), ["cell"], "h", FAN, "pmod(h, 64)")
        pivots = materialize(chosen.groupBy("cell").agg(F.expr("collect_list(v) as ps")))

        def measured(side: DataFrame) -> DataFrame:
            return side.join(pivots, "cell").selectExpr(*columns, f"transform(ps, p -> {distance('v', 'p')}) as d").selectExpr("*", "array_min(d) as m")

        child = f"cell * {FAN} + 1"
        reach = f"filter(sequence(0, size(d) - 1), i -> d[i] <= m + {2 * radius + 1e-9}D)"
        to_left = measured(left).selectExpr(*columns, f"{child} + array_position(d, m) - 1 as child")
        to_right = measured(right).selectExpr(*columns, f"explode(transform({reach}, i -> {child} + i)) as child")
        after = materialize(_sizes(to_left, to_right, "cell", "child").withColumnsRenamed({"l": "cl", "r": "cr"}))
        split = after.groupBy("cell").agg(F.expr("sum(cl * cr) as work"), F.expr("sum(cr) as rows")).join(big, "cell")
        worth = materialize(split.where(f"work < 0.5 * l * r and spread * rows / r <= {SPREAD}").selectExpr("cell", "spread * rows / r as spread"))
        if worth.isEmpty():
            break
        done.append((left.join(worth, "cell", "left_anti"), right.join(worth, "cell", "left_anti")))
        # a right row goes to children that have left rows
        used = after.join(worth, "cell").select("cell", "child", "spread")
        left, right = (materialize(side.join(used, ["cell", "child"], "left_semi").selectExpr("rep", "n", "v", "child as cell")) for side in (to_left, to_right))
        cells = used.selectExpr("child as cell", "spread")
    done.append((left, right))
    return tuple(reduce(DataFrame.unionByName, side) for side in zip(*done, strict=True))


def _by_size(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of every length; those that hold null or non-finite components are near to nothing."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(float), lists.value_lengths().fill_null(0).to_numpy()
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        matrix = flat[starts[at][:, None] + np.arange(size)]
        whole = np.isfinite(matrix).all(axis=1)
        yield at[whole], matrix[whole]


class Met:
    """Left rows of one length in a tile, and what they have met so far. ``most`` is the distance of each beyond which another row changes nothing."""

    def __init__(self, reps: np.ndarray, rows: np.ndarray, max_dist: float):
        self.reps, self.rows, self.max_dist = reps, rows, max_dist
        self.most = np.full(len(reps), float(max_dist))
        self.near, self.best = np.zeros(len(reps), np.int64), np.full(len(reps), np.inf)
        self.found: list[list[np.ndarray]] = []
        self.kept = self.new = 0

    def closer(self, two: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, distance) of rows closer than ``max_dist`` that are not beyond ``most``.

        A matrix product with two more columns, the halves of both squared norms less the bound, is below zero for far pairs. It is taken in
        single precision with a slack of twice its error at least; the differences of the others are summed in double precision.
        """
        width = two.shape[1]
        slack = (width + 16) * 2.0**-22
        with np.errstate(over="ignore", invalid="ignore"):
            for first in range(0, len(two), STRIP):
                strip = two[first : first + STRIP]
                norms = (strip * strip).sum(axis=1)
                for top in range(0, len(self.rows), BLOCK):
                    one, limit = self.rows[top : top + BLOCK], self.most[top : top + BLOCK] ** 2
                    squares = (one * one).sum(axis=1)
                    kind = np.float32 if max(norms.max(), squares.max(), limit.max()) < 1e30 else float
                    near = (limit * (1 + slack) - squares * (1 - slack)) / 2
                    left = np.column_stack([one, near, np.ones(len(one))]).astype(kind)
                    right = np.column_stack([strip, np.ones(len(strip)), norms * (slack - 1) / 2]).astype(kind)
                    some = np.flatnonzero(~(left @ right.T < -1e-35).ravel())
                    for part in np.split(some, range(PAIRS, len(some), PAIRS)):
                        i, j = np.divmod(part, len(strip))
                        terms = (one[i] - strip[j]) ** 2
                        total = np.zeros(len(part))
                        for d in range(width):
                            total += terms[:, d]
                        dist = np.sqrt(total)
                        i += top
                        stay = (dist < self.max_dist) & (dist <= self.most[i])
                        yield i[stay], j[stay] + first, dist[stay]

    def add(self, i: np.ndarray, r_rep: np.ndarray, r_n: np.ndarray, dist: np.ndarray) -> None:
        self.found.append([i.astype(np.int32), r_rep, r_n, dist])
        self.new += len(i)

    def taken(self) -> list[np.ndarray]:
        """The pairs held (row, r_rep, r_n, distance), which are given away."""
        columns = [np.concatenate(c) for c in zip(*self.found, strict=True)]
        self.found, self.kept, self.new = [], 0, 0
        return columns

    def nearest(self, k: int) -> None:
        """Of the pairs held the k nearest of every row stay, with all that tie at nine places."""
        found = self.taken()
        order = np.lexsort([found[3], found[0]])
        found = [c[order] for c in found]
        start, end = (np.searchsorted(found[0], found[0], side) for side in ("left", "right"))
        last = found[3][np.minimum(start + k, end) - 1] + 2e-9
        full = end - start >= k
        self.most[found[0][full]] = np.minimum(self.most[found[0][full]], last[full])
        self.found = [[c[found[3] <= last] for c in found]]
        self.kept = len(self.found[0][0])


def met_in_tiles(
    left: DataFrame, right: DataFrame, max_dist: float, k: int | None = None, totals: bool = False, block: int = BLOCK, enough: int | None = None,
) -> DataFrame:
    """(rep, r_rep, r_n, dist) of the left and right rows of a cell that are closer than ``max_dist``.

    A cell's left rows are dealt to tiles of ``block`` rows at least. A task holds a tile's left rows, which move once, and streams all right rows of the
    cell, so these are copied once a tile: to ``TILES`` tiles, of a cell of more than TILES * WIDE blocks to one per WIDE blocks. With ``k`` a tile gives only
    the nearest of each left row; with ``totals`` one row (rep, near, best): the weights of all and the least distance, and weights past ``enough``
    are not counted on. In both cases a row that has what it needs is compared with nearer rows only.
    """
    wide = WIDE * block if k is None else max(block, min(WIDE * block, 4 * HELD // max(k, 1)))
    tiles = f"cast(least(ceil(l / {block}), greatest({TILES}, ceil(l / {wide}))) as int)"
    shape = materialize(_sizes(left, right, "cell").selectExpr("cell", f"{tiles} as ls", "l", "r"))
    # a tile of a large cell or a share of the comparisons or of the rows for each task, so small cells are met together
    tasks = shape.agg(F.expr(f"coalesce(cast(ceil(greatest(sum(if(ls > 1, ls, l * 1D * r / {block * block})), sum(l + r) / {16 * block})) as bigint), 1)")).first()[0]
    shape = shape.select("cell", "ls")
    one = left.where("rep is not null").join(shape, "cell").selectExpr("cell", "cast(pmod(xxhash64(rep), ls) as int) as a", "0 as side", "rep", "n", "v")
    two = right.where("rep is not null").join(shape, "cell").selectExpr("cell", "explode(sequence(0, ls - 1)) as a", "1 as side", "rep", "n", "v")
    keys = ["cell", "a"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "near", "best"] if totals else ["rep", "r_rep", "r_n", "dist"]
        tile, held, ready = None, [], {}

        def give(met: Met) -> Iterator[pa.RecordBatch]:
            if totals:
                some = np.flatnonzero(met.near)
                yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (met.reps, met.near, met.best)], names=names)
            elif met.found:
                if k is not None:
                    met.nearest(k)
                rows, *rest = met.taken()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (met.reps[rows], *rest)], names=names)

        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*keys, "side")], axis=1)
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1 if len(marks) else []
            for lo, hi in itertools.pairwise([0, *edges, len(marks)]):
                if lo == hi:
                    continue
                if tile != tuple(marks[lo, :2]):
                    for met in ready.values():
                        yield from give(met)
                    tile, held, ready = tuple(marks[lo, :2]), [], {}
                part = batch.slice(lo, hi - lo)
                reps, ns = part.column("rep").to_numpy(), part.column("n").to_numpy()
                groups = [(reps[at], ns[at], m) for at, m in _by_size(part.column("v")) if len(at)]
                if marks[lo, 2] == 0:
                    held += [(r, m) for r, _, m in groups]
                    continue
                for width in {m.shape[1] for _, m in held}:
                    # the left rows of a tile come first, so they are all here
                    same = [(r, m) for r, m in held if m.shape[1] == width]
                    ready[width] = Met(np.concatenate([r for r, _ in same]), np.concatenate([m for _, m in same]), max_dist)
                held = []
                for r_reps, r_ns, two_m in groups:
                    met = ready.get(two_m.shape[1])
                    if met is None:
                        continue
                    for i, j, dist in met.closer(two_m):
                        other = met.reps[i] != r_reps[j]
                        i, j, dist = i[other], j[other], dist[other]
                        if totals:
                            np.add.at(met.near, i, r_ns[j])
                            np.minimum.at(met.best, i, dist)
                        elif len(i):
                            met.add(i, r_reps[j], r_ns[j], dist)
                            if met.new > max(HELD, met.kept) // 2:
                                if k is None:
                                    yield from give(met)
                                else:
                                    met.nearest(k)
                    if totals and enough is not None:
                        full = met.near >= enough
                        met.most[full] = met.best[full]
        for met in ready.values():
            yield from give(met)

    schema = "rep long, near long, best double" if totals else "rep long, r_rep long, r_n long, dist double"
    # many partitions, so that two tiles seldom meet in one
    dealt = one.unionByName(two).repartition(min(16 * tasks, 4000), *keys).sortWithinPartitions(*keys, "side")
    return dealt.mapInArrow(compare, schema)


def _members(vectors: DataFrame, max_dist: float, leaf: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, left, right): vec_id with its representative, and the tree over distinct vectors."""
    # single precision stays so until it is compared, which is exact and half the bytes
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = vectors.selectExpr("vec_id", "embedding as v" if single else "cast(embedding as array<double>) as v")
    unique = materialize(rows.groupBy("v").agg(F.expr("min(vec_id) as rep"), F.expr("count(*) as n")))
    left, right = pivot_tree(unique, max_dist, leaf)
    # vectors find their representative by a digest of their text, in which equal numbers are equal; a null vector has none
    digest = "unhex(sha2(cast(transform(v, x -> x + 0D) as string), 256)) as digest"
    members = rows.selectExpr("vec_id", digest).join(unique.selectExpr(digest, "rep", "n"), "digest").select("vec_id", "rep", "n")
    return members, left, right


def similar_pairs(vectors: DataFrame, max_dist: float, leaf: int = LEAF, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, pairs): vec_id with its representative, and (rep, r_rep, r_n, dist) of distinct vectors closer than ``max_dist``.

    Copies collapse to one vector with a weight. ``k`` asks for the k nearest of every vector only (a few more come along).
    """
    members, left, right = _members(vectors, max_dist, leaf)
    return members, met_in_tiles(left, right, max_dist, k)


def similarity_counts(vectors: DataFrame, max_dist: float, top_k: int, leaf: int = LEAF) -> DataFrame:
    """For each vector, how many others lie closer than ``max_dist`` (at most top_k), and the nearest one's distance."""
    members, left, right = _members(vectors, max_dist, leaf)
    found = met_in_tiles(left, right, max_dist, totals=True, enough=top_k).groupBy("rep").agg(F.expr("sum(near) as near"), F.expr("min(best) as best"))
    return members.join(found, "rep", "left").selectExpr(
        "vec_id", f"least(coalesce(near, 0) + n - 1, {top_k}) as n_similar", "if(n > 1, 0D, best) as nearest_dist"
    )


def similarity_lists(vectors: DataFrame, max_dist: float, top_k: int, leaf: int = LEAF) -> DataFrame:
    """For each vector, the ids of up to ``top_k`` others closer than ``max_dist``, nearest first, ties by id.

    Distances are compared at nine places. A copy stands in the list for itself; of a vector with many copies the first ids do.
    """
    members, pairs = similar_pairs(vectors, max_dist, leaf, top_k)
    members = materialize(members)
    ids = salted_top_k(members.select("rep", "vec_id"), ["rep"], "vec_id", top_k + 1, "pmod(xxhash64(vec_id), 64)").groupBy("rep").agg(F.expr("collect_list(vec_id) as ids"))
    first = salted_top_k(pairs.selectExpr("rep", "r_rep", "round(dist, 9) as dist"), ["rep"], "dist, r_rep", top_k, "pmod(xxhash64(r_rep), 64)").drop("rank")
    own = ids.selectExpr("rep", "rep as r_rep", "0D as dist")
    listed = first.unionByName(own).join(ids.withColumnRenamed("rep", "r_rep"), "r_rep").groupBy("rep").agg(
        F.expr("array_sort(flatten(collect_list(transform(ids, i -> struct(dist, i as id))))) as near")
    )
    return members.join(listed, "rep").selectExpr("vec_id", f"slice(filter(transform(near, x -> x.id), i -> i <> vec_id), 1, {top_k}) as similar")
