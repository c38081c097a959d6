"""Probabilistic suffix tree over text bytes, and the add-one word scores beside it.

Symbols are UTF-8 bytes of the lower-cased text and one end symbol. Tasks count windows of ``DEPTH`` bytes and the next
symbol; Spark sums them. Contexts of every length are sums of these counts. A context stays in the tree when it is seen
``least`` times or more and its next-symbol distribution diverges from that of its longest retained proper suffix
(Kullback-Leibler divergence weighted by its count, in bits). Distributions are smoothed by mixing in the
suffix's with the weight d / (n + d), d being the distinct symbols seen (Witten-Bell); the empty context mixes in the uniform one. A
position is scored in its longest suffix state.

The tree is a table and grows with the corpus. Texts are read once for the windows of training texts and of those to score
(with a count of 0). A window's code has the last byte of its context first, so the contexts that end alike are one run of
the sorted codes: contexts of up to ``BASE`` bytes are one list, bounded by the bytes there are; the windows that end in the same
``BASE`` + 1 bytes meet in one task, which grows all longer contexts of theirs.

Texts are scored by their windows' probabilities. Windows whose contexts have the same last bytes, and no state beyond those, are
one entry; the most frequent entries and words (a bound on what is sent, not on the result) are looked up in the tasks, all
other windows and words are joined.

Defined results: null and empty texts are the end alone; repeated rows score alike; an empty training set gives the uniform
model and counts of 0; an empty table gives an empty result; further columns pass through (``keep`` names the columns to
carry, all by default), clashing names are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm.text import body
from boxwright.session import materialize

DEPTH = 6
BASE = 2  # contexts of up to so many bytes are one list
END = 0x100  # the end symbol
STEP = 1 << 21  # symbols worked on at once
HELD = 1 << 21  # distinct windows that a task holds before it gives their counts
NAMES = 1 << 19  # distinct words likewise
ROWS = 1 << 19  # windows whose contexts are grown at once
ENDING = 9 + 8 * (DEPTH - BASE - 1)  # bits of a code behind the last BASE + 1 bytes of its context


def raw_texts(column: pa.Array) -> list[bytes]:
    """Lower-cased bytes; null is empty."""
    return [(t or b"").lower() for t in column.cast(pa.large_binary()).to_pylist()]


def pieces(texts: Iterable[bytes], step: int = STEP) -> Iterator[list[bytes]]:
    """Lists of texts with about ``step`` symbols."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + DEPTH
        if size >= step:
            yield held
            held, size = [], 0
    if held:
        yield held


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of texts and their number per text: DEPTH bytes of context, the last one highest, and the next symbol in the lowest 9
    bits, one per byte and one for the end. Zeros stand before the first byte."""
    x = np.frombuffer(b"".join(bytes(DEPTH) + t for t in texts) + bytes(DEPTH), np.uint8).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    last = np.cumsum(sizes + DEPTH - 1) - DEPTH
    code = x[DEPTH:].copy()
    code[last] = END
    for i in range(DEPTH):
        code |= x[i : i + len(code)] << (9 + 8 * i)
    whole = np.ones(len(code), bool)
    for k in range(1, DEPTH):
        whole[last + k] = False
    return code[whole], sizes


def starts(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.r_[len(values) > 0, values[1:] != values[:-1]])


def run_of(first: np.ndarray, size: int) -> np.ndarray:
    """The run of every place."""
    return np.repeat(np.arange(len(first)), np.diff(np.r_[first, size]))


def count_windows(marked: DataFrame) -> DataFrame:
    """(code, n, m) over all texts (text, n, m); n and m of a text are 0 or 1 and say where its windows count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, times = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, first = keys[order], starts(keys[order])
            return keys[first], np.add.reduceat(times[order], first)

        def give() -> pa.RecordBatch:
            keys, times = merged()
            codes = keys >> 2
            first = starts(codes)
            n, m = (np.add.reduceat(times * (keys >> bit & 1), first) for bit in (1, 0))
            return pa.RecordBatch.from_arrays([pa.array(codes[first]), pa.array(n), pa.array(m)], names=["code", "n", "m"])

        for batch in batches:
            texts, n, m = raw_texts(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            done = 0
            for part in pieces(texts):
                codes, sizes = windows(part)
                kinds = 2 * n[done : done + len(part)] + m[done : done + len(part)]
                done += len(part)
                held.append(np.unique(codes << 2 | np.repeat(kinds, sizes), return_counts=True))
                size += len(held[-1][0])
                if size >= 2 * HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size >= HELD:
                        yield give()
                        held, size = [], 0
        if held:
            yield give()

    found = marked.select("text", F.col("n").cast("long"), F.col("m").cast("long")).mapInArrow(count, "code long, n long, m long")
    return found.groupBy("code").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def grown(rows: np.ndarray, n: np.ndarray, q: np.ndarray, length: int, least: int, min_bits: float) -> tuple[np.ndarray, np.ndarray]:
    """Probability of every row (context and symbol, sorted) in its longest suffix state, and whether its context is one. q: that in
    the states of shorter contexts."""
    first = starts(rows >> 9)
    of = run_of(first, len(rows))
    seen = n > 0
    total, d = np.add.reduceat(n, first), np.add.reduceat(seen.astype(float), first)
    bits = np.add.reduceat(n * np.log2(np.where(seen, n / np.maximum(total[of], 1) / q, 1.0)), first)
    keep = total > 0 if length == 0 else (total >= least) & (bits >= min_bits)
    return np.where(keep[of], (n + d[of] * q) / np.maximum(total[of] + d[of], 1), q), keep[of]


def shorter(code: np.ndarray, length: int) -> np.ndarray:
    """Context and symbol of windows, with the last ``length`` bytes of the context."""
    return code >> (9 + 8 * (DEPTH - length)) << 9 | code & 511


def entry(code: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Key of the windows that have the symbol and the last ``length`` bytes in common."""
    return length - BASE << 57 | code & ~((1 << 8 * (DEPTH - length)) - 1 << 9)


def states(counts: DataFrame, least: int = 8, min_bits: float = 64.0) -> DataFrame:
    """(code, l, length, met, first) of every window to score (code, n, m): log10 of its symbol's probability in its longest suffix
    state; windows with the same last ``length`` bytes and symbol are one entry, met that often, of which one row is the first."""
    short = counts.groupBy(F.expr(f"shiftleft(shiftright(code, {9 + 8 * (DEPTH - BASE)}), 9) | (code & 511)").alias("code")).agg(F.sum("n").alias("n")).toArrow().sort_by("code")
    base, n = short["code"].to_numpy(), short["n"].to_numpy().astype(float)
    logs = np.full(len(base), 1 / 257)
    for length in range(BASE + 1):
        rows, at, of = np.unique(base >> (9 + 8 * (BASE - length)) << 9 | base & 511, return_index=True, return_inverse=True)
        logs = grown(rows, np.bincount(of, n, len(rows)), logs[at], length, least, min_bits)[0][of] if len(rows) else logs

    def grow(code: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        p, deepest = logs[np.searchsorted(base, shorter(code, BASE))], np.zeros(len(code), np.int64)
        for length in range(BASE + 1, DEPTH + 1):
            rows, at, of = np.unique(shorter(code, length), return_index=True, return_inverse=True)
            p, keep = (x[of] for x in grown(rows, np.bincount(of, n, len(rows)), p[at], length, least, min_bits))
            deepest[keep] = length
        enough = np.full(len(code), DEPTH, np.int64)
        for length in range(DEPTH - 1, BASE, -1):
            first = starts(code >> (9 + 8 * (DEPTH - length)))
            enough[np.maximum.reduceat(deepest, first)[run_of(first, len(code))] <= length] = length
        some = np.flatnonzero(m > 0)
        keys, at, of = np.unique(entry(code[some], enough[some]), return_index=True, return_inverse=True)
        met, first = np.bincount(of, m[some], len(keys)).astype(np.int64), np.zeros(len(some), bool)
        first[at] = True
        columns = [pa.array(code[some]), pa.array(np.log10(p[some])), pa.array(enough[some].astype(np.int8)), pa.array(met[of]), pa.array(first)]
        return pa.RecordBatch.from_arrays(columns, names=["code", "l", "length", "met", "first"])

    def grow_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, enough = [], 0, ROWS
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += len(batch)
            if size >= enough:
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                # the last bytes at the end may go on in the next batch
                cut = np.searchsorted(rows[0], rows[0][-1] >> ENDING << ENDING)
                if cut:
                    yield grow(*[x[:cut] for x in rows])
                held, size = [[x[cut:] for x in rows]], len(rows[0]) - cut
                enough = max(ROWS, 2 * size)
        if size:
            yield grow(*[np.concatenate(x) for x in zip(*held, strict=True)])

    together = counts.select("code", "n", "m").repartition(F.shiftright("code", ENDING)).sortWithinPartitions("code")
    return together.mapInArrow(grow_all, "code long, l double, length byte, met long, first boolean")


def frequent_entries(found: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys and log10 probabilities of the entries met 2^k times or more, and k, the least one with at most ``most`` entries."""
    bits, only = F.floor(F.log2("met")).cast("int"), found.where("first")
    sizes = dict(only.groupBy(bits.alias("k")).count().collect())
    k, held = 64, 0
    while k > 0 and held + sizes.get(k - 1, 0) <= most:
        k -= 1
        held += sizes.get(k, 0)
    rows = only.where(bits >= k).select("code", "l", "length").toArrow()
    keys = entry(rows["code"].to_numpy(), rows["length"].to_numpy().astype(np.int64))
    order = np.argsort(keys)
    return keys[order], rows["l"].to_numpy()[order], k


def text_scores(keys: np.ndarray, logs: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the sum over its windows in an entry of ``keys``; all other windows, and their number per text."""
    codes, sizes = windows(texts)
    distinct, of = np.unique(codes, return_inverse=True)
    l, hit = np.zeros(len(distinct)), np.zeros(len(distinct), bool)
    for length in range(BASE + 1, DEPTH + 1):
        mine = entry(distinct, np.int64(length))
        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        same = keys[at] == mine if len(keys) else hit[:0]
        l[np.flatnonzero(same)] = logs[at[same]] if len(keys) else 0
        hit[np.flatnonzero(same)] = True
    first, rare = np.cumsum(sizes) - sizes, ~hit[of]
    return np.add.reduceat(l[of], first), codes[rare], np.add.reduceat(rare.astype(np.int64), first)


def word_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word, c) over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in raw_texts(batch.column(0)):
                held.update(text.split())
                if len(held) >= NAMES:
                    yield give()
                    held.clear()
        if held:
            yield give()

    return texts.select(body(F.col(column))).mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(
    docs: DataFrame, training: DataFrame | Column, frequent: int = 65_536, column: str = "text", sent: int = 1 << 20, keep: Sequence[str] | None = None
) -> DataFrame:
    """Documents with n_tokens, n_known, train_tokens, base_score and score, learnt from ``training``: texts, or the test that
    picks them from the documents, which are then read once for both."""
    text = body(F.col(column)).alias("text")
    if isinstance(training, Column):
        marked = docs.select(text, F.coalesce(training.cast("int"), F.lit(0)).alias("n"), F.lit(1).alias("m"))
    else:
        marked = docs.select(text, F.lit(0).alias("n"), F.lit(1).alias("m")).union(training.select(text, F.lit(1), F.lit(0)))
    learnt = marked.where("n = 1").select("text")
    counts = materialize(word_counts(learnt))
    texts, (n_words, n_types) = learnt.count(), counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the end is a token of every training text
    total, types, ends = n_words + texts, n_types + (texts > 0), texts
    found = materialize(states(materialize(count_windows(marked))))
    keys, logs, k = frequent_entries(found, sent)
    head = counts.where(F.length("word") <= 64).orderBy(F.desc("c"), "word").limit(frequent).toPandas()
    known = dict(zip(head["word"].str.encode("utf-8"), head["c"].astype(int), strict=True))
    scale = float(total + types + 1)
    rest = (docs if keep is None else docs.select(*dict.fromkeys((*keep, column)))).drop("n_tokens", "n_known", "train_tokens", "base_score", "score", "_s", "_row", "_t")

    @F.arrow_udf("n_words long, known long, base double, score double, others array<struct<word: string, n: int>>, windows array<long>")
    def local(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([local_part(raw) for raw in pieces(raw_texts(texts))] or [local_part([])])

    def local_part(raw: list[bytes]) -> pa.Array:
        """Totals of the frequent words and of the tree per text; the others as flat arrays, so a batch stays small."""
        totals, names, times, ends = [], [], [], [0]
        for text in raw:
            found, base, size = 0, 0.0, 0
            for w, n in Counter(text.split()).items():
                c = known.get(w)
                size += n
                if c is None:
                    names.append(w)
                    times.append(n)
                else:
                    found += n
                    base += n * log10((c + 1) / scale)
            totals.append((size, found, base))
            ends.append(len(names))
        size, found, base = zip(*totals) if totals else ((), (), ())
        other = pa.StructArray.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.array(times, pa.int32())], ["word", "n"])
        scores, rare, others = text_scores(keys, logs, raw) if raw else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        bounds = np.concatenate(([0], np.cumsum(others))).astype(np.int32)
        columns = [
            pa.array(size, pa.int64()), pa.array(found, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), other),
            pa.ListArray.from_arrays(pa.array(bounds), pa.array(rare, pa.int64())),
        ]
        return pa.StructArray.from_arrays(columns, ["n_words", "known", "base", "score", "others", "windows"])

    placed = rest.withColumn("_s", local(body(F.col(column)))).withColumn("_row", F.monotonically_increasing_id())
    names = [c for c in rest.columns if keep is None or c in keep]
    placed = materialize(placed.select(*names, "_s", "_row"))
    rows = placed.select("_row", F.explode("_s.others").alias("x")).select("_row", F.col("x.word").alias("word"), F.col("x.n").alias("n"))
    unsent = found.where(F.floor(F.log2("met")) < k).select("code", "l")
    rare = placed.select("_row", F.explode("_s.windows").alias("code")).join(unsent, "code").groupBy("_row").agg(F.sum("l").alias("tail"))
    others = rows.join(counts, "word", "left").groupBy("_row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("found"),
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(scale))).alias("rest"),
    )
    end = F.log10(F.lit((ends + 1) / scale))
    return placed.join(others, "_row", "left").join(rare, "_row", "left").select(
        *names, (F.col("_s.n_words") + 1).alias("n_tokens"), (F.col("_s.known") + F.coalesce("found", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("_s.base") + F.coalesce("rest", F.lit(0.0)) + end).alias("base_score"), (F.col("_s.score") + F.coalesce("tail", F.lit(0.0))).alias("score"),
    )
