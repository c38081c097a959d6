"""Phrase collocations by weighted acyclic automata of n-gram counts.

Three passes over the texts, by length of phrase: words, pairs, and 3 to ``longest`` words. A phrase seen ``least`` times has only parts seen
as often, so a pass keeps what the pass before left: bitmaps of fixed size mark the frequent words, then the frequent pairs (two phrases on one
bit cost work, not results). In a pass every task cuts its texts into words by array operations, counts phrases and builds an
automaton a prefix range from them whenever a few million are held (``automata.py``). The ranges are those of a hash of a phrase's first two words,
so a frequent first word is spread over many. The automata of a range meet in one task, which unites them one by one, sums
the weights and keeps the phrases seen often enough. Part counts are lookups: the frequent phrases of a range are one automaton, and the parts of
candidates are composed with it, in salted streams, since a common word is a part of many.

A word's label is a 64-bit hash of its language and bytes. A second hash travels with every distinct word of the first pass; if two words
share a label, all is done again with another seed. Numbers are 64-bit integers, products are decimals of 38 digits.

Defined results: a null text is empty, a null language ``und``; texts without words count nothing; repeated rows count each time; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwright.llm import automata
from boxwright.session import materialize

SLICE = 1 << 19  # bytes cut into words at once
HELD = 1 << 20  # distinct phrases of a task before it writes automata
RANGE_BYTES = 4 << 20  # text a prefix range
MOST_RANGES = 1 << 16
BITS = 26  # a bitmap is 8 MB
SALTS = 4
GAP, CUT = 1, 2

_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = GAP
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = CUT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Hashing:
    """Two hashes of words by prefix sums of byte values times powers of an odd number, modulo 2^64."""

    def __init__(self, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.seed, self.sets = seed, []
        for _ in range(2):
            odd = int(draw.integers(1 << 62)) * 8 + 3 & (1 << 64) - 1
            self.sets.append((draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), odd, pow(odd, -1, 1 << 64)))
        self.powers: list = []

    def _grow(self, n: int) -> None:
        if not self.powers or len(self.powers[0][0]) < n:
            n = max(n, SLICE + 1)
            self.powers = [tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (odd, inverse)) for _, odd, inverse in self.sets]

    def words(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(label, check) of the words [start, end) of a text of bytes; ``langs`` are two hashes a word's language."""
        self._grow(len(text) + 1)
        out = []
        for i, ((values, _, _), (up, down)) in enumerate(zip(self.sets, self.powers, strict=True)):
            sums = np.zeros(len(text) + 1, np.uint64)
            np.cumsum(values[text] * up[: len(text)], out=sums[1:])
            out.append(automata._mixed((sums[end] - sums[start]) * down[start], (end - start).astype(np.uint64), langs[i]))
        return np.maximum(out[0], 1), out[1]


def _slices(text: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first byte, last byte, first document, last document) of runs of whole documents, or parts of one cut between pieces."""
    n, a = len(ends) - 1, 0
    while a < n:
        b = max(int(np.searchsorted(ends, ends[a] + SLICE, "right")) - 1, a + 1)
        at, stop = int(ends[a]), int(ends[b])
        while stop - at > SLICE:
            cuts = np.flatnonzero(_KIND[text[at : at + SLICE]] == CUT)
            size = SLICE
            while not len(cuts) and at + size < stop:  # a piece longer than a slice stays whole
                cuts = size + np.flatnonzero(_KIND[text[at + size : min(stop, at + 2 * size)]] == CUT)[:1]
                size *= 2
            if not len(cuts):
                break
            yield at, at + int(cuts[-1]) + 1, a, b
            at += int(cuts[-1]) + 1
        yield at, stop, a, b
        a = b


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """Lower-case bytes of a batch (lang, text), its documents' ends, its languages and each document's one."""
    langs, code = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True) if batch.num_rows else ([], np.zeros(0, int))
    column = batch.column(1)
    ends = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) else np.int64, batch.num_rows + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    text = _LOWER[np.frombuffer(data, np.uint8, int(ends[-1])) if data is not None and ends[-1] else np.zeros(0, np.uint8)]
    return text, ends, list(langs), np.asarray(code).reshape(-1)


def _words(hashing: Hashing, batch: pa.RecordBatch) -> Iterator[tuple]:
    """Per slice: its bytes, each word's start, end, piece, label, check and language, and the languages."""
    text, ends, langs, code = _texts(batch)
    hashes = np.array([[xxhash.xxh64_intdigest(x.encode(), hashing.seed + i) for x in langs] for i in range(2)], np.uint64).reshape(2, -1)
    for at, stop, a, b in _slices(text, ends):
        part = text[at:stop]
        kind = _KIND[part]
        fresh = np.zeros(len(part) + 1, bool)  # a document starts here
        starts = ends[a:b] - at
        fresh[starts[(starts >= 0) & (starts < len(part))]] = True
        word = np.r_[False, kind == 0, False]
        start = np.flatnonzero(word[1:-1] & (~word[:-2] | fresh[:-1]))
        end = np.flatnonzero(word[1:-1] & (~word[2:] | fresh[1:])) + 1
        if not len(start):
            continue
        piece = np.cumsum((kind == CUT) | fresh[:-1], dtype=np.int32)[start]
        lang = code[np.searchsorted(ends[a:b], start + at, "right") - 1 + a]
        yield part, start, end, piece, *hashing.words(part, start, end, hashes[:, lang]), lang, langs


def prefix_hash(paths: np.ndarray) -> np.ndarray:
    """Hash of the first two labels; its upper bits are the prefix range, its lower bits the place in a bitmap."""
    return automata._mixed(paths[:, 0], paths[:, 1] if paths.shape[1] > 1 else np.zeros(len(paths), np.uint64))


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64((1 << BITS) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(frequent: DataFrame, column: str) -> np.ndarray:
    """Bitmap of fixed size of the hashes in a column."""
    place = F.expr(f"cast(shiftrightunsigned({column} & {(1 << BITS) - 1}L, 6) as int)").alias("at")
    rows = frequent.groupBy(place).agg(F.expr(f"bit_or(shiftleft(1L, cast({column} & 63L as int)))").alias("bits")).toPandas()
    out = np.zeros(1 << BITS - 6, np.uint64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _ranges(paths: np.ndarray, count: int) -> np.ndarray:
    return (prefix_hash(paths) >> np.uint64(64 - int(log2(count)))).astype(np.int64) if count > 1 else np.zeros(len(paths), np.int64)


def _by_range(paths: np.ndarray, weights: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(range, rows in order) of distinct phrases that are in order."""
    at = _ranges(paths, count)
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]]) if len(at) else []
    for rows in np.split(order, starts[1:]) if len(at) else []:
        yield int(at[rows[0]]), rows


def _word_pieces(seed: int, count: int) -> Callable:
    """Automata of words with their languages, bytes and check hashes; range -1 counts the words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.DataFrame]:
        hashing, held, totals = Hashing(seed), [], {}
        size = 0

        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("range", pa.int64()), ("blob", pa.binary()), ("check", pa.binary()), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.binary())), ("lang", pa.string()), ("n", pa.int64())]))

        def flush() -> Iterator[pa.RecordBatch]:
            names = sorted({x for h in held for x in h[3]})
            number = {x: i for i, x in enumerate(names)}
            label, check, weight = (np.concatenate([h[i] for h in held]) for i in range(3))
            lang = np.concatenate([np.array([number[x] for x in h[3]], np.int64)[h[4]] for h in held])
            word = np.concatenate([h[5] for h in held])
            order = np.lexsort([check, label])
            label, check, weight, lang, word = label[order], check[order], weight[order], lang[order], word[order]
            new = np.r_[True, (label[1:] != label[:-1]) | (check[1:] != check[:-1])]
            weight = np.add.reduceat(weight, np.flatnonzero(new))
            label, check, lang, word = label[new], check[new], lang[new], word[new]
            clash = np.r_[False, label[1:] == label[:-1]]
            if clash.any():
                yield packed([{"range": -2}])
                keep = ~clash
                label, check, weight, lang, word = label[keep], check[keep], weight[keep], lang[keep], word[keep]
            for at, rows in _by_range(label[:, None], weight, count):
                aut = automata.build(label[rows][:, None], weight[rows])
                yield packed([{"range": at, "blob": aut.to_bytes(), "check": check[rows].tobytes(), "langs": [names[i] for i in lang[rows]], "words": list(word[rows])}])

        for batch in batches:
            for part, start, end, _, label, check, lang, langs in _words(hashing, batch):
                order = np.lexsort([check, label])
                new = np.r_[True, (label[order][1:] != label[order][:-1]) | (check[order][1:] != check[order][:-1])]
                lead = order[new]
                counts = np.diff(np.r_[np.flatnonzero(new), len(order)])
                raw = part.tobytes()
                words = np.empty(len(lead), object)
                words[:] = [raw[i:j] for i, j in zip(start[lead].tolist(), end[lead].tolist(), strict=True)]
                held.append((label[lead], check[lead], counts, langs, lang[lead], words))
                size += len(lead)
                for i, n in enumerate(np.bincount(lang, minlength=len(langs)).tolist()):
                    totals[langs[i]] = totals.get(langs[i], 0) + n
                if size > HELD // 4:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
        if totals:
            yield packed([{"range": -1, "lang": k, "n": n} for k, n in totals.items()])

    return run


def _united_words(least: int) -> Callable:
    """Frequent words (label, lang, word, f) of the pieces in order of range; -1 and -2 rows pass on as totals and clashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "label", "hash", "lang", "word", "f"]
        now, labels, checks, weights, first = None, [], [], [], {}

        def give(rows: list) -> pa.RecordBatch:
            types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        def united() -> Iterator[pa.RecordBatch]:
            label, check, weight = np.concatenate(labels), np.concatenate(checks), np.concatenate(weights)
            order = np.lexsort([check, label])
            at = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]])
            sums = np.add.reduceat(weight[order], at)
            last = np.r_[at[1:], len(order)] - 1
            if (check[order][at] != check[order][last]).any():
                yield give([(2, 0, 0, None, None, 0)])
            some = np.flatnonzero(sums >= least)
            rows = [(0, int(np.int64(x.view(np.int64))), int(h.view(np.int64)), *word_of(order[at[i]]), int(sums[i]))
                    for i, x, h in zip(some, label[order][at[some]], prefix_hash(label[order][at[some]][:, None]), strict=True)]
            if rows:
                yield give(rows)

        def word_of(place: int) -> tuple[str, bytes]:
            piece = int(np.searchsorted(starts, place, "right")) - 1
            langs, words = held[piece]
            return langs[place - starts[piece]].as_py(), words[place - starts[piece]].as_py()

        held, starts, size = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                at = batch.column(0)[i].as_py()
                if at != now:
                    if labels:
                        yield from united()
                    now, labels, checks, weights, held, starts, size = at, [], [], [], [], [], 0
                if at == -2:
                    yield give([(2, 0, 0, None, None, 0)])
                elif at == -1:
                    yield give([(1, 0, 0, batch.column(5)[i].as_py(), None, batch.column(6)[i].as_py())])
                else:
                    paths, weight = automata.paths_of(automata.from_bytes(batch.column(1)[i].as_py()), 1)
                    labels.append(paths[:, 0])
                    weights.append(weight)
                    checks.append(np.frombuffer(batch.column(2)[i].as_py(), np.uint64))
                    held.append((batch.column(3)[i].values, batch.column(4)[i].values))
                    starts.append(size)
                    size += len(weight)
        if labels:
            yield from united()

    return run


def _phrase_pieces(seed: int, count: int, longest: int, words: np.ndarray, pairs: np.ndarray | None) -> Callable:
    """Automata of the pairs of marked words, or of the longer phrases of marked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing, held, size = Hashing(seed), [], 0
        depth = 2 if pairs is None else longest

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return automata.summed(np.concatenate([p for p, _ in held]), np.concatenate([w for _, w in held]))

        def flush(paths: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at, rows in _by_range(paths, weights, count):
                blob = automata.build(paths[rows], weights[rows]).to_bytes()
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([blob], pa.binary())], names=["range", "blob"])

        for batch in batches:
            for _, _, _, piece, label, _, _, _ in _words(hashing, batch):
                good = _marked(words, prefix_hash(label[:, None]))
                link = (piece[1:] == piece[:-1]) & good[1:] & good[:-1]
                at = np.flatnonzero(link)
                made = np.stack([label[at], label[at + 1]], axis=1)
                if pairs is not None:
                    link[at] = _marked(pairs, prefix_hash(made))
                    valid, grams = link, []
                    for n in range(3, longest + 1):
                        valid = valid[:-1] & link[n - 2 :]
                        at = np.flatnonzero(valid)
                        gram = np.zeros((len(at), depth), np.uint64)
                        for i in range(n):
                            gram[:, i] = label[at + i]
                        grams.append(gram)
                    made = np.concatenate(grams) if grams else made[:0]
                if len(made):
                    held.append(automata.summed(made, np.ones(len(made), np.int64)))
                    size += len(held[-1][0])
                if size > HELD:
                    held = [joined()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from flush(*held[0])
                        held, size = [], 0
        if held:
            yield from flush(*joined())

    return run


def _united_phrases(least: int, depth: int) -> Callable:
    """Frequent phrases (labels, hash, f) of the pieces in order of range; automata are united as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return automata.summed(np.concatenate([p for p, _ in held]), np.concatenate([w for _, w in held]))

        def give() -> pa.RecordBatch:
            paths, weights = joined()
            some = weights >= least
            paths, weights = paths[some], weights[some]
            lengths = (paths != 0).sum(1)
            flat = paths[paths != 0].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(flat, pa.int64()))
            return pa.RecordBatch.from_arrays([lists, pa.array(prefix_hash(paths).view(np.int64)), pa.array(weights, pa.int64())], names=["labels", "hash", "f"])

        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != now:
                    if held:
                        yield give()
                    now, held, size = at, [], 0
                held.append(automata.paths_of(automata.from_bytes(blob), depth))
                size += len(held[-1][0])
                if size > HELD and len(held) > 1:
                    held = [joined()]
                    size = 0  # a range's own phrases do not count again
        if held:
            yield give()

    return run


def _matrix(lists: pa.ListArray, depth: int) -> np.ndarray:
    ends = lists.offsets.to_numpy()
    sizes = np.diff(ends)
    out = np.zeros((len(lists), depth), np.uint64)
    row = np.repeat(np.arange(len(lists)), sizes)
    flat = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64).view(np.uint64)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def part_counts(frequent: DataFrame, requests: DataFrame, longest: int, ranges: int) -> DataFrame:
    """The requests (part, ...) with f, the count of the part, by composition with the automata of the frequent phrases (labels, f)."""
    place = lambda c: F.expr(f"pmod(xxhash64({c}[0], get({c}, 1)), {ranges})")
    rest = [c for c in requests.columns if c != "part"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, paths, weights = None, [], []

        def give() -> pa.RecordBatch:
            blob = automata.build(*automata.summed(np.concatenate(paths), np.concatenate(weights))).to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([blob], pa.binary())], names=["at", "blob"])

        for batch in batches:
            at, whole, f = batch.column(0).to_numpy(), _matrix(batch.column(1), longest), batch.column(2).to_numpy()
            for rows in np.split(np.arange(len(at)), np.flatnonzero(at[1:] != at[:-1]) + 1) if len(at) else []:
                if now != at[rows[0]]:
                    if paths:
                        yield give()
                    now, paths, weights = int(at[rows[0]]), [], []
                paths.append(whole[rows])
                weights.append(f[rows])
        if paths:
            yield give()

    laid = frequent.select(place("labels").alias("at"), "labels", "f").repartition("at").sortWithinPartitions("at")
    blobs = laid.mapInArrow(build, "at long, blob binary").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = requests.select(place("part").alias("at"), F.expr(f"cast(pmod(xxhash64(part, {', '.join(rest)}), {SALTS}) as int)").alias("salt"), F.lit(None).cast("binary").alias("blob"), "part", *rest)
    none = [F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in ("part", *rest)]
    both = blobs.select("at", "salt", "blob", *none).union(asked).repartition("at", "salt").sortWithinPartitions("at", "salt", F.col("blob").isNull())

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, aut = None, None
        for batch in batches:
            at, salt = batch.column("at").to_numpy(), batch.column("salt").to_numpy()
            is_blob = batch.column("blob").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (salt[1:] != salt[:-1]) | is_blob[1:] | is_blob[:-1]) + 1
            for rows in np.split(np.arange(len(at)), cuts) if len(at) else []:
                here = (at[rows[0]], salt[rows[0]])
                if is_blob[rows[0]]:
                    key, aut = here, automata.from_bytes(batch.column("blob")[int(rows[0])].as_py())
                    continue
                some = batch.slice(int(rows[0]), len(rows))
                f = automata.lookup(aut, _matrix(some.column("part"), longest)) if key == here else np.zeros(len(rows), np.int64)
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in ("part", *rest)], pa.array(f, pa.int64())], names=["part", *rest, "f"])

    fields = ", ".join(f"{c} {requests.schema[c].dataType.simpleString()}" for c in ("part", *rest))
    return both.mapInArrow(compose, f"{fields}, f long")


def frequent_phrases(docs: DataFrame, least: int, longest: int, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, totals, phrases): frequent words (label, lang, word, f), words by language (lang, n), frequent phrases (labels, f)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    count = 1 << max(4, min(ceil(log2(MOST_RANGES)), ceil(log2(max(1, size / RANGE_BYTES)))))
    pieces = texts.mapInArrow(_word_pieces(seed, count), "range long, blob binary, check binary, langs array<string>, words array<binary>, lang string, n long")
    united = pieces.repartition("range").sortWithinPartitions("range").mapInArrow(_united_words(least), "kind int, label long, hash long, lang string, word binary, f long")
    united = materialize(united)
    if united.where("kind = 2").limit(1).count():
        return frequent_phrases(docs, least, longest, seed + 1)
    words = united.where("kind = 0").select("label", "hash", "lang", F.col("word").cast("string").alias("word"), "f")
    totals = united.where("kind = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    marks, found = bitmap(words, "hash"), words.select(F.array("label").alias("labels"), "f")
    pairs = None
    for depth in (2, longest) if longest > 2 else (2,):
        pieces = texts.mapInArrow(_phrase_pieces(seed, count, longest, marks, pairs), "range long, blob binary")
        made = pieces.repartition("range").sortWithinPartitions("range").mapInArrow(_united_phrases(least, depth), "labels array<long>, hash long, f long")
        made = materialize(made)
        pairs = bitmap(made, "hash") if depth == 2 and longest > 2 else pairs
        found = found.union(made.select("labels", "f"))
    return words, totals, found


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int | None = 2000) -> DataFrame:
    """Phrases of 2 to ``longest`` words seen ``least`` times that no longer one covers, by the score of their weakest cut, for each language."""
    words, totals, phrases = frequent_phrases(docs, least, longest)
    made = phrases.where("size(labels) > 1")
    cuts = made.select("labels", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(labels) - 1)")).alias("k"))
    sides = F.expr("explode(array(struct(0 as side, slice(labels, 1, k) as part), struct(1 as side, slice(labels, k + 1, size(labels) - k) as part))) as x")
    requests = cuts.select("labels", "a", "k", sides).select("x.part", "labels", "a", "k", "x.side")
    ranges = max(16, made.count() // 50_000)
    answers = part_counts(phrases, requests, longest, ranges)
    parts = [F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{'lr'[s]}{k}") for k in range(1, longest) for s in (0, 1)]
    counted = answers.groupBy("labels").agg(F.max("a").alias("a"), *parts)
    spelled = made.select("labels", F.posexplode("labels").alias("at", "label")).join(words.select("label", "lang", "word"), "label")
    spelled = spelled.groupBy("labels").agg(F.max("lang").alias("lang"), *[F.max(F.when(F.col("at") == i, F.col("word"))).alias(f"w{i}") for i in range(longest)])
    inside = F.expr("explode(flatten(transform(sequence(2, size(labels) - 1), m -> transform(sequence(1, size(labels) - m + 1), i -> slice(labels, i, m))))) as inner")
    covers = made.where("size(labels) > 2").select("f", inside).groupBy("inner").agg(F.max("f").alias("cover")).withColumnRenamed("inner", "labels")
    whole = counted.join(covers, "labels", "left").where("cover is null or cover < a").join(spelled, "labels").join(totals, "lang")
    exact = "cast(1000 * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0)) as decimal(38, 0)) div (cast(l{k} as decimal(19, 0)) * cast(r{k} as decimal(19, 0)))"
    choices = ", ".join(f"if(l{k} is null, null, struct({exact.format(k=k)} as score, {k} as k, l{k} as l, r{k} as r))" for k in range(1, longest))
    best = F.expr(f"array_min(filter(array({choices}), x -> x is not null))")
    scored = whole.withColumn("x", best).select("lang", F.concat_ws(" ", *[f"w{i}" for i in range(longest)]).alias("phrase"), "a", "x.l", "x.r", "n", "x.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
