"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words.

A text is cut into words by the tokenizer's pattern; a word is an array of bytes over which the lowest-ranked merge,
leftmost first, is folded until no pair has a rank. Decoding concatenates the binary pieces of the ids.

``encode`` folds every distinct word of a task's batches once, in a pandas UDF over the text alone, with a bounded memory of
words; nothing is shuffled. ``encode_native`` does the same by Spark's higher-order functions: ranks come from a literal map
(an array of small maps addressed by crc32), ``aggregate`` folds the merges, the most frequent words (a bound on the literal,
not on the result) are encoded beforehand and looked up, every other word is folded in place. Both give the same ids; the
README has the figures that made the query use the first.

Defined results: null and empty texts have no tokens; repeated rows are encoded alike; an empty table gives an empty result;
further columns pass through, clashing names are replaced. Long words merge by a heap in n log n steps; the native fold costs
the square of a word's bytes in copied pieces.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.attribution import parse_ranks
from boxwright.llm.text import body
from boxwright.session import materialize

RANK_BUCKETS = 32768
WORD_BUCKETS = 65536
NONE = 2147483647


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Pieces of a word: the adjacent pair of lowest rank is joined, leftmost first, until none has a rank."""
    if len(word) > 48:
        return _fold_long(word, ranks)
    pieces = [word[i : i + 1] for i in range(len(word))]
    while len(pieces) > 1:
        found = [(r, i) for i in range(len(pieces) - 1) if (r := ranks.get(pieces[i] + pieces[i + 1])) is not None]
        if not found:
            break
        i = min(found)[1]
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
    return pieces


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same over a heap of pairs: (rank, start, middle, end), dropped when a neighbour has changed."""
    end = list(range(1, len(word) + 1))  # end of the piece that starts here; 0 where none starts
    before = list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(start: int) -> None:
        middle = end[start]
        if middle < len(word) and (r := ranks.get(word[start : end[middle]])) is not None:
            heapq.heappush(heap, (r, start, middle, end[middle]))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, start, middle, stop = heapq.heappop(heap)
        if end[start] != middle or end[middle] != stop:
            continue
        end[start], end[middle] = stop, 0
        if stop < len(word):
            before[stop] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    out, at = [], 0
    while at < len(word):
        out.append(word[at : end[at]])
        at = end[at]
    return out


def encode(docs: DataFrame, ranks: bytes, pattern: str, remembered: int = 400_000, column: str = "text") -> DataFrame:
    """Documents with ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and ``decoded`` (the bytes of the ids).

    ``remembered`` bounds the words a task keeps encoded; beyond it they are encoded anew.
    """
    cut = regex_pattern(pattern)

    @F.pandas_udf("n_tokens long, ids binary, decoded binary")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = parse_ranks(ranks)
        packed = {piece: rank.to_bytes(4, "little") for piece, rank in table.items()}
        pieces = {rank: piece for piece, rank in packed.items()}
        finder, known = regex.compile(cut), {}
        for texts in batches:
            out = []
            for text in texts:
                words = finder.findall(text or "")
                if len(known) > remembered:
                    known.clear()
                for w in set(words).difference(known):
                    raw = w.encode("utf-8")
                    whole = packed.get(raw)
                    known[w] = whole if whole is not None else b"".join([packed[p] for p in fold_merges(raw, table)])
                ids = b"".join([known[w] for w in words])
                out.append((len(ids) // 4, ids, b"".join([pieces[ids[i : i + 4]] for i in range(0, len(ids), 4)])))
            yield pd.DataFrame(out, columns=["n_tokens", "ids", "decoded"])

    rest = docs.drop("n_tokens", "ids", "decoded", "_coded")
    return rest.withColumn("_coded", code(F.col(column))).select(*rest.columns, "_coded.*")


def regex_pattern(pattern: str) -> str:
    """The pattern with white space by Unicode property."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}")


def java_pattern(pattern: str) -> str:
    """The pattern for Java's engine: white space and classes by Unicode property."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{IsWhite_Space}\p{L}\p{N}]").replace(r"(?!\S)", r"(?![^\p{IsWhite_Space}])").replace(r"\s", r"\p{IsWhite_Space}")


def literal_map(pairs: dict[str, object], buckets: int, kind: str) -> tuple[F.Column, int]:
    """Literal array of maps, the entry of a key in the map that crc32 of the key names."""
    parts: list[dict[str, object]] = [{} for _ in range(buckets)]
    for key, value in pairs.items():
        parts[zlib.crc32(key.encode()) % buckets][key] = value
    return F.from_json(F.lit(json.dumps(parts, ensure_ascii=False, separators=(",", ":"))), f"array<map<string,{kind}>>"), buckets


def looked_up(table: tuple[F.Column, int], key: F.Column) -> F.Column:
    return F.get(table[0], (F.crc32(key) % table[1]).cast("int"))[key]


class Codec:
    """Encoding and decoding expressions of one vocabulary (its rank file, parsed)."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        self.pattern = java_pattern(pattern)
        parsed = parse_ranks(ranks)
        self.ranks = literal_map({piece.hex(): rank for piece, rank in parsed.items()}, RANK_BUCKETS, "int")
        pieces = [""] * (max(parsed.values()) + 1)
        for piece, rank in parsed.items():
            pieces[rank] = piece.hex()
        self.pieces = F.split(F.lit(",".join(pieces)), ",")

    def rank(self, piece: F.Column) -> F.Column:
        return F.coalesce(looked_up(self.ranks, piece), F.lit(NONE))

    def pieces_of(self, word: F.Column) -> F.Column:
        """Merged pieces (hex) of the bytes (hex) of a word."""
        start = F.transform(F.sequence(F.lit(1), F.length(word), F.lit(2)), lambda i: F.substring(word, i, F.lit(2)))
        pair = lambda p: F.when(
            F.size(p) > 1, F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: self.rank(F.concat(F.get(p, i), F.get(p, i + 1))))
        ).otherwise(F.array().cast("array<int>"))
        begin = F.transform(F.array(start), lambda p: F.struct(p.alias("p"), pair(p).alias("k")))[0]

        def merge(acc: F.Column, at: F.Column) -> F.Column:
            """Join the pieces at and at + 1 (from 1); only the ranks beside them change."""
            p, k = acc["p"], acc["k"]
            both = F.concat(F.get(p, at - 1), F.get(p, at))
            left = F.when(at > 1, F.array(self.rank(F.concat(F.get(p, at - 2), both)))).otherwise(F.array().cast("array<int>"))
            right = F.when(at < F.size(k), F.array(self.rank(F.concat(both, F.get(p, at + 1))))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(p, 1, at - 1), F.array(both), F.slice(p, at + 2, F.size(p))).alias("p"),
                F.concat(F.slice(k, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(k, at + 2, F.size(k))).alias("k"),
            )

        def step(acc: F.Column, _: F.Column) -> F.Column:
            least = F.array_min(acc["k"])
            place = F.array_position(acc["k"], least).cast("int")
            return F.when(F.coalesce(least, F.lit(NONE)) == NONE, acc).otherwise(F.transform(F.array(place), lambda at: merge(acc, at))[0])

        rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) / 2 - 1).cast("int"))
        return F.aggregate(rounds, begin, step, lambda acc: acc["p"])

    def ids(self, word: F.Column) -> F.Column:
        """Ids of a word given in hex; a word that is a token needs no fold."""
        whole = looked_up(self.ranks, word)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(self.pieces_of(word), lambda p: looked_up(self.ranks, p)))

    def decoded(self, ids: F.Column) -> F.Column:
        """Bytes (hex) of ids."""
        return F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), "")


def little_endian(value: F.Column) -> F.Column:
    """Eight hex digits of an id as little-endian unsigned 32-bit integer."""
    digits = F.lower(F.lpad(F.hex(value), 8, "0"))
    return F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)])


def distinct_words(docs: DataFrame, pattern: str, column: str = "text") -> DataFrame:
    """(word, n) over whole texts."""
    cut = F.regexp_extract_all(body(F.col(column)), F.lit(pattern), F.lit(0))
    return docs.select(F.explode(cut).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def encode_native(docs: DataFrame, ranks: bytes, pattern: str, dictionary: int = 131_072, longest: int = 64, column: str = "text") -> DataFrame:
    """Documents with ``n_tokens``, ``ids_hex`` (little-endian ids) and ``decoded_hex`` (bytes decoded from the ids).

    ``dictionary`` and ``longest`` bound the literal of frequent words: at most dictionary * longest characters.
    """
    codec = Codec(ranks, pattern)
    frequent = distinct_words(docs, codec.pattern, column).where(F.length("word") <= longest).orderBy(F.desc("n"), "word").limit(dictionary)

    def code(word: F.Column) -> F.Column:
        ids = codec.ids(F.lower(F.hex(F.encode(word, "UTF-8"))))
        return F.transform(F.array(ids), lambda x: F.concat(F.array_join(F.transform(x, little_endian), ""), F.lit(" "), codec.decoded(x)))[0]

    known = materialize(frequent.select("word").repartition(64)).select("word", code(F.col("word")).alias("code"))
    table = literal_map({r["word"]: r["code"] for r in materialize(known).toLocalIterator()}, WORD_BUCKETS, "string")
    cut = F.regexp_extract_all(body(F.col(column)), F.lit(codec.pattern), F.lit(0))
    codes = F.transform(cut, lambda w: F.coalesce(looked_up(table, w), code(w)))
    rest = docs.drop("n_tokens", "ids_hex", "decoded_hex", "_codes", "_halves")
    coded = rest.withColumn("_codes", codes)
    half = lambda i: F.array_join(F.transform("_codes", lambda c: F.substring_index(c, " ", i)), "")
    return coded.withColumns({"ids_hex": half(1), "decoded_hex": half(-1)}).withColumn("n_tokens", (F.length("ids_hex") / 8).cast("long")).drop("_codes")


def decode(ids: F.Column, codec: Codec) -> F.Column:
    """Text of an array of ids."""
    return F.decode(F.unhex(codec.decoded(ids)), "UTF-8")
