"""SimHash near-duplicates with pigeonring filtering.

A text's 64-bit fingerprint holds, per bit, the majority over the XXH64 values of its word shingles. Two fingerprints
link when at most ``radius`` bits differ. The ring of bits is cut into radius + 1 segments. If the differences of all
segments sum to at most the radius, some segment starts a chain on which the differences of its first l segments sum to at
most l * radius / (radius + 1) for every l. The first link of that chain must be equal and the first two differ by one bit
at most: that is the join key. The remaining links are checked inside the join, before the whole distance.

Only distinct fingerprints are joined, so copies cost nothing: one row each, whatever their number. A key is emitted as it
stands by one side; the other side adds the variants with one bit of its second segment flipped, and only if that
segment has odd parity, since of two segments one bit apart exactly one is odd. A fingerprint thus makes a fixed number of
rows, and has at most sum(C(64, d)) neighbours for d up to the radius.

Defined results: null and empty texts have the fingerprint 0 and link like any other; fewer words than a shingle make one
shingle; null ids are ranked last when the smallest id of a component is taken; repeated rows share their component; an
empty table gives an empty result; further columns pass through, clashing names are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.components import components
from boxwright.llm.text import lower_ascii, words
from boxwright.session import materialize


def shingle_hashes(width: int = 3) -> F.Column:
    """XXH64 (seed 42) of every shingle of the word array ``_words``, repeats included."""
    return F.expr(f"""transform(
        if(size(_words) = 0, array(), sequence(1, greatest(1, size(_words) - {width - 1}))),
        i -> xxhash64(array_join(slice(_words, i, {width}), ' ')))""")


def with_fingerprint(docs: DataFrame, width: int = 3, column: str = "text") -> DataFrame:
    """Documents with ``fp``, the signed 64-bit fingerprint of all shingles."""

    @F.pandas_udf("long")
    def majority(hashes: pd.Series) -> pd.Series:
        out = np.zeros(len(hashes), np.uint64)
        for i, h in enumerate(hashes):
            if h is not None and len(h):
                bits = np.unpackbits(np.ascontiguousarray(h, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones = bits.sum(0, dtype=np.int64)
                out[i] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
        return pd.Series(out.view(np.int64))

    rest = docs.drop("fp", "_words")
    return rest.withColumn("_words", words(lower_ascii(F.col(column)))).withColumn("_hashes", shingle_hashes(width)).withColumn("fp", majority("_hashes")).drop("_words", "_hashes")


def segments(radius: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, width) of radius + 1 segments of nearly equal width."""
    m = radius + 1
    return [(i * bits // m, (i + 1) * bits // m - i * bits // m) for i in range(m)]


def _part(ring: list[tuple[int, int]], i: int) -> str:
    """Value of the i-th segment of fp, counted round the ring."""
    first, width = ring[i % len(ring)]
    return f"(shiftrightunsigned(fp, {first}) & {(1 << width) - 1}L)"


def _key(ring: list[tuple[int, int]], i: int, flip: str = "0L") -> str:
    """The join key of a chain from segment i: that segment and the next one."""
    return f"struct({i} as at, {_part(ring, i)} as a, ({_part(ring, i + 1)} ^ {flip}) as b)"


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints (column fp), u < v, that differ in at most ``radius`` bits."""
    ring = segments(radius)
    m = len(ring)

    def flips(i: int) -> str:
        width = ring[(i + 1) % m][1]
        return f"if(bit_count({_part(ring, i + 1)}) % 2 = 1, transform(sequence(0, {width - 1}), j -> {_key(ring, i, 'shiftleft(1L, j)')}), array())"

    plain = [f"array({_key(ring, i)})" for i in range(m)]
    left = prints.selectExpr("fp as u", f"explode(concat({', '.join(plain)})) as k").selectExpr("u", "k.at as at", "k.a as a", "k.b as b")
    right = prints.selectExpr("fp as v", f"explode(concat({', '.join(plain + [flips(i) for i in range(m)])})) as k").selectExpr("v", "k.at as at", "k.a as a", "k.b as b")
    # the chain from segment k.at: budgets floor(l * radius / m), then the whole distance
    turned = " ".join(f"when {i} then {_rotated('(u ^ v)', ring[i][0])}" for i in range(m))
    chain = f"case l.at {turned} end"
    tests = ["l.at = r.at", "l.a = r.a", "l.b = r.b", "u <> v", f"bit_count(u ^ v) <= {radius}"]
    for n in range(2, m):
        # after the rotation the chain's first n segments are the lowest bits; widths differ by one at most, so take the exact width per start
        widths = " ".join(f"when {i} then {sum(ring[(i + j) % m][1] for j in range(n))}" for i in range(m))
        tests.append(f"bit_count({chain} & (shiftleft(1L, case l.at {widths} end) - 1)) <= {n * radius // m}")
    # by a shuffle always: a print makes up to m + 64 rows on the right, which no plan knows, so its few bytes would be broadcast as many
    pairs = left.alias("l").join(right.alias("r").hint("merge"), F.expr(" and ".join(tests)))
    return pairs.selectExpr("least(u, v) as u", "greatest(u, v) as v").distinct()


def _rotated(x: str, first: int) -> str:
    return x if first == 0 else f"(shiftrightunsigned({x}, {first}) | shiftleft({x}, {64 - first}))"


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, keep: Sequence[str] | None = None) -> DataFrame:
    """Documents with fp and component_id, the smallest doc_id that links reach. ``keep`` names the columns to carry (all by default)."""
    printed = with_fingerprint(docs.drop("component_id"), width)
    printed = materialize(printed if keep is None else printed.select(*keep, "fp"))
    return with_components(printed, radius)


def with_components(printed: DataFrame, radius: int = 3) -> DataFrame:
    """component_id for rows that carry fp (a table that can be read again)."""
    prints = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = materialize(links(prints.select("fp"), radius))
    roots = components(found)
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return printed.join(by_print, "fp")


def hex_of(fp: F.Column) -> F.Column:
    """16 lower-case hex digits of the unsigned value."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
