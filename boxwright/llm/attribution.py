"""Token counts of fields and sections by offset-mapped attribution.

Every document is encoded once, whole. The tokens' byte lengths give their spans in the UTF-8 text, which are joined with the
section spans as intervals: both are sorted, so one merge finds each token's sections. A token that crosses a boundary goes
by an explicit rule: ``first`` gives it to the section of its first byte, ``last`` to that of its last byte, and ``share`` splits
it by bytes.

Sections partition a text: paragraphs (runs of lines between blank lines) or lines, each with its closing line breaks, so
counts of a document's sections sum to the document's tokens. The work is one pandas UDF over the text; the vocabulary
(about a megabyte) travels with it.

Defined results: null and empty texts have no sections; repeated rows are counted alike; an empty table gives an empty result;
further columns pass through, clashing names are replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUTS = {"line": re.compile(rb"\n"), "paragraph": re.compile(rb"\n(?:[\x20\x09\x0B-\x0D]*\n)+")}


def rank_file(spark: SparkSession, path: str) -> bytes:
    """The rank file's bytes, read once by the driver; its size is checked."""
    with open(path, "rb") as f:
        raw = f.read(64 << 20)
    if len(raw) == 64 << 20:
        raise ValueError("rank file of 64 MB or more")
    return raw


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def coder(raw: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """Encoding and the byte length of every id."""
    ranks = parse_ranks(raw)
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        lengths[rank] = len(piece)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def section_ends(raw: bytes, kind: str) -> np.ndarray:
    """Byte ends of the sections of a text."""
    ends = [m.end() for m in CUTS[kind].finditer(raw)]
    return np.array(ends if ends and ends[-1] == len(raw) else [*ends, len(raw)], np.int64)


def attribute(token_ends: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section, both given by ascending byte ends."""
    starts = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(ends, starts, "right")
    if rule == "first":
        return np.bincount(first, minlength=len(ends)).astype(float)
    last = np.searchsorted(ends, token_ends, "left")
    if rule == "last":
        return np.bincount(last, minlength=len(ends)).astype(float)
    if rule != "share":
        raise ValueError(rule)
    out = np.zeros(len(ends))
    inside = first == last
    np.add.at(out, first[inside], 1.0)
    for s, e, a, b in zip(starts[~inside], token_ends[~inside], first[~inside], last[~inside], strict=True):
        edges = np.concatenate(([s], ends[a:b], [e]))
        out[a : b + 1] += np.diff(edges) / (e - s)
    return out


def section_tokens(docs: DataFrame, ranks: bytes, pattern: str, kind: str = "paragraph", rule: str = "first", column: str = "text") -> DataFrame:
    """Documents with ``n_tokens`` and ``sections``: array of struct(start, end, tokens), places in code points."""

    @F.pandas_udf("n_tokens long, sections array<struct<start: int, end: int, tokens: double>>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoding, lengths = coder(ranks, pattern)
        for texts in batches:
            yield counted(texts, encoding, lengths)

    def counted(texts: pd.Series, encoding: tiktoken.Encoding, lengths: np.ndarray) -> pd.DataFrame:
        totals, sections = [], []
        for text in texts:
            if not text:
                totals.append(0)
                sections.append([])
                continue
            raw = text.encode("utf-8", "surrogatepass")
            ids = np.array(encoding.encode_ordinary(text), np.int64)
            token_ends, ends = np.cumsum(lengths[ids]), section_ends(raw, kind)
            tokens = attribute(token_ends, ends, rule)
            # code points up to a byte: bytes that continue none
            heads = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
            places = heads[np.concatenate(([0], ends))].tolist()
            totals.append(len(ids))
            sections.append([{"start": a, "end": b, "tokens": t} for a, b, t in zip(places[:-1], places[1:], tokens.tolist(), strict=True)])
        return pd.DataFrame({"n_tokens": totals, "sections": sections})

    rest = docs.drop("n_tokens", "sections", "_c")
    return rest.withColumn("_c", count(F.col(column))).select(*rest.columns, "_c.*")
