"""Compression classifier: texts are compressed against dictionaries of good and of bad text.

Each dictionary is raw text of labelled rows: slices of half of a class's texts, spread over each whole text. A text is cut into pieces of a few kilobytes, so that the dictionary counts
throughout a long text, and every piece is compressed three times: with the good dictionary, the bad one, and none. The
normalised differences of the compressed sizes are calibrated to a probability by logistic regression on labelled rows
that are in neither dictionary.

The fit reads at most ``max_rows`` labelled rows a class (a documented bound, taken in hash order of the id), and a dictionary
has about ``dictionary`` bytes (the other bound), to which every one of its texts gives the same share. Labelled texts are
cut and compressed whole in the tasks, as those to score are; only slices and sizes come to the driver. Every text is
scored whole. Null and empty texts have no sizes to compare and get the score 0; texts only count, never other columns. An
empty table gives an empty result; without labels of both classes every text scores 0.5; further columns pass through,
clashing names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.session import materialize

PIECE = 2048  # bytes compressed at once
SLICE = 64  # bytes of a text that stand together in a dictionary
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    spread: tuple[float, ...]


def _coders(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    plain = {"level": LEVEL, "write_content_size": False, "write_dict_id": False}
    made = []
    for raw in (good, bad):
        words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=words, **plain))
    return [*made, zstandard.ZstdCompressor(**plain)]


def sizes_of(text: str | None, coders: list[zstandard.ZstdCompressor]) -> tuple[int, int, int, int]:
    """Bytes of the text, and compressed with good, bad and no dictionary."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
    return len(raw), *(sum(len(c.compress(p)) for p in pieces) for c in coders)


def features(sizes: np.ndarray) -> np.ndarray:
    """Normalised differences: good against bad, either against none, none against the raw size, and the length."""
    raw, good, bad, none = (sizes[:, i].astype(float) for i in range(4))
    least = np.maximum(1.0, np.minimum(good, bad))
    one = np.stack([(good - bad) / least, (good - bad) / np.maximum(raw, 1), none / np.maximum(raw, 1), good / np.maximum(raw, 1), np.log1p(raw)], 1)
    return np.concatenate([one, one[:, :4] ** 2, one[:, :1] * one[:, 2:3]], 1)


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps; weights with the intercept first."""
    centre, spread = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([np.ones((len(x), 1)), np.clip((x - centre) / spread, -8, 8)], 1)
    w = np.zeros(z.shape[1])
    penalty = np.eye(len(w)) * ridge
    penalty[0, 0] = 1e-6

    def loss(v: np.ndarray) -> float:
        margin = z @ v
        return float(np.logaddexp(0, margin).sum() - y @ margin + v @ penalty @ v / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        before = loss(w)
        while loss(w + step) > before and np.abs(step).max() > 1e-10:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, spread


def slices(text: str, share: int) -> bytes:
    """About ``share`` bytes of the text, in slices from the middles of equal parts of it; a shorter text is taken whole."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= share:
        return raw
    n = max(1, share // SLICE)
    starts = ((2 * i + 1) * len(raw) // (2 * n) - SLICE // 2 for i in range(n))
    return b"".join(raw[max(0, at) : max(0, at) + SLICE] for at in starts)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 3_000, dictionary: int = 256 * 1024) -> Model | None:
    """Model of the texts of ``docs`` that ``labels`` (doc_id, quality) name: at most ``max_rows`` labels of either class, and
    dictionaries of ``dictionary`` bytes. The labels are chosen first, so only their texts move."""
    marks_of = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rank = F.xxhash64("doc_id")
    chosen = [marks_of.where(F.col("quality") == q).orderBy(rank, "doc_id").limit(max_rows) for q in (1, 0)]
    texts = docs.where("text is not null and text <> ''").select("doc_id", "text")
    texts = materialize(texts.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id"))
    rows = texts.select("doc_id", "quality").toPandas().sort_values("doc_id")
    rows = rows.iloc[np.argsort((rows["doc_id"].to_numpy() * 2654435761) % (1 << 32), kind="stable")]
    place = {int(k): i for i, k in enumerate(rows["doc_id"].drop_duplicates())}
    taken = {q: rows.loc[rows["quality"] == q, "doc_id"].drop_duplicates().tolist() for q in (1, 0)}
    if min((rows["quality"] == q).sum() for q in (1, 0)) < 4 or min(map(len, taken.values())) < 2:
        return None
    # the first half of a class's texts gives its dictionary, the second one is for the calibration
    given = {int(k): max(SLICE, dictionary // (len(ids) // 2)) for ids in taken.values() for k in ids[: len(ids) // 2]}
    shares = docs.sparkSession.createDataFrame(list(given.items()), "doc_id long, share int")

    @F.pandas_udf("binary")
    def piece(texts: pd.Series, shares: pd.Series) -> pd.Series:
        return pd.Series([slices(t, n) for t, n in zip(texts, shares, strict=True)], dtype=object)

    cut = texts.join(F.broadcast(shares), "doc_id").select("doc_id", "quality", piece("text", "share").alias("piece")).collect()
    cut.sort(key=lambda r: (place[r["doc_id"]], bytes(r["piece"])))
    dictionaries = {q: b"\n".join(bytes(r["piece"]) for r in cut if r["quality"] == q) for q in (1, 0)}
    good, bad = dictionaries[1], dictionaries[0]

    @F.pandas_udf("array<long>")
    def sizes(texts: pd.Series) -> pd.Series:
        coders = _coders(good, bad)
        return pd.Series([list(sizes_of(t, coders)) for t in texts], dtype=object)

    rest = texts.join(F.broadcast(shares), "doc_id", "left_anti").select("doc_id", "quality", sizes("text").alias("sizes")).collect()
    rest.sort(key=lambda r: (place[r["doc_id"]], r["sizes"]))
    x, y = features(np.array([r["sizes"] for r in rest])), np.array([float(r["quality"]) for r in rest])
    w, centre, spread = calibrate(x, y)
    # the classes were drawn to equal sizes; move the intercept to their true odds
    n = dict(marks_of.groupBy("quality").count().collect())
    w[0] += np.log(n[1] / n[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(dictionaries[1], dictionaries[0], tuple(w.tolist()), tuple(centre.tolist()), tuple(spread.tolist()))


def score_texts(docs: DataFrame, model: Model | None, column: str = "text") -> DataFrame:
    """Documents with ``score``, the calibrated probability of good quality."""
    if model is None:
        return docs.withColumn("score", F.when(F.coalesce(F.length(column), F.lit(0)) == 0, 0.0).otherwise(0.5))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        coders = _coders(model.good, model.bad)
        sizes = np.array([sizes_of(t, coders) for t in texts]).reshape(-1, 4)
        z = np.clip((features(sizes) - np.array(model.centre)) / np.array(model.spread), -8, 8)
        p = 1 / (1 + np.exp(-np.clip(model.weights[0] + z @ np.array(model.weights[1:]), -30, 30)))
        return pd.Series(np.where(sizes[:, 0] > 0, p, 0.0))

    return docs.withColumn("score", score(F.col(column)))
