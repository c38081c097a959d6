"""Quality rules: base statistics of whole texts and a learned decision list.

Statistics come from a pandas UDF over the text alone. The list is learned by sequential covering: a rule for low quality
is grown on one part of the labelled rows, one threshold condition at a time by information gain, pruned on the other
part, and kept while it is precise there; what it covers is removed and the next rule is grown. The list becomes an
ordered SQL CASE over the statistics.

Learning reads at most ``max_rows`` labelled rows (a documented bound of the fit, taken in hash order of the id);
everything else covers all rows.

Defined results: null and empty texts have all counts 0 and fail the base rule; repeated rows are judged alike; an empty
table gives an empty result; without labels the list is empty and keeps what the base rule keeps; further columns pass
through, clashing names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_bangs", "n_bars", "n_distinct", "longest_run",
)
FEATURES = {
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_upper + n_lower, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "bars_per_word": "n_bars / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "run_share": "longest_run / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more. Window names are built exactly, by doubling."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    names, width = ids, 1
    while width < window:
        step = min(width, window - width)
        names = np.unique(names[: len(names) - step] * np.int64(1 << 31) + names[step:], return_inverse=True)[1].astype(np.int64)
        width += step
        if names.max() == len(names) - 1:
            return 0
    twice = np.bincount(names)[names] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[:n] += twice
    edges[window : window + n] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    # bytes.split() cuts at exactly \x20 and \x09-\x0D
    parts = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in parts), np.int64, len(parts))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    change = np.flatnonzero(np.diff(ids)) if len(ids) else ids
    run = int(np.diff(np.concatenate(([-1], change, [len(ids) - 1]))).max()) if len(ids) else 0
    return (
        len(parts), len(text) - int(hist[32] + hist[9:14].sum()), int(hist[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(ids) if len(seen) < len(ids) else 0,
        len(lines), int(hist[65:91].sum()), int(hist[97:123].sum()), int(hist[48:58].sum()), int(hist[33]), int(hist[124]), len(seen), run,
    )


def text_statistics(docs: DataFrame, column: str = "text") -> DataFrame:
    """Documents with the COUNTS columns."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts_of(t) for t in texts], columns=list(COUNTS))

    rest = docs.drop(*[c for c in docs.columns if c in (*COUNTS, "_counts")])
    return rest.withColumn("_counts", measure(F.col(column))).select(*rest.columns, "_counts.*")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<'} {self.threshold!r}D"

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold


def _covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    mask = np.ones(n, bool)
    for condition in rule:
        mask &= condition.mask(x)
    return mask


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int) -> list[Condition]:
    """Add the condition of highest gain until the rule covers no good row."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < max_conditions and inside.any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), inside.sum()
        best, choice = 1e-9, None
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            cut = np.flatnonzero(np.diff(v)) + 1
            if not len(cut):
                continue
            below = np.concatenate(([0], np.cumsum(b)))[cut]
            for above, p, n in ((False, below, cut), (True, p0 - below, len(v) - cut)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-12) / n) - np.log2(p0 / n0)), 0)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, choice = gain[k], Condition(name, above, float((v[cut[k] - 1] + v[cut[k]]) / 2))
        if choice is None:
            break
        rule.append(choice)
        inside &= choice.mask(x)
    return rule


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, precision: float = 0.95, max_rules: int = 16, max_conditions: int = 4) -> list[list[Condition]]:
    """Ordered rules for low quality. ``fold`` marks the rows that prune."""
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        g, p = left & ~fold, left & fold
        if not bad[g].any():
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], max_conditions)
        pruned = {k: v[p] for k, v in x.items()}

        def worth(r: list[Condition], pruned=pruned, p=p) -> float:
            hit = _covers(r, pruned, int(p.sum()))
            return (2 * bad[p][hit].sum() - hit.sum()) / max(1, hit.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _covers(rule, x, len(bad)) & left
        held = hit & fold
        if not rule or hit.sum() < 5 or bad[hit].mean() < precision or (held.any() and bad[held].mean() < precision):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit_rules(statistics: DataFrame, labels: DataFrame, max_rows: int = 40_000) -> list[list[Condition]]:
    """Learn the list from labelled statistics; ``labels`` has doc_id and quality (1 good, 0 bad)."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = statistics.select("doc_id", *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()]).join(known, "doc_id")
    taken = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).toPandas()
    if taken.empty:
        return []
    fold = ((taken["doc_id"].to_numpy() * 2654435761) >> 7) % 3 == 0
    return learn_rules({n: taken[n].to_numpy(float) for n in FEATURES}, (taken["quality"] == 0).to_numpy(), fold)


def base_failed() -> F.Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


def kept(rules: list[list[Condition]]) -> F.Column:
    """The list as one ordered conditional expression: base rule first, then the learned rules, then keep."""
    verdict = F.when(base_failed(), False)
    for rule in rules:
        verdict = verdict.when(F.expr(" and ".join(c.sql() for c in rule)), False)
    return verdict.otherwise(True)
