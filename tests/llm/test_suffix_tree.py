"""The suffix tree against a plain version, with contexts that a share of a large corpus would drop."""

from collections import Counter, defaultdict
from math import log2, log10

import pytest
from pyspark.sql import functions as F

from boxwright.llm import suffix_tree


def plain_scores(training, texts, depth=6, least=8, min_bits=64.0):
    levels = [defaultdict(Counter) for _ in range(depth + 1)]

    def positions(text):
        raw = bytes(depth) + text.lower().encode()
        return [(raw[i : i + depth], raw[i + depth] if i + depth < len(raw) else 256) for i in range(len(raw) - depth + 1)]

    for text in training:
        for c, s in positions(text):
            for k in range(depth + 1):
                levels[k][c[depth - k :]][s] += 1
    kept = [set() for _ in levels]

    def p(c, s, k):
        if k < 0:
            return 1 / 257
        c = c[len(c) - k :]
        if c not in kept[k]:
            return p(c, s, k - 1)
        n = levels[k][c]
        return (n[s] + len(n) * p(c, s, k - 1)) / (n.total() + len(n))

    for k, level in enumerate(levels):
        for c, n in level.items():
            bits = sum(v * log2(v / n.total() / p(c, s, k - 1)) for s, v in n.items())
            if k == 0 or n.total() >= least and bits >= min_bits:
                kept[k].add(c)
    return [sum(log10(p(c, s, depth)) for c, s in positions(t)) for t in texts]


def test_rare_contexts_are_kept_and_scores_are_exact(spark):
    # 40 places of a name among 4 million symbols are less than 2^-16 of them
    training = ["the cat sat " * 20_000] * 16 + [f"abc{i % 5} zyqxwvk" for i in range(40)]
    texts = ["zyqxwvk", "a cat sat", "", "Zyqx é\U0001f600 new", "the zyqxwvk sat"]
    both = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    learnt = spark.createDataFrame([(i, t) for i, t in enumerate(training)], "doc_id long, text string")
    want = plain_scores(training, texts)
    for sent in (0, 1 << 20):
        got = {r.doc_id: r.score for r in suffix_tree.score(both, learnt, sent=sent).select("doc_id", F.col("score")).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-9)


def test_texts_are_read_once_and_windows_of_one_state_are_one_entry(spark):
    """A test on the documents in place of training texts, the named columns alone, and fewer rows to send than windows."""
    rows = [(i, f"{'the cat sat ' * 30}abc{i} x{i * 7919}\x00", i % 3 > 0) for i in range(60)] + [(60, None, True), (61, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    want = plain_scores([t or "" for _, t, learn in rows if learn], [t or "" for _, t, _ in rows])
    for sent in (0, 100, 1 << 20):
        out = suffix_tree.score(docs, F.col("learn"), sent=sent, keep=("doc_id",))
        assert out.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        got = {r.doc_id: r.score for r in out.collect()}
        assert [got[i] for i in range(len(rows))] == pytest.approx(want, rel=1e-9)
    counts = suffix_tree.count_windows(docs.select("text", F.coalesce(F.col("learn").cast("int"), F.lit(0)).alias("n"), F.lit(1).alias("m")).na.fill(""))
    found = suffix_tree.states(counts)
    keys, _, least = suffix_tree.frequent_entries(found, 1 << 20)
    assert least == 0 and len(set(keys)) == len(keys) == found.where("first").count() < found.count()
    assert found.where("first").agg(F.sum("met")).first()[0] == counts.agg(F.sum("m")).first()[0] == sum(len(t or "") + 1 for _, t, _ in rows)
