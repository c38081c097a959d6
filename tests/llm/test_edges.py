"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; discovery by context; the pipeline."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from boxwright.llm import attribution, bpe, compression, mixing, near, pii, rules, sharding, simhash, suffix_tree, topk
from tests.llm import brute

RAW = open(brute.RANK_FILE, "rb").read()
LONG = "alpha beta " * 30_000
ROWS = [
    (1, None, None, 9), (None, "x y z", "a", 9), (2, "", "a", 9), (3, LONG, "b", 9), (4, "9" * 40_000 + " a@b.co", "b", 9), (5, "same text here", "c", 9),
    (5, "same text here", "c", 9), (6, "same text here", "c", 9),
]
SCHEMA = "doc_id long, text string, source string, {clash} int"
CASES = {
    "mix": (lambda d: mixing.mix(d), "taken"),
    "pii": (lambda d: pii.find(d), "spans"),
    "score": (lambda d: compression.score_texts(d, None), "score"),
    "suffix": (lambda d: suffix_tree.score(d, d), "n_known"),
    "shard": (lambda d: sharding.shard_documents(d), "slot"),
    "sections": (lambda d: attribution.section_tokens(d, RAW, public_tokenizers.PATTERN), "sections"),
    "bpe": (lambda d: bpe.encode(d, RAW, public_tokenizers.PATTERN), "n_tokens"),
    "simhash": (lambda d: simhash.near_duplicates(d), "fp"),
    "rules": (lambda d: rules.text_statistics(d), "n_words"),
}


@pytest.mark.parametrize("name", CASES)
def test_odd_rows(spark, name):
    fn, clash = CASES[name]
    docs = spark.createDataFrame(ROWS, SCHEMA.format(clash=clash))
    out = fn(docs)
    rows = out.collect()
    assert len(rows) == len(ROWS) and len(set(out.columns)) == len(out.columns)
    same = [r for r in rows if r["doc_id"] == 5]
    if name not in ("mix", "shard"):
        assert same[0][clash] == same[1][clash]
    assert fn(docs.limit(0)).collect() == []


def test_deduplicate(spark):
    base = [f"w{i * 7919 % 1000}" for i in range(300)]
    edited, far = base[:150] + ["other"] + base[151:], [f"v{i}" for i in range(300)]
    rows = [(i, " ".join(w), "keep") for i, w in enumerate([edited, base, base, far, base])] + [(9, None, "keep"), (10, "", "keep")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    assert sorted(r.doc_id for r in near.deduplicate(docs).collect()) == [0, 3, 9]
    assert near.deduplicate(docs.limit(0)).count() == 0


def test_deduplicate_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 10, 20, "x", 3), (2, "A b c d e f", 11, 21, "y", 4), (None, "other", 12, 22, "z", 5), (None, "other", 13, 23, "w", 6), (None, None, 14, 24, "v", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _row long, id string, `row` long")
    out = near.deduplicate(docs)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert rows[0] in got and rows[4] in got and (rows[2] in got) != (rows[3] in got) and len(got) == 3


def test_top_k_ties_and_holes(spark):
    rows = [(i, [0.5, 0.25]) for i in range(0, 30)] + [(100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [1.0, 1.0]), (None, [1.0, 1.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_k(v, v.where("vec_id % 100 = 0"), 10).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got if r.query_id == 0) == [(0, 1, 400)] + [(0, i + 1, i) for i in range(1, 10)]
    assert {r.query_id for r in got} == {0, 400}
    assert topk.top_k(v.limit(0), v.limit(0), 10).count() == 0


def test_contexts_discover(spark):
    """Numbers behind a word that mostly stands before telephone numbers are found, decoys behind common words are not."""
    rows = [(i, f"lorem w{i % 7} phone: +1 (212) 555-{1000 + i} the dolor the sit") for i in range(40)]
    rows += [(100 + i, f"ipsum phone: 212555{1000 + i} the amet") for i in range(5)] + [(200 + i, f"the 99{10000 + i} sit") for i in range(5)]
    out = {r.doc_id: r.s for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.digest("spans").alias("s")).collect()}
    assert out[100] == "phone:13:23" and out[200] == ""
    text = spark.createDataFrame([("call +1 (212) 555-1000 now a@b.co", 1)], "text string, doc_id long")
    assert pii.find(text).select(pii.redacted()).first()[0] == "call [phone] now [email]"


def test_pattern_survives_other_seeds(spark):
    """A pattern needs seeds of its own, not a share of all; numbers in groups and spelt addresses are found by two- and three-word contexts."""
    rows = [(i, f"please call back under +1 (212) 555-{1000 + i} or so w{i % 7}") for i in range(12)]
    rows += [(50 + i, f"my mail is u{i}@host{i}.org thanks") for i in range(12)]
    rows += [(1000 + i, f"w{i % 97} x{i}@y{i % 13}.com w{i % 89}") for i in range(9000)]
    rows += [(20_000, "call back under (212) 555-9999 or so"), (20_001, "call back under 555 123 4567"), (20_002, "so my mail is joe [at] host dot org thanks")]
    rows += [(20_003, "back in 1999 2001 2003 all was well"), (20_004, "well 1234567 tons"), (20_005, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_m", "_g", "_token", "_row", "k", "base", "spans")})
    out = {r.doc_id: r.s for r in pii.find(docs, keep=("doc_id", "_m", "_g", "_row")).where("doc_id >= 20000").select("doc_id", pii.digest("spans").alias("s")).collect()}
    assert out == {20_000: "phone:16:30", 20_001: "phone:16:28", 20_002: "email:14:35", 20_003: "", 20_004: "", 20_005: ""}


def test_contexts_are_whole_words(spark):
    """A long word beside a number is no pattern, and none is cut from it; reaches end between words."""
    long = "q" * 70
    rows = [(0, f"{long} +15551112222 end"), (1, "one two three four +15551112222"), (2, "+15551112222")]
    seen = pii.with_contexts(pii.base_spans(spark.createDataFrame(rows, "doc_id long, text string")))
    got = {r.doc_id: list(r.p) for r in seen.select("doc_id", F.expr("_seen[0].patterns").alias("p")).collect()}
    assert got == {0: [">end"], 1: ["<four", "<three four", "<two three four"], 2: []}


def test_rules_learn_and_read(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = {n: rng.random(600) for n in rules.FEATURES}
    bad = (x["upper_share"] > 0.7) & (x["bangs_per_word"] > 0.3)
    found = rules.learn_rules(x, bad, np.arange(600) % 3 == 0)
    hit = np.zeros(600, bool)
    for rule in found:
        hit |= rules._covers(rule, x, 600)
    assert (hit == bad).mean() > 0.97 and all(len(r) <= 4 for r in found)


def test_minimax_capacity(spark):
    """The searched capacity is the smallest that greedy filling meets."""
    import random

    rng = random.Random(3)
    for shards in (1, 3, 16):
        sizes = [rng.randint(1, 900) for _ in range(120)] + [5000]
        rng.shuffle(sizes)
        ends, at = [], 0
        for s in sizes:
            at += s
            ends.append((at,))
        def fits(c):
            used, load = 1, 0
            for s in sizes:
                if load + s > c:
                    used, load = used + 1, 0
                load += s
            return used <= shards
        want = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
        got, cuts = sharding.smallest_capacity(spark.createDataFrame(ends, "end long"), shards, sum(sizes), max(sizes))
        assert got == want and cuts[-1] == sum(sizes)


def test_attribution_rules():
    import numpy as np

    ends, tokens = np.array([4, 10]), np.array([3, 6, 10])
    assert attribution.attribute(tokens, ends, "first").tolist() == [2, 1]
    assert attribution.attribute(tokens, ends, "last").tolist() == [1, 2]
    assert attribution.attribute(tokens, ends, "share") == pytest.approx([1 + 1 / 3, 1 + 2 / 3])


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    base = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = corpus_pipeline.quality_rules(spark, docs, d)
    assert kept.columns == base and all(brute.quality(r.text)[0] >= 20 for r in kept.collect())
    ones = corpus_pipeline.simhash_near_dedup(spark, kept, d)
    seen = [r.text for r in ones.collect()]
    assert ones.columns == base and len(seen) == len(set(seen))
    masked = corpus_pipeline.personal_data(spark, ones, d)
    assert masked.columns == base and not any(brute.base_spans(r.text) for r in masked.where("text like '%[email]%'").collect())
    mixed = corpus_pipeline.mix_sources(spark, masked, d)
    assert mixed.columns == base and max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3
    out = corpus_pipeline.run(spark, d)
    rows = out.collect()
    enc = brute.encoding()
    assert rows and all(r.round_trip for r in rows) and {r.doc_id for r in rows} <= texts.keys()
    clean = [r for r in rows if not brute.base_spans(texts[r.doc_id])]
    assert all(r.n_tokens == len(enc.encode_ordinary(texts[r.doc_id])) for r in clean)


def test_components_chain(spark):
    from boxwright.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert components(links.where(F.lit(False))).collect() == []


def test_dense_ball_has_the_groups_of_all_links(spark):
    """Groups of near copies with their own edits, against all pairs of texts whose shingles are similar."""
    import random

    rng, texts = random.Random(5), []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = sorted({find(i) for i in range(len(texts))})
    assert 4 <= len(want) < 60
    assert sorted(r.doc_id for r in near.deduplicate(docs).collect()) == want
