"""Collocations against plain counts, automata against dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from boxwright.llm import automata
from boxwright.llm import collocations as C
from boxwright.llm.registry import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, longest=5, top=2000):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ("" if text is None else text).translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, *words[i : i + m]] += 1
    made = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = set()
    for p, a in made.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                part = (p[0], *p[i : i + m])
                if a >= f[part]:
                    covered.add(part)
    out = []
    for (lang, *p), a in made.items():
        if (lang, *p) not in covered:
            cuts = [(1000 * a * n[lang] // (f[lang, *p[:k]] * f[lang, *p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, score, a, " ".join(p), f[lang, *p[:k]], f[lang, *p[k:]], n[lang]))
    out.sort(key=lambda r: (r[0], -r[1], -r[2], r[3].encode()))
    rank, rows = Counter(), []
    for lang, score, a, p, left, right, total in out:
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], p, a, left, right, total, score))
    return rows


def random_docs(seed, n=300):
    rng = random.Random(seed)
    some = ["the", "The", "of", "a", "ré", "É", "x" * 40, "new", "york", "city", "#", "\U0001f600", "b c"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "\x0b", " ; ", "?"]
    made = [(rng.choice([None, "en", "fr", "und", ""]), "".join(rng.choice(some) + rng.choice(gaps) for _ in range(rng.choice([0, 1, 5, 60])))) for _ in range(n)]
    return [*made, ("en", None), (None, None), ("en", " .;\n"), ("en", "the of a. " * 3000), *[("en", "new york city of the")] * 9]


@pytest.mark.parametrize("size,held,spread", [(1 << 20, 1 << 21, 4 << 20), (64, 50, 1 << 10)])
def test_random_texts(spark, monkeypatch, size, held, spread):
    docs = random_docs(1)
    monkeypatch.setattr(C, "RANGE_BYTES", spread)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = sorted(tuple(r) for r in C.collocations(df, least=6).collect())
    assert got == sorted(brute(docs, 6)) and len(got) > 20


def test_small_slices_give_the_same_words(monkeypatch):
    import pyarrow as pa

    docs = random_docs(2, 40)
    batch = pa.RecordBatch.from_arrays([pa.array([a or "und" for a, _ in docs]), pa.array([b or "" for _, b in docs])], names=["lang", "text"])

    def words():
        return [(x, y) for part, start, end, _, label, check, _, _ in C._words(C.Hashing(1), batch) for x, y in zip(label.tolist(), [part[i:j].tobytes() for i, j in zip(start, end)])]  # noqa: B905

    whole = words()
    monkeypatch.setattr(C, "SLICE", 37)
    assert words() == whole
    assert len({x for x, _ in whole}) == len({(a or "und", w) for a, b in docs for p in re.split(r"[.,;:!?\x0A-\x0D]", (b or "").translate(LOWER)) for w in re.findall(r"[^\x20\x09]+", p)})


def test_query(spark):
    import duckdb

    docs = duckdb.sql("select lang, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    got = sorted(tuple(r) for r in QUERIES["op11_collocations"](spark, "/root/testdata/sf0.01").collect())
    assert got == sorted(brute(docs, 100)) and got


def test_empty_table_and_extra_columns(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    df = spark.createDataFrame([("a b", "en", 1, "w")] * 3, "text string, lang string, range int, word string")
    assert [tuple(r) for r in C.collocations(df, least=2).collect()] == [("en", 1, "a b", 3, 3, 3, 6, 2000)]


def test_equal_labels_are_noticed(spark, monkeypatch):
    """Two words of one label and different check hashes make the job start again with another seed."""
    seeds = []
    plain = C._word_pieces

    def watched(seed, count):
        seeds.append(seed)
        return plain(seed, count)

    monkeypatch.setattr(C, "_word_pieces", watched)
    row = spark.createDataFrame([("a b", "en")] * 3, "text string, lang string")
    united = C._united_words

    def clashing(least):
        def run(batches):
            import pyarrow as pa

            for b in united(least)(batches):
                yield b
                if len(seeds) == 1:
                    yield pa.RecordBatch.from_pylist([{"kind": 2}], schema=b.schema)

        return run

    monkeypatch.setattr(C, "_united_words", clashing)
    assert C.collocations(row, least=2).count() == 1 and seeds == [42, 43]


def phrases(rng, n, depth, labels):
    out = {}
    for _ in range(n):
        out[tuple(rng.choice(labels) for _ in range(rng.randint(1, depth)))] = rng.randint(1, 5)
    return out


def arrays(counts, depth):
    paths = np.zeros((len(counts), depth), np.uint64)
    for i, p in enumerate(counts):
        paths[i, : len(p)] = p
    return automata.summed(paths, np.array(list(counts.values()), np.int64))


@pytest.mark.parametrize("depth,labels", [(1, [1, 2, 3]), (3, [1, 2]), (4, [5, 6, 7, 2**64 - 1])])
def test_automata(depth, labels):
    rng = random.Random(depth)
    parts = [phrases(rng, 40, depth, labels) for _ in range(3)]
    made = [automata.from_bytes(automata.build(*arrays(p, depth)).to_bytes()) for p in parts]
    for p, a in zip(parts, made, strict=True):
        paths, weights = automata.paths_of(a, depth)
        assert {tuple(x for x in r if x): w for r, w in zip(paths.tolist(), weights.tolist(), strict=True)} == p
    total = Counter()
    for p in parts:
        total.update(p)
    paths, weights = automata.union(made, depth)
    assert {tuple(x for x in r if x): w for r, w in zip(paths.tolist(), weights.tolist(), strict=True)} == total
    whole = automata.build(paths, weights)
    asked = [tuple(rng.choice([*labels, 99]) for _ in range(rng.randint(1, depth))) for _ in range(200)]
    queries = np.zeros((len(asked), depth), np.uint64)
    for i, q in enumerate(asked):
        queries[i, : len(q)] = q
    assert automata.lookup(whole, queries).tolist() == [total.get(q, 0) for q in asked]


def test_equal_states_are_one():
    paths = np.array([[a, b, c] for a in (1, 2, 3) for b in (4, 5) for c in (6, 7)], np.uint64)
    aut = automata.build(paths, np.ones(len(paths), np.int64))
    assert len(aut.first) - 1 == 3 and len(aut.label) == 3 + 2 + 2
