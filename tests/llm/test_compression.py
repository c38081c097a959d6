"""The fit sees whole labelled texts, and every dictionary text."""

import random

from boxwright.llm import compression


def test_what_lies_behind_a_long_head_is_learned(spark):
    rng = random.Random(2)
    good, bad = ([f"{k}{rng.randrange(10**5)}" for _ in range(300)] for k in ("lorem", "zap"))
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(good, 2_500) + " " + say(bad if i % 2 else good, 5_000)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    model = compression.fit(docs, labels)
    got = {r.doc_id: r.score for r in compression.score_texts(docs, model).collect()}
    assert all((got[i] > 0.7) if i % 2 == 0 else (got[i] < 0.3) for i in range(60, 80))
    assert len(model.good) > 200_000


def test_slices_are_spread_over_the_whole_text():
    text = "".join(f"{i:08d}" for i in range(10_000))
    cut = compression.slices(text, 640)
    at = [text.index(cut[k : k + 64].decode()) for k in range(0, 640, 64)]
    assert all(8_000 * i < a < 8_000 * (i + 1) for i, a in enumerate(at)) and compression.slices("abc", 640) == b"abc"
