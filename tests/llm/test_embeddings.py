"""Embedding near-duplicates against all cosines."""

from collections import Counter

import numpy as np
import pytest

from boxwright.llm import embeddings as E
from boxwright.llm.registry import QUERIES

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, threshold=0.98):
    """{row: (n_links, component)} by all pairs."""
    good = []
    for i, (_, label, v) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append((i, label, np.array([np.float32(x) for x in v], "f8")))
    near = {i: set() for i in range(len(rows))}
    for i, a, x in good:
        for j, b, y in good:
            if i != j and a == b and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                near[i].add(j)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out[i] = (rows[i][0], len(near[i]), min(ids) if ids else None)
    return Counter(out.values())


def clustered(seed, n, dim=24, noise=0.0):
    """Vectors around a few centres, at angles on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    centres, out = rng.standard_normal((max(2, n // 40), dim)), []
    for i in range(n):
        c = centres[rng.integers(len(centres))]
        v = c + rng.standard_normal(dim) * np.linalg.norm(c) / np.sqrt(dim) * rng.choice([0.02, 0.08, 0.14, 0.2, 3])
        out.append((i, int(rng.integers(3)), [float(np.float32(x)) for x in v * rng.choice([1, 1, 7])]))
    return out


def got(df, **options):
    rows = E.near_duplicates(df, **options).collect()
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in rows)
    return Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in rows)


@pytest.mark.parametrize("tile", [16, 1024])
def test_clusters(spark, tile):
    rows = clustered(3, 500)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4), tile=tile) == brute(rows)


def test_few_tables_count_a_pair_once(spark):
    rows = clustered(4, 300)
    many = got(spark.createDataFrame(rows, SCHEMA), plan_of=lambda *_: (4, 40), tile=8)
    assert many == brute(rows)


def test_recall_of_the_plan():
    rng = np.random.default_rng(0)
    for largest in (100, 10_000, 10**8):
        bits, tables = E.plan(largest, 0.98)
        x = rng.standard_normal((400, 64))
        side = rng.standard_normal((400, 64))
        side -= (side * x).sum(1, keepdims=True) / (x * x).sum(1, keepdims=True) * x
        y = 0.98 * x / np.linalg.norm(x, axis=1, keepdims=True) + np.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
        planes = rng.standard_normal((bits * tables, 64))
        same = ((x @ planes.T > 0) == (y @ planes.T > 0)).reshape(400, tables, bits).all(2).any(1)
        assert same.mean() > 0.99


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, 0, one), (1, 0, one), (None, 0, one), (5, 0, [2.0, 4.0, 6.0]), (6, 1, one), (7, None, one), (8, 0, None), (9, 0, []), (10, 0, [0.0, -0.0, 0.0]),
        (11, 0, [1.0, None, 3.0]), (12, 0, [1.0, float("nan"), 3.0]), (13, 0, [1.0, float("inf"), 3.0]), (14, 0, [1.0, 2.0]), (None, 2, one), (15, 3, [0.0, 1.0]), (16, 3, [-0.0, 1.0]),
    ]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_one_ball_over_many_tiles(spark):
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(16)
    rows = [(i, 1, [float(np.float32(x)) for x in centre + rng.standard_normal(16) * 0.05]) for i in range(600)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4), tile=32) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, 0, [1.0, 0.0], "x", 3), (2, 0, [1.0, 0.0], "y", 4)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, name string, g long")
    assert got(df) == Counter({(1, 1, 1): 1, (2, 1, 1): 1})


def test_query(spark):
    import duckdb

    rows = duckdb.sql("select vec_id, label, embedding from '/root/testdata/sf0.01/embeddings.parquet'").fetchall()
    found = QUERIES["op12_embedding_dedup"](spark, "/root/testdata/sf0.01").collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == brute(rows)
