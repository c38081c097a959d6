"""Conversation repair against plain edit scripts."""

import random

import duckdb
import pytest

from boxwright.llm import conversations as C
from boxwright.llm.registry import QUERIES
from tests.llm import brute_conversations as brute

SCHEMA = "conv_id long, turn long, role string, text string"


def check(got, rows, damage=True):
    if damage:
        want = brute.damaged(rows)
    else:
        want = {}
        for conv, turn, role, text in rows:
            want.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert len(got) == len(want)
    for r in got:
        x = brute.repair(want[r["conv_id"]])
        assert {k: r[k] for k in x if k != "made"} == {k: v for k, v in x.items() if k != "made"}, want[r["conv_id"]]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '/root/testdata/{sf}/conversations.parquet'").fetchall()
    check([r.asDict() for r in QUERIES["op13_conversation_repair"](spark, f"/root/testdata/{sf}").collect()], rows)


def odd_rows(seed, n=300):
    rng = random.Random(seed)
    texts = [None, "", " \n", "a.", "a", "b!\r\n", "c? ", "é. ", "same text.", "x" * 5000 + "."]
    roles = [None, "", "user", "assistant", "system", "tool", "User", "\U0001f600"]
    return [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, *range(30)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 3, 7, 512])
def test_odd_rows_and_block_sizes(spark, size):
    rows = odd_rows(size)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check([r.asDict() for r in C.repair(C.damage(df), size).collect()], rows)
    check([r.asDict() for r in C.repair(df, size).collect()], rows, damage=False)


def test_one_long_conversation(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", f"{t}.", f"{t}", ""])) for t in range(400)]
    rows += [(7, None, "user", "again and again.")] * 60
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [r.asDict() for r in C.repair(df, 16).collect()]
    check(got, rows, damage=False)
    made = brute.repair([r[1:] for r in rows])["made"]
    out = sorted(C.repaired(df, 16).collect(), key=lambda r: r["place"])
    assert [(r["role"], r["text"]) for r in out] == list(made)
    assert [r["place"] for r in out] == list(range(len(made)))


def test_empty_table_extra_columns_and_text_ids(spark):
    assert C.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([("a", 0, "user", "x.", 1, "k")], "conv_id string, turn int, role string, text string, block int, kind string")
    row = C.repair(df).first()
    assert (row["conv_id"], row["cost"], row["audit"]) == ("a", 2, "KI")


def test_nodes_are_shared_and_classes_are_few():
    assert len(C.CLASSES) < 30
    node = C.root(C.END)
    for symbol in reversed("suaD"):
        node = C.step(node, symbol)
    assert (node[0][0], node[1][0]) == (3, "KKKD")
