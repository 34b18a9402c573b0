"""Undo and redo stacks, next to two plain lists per history."""

import random

import numpy as np
import pytest

from ledgertone.operators import stacks as K

SCHEMA = "history string, seq bigint, action string, state string"


def plain(rows, keep):
    stacks = {}
    for h, seq, action, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1], ["do", "undo", "redo"].index(r[2]) if r[2] in ("do", "undo", "redo") else 3)):
        undo, redo = stacks.setdefault(h, ([], []))
        if action == "do":
            undo.append(seq)
            redo.clear()
            del undo[:-keep]
        elif action == "undo" and undo:
            redo.append(undo.pop())
        elif action == "redo" and redo:
            undo.append(redo.pop())
    return sorted((str(h), s, name) for h, two in stacks.items() for name, seqs in zip(("undo", "redo"), two) for s in seqs)


def found(spark, rows, keep):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted((str(r["history"]), r["seq"], r["state"]) for r in K.live_operations(df, keep=keep).collect())


def drawn(seed, n, weights):
    rng = random.Random(seed)
    one = lambda i: rng.choices(["do", "undo", "redo"], weights[i * len(weights) // n])[0]
    # two thirds of the rows in one history, some without any
    return [(rng.choice(["hot"] * 8 + ["a", "b", None, None]), i, one(i), "clash") for i in range(n)]


@pytest.mark.parametrize("seed, weights", [(1, [(4, 3, 2)]), (2, [(1, 4, 4)]), (3, [(6, 1, 1), (0, 3, 2), (1, 3, 3)])])
def test_against_two_lists(spark, monkeypatch, seed, weights):
    monkeypatch.setattr(K, "FAN", 4)  # several levels of composed maps
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        rows = drawn(seed, 4000, weights)
        assert found(spark, rows, 7) == plain(rows, 7)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_maps_and_walks_agree():
    rng = random.Random(5)
    cursors, lengths = K._pairs(6)
    for _ in range(20):
        kinds = np.array(rng.choices([0, 1, 2], [1, 2, 2], k=rng.randint(0, 60)), np.uint8)
        to = K.block_map(kinds, 6)
        for state in range(len(cursors)):
            assert cursors[to[state]] == K.walk(kinds, np.arange(len(kinds)), state, 6)[2]


def test_odd_rows(spark):
    rows = [("h", 1, "do", ""), ("h", 1, "undo", ""), ("h", 2, "redo", ""), ("h", 3, "paint", ""), ("h", 4, None, ""), ("h", None, "undo", ""),
            ("e", 1, "undo", ""), ("e", 2, "redo", ""), (None, 1, "do", ""), (None, 2, "do", ""), (None, 3, "undo", "")]
    assert found(spark, rows, 200) == [("None", 1, "undo"), ("None", 2, "redo"), ("h", 1, "undo")]
    assert found(spark, rows[:0], 200) == []


def test_new_work_clears_redo_and_the_oldest_go(spark):
    rows = [("h", i, "do", "") for i in range(300)] + [("h", 300 + i, "undo", "") for i in range(50)] + [("h", 400, "do", "")]
    assert found(spark, rows, 200) == [("h", i, "undo") for i in [*range(100, 250), 400]]


def test_many_short_histories(spark):
    rng = random.Random(6)
    rows = [(f"h{rng.randint(0, 900)}", i, rng.choice(["do", "do", "undo", "redo"]), "") for i in range(6000)]
    assert found(spark, rows, 3) == plain(rows, 3)
