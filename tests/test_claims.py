"""Ids claimed in order, next to one pass over the claims."""

import random
from collections import Counter

import pytest

from ledgertone.operators import claims as C


def plain(moves, owners, by):
    """Accepted or not, claim by claim; an id left by an accepted move is free for the first who asks."""
    holders, used, out = Counter(owners), set(owners), {}
    asked, freed, left = {}, {}, Counter()
    for seq, old, new in sorted(moves):
        if old == new:
            out[seq] = True
            continue
        free = (new not in used or new in freed) if by == "set" else left[new] >= holders[new]
        last = asked.get(new)
        out[seq] = free and (last is None or last < freed.get(new, -1))
        asked[new] = seq
        if out[seq] and old is not None:
            freed[old], left[old] = seq, left[old] + 1
    return out


def settled(spark, moves, owners, by):
    got = C.settle_ids(
        spark.createDataFrame(moves, "seq bigint, old_id string, new_id string").repartition(3),
        spark.createDataFrame([(o,) for o in owners], "id string"), by,
    )
    return {r.seq: r.accepted for r in got.collect()}


@pytest.mark.parametrize("by", ["set", "holders"])
@pytest.mark.parametrize("seed", range(3))
def test_against_one_pass(spark, seed, by):
    r = random.Random(seed)
    ids = [f"i{k}" for k in range(40)]
    owners = [r.choice(ids[:30]) for _ in range(35)]
    olds = r.sample(owners, 30) + [None] * 25
    r.shuffle(olds)
    moves = [(k * 3, old, r.choice(ids)) for k, old in enumerate(olds)]
    assert settled(spark, moves, owners, by) == plain(moves, owners, by)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """10 000 renames, each into the id that the one before left; and a chain that begins with a held id."""
    n, rounds = 10_000, []
    write = C.written
    monkeypatch.setattr(C, "written", lambda df: rounds.append(1) or write(df))
    moves = [(k, f"a{k}", f"a{k - 1}" if k else "free") for k in range(n)] + [(n + k, f"b{k}", f"b{k - 1}" if k else "taken") for k in range(100)]
    owners = [m[1] for m in moves] + ["taken"]
    got = settled(spark, moves, owners, "set")
    assert all(got[k] for k in range(n)) and not any(got[n + k] for k in range(100))
    assert len(rounds) <= 14 + 2


def test_a_hot_id(spark):
    """Very many rows ask for one id that very many leave."""
    moves = [(2 * k, "hot", f"n{k}") for k in range(2000)] + [(2 * k + 1, f"o{k}", "hot") for k in range(2000)]
    owners = ["hot"] * 2000 + [f"o{k}" for k in range(2000)]
    for by in ("set", "holders"):
        assert settled(spark, moves, owners, by) == plain(moves, owners, by)
