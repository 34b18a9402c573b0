"""Linked components against all pairs compared by sets of word tuples."""

import random
import re

import pytest
from pyspark.sql import types as T

from ledgertone.llm import common, jaccard, queries

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("k", T.StringType()), T.StructField("component", T.IntegerType())])


def shingle_set(text, n):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted((str(i), len(sets[k]), str(low.get(find(k)))) for k, (i, _) in enumerate(rows))


def run(spark, rows, n, percent):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(3)
    out = jaccard.linked_components(df, n, percent)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((str(r[0]), r[1], str(r[2])) for r in out.collect())


def cases():
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for f in range(12):  # families of near copies at all distances, around the threshold
        base = [rng.choice(vocab) for _ in range(rng.choice([12, 60, 140]))]
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((len(rows) + 10, " ".join(t)))
    passage = " ".join(rng.choice(vocab) for _ in range(50))
    rows += [(500 + k, passage + " " + " ".join(rng.choice(vocab) for _ in range(60))) for k in range(60)]
    rows += [(700, "The Cat"), (701, "the  cat\n"), (702, "THE CAT sat"), (703, ""), (704, None), (705, " \t "), (706, ""), (707, "a b c d"), (708, "A B C D")]
    rows += [(709, "Écoles a b c"), (710, "écoles a b c"), (None, "a b c d"), (None, None), (711, "x " * 3000), (712, "x " * 50), (713, "x x x x")]
    return rows + rows[:20] + [(rows[3][0], "another text under a known id, with its own words")]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_against_all_pairs(spark, n, percent, monkeypatch):
    rows = cases()
    assert run(spark, rows, n, percent) == brute(rows, n, percent)


def test_leaders_first(spark, monkeypatch):
    """With little left to the full comparison, rounds of leaders find the same components."""
    monkeypatch.setattr(jaccard, "LEFT", 0)
    monkeypatch.setattr(jaccard, "ROUNDS", 2)
    monkeypatch.setattr(jaccard, "SMALL", 0)
    rows = cases()
    assert run(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_crowds(spark, monkeypatch):
    """Frequent elements compared in blocks, a pair met at several elements or in two parts of one returned once."""
    monkeypatch.setattr(jaccard, "CROWD", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "KNOWN", 2)
    rows = cases()
    assert run(spark, rows, 4, 85) == brute(rows, 4, 85)


def near_copies(rng, n):
    base = [f"b{k}" for k in range(130)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randrange(1, 6)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(12)}"
        rows.append((i, " ".join(t)))
    return rows


def test_pairs_of_a_crowd(spark, monkeypatch):
    """Of a crowd of near copies, pairs far fewer than all are verified, and their number doesn't grow with its square."""
    seen, real = [], jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda pairs, sets, percent: (seen.append(pairs.count()), real(pairs, sets, percent))[1])
    counts = {}
    for n in (150, 450):
        rows = near_copies(random.Random(n), n)
        seen.clear()
        assert run(spark, rows, 4, 85) == brute(rows, 4, 85)
        counts[n] = sum(seen)
    print(counts)
    assert counts[450] <= 6 * counts[150] and counts[450] <= 16 * 450


def test_few_links_need_no_rounds(spark, monkeypatch):
    """Few links are followed in one pass and save one table; many give the same components."""
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(130)] + [(k, k + 1) for k in range(400, 480)] + [(7, 7), (None, 3)]
    nodes = spark.createDataFrame([(k,) for k in range(500)], "node bigint")
    made, real = [], common.saved
    monkeypatch.setattr(common, "saved", lambda df, label: (made.append(label), real(df, label))[1])
    few = sorted(map(tuple, common.components(nodes, spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert made == ["links"]
    monkeypatch.setattr(common, "FEW_LINKS", 0)
    assert few == sorted(map(tuple, common.components(nodes, spark.createDataFrame(links, "a bigint, b bigint")).collect()))


def test_empty(spark):
    assert run(spark, [], 4, 85) == []
    assert run(spark, [(1, None)], 4, 85) == [("1", 0, "1")]


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((str(r[0]), r[1], str(r[2])) for r in queries.QUERIES["op4_ngram_jaccard"](spark, SF).collect())
    assert got == brute(rows, 4, 85)
