"""Repeated passages: planted exact and changed copies are found whole, other text is left alone."""

import random

import numpy as np
from pyspark.sql import types as T

from ledgertone.llm import passages as P
from ledgertone.llm import queries

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("uid", T.StringType()), T.StructField("spans", T.IntegerType())])


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "clash", 3) for i, t in rows], SCHEMA).repartition(3)


def planted():
    rng = random.Random(3)
    rows, where = [], {}
    for p in range(6):
        passage = words(rng, [51, 60, 80, 200, 55, 120][p])
        for copy in range(8):
            own = list(passage)
            if p >= 2 and copy:  # changed, dropped and added words
                for _ in range(len(own) // 30):
                    k = rng.randrange(len(own))
                    own[k : k + 1] = rng.choice([[], words(rng, 1), [own[k], *words(rng, 1)]])
            head, tail = words(rng, rng.randrange(0, 60)), words(rng, rng.randrange(0, 60))
            rows.append((len(rows), " ".join(head + own).upper() + "\n" + "  ".join(tail)))
            where[len(rows) - 1] = (len(head), len(head) + len(own), p * 8)
    clean = [(100 + k, " ".join(words(rng, 300))) for k in range(20)]
    short = " ".join(words(rng, 30))
    clean += [(200 + k, " ".join(words(rng, 20)) + " " + short + " " + " ".join(words(rng, 20))) for k in range(5)]
    odd = [(300, None), (301, ""), (302, " \n "), (303, "x " * 5000), (304, "y x " * 2000), (305, rows[9][1]), (305, rows[9][1]), (None, rows[17][1]), (None, None), (306, "one two"), (1, "another text of a known id " + " ".join(words(rng, 70)))]
    return rows, where, clean, odd


def test_planted_passages(spark):
    rows, where, clean, odd = planted()
    got = P.repeated_passages(frame(spark, rows + clean + odd)).collect()
    cover, refs = {}, {}
    for r in got:
        cover.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["start_word"] + r["n_words"]))
        refs.setdefault(r["doc_id"], set()).add(r["ref_doc_id"])
        assert r["matched"] >= 0.8 * max(r["n_words"], r["ref_n_words"])
    for i, (s, e, first) in where.items():
        if i == first:
            assert i not in cover  # the first occurrence stays
        else:
            assert len(cover[i] & set(range(s, e))) >= 0.9 * (e - s) and len(cover[i] - set(range(s - 2, e + 2))) == 0, i
            assert all(first <= r < i for r in refs[i])
    assert not {i for i, _ in clean} & set(cover)
    assert {300, 301, 302, 306}.isdisjoint(cover) and 305 in cover and None in cover


def test_cut(spark):
    rows, where, clean, odd = planted()
    source = dict(rows + clean)
    out = P.cut_repeats(frame(spark, rows + clean + odd), size_col="n_chars")
    assert out.dtypes == frame(spark, []).dtypes
    got = out.collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["uid"] == "clash"}
    assert 305 not in by  # nothing was left of these copies
    for i, t in clean:
        assert by[i]["text"] == t
    for i, (s, e, first) in where.items():
        if i == first:
            assert by[i]["text"] == source[i]
        elif i in by and i != 1:
            left = by[i]["text"].split()
            assert len(left) <= len(source[i].split()) - 0.9 * (e - s) and by[i]["n_chars"] == len(by[i]["text"])
    assert by[300]["text"] is None and by[301]["text"] == ""
    assert P.cut_repeats(frame(spark, [])).count() == 0 and P.repeated_passages(frame(spark, [])).count() == 0


def test_seeds_cover_equal_runs():
    rng = np.random.default_rng(0)
    run = rng.integers(0, 2**63, P.K + P.W - 1).astype(np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64), run, rng.integers(0, 2**63, 30).astype(np.uint64)]) for _ in "ab")
        assert set(P.seeds(a)[0]) & set(P.seeds(b)[0])


def brute_chain(segments):
    best = {}
    for i in sorted(range(len(segments)), key=lambda i: segments[i]):
        x, y, n = segments[i]
        best[i] = n + max(
            [0.0] + [best[j] - P.GAP_COST * (x - a - m + y - b - m) for j, (a, b, m) in enumerate(segments) if j in best and a + m <= x and b + m <= y]
        )
    return max(best.values())


def test_chain_is_best(monkeypatch):
    monkeypatch.setattr(P, "MOST_GAP", 10**9)
    rng = random.Random(1)
    for _ in range(60):
        segments = sorted({(rng.randrange(200), rng.randrange(200), rng.randrange(8, 30)) for _ in range(rng.randrange(2, 25))})
        score = 0.0
        own = P.chain(segments)
        assert sorted(s for c in own for s in c) == segments
        for c in own[:1]:
            score = c[0][2] + sum(q[2] - P.GAP_COST * (q[0] - p[0] - p[2] + q[1] - p[1] - p[2]) for p, q in zip(c, c[1:], strict=False))
        assert abs(score - brute_chain(segments)) < 1e-9


def test_runs_beside_each_other(spark):
    """Two exact runs with different words between: each counts by itself where the two together are too unlike."""
    rng = random.Random(7)
    rows, want = [], {}
    for k, (n, gap, m) in enumerate([(60, 25, 30), (55, 28, 30), (57, 24, 24), (53, 35, 60), (30, 25, 60), (60, 40, 60)] * 10):
        one, two = words(rng, n), words(rng, m)
        for copy in (0, 1):
            rows.append((2 * k + copy, " ".join(words(rng, 30) + one + words(rng, gap) + two + words(rng, 30))))
        want[2 * k + 1] = {w for s, size in ((30, n), (30 + n + gap, m)) if size >= 50 for w in range(s, s + size)}
    cover = {}
    for r in P.repeated_passages(frame(spark, rows)).collect():
        cover.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["start_word"] + r["n_words"]))
    assert cover == want


def test_runs_of_one_segment():
    """Seeds on one diagonal are one segment, whose equal runs count by themselves too."""
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**32, 200).astype(np.uint32)
    b = a.copy()
    for s, e in ((60, 75), (85, 100), (110, 125)):
        b[s:e] += 1
    assert P.alike(a[:135], b[:135], [(0, 0, 135)], 20, 0.8) == [(0, 60, 0, 60, 60)]


def test_first_holder_of_a_part(spark):
    """A passage that an earlier document holds in part is found in the later documents that hold all of it."""
    rng = random.Random(11)
    rows, whole = [], []
    for k, (n, part) in enumerate([(52, 49), (55, 45), (60, 48), (50, 46)] * 25):
        passage = words(rng, n)
        for copy in range(3):
            own = passage[:part] if copy == 0 else passage
            rows.append((3 * k + copy, " ".join(words(rng, 30) + own + words(rng, 30))))
        whole.append((3 * k + 2, 30, 30 + n))
    cover = {}
    for r in P.repeated_passages(frame(spark, rows)).collect():
        cover.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["start_word"] + r["n_words"]))
    assert cover == {i: set(range(s, e)) for i, s, e in whole}


def test_cut_words():
    assert P.cut_words(" a b\nc  d\te ", [(1, 3)]) == " a d\te "
    assert P.cut_words("é b", [(0, 5)]) == "" and P.cut_words("a b", [(1, 2)]) == "a "
    assert P.merged([(0, 30), (31, 60), (100, 120)], 50) == [(0, 60)]


def test_query(spark):
    rows = queries.QUERIES["op10_repeated_passages"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["ref_doc_id"] < r["doc_id"] for r in rows)
