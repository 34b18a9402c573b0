"""Learned filters: held-out accuracy, agreement with plain loops, odd rows."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from ledgertone.llm import quality_model, queries, rules, toxicity
from ledgertone.llm.common import rows_where

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("Score", T.StringType()), T.StructField("kept", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("n_words", T.IntegerType())])
ODD = [(1, ""), (2, None), (None, "null id"), (3, "same"), (3, "same"), (4, " \n "), (5, "word " * 80_000), (6, "日本語 😀 \x1c")]


def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 7, 8, 9) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def known(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    return docs, {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def balanced(pairs):
    return np.mean([np.mean([p == y for p, y in pairs if y == label]) for label in (0, 1)])


def test_quality_held_out(spark, known):
    docs, labels = known
    rows = queries.QUERIES["op3_quality"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert balanced([(r["predicted"], labels[r["doc_id"]]["quality"]) for r in rows if r["held_out"] and r["doc_id"] in labels]) > 0.9


def test_toxicity_query(spark, known):
    docs, _ = known
    rows = queries.QUERIES["op9_toxicity"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def texts(rng, n, toxic, spelling=lambda w: w):
    own = np.random.default_rng(99)
    plain = ["".join(own.choice(list("abcdefghilmnorstu"), own.integers(2, 9))) for _ in range(600)]
    bad = [spelling(w) for w in ("grumblewort", "snarkfiend", "vilemouth", "dreckhead", "spitegob")]
    out = []
    for _ in range(n):
        words = list(rng.choice(plain, rng.integers(20, 400)))
        for _ in range(4 * toxic):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad)))
        out.append(" ".join(words))
    return out


def test_toxicity_learns_and_knows_misspellings():
    rng = np.random.default_rng(4)
    clean, rude = texts(rng, 600, 0), texts(rng, 300, 1)
    lean, bias = toxicity.fit(clean + rude, [0] * 600 + [1] * 300).flat()
    new = np.random.default_rng(4)
    fresh = texts(new, 100, 0)
    assert (toxicity.score_texts(fresh, lean, bias) < 0.5).mean() > 0.95
    assert (toxicity.score_texts(texts(new, 100, 1), lean, bias) >= 0.5).mean() > 0.95
    wrong = texts(new, 100, 1, lambda w: w[:3] + w[4:])
    assert (toxicity.score_texts(wrong, lean, bias) >= 0.5).mean() > 0.5
    same = toxicity.score_texts([rude[0], "", None], lean, bias)
    assert same[1] == same[2] < 0.5 <= same[0]


def test_bag_odds_by_hand():
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 8, 9, 16, 17, 40, 41):
        codes, odds = rng.integers(0, 12, n), rng.normal(size=12)
        got = toxicity.bag_odds(odds, codes, 0.25)
        starts = range(0, max(1, n - toxicity.BAG // 2), toxicity.BAG // 2)
        want = [odds[list(set(codes[s : s + toxicity.BAG].tolist()))].sum() / toxicity.BAG + 0.25 for s in starts]
        assert np.allclose(got, want)


def test_models_without_both_labels(spark):
    for fit in (toxicity.fit, quality_model.fit):
        assert fit([], []) and fit(["a b"], [1]) and fit(["a b"], [0])
    lean, bias = toxicity.fit(["a b"], [1]).flat()
    assert toxicity.score_texts(["x", None], lean, bias).min() > 0.9
    model = quality_model.fit(["a b"], [0])
    assert quality_model.score(odd(spark), model).where("score > 0.1").count() == 0


def test_scores_of_odd_rows(spark, known):
    docs, labels = known
    some = [(docs[i], r) for i, r in labels.items()]
    model = quality_model.fit([t for t, _ in some], [r["quality"] for _, r in some])
    own = quality_model.Sizes(model.good, model.bad)
    got = quality_model.score(odd(spark), model)
    assert got.columns == ["doc_id", "text", "kept", "row", "n_words", "score", "predicted"]
    want = sorted((str(i), round(float(model.scores(np.array(own.features(t)))[0]), 9)) for i, t in ODD)
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in got.collect()) == want
    assert quality_model.score(odd(spark).limit(0), model).count() == 0
    tox = toxicity.fit(["you are vile", "good day to you"], [1, 0])
    assert toxicity.score(odd(spark), tox).count() == len(ODD) and toxicity.score(odd(spark).limit(0), tox).count() == 0


def plain_facts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_base_facts(spark, known):
    docs, _ = known
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in queries.QUERIES["op7_quality_rules"](spark, SF).collect():
        f = plain_facts(docs[r["doc_id"]])
        assert tuple(r[n] for n in names) == f
        assert r["base_failed"] == (f[0] < 50 or 100 * f[4] > 50 * f[0]) and not (r["kept"] and r["base_failed"])
    got = rules.judge(odd(spark))
    assert got.columns[:4] == ["doc_id", "text", "Score", "row"]
    assert sorted(str(tuple(r[n] for n in names)) for r in got.collect()) == sorted(str(plain_facts(t)) for _, t in ODD)
    assert rules.judge(odd(spark).limit(0)).count() == 0
    long = "a b c d " * 3 + "x"
    assert rules.facts_of(long)[4] == plain_facts(long)[4] == 12


def plain_em(patterns):
    """The same estimate, text by text instead of by counts of patterns."""
    p = [0.2 if -1 in v else 0.95 for v in patterns]
    for _ in range(200):
        votes = [[{-1: 6.0, 0: 2.0, 1: 2.0}, {-1: 0.5, 0: 1.5, 1: 8.0}] for _ in rules.RULES]
        for v, q in zip(patterns, p, strict=True):
            for j, x in enumerate(v):
                votes[j][0][x] += 1 - q
                votes[j][1][x] += q
        good = min(0.99, max(0.5, (sum(p) + 9) / (len(p) + 10)))
        new = []
        for v in patterns:
            a, b = good, 1 - good
            for j, x in enumerate(v):
                a *= votes[j][1][x] / sum(votes[j][1].values())
                b *= votes[j][0][x] / sum(votes[j][0].values())
            new.append(a / (a + b))
        done = max(abs(x - y) for x, y in zip(p, new, strict=True)) < 1e-9
        p = p if done else new
        if done:
            break
    return new


def test_verdict_against_plain_em(spark, known):
    docs, labels = known
    rows = rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    want = plain_em([tuple(r["votes"]) for r in rows])
    assert all(abs(r["posterior"] - w) < 1e-5 for r, w in zip(rows, want, strict=True))
    assert all(r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5) for r in rows)
    fit = [(int(r["kept"]), labels[r["doc_id"]]["quality"]) for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    assert balanced(fit) > 0.95


def test_rows_where_keeps_columns(spark):
    out = rows_where(odd(spark), "text", lambda d, t: rules.judge(d, rules.fit_patterns(np.empty((0, 8)), np.empty(0)), t), "NOT kept")
    assert out.dtypes == odd(spark).dtypes and out.count() >= 7


def test_toxicity_fit_is_small_in_memory():
    """A tenth of the longest sample allowed takes a tenth of 400 MB at most, texts not counted."""
    import tracemalloc

    from ledgertone.llm import toxicity

    def pairs():
        r = random.Random(1)
        words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 11))) for _ in range(60000)]
        chars, k = 0, 0
        while chars < toxicity.FIT_CHARS // 10:
            text = " ".join(r.choices(words, k=800)) + " vile" * (k % 2)
            chars, k = chars + len(text), k + 1
            yield text, k % 2

    tracemalloc.start()
    toxicity.fit_pairs(pairs(), rounds=4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 + 60000 * 100
