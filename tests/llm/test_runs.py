"""Periodic runs next to a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgertone.llm import runs
from ledgertone.llm.queries import QUERIES


def plain(words):
    """(start, length, period): every period tried from the smallest, stretches extended one by one."""
    out, n, taken = [], len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if length >= max(6, 4 * q) and (s, length) not in taken:
                taken.add((s, length))
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def got(words):
    codes = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x = np.array([codes[w] for w in words], np.int64)
    return [tuple(r) for r in runs.find_runs(x, len(x)).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120))
def test_few_letters(words):
    assert got(words) == plain(words)


@pytest.mark.parametrize("seed", range(60))
def test_long_periods(seed):
    """Runs of all periods up to 300, of little more than four repetitions, next to and inside each other."""
    r = random.Random(seed)
    words = []
    for _ in range(r.randint(1, 6)):
        p = r.choice([1, 2, 5, 8, 9, 15, 16, 17, 31, 32, 33, 64, 65, 100, 127, 128, 129, 255, 300])
        letters = r.choice([2, 3, 50, 10**9])
        root = [r.randrange(letters) for _ in range(p)]
        if p >= 9 and r.random() < 0.4:  # a root with a run of its own
            root = (root[: p // 9] * 18)[:p]
        length = int(4 * p + r.choice([-1, 0, 1, p // 2, 3 * p]))
        words += [root[i % p] for i in range(length)] + [r.randrange(10**9) for _ in range(r.randint(0, 5))]
    assert got(words) == plain(words)


def test_rows_of_every_kind(spark):
    texts = [None, "", " \t", "a", "a a a a a", "a a a a a a", "x y " * 9, "日本 語 " * 5 + "end", " ".join(f"w{i % 11}" for i in range(5000)), "a b " * 40000]
    rows = [(i, t, "n", i) for i, t in enumerate(texts)] + [(1, "", "n", 1), (None, "a a a a a a a", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_runs int")
    out = sorted(runs.periodic_runs(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words))
    assert len(out) == len(rows)
    for r, text in zip([x for x in out if x.doc_id is not None], [texts[0], "", "", *texts[2:]], strict=True):
        words = (text or "").encode().split()
        want = plain(words) if len(words) < 10000 else [(0, 80000, 2)]
        assert [tuple(x) for x in r.runs] == want and r.n_runs == len(want) and r.n_words == len(words)
    assert out[-1].collapsed == "a" and out[0].start is None and out[0].collapsed == ""
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_query_against_plain(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words, h = (d.text or "").encode().split(), zlib.crc32(str(d.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain(words) if n < 3000 else got(words)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        want[d.doc_id] = (
            len(found), *top, None if top[0] is None else 1000 * top[1] // top[2],
            hashlib.sha256("".join("%d,%d,%d\n" % f for f in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
        )
    rows = {r[0]: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert rows == want and any(v[0] for v in want.values())


def test_scales_read_only_what_repeats(monkeypatch):
    """Every scale went over all words; now only over stretches whose words come again, so prose costs none of them."""
    r, read = random.Random(5), []
    marked = runs._marked
    monkeypatch.setattr(runs, "_marked", lambda x, w: read.append(len(x)) or marked(x, w))
    prose = [r.randrange(3000) for _ in range(40000)]
    assert got(prose) == plain_at(prose, []) and sum(read) == 0
    root = [r.randrange(3000) for _ in range(50)]
    words = prose[:20000] + root * 6 + prose[20000:]
    assert got(words) == plain_at(words, [(20000, 300, 50)]) and sum(read) < 3000


def plain_at(words, expected):
    """The runs as expected, after a look at each that it is one; periods to 8 are searched."""
    for s, n, q in expected:
        assert all(words[i] == words[i + q] for i in range(s, s + n - q)) and n >= 4 * q
        assert words[s - 1] != words[s - 1 + q] and words[s + n] != words[s + n - q]
    short = [(s, n, q) for q in range(1, 9) for s, n in stretches(words, q) if n >= max(6, 4 * q)]
    return sorted(short + expected, key=lambda r: (r[0], r[2]))


def stretches(words, q):
    i = 0
    while i + q < len(words):
        s = i
        while i + q < len(words) and words[i] == words[i + q]:
            i += 1
        yield s, i - s + q
        i += 1


BLANKS = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  ", " \r\n"]
#: Words of up to and over eight bytes, with equal beginnings, and with what other splitters take for blanks.
WORDS = ["a", "b", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaaaaaab", "\0", "\0\0", "a\0", "日本語", "é", "\x85", "\xa0", "\x1c", " x", "𝄞𝄞", "𝄞𝄞𝄞", "x" * 500]


@pytest.mark.parametrize("seed", range(30))
def test_texts_together(seed):
    """Rows of many texts in one call, with runs at their ends, copies of texts and all kinds of blanks and words."""
    r, texts = random.Random(seed), []
    for _ in range(r.randint(1, 40)):
        words = []
        for _ in range(r.randint(0, 4)):
            root = [r.choice(WORDS) if r.random() < 0.6 else str(r.randrange(10**6)) for _ in range(r.choice([1, 2, 3, 8, 9, 10, 16, 17, 40]))]
            words += [root[i % len(root)] for i in range(int(len(root) * r.choice([1, 3, 4, 4.3, 6])))]
        text = "".join(w + (r.choice(BLANKS) if r.random() < 0.2 else " ") for w in words)
        texts += [r.choice(["", " ", "\n"]) + (text if r.random() < 0.5 else text.rstrip(" \t\n\x0b\x0c\r"))] * r.choice([1, 1, 1, 4])
        texts += [None] * (r.random() < 0.1)
    rows = list(zip(*[c.to_pylist() for c in runs._rows(texts)], strict=True))
    assert len(rows) == len(texts)
    for text, (n_words, n_runs, *best, listed, digest, collapsed) in zip(texts, rows, strict=True):
        words = (text or "").encode().split()
        want = plain(words)
        gone = {i for s, m, q in want for i in range(s + q, s + m)}
        assert (n_words, n_runs) == (len(words), len(want)) and [tuple(x.values()) for x in listed] == want
        assert best == list(min(want, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None)))
        assert digest == hashlib.sha256("".join("%d,%d,%d\n" % f for f in want).encode()).hexdigest()
        assert collapsed.encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_kept_columns(spark):
    df = spark.createDataFrame([(1, "a b " * 5, 2.5), (None, None, None)], "`doc id` bigint, text string, x double")
    whole, some = runs.periodic_runs(df), runs.periodic_runs(df, keep=["x", "doc id"])
    assert some.columns == ["x", "doc id", *whole.columns[3:]]
    assert sorted(map(repr, some.collect())) == sorted(map(repr, whole.select(some.columns).collect()))
