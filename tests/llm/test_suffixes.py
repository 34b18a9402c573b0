"""Suffix arrays next to sorted(), and removed bytes next to a table of all strings."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgertone.llm import suffixes
from ledgertone.llm.queries import QUERIES


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200) | st.text("ab", max_size=200).map(str.encode))
def test_suffix_array(text):
    x = np.frombuffer(text, np.uint8)
    depth = 24
    got = suffixes.suffix_array(x, depth)
    padded = text + bytes(depth)
    assert sorted(got.tolist()) == list(range(len(text)))
    prefixes = [padded[i : i + depth] for i in got]
    assert prefixes == sorted(prefixes)
    common = suffixes.common_prefixes(x, got, depth)
    for k in range(1, len(got)):
        a, b = prefixes[k - 1], prefixes[k]
        assert common[k] == next((i for i in range(depth) if a[i] != b[i]), depth)


def plain(rows, least=50):
    """(id, n_bytes, spans, kept) of (id, text) rows, from the smallest id of every string."""
    lowest = {}
    for i, t in rows:
        t = (t or "").encode()
        for s in range(len(t) - least + 1) if i is not None else ():
            lowest[t[s : s + least]] = min(i, lowest.get(t[s : s + least], i))
    out = []
    for i, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - least + 1) if i is not None else ():
            if lowest[t[s : s + least]] < i:
                gone[s : s + least] = True
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0))
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((i, len(t), tuple(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), kept))
    return sorted(out, key=str)


def removed(spark, rows):
    df = spark.createDataFrame([(t, i, "x", 0) for i, t in rows], "text string, doc_id int, block string, id int")
    got = suffixes.without_repeats(df.repartition(3)).collect()
    return sorted(((r.doc_id, r.n_bytes, tuple(tuple(s) for s in r.spans), bytes(r.kept)) for r in got), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdéf") for _ in range(r.randint(1, 9))) for _ in range(300)]
    words = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared = [words(r.randint(6, 60)) for _ in range(6)]
    line = words(12)[:63]
    rows = []
    for _ in range(n):
        parts = [words(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            parts += [s[r.randint(0, 20) : len(s) - r.randint(0, 20)], words(r.randint(0, 10))]
        if r.random() < 0.4:
            parts += [line, words(2)]
        rows.append((r.randint(0, n), " ".join(parts)))
    rows += [(n + 1, rows[0][1]), (n + 2, None), (n + 3, ""), (None, rows[1][1]), (n + 4, "z" * 300), (n + 5, "z" * 120), (n + 6, rows[2][1][:50]), rows[3]]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_plain(spark, monkeypatch, small):
    """Whole, and with blocks, slices, buckets and thresholds so small that every way is taken (workers fork the settings by closure)."""
    rows = corpus(5, 120)
    if small:
        for name, value in (("BLOCK", 3000), ("ENTRIES", 100)):
            monkeypatch.setattr(suffixes, name, value)
    assert removed(spark, rows) == plain(rows)


@pytest.mark.parametrize(("multi", "hot", "array", "size"), [(32, 8192, 1 << 20, 1 << 20), (2, 3, 500, 256), (1, 1, 1, 128), (3, 10**6, 2000, 4096)])
def test_steps_in_process(monkeypatch, multi, hot, array, size):
    """The same steps called one after the other, with thresholds that deal pieces in every way."""
    for name, value in (("MULTI", multi), ("HOT", hot), ("ARRAY", array), ("SLICE", size)):
        monkeypatch.setattr(suffixes, name, value)
    rows = corpus(6, 150)
    blocks = {k: pa.table({"seq": pa.array(range(len(rows[k::4])), pa.int32()), "id": pa.array([i for i, _ in rows[k::4]], pa.int64()), "text": pa.array([t for _, t in rows[k::4]])}) for k in range(4)}
    n, key = 7, lambda k: (pa.scalar(k),)
    entries = pa.concat_tables([suffixes._entries(n, 50)(key(k), t) for k, t in blocks.items()])
    of = lambda t, c, v: t.filter(pa.compute.equal(t.column(c), v))
    answers = pa.concat_tables([suffixes._answers(of(entries, "bucket", b)) for b in set(entries.column("bucket").to_pylist())])
    found = pa.concat_tables([suffixes._found(n, 50)(key(k), t, of(answers, "block", k)) for k, t in blocks.items()])
    known = found.filter(found.column("bucket").is_null()).select(["block", "ranges"])
    ranges = pa.concat_tables([known, *[suffixes._compared(50)(of(found, "bucket", b)) for b in range(n)]])
    got = []
    for k, t in blocks.items():
        for r in suffixes._cut(key(k), t, of(ranges, "block", k)).to_pylist():
            got.append((r["id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), r["kept"]))
    assert sorted(got, key=str) == plain(rows)


def test_odd_tables(spark):
    assert removed(spark, []) == []
    assert removed(spark, [(None, "a" * 60), (None, "a" * 60), (1, None)]) == plain([(None, "a" * 60), (None, "a" * 60), (1, None)])
    long = " ".join(f"w{i * i % 9973}" for i in range(60000))
    rows = [(2, long), (1, long[1000:200000]), (3, long[150000:150049]), (4, long[150000:150050])]
    assert removed(spark, rows) == plain(rows)


def test_query_against_plain(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in plain(docs))
    got = sorted(tuple(r) for r in QUERIES["op13_suffix_dedup"](spark, sf).collect())
    assert got == want and any(r[2] for r in got)
