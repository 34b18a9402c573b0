"""Round trips and packing against the tokenizers library, text by text."""

import hashlib
import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ledgertone.llm import bpe, packing, queries

SF = "/root/testdata/sf0.001"
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    (1, ""), (2, None), (None, "null id"), (3, "same"), (3, "same"), (4, "  \n\t  "), (5, "Été déjà vú ÉCOLE 'S don't 12a3"),
    (6, "x<|endoftext|>y <|startoftext|>"), (7, "a \n\n b c 　 d  "), (8, "long " * 60_000), (9, "z" * 5000),
    (10, "tabs\tand\r\nlines\x0bv\x0cf \x1c x"), (11, "日本語 テスト 한국어 😀😀 ‍"), (12, " lead"), (13, "trail \n "), (14, "a  b   c\n\n\nd"),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("block", T.IntegerType())])


def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in ODD], SCHEMA)


def test_encode_as_library(spark):
    tok = Tokenizer.from_file(WORDS)
    want = []
    for i, t in ODD:
        e = tok.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), tuple(e), tok.decode(e, skip_special_tokens=False)))
    got = bpe.decode(bpe.encode(odd(spark), WORDS), WORDS)
    assert got.columns == ["doc_id", "ids", "decoded"]
    assert sorted((str(r[0]), tuple(r[1]), r[2]) for r in got.collect()) == sorted(want)
    once = bpe.encode(odd(spark).coalesce(1), WORDS, stable=True)
    assert sorted((str(r[0]), tuple(r[1])) for r in once.collect()) == sorted(w[:2] for w in want)
    empty = bpe.decode(bpe.encode(odd(spark).limit(0), WORDS), WORDS)
    assert empty.count() == 0


def test_decode_nulls_and_other_decoder(spark):
    ids = Tokenizer.from_file(BYTES).encode("Été, a  b\n", add_special_tokens=False).ids
    rows = spark.createDataFrame([(1, ids), (2, None), (3, [])], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in bpe.decode(rows, BYTES).collect()}
    assert got == {1: "Été, a  b\n", 2: None, 3: ""}


def test_query_hashes(spark):
    tok = Tokenizer.from_file(WORDS)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_bpe_round_trip"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        e = tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(e)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(e, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("most", [4, 2048])
def test_packing(spark, most):
    tok = Tokenizer.from_file(BYTES)
    rows = packing.pack_documents(odd(spark), BYTES, most).collect()
    want = sorted((str(i), tuple(tok.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in ODD)
    by, got = {}, []
    for r in sorted(rows, key=lambda r: r["sequence_id"]):
        if r["start"] == 0:
            by = {"id": str(r["doc_id"]), "ids": [], "n": r["doc_tokens"]}
            got.append(by)
        assert (by["id"], len(by["ids"]), by["n"]) == (str(r["doc_id"]), r["start"], r["doc_tokens"])
        n = r["length"]
        assert n == len(r["ids"]) == r["bucket"] <= most and n & (n - 1) == 0 and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{n}I", *r["ids"]))
        by["ids"] += r["ids"]
    assert sorted((b["id"], tuple(b["ids"])) for b in got) == want
    assert all(len(b["ids"]) == b["n"] for b in got)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert packing.pack_documents(odd(spark).limit(0), BYTES).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd(spark), BYTES, 100)


def test_pack_query(spark, tmp_path):
    tok = Tokenizer.from_file(BYTES)
    total = sum(
        len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        for r in spark.read.parquet(f"{SF}/documents.parquet").collect()
    )
    rows = queries.QUERIES["op2_pack_documents"](spark, SF)
    assert sum(r["length"] for r in rows.collect()) == total
    packing.write_buckets(rows, str(tmp_path / "b"))
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "b")).select("bucket").distinct().collect()} <= {2**k for k in range(12)}


def test_runs_encoded_together(monkeypatch):
    """Runs are encoded many at a time and the frequent ones once, with the ids of whole texts."""
    monkeypatch.setattr(packing, "MEMORY_RUNS", 60)
    tok, given = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            given.extend(texts)
            return tok.encode_batch_fast(texts, **kw)

        def __getattr__(self, name):
            return getattr(tok, name)

    runs = packing._Runs(public_tokenizers.path("byte_bpe_50k.json"))
    runs.tokens = Counted()
    for k in range(40):
        often = " ".join(f"often{i}" for i in range(20))
        texts = [f"{often} {often}\nrare{k} caf\u00e9{k} it's", f" led {k} ", "", "a  b\n\nc\t d\r\n", "x\x0by z", "a\0 b", "\u3000 q\u00a0r", "end\n", "\n", "<|endoftext|> z"]
        assert [list(x) for x in runs.ids(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(" often7" in t for t in given) == 1 and len(given) < 1200


def test_runs_end_with_their_task():
    """Nothing in the table of runs refers to itself: a worker would hold it through its next tasks."""
    import gc

    runs = packing._Runs(public_tokenizers.path("byte_bpe_50k.json"))
    runs.ids(["some words here", "and some more words"])
    gc.collect()
    gc.disable()
    try:
        del runs
        assert gc.collect() == 0
    finally:
        gc.enable()
