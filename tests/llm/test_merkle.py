"""Merkle manifests next to a tree built in plain loops."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ledgertone.llm import merkle
from ledgertone.llm.queries import QUERIES


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """(root, per node the siblings [(left, right), ...] from the bottom up)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(paths):
            s = at[k] // 16 * 16
            run = nodes[s : s + 16]
            p.append(("".join(run[: at[k] - s]), "".join(run[at[k] - s + 1 :])))
        nodes = [H(*nodes[s : s + 16]) for s in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], paths


def plain(rows, changed):
    """rows (doc_id, source, lang, n_chars, text) -> (doc_id, leaf, subroot, root, proof, folded, verified)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], H(*map(field, r)), H(*map(field, changed(r)))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        made[s] = tree([x[1] for x in groups[s]])
    root, tops = tree([made[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (i, leaf, seen), path in zip(groups[s], made[s][1], strict=True):
            whole, h = path + top, seen
            for left, right in whole:
                h = H(left, h, right)
            out.append((i, leaf, made[s][0], root, H(*[x for p in whole for x in p]), h, h == root))
    return sorted(out, key=str)


def lower(r):
    up = r[4] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
    return (*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)})) if up else r


def got(df):
    seen = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    head = ["doc_id", "source", "lang", "n_chars"]
    leaves = df.select("doc_id", "source", F.lit("x").alias("path"), F.lit(1).alias("g"), F.lit(2).alias("i"), merkle.row_digest(*head, "text").alias("leaf"), merkle.row_digest(*head, seen).alias("seen"))
    done = merkle.manifest(leaves).withColumn("folded", merkle.fold("seen"))
    return sorted((tuple(r) for r in done.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(), "folded", F.expr("folded = root")).collect()), key=str)


SCHEMA = "doc_id bigint, source string, lang string, n_chars int, text string"


@pytest.mark.parametrize("block", [256, 16])
def test_against_plain(spark, monkeypatch, block):
    """A hot source over several windows, lone leaves, null and empty values, ties, repeated rows, over 16 sources."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = [(i, "hot", "en", i % 7, f"Text {i} É") for i in range(700)]
    rows += [(1000 + i, f"s{i % 19}", None, None, "A" * i) for i in range(60)]
    rows += [(5000, None, "de", 1, None), (5001, "", "de", 1, ""), (5002, "ß", "x", 0, "lone"), (5003, "hot ", "x", 0, "b")]
    rows += [(None, "hot", "en", 1, "no id"), (3, "hot", "en", 9, "TIE"), (3, "hot", "en", 9, "TIE"), (5002, "Z", "1:a", 0, "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df.repartition(5)) == plain(rows, lower)


def test_small_tables(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    one = [(7, "a", "b", 1, "lone")]
    assert got(spark.createDataFrame(one, SCHEMA)) == plain(one, lower)
    assert got(spark.createDataFrame(one, SCHEMA))[0][4] == H()


def test_query_against_plain(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    out = sorted((tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, sf).collect()), key=str)
    assert out == plain(rows, lower) and {r[6] for r in out} == {True, False}
