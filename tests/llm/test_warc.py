"""Archives: round trips, magic inside payloads, any split size."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgertone.llm import queries, warc

SF = "/root/testdata/sf0.001"
INNER = "x" * 90 + "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [
    (1, "http://a/", "<p>" + "a" * 200), (2, "http://b/", "<p>" + "a" * 200), (3, None, None), (4, "http://c d\n/", ""),
    (5, "http://WARC/1.0/", "short"), (6, "u", "short"), (7, "u", INNER), (8, "u", INNER + "WARC/1.0\r\n"), (9, "u", "WARC/1.WARC/1.0\r\n"),
    (None, "u", "<p>" + "a" * 200), (0, "u", "é😀" * 60), (10, "u", "é😀" * 60), (10, "u", "é😀" * 60), (0, "u", "é😀" * 60), (11, "u", "\r\n\r\n" * 50),
    (12, "u", "b" * 100), (13, "u", "b" * 100), (14, "u", "b" * 99), (15, "u", "b" * 99), (16, "u", INNER),
]
SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.IntegerType()), T.StructField("n", T.IntegerType())])


def expected(rows):
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = h in first and i != first[h]
        out.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", str(first[h]) if again else "None"))
    return sorted(out)


def number(text):
    return str(None if text in (None, "<urn:page:null>") else int(text[len("<urn:page:") : -1]))


@pytest.mark.parametrize("split", ["150", "128m"])
def test_round_trip(spark, tmp_path, split):
    pages = spark.createDataFrame([(*r, 1, 2) for r in ROWS], SCHEMA).repartition(3)
    path = str(tmp_path / "w")
    warc.write_archive(pages, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.read_archive(spark, path)
        rows = sorted((number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in got.collect())
        assert rows == expected(ROWS)
        stored = {hashlib.sha256(bytes(r["payload"])).hexdigest() for r in warc.payloads(spark, path).collect()}
        assert stored == {r[2] for r in expected(ROWS)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    sizes = spark.createDataFrame([(f"file:{p}", p.stat().st_size) for p in (tmp_path / "w").glob("part-*")], "file string, size long")
    sizes = sizes.withColumn("file", F.regexp_replace("file", "^file:/*", "/"))
    ends = got.withColumn("file", F.regexp_replace("file", "^file:/*", "/"))
    assert warc.broken_files(ends, sizes).count() == 0
    assert warc.broken_files(ends.where("offset > 0 and false"), sizes).count() == sizes.count()


def test_empty_table(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


def test_garbage_is_no_record(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "x.warc").write_bytes(b"no record WARC/1.0\r\nContent-Length: zz\r\n\r\nWARC/1.")
    assert warc.read_archive(spark, str(tmp_path / "g")).count() == 0


def test_query_matches_sql(spark):
    from oracle import compare, connect

    assert compare(queries.QUERIES["op8_warc"](spark, SF), connect(SF), queries.ORACLES["op8_warc"]) is None
    assert duckdb.sql(f"select count(*) from '{SF}/pages.parquet'").fetchall()[0][0] > 0
