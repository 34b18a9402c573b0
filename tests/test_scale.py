"""Costly work per row is dealt over all cores, and what several steps read is made once."""

import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgertone.operators import changes as C
from ledgertone.operators.audit import audit_rows
from ledgertone.operators.facts import with_facts
from ledgertone.operators.links import link_counts
from ledgertone.operators.typos import flagged_tokens, vocab_keys
from ledgertone.plans.catalog_queries import part_catalog
from ledgertone.plans.text_queries import vocabulary
from ledgertone.sources.change_docs import ingest_change_docs
from ledgertone.sources.curve_files import lenient_points_from_lines, points_from_lines


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def reads(df, column: str = "") -> int:
    """How often a plan reads a table, or one whose first column is named."""
    return plan(df).count(f"Relation [{column}")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("tables"))
    parts = [(k, f"hot {n}", f"Brand#{k % 3 + 1}", "SMALL", k % 40 + 1, 900.0 + k) for k, n in enumerate(["bolt", "ring", "nut"] * 30)]
    parts = spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    parts.coalesce(1).write.parquet(f"{sf}/part.parquet")
    day = datetime.datetime(1998, 2, 6)
    orders = [(k, k % 7, "OFP"[k % 3], 10.5 + k, day, "1-URGENT") for k in range(120)]
    orders = spark.createDataFrame(
        orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    )
    orders.coalesce(1).write.parquet(f"{sf}/orders.parquet")
    docs = [(1, "words words wordz", "en"), (2, "words wrods", "de"), (3, None, "de")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{sf}/documents.parquet")
    return sf


def test_rules_and_readers_use_all_cores(spark, tables):
    catalog = part_catalog(spark, tables)
    docs = spark.createDataFrame([(1, '{"id": "a"}')], "doc_id long, text string").coalesce(1)
    lines = spark.createDataFrame([("u", 1, "20 1.5"), ("u", 2, "30 2.5")], "path string, line_order long, line string").coalesce(1)
    changes = C.normalize_brands(spark.createDataFrame([(1, {"brand": "x"})], "change_id long, replace map<string,string>").coalesce(1), catalog)
    found = [audit_rows(catalog), ingest_change_docs(docs)[0], lenient_points_from_lines(lines)[0], points_from_lines(lines)[0], changes]
    assert [("Repartition" in plan(df)) or i == 3 for i, df in enumerate(found)] == [True] * 5
    assert audit_rows(catalog).rdd.getNumPartitions() > 1
    assert sorted(r.freq for r in found[3].collect()) == [20.0, 30.0]


def test_whole_numbers_are_not_read_as_text(spark):
    rows = spark.createDataFrame([(2001, 7), (None, None), (-3, 0)], "year int, price_usd int")
    others = ("brand", "model", "variant", "driver_type", "driver_config", "form_factor", "connector", "impedance", "sensitivity")
    full = rows.withColumns({c: F.lit("1") for c in others} | {c: F.array().cast("array<string>") for c in ("tags", "files")})
    same = ["_year", "_whole"]
    text = full.withColumns({c: F.col(c).cast("string") for c in ("year", "price_usd")})
    assert sorted(map(str, with_facts(full).select(same).collect())) == sorted(map(str, with_facts(text).select(same).collect()))


@pytest.mark.parametrize("name", ["waived_issues", "issues_by_entry"])
def test_issues_are_made_once(spark, tables, name):
    df = entry.queries()[name](spark, tables)
    assert reads(df) > 0 and reads(df, "p_") == 0 and df.count() > 0


def test_undo_redo_saves_its_steps(spark, tables):
    df = entry.queries()["undo_redo"](spark, tables)
    assert reads(df) <= 30
    got = {r.step: r.n for r in df.groupBy("step").agg(F.count("*").alias("n")).collect()}
    after = 120 - 12 + 3
    # keys 1, 31, 61 and 91 leave in the second operation
    assert got == {"undo 2": after, "undo 2 1": 120, "redo 1 2": after - 4}


def test_vocabulary_and_unknown_words_are_counted_once(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    pool = vocabulary(docs)
    assert reads(pool) > 0 and reads(pool, "doc_id") == 0
    few = spark.createDataFrame([("words", 1)], "word string, rank long")
    found = flagged_tokens(docs, "text", few.select("word"), few)
    assert reads(found) > 0 and reads(found, "doc_id") == 0
    assert sorted((r.token, r.n) for r in found.collect()) == [("wordz", 1), ("wrods", 1)]


def test_words_are_told_apart_before_they_are_folded(spark):
    docs = spark.createDataFrame([(1, "Ab ab² AB", "En"), (2, None, "de")], "doc_id long, text string, lang string")
    keys = vocab_keys(docs, ["lang", "text"])
    assert "Aggregate [w#" in plan(keys)
    assert sorted(r.key for r in keys.collect()) == ["ab", "ab ab2 ab", "ab2", "en"]


@pytest.mark.parametrize("fold", [True, False])
def test_links_are_counted_before_they_are_normalized(spark, fold):
    rows = spark.createDataFrame([(1, ["a//b", "a/b", "A/b", "", None]), (2, ["a/b", "x"]), (2, None)], "row_id long, files array<string>")
    counts = link_counts(rows, "row_id", fold=fold)
    assert "Aggregate [raw#" in plan(counts)
    want = ("a/b", 4, 2, 1, 2) if fold else ("a/b", 3, 2, 1, 2)
    assert [tuple(r) for r in counts.collect()] == [want]
