"""The operators with production parameters over their whole tables, as registered queries."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertone.plans.base import table

from . import bpe, jaccard, lattice, licenses, merkle, packing, passages, quality_model, rules, runs, suffixes, toxicity, warc
from .common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    vocab = public_tokenizers.path("word_bpe_49k.json")
    done = bpe.decode(bpe.encode(table(spark, sf, "documents"), vocab, stable=True), vocab)
    return done.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op2_pack_documents(spark: SparkSession, sf: str) -> DataFrame:
    vocab = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf, "documents"), vocab, most=2048, end_id=1).drop("ids")


@query
def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = held_out("doc_id", 4, 2)
    model = quality_model.fit_on(docs.where(~out), labels.where(~out))
    return quality_model.score(docs, model, threshold=0.7).select("doc_id", out.alias("held_out"), "score", "predicted")


@query
def op4_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.linked_components(table(spark, sf, "documents"), words=4, percent=85)


@query
def op5_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf, "embeddings"), threshold=0.93).select(
        "vec_id", "n_links", F.col("component_id").cast("bigint").alias("component_id"), "kept"
    )


@query
def op6_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.find_notices(table(spark, sf, "documents"))


@query
def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


@query
def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(.*)>', 1) AS BIGINT)")
    return warc.round_trip(table(spark, sf, "pages")).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


ORACLES["op8_warc"] = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again
      FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
                   min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first FROM pages))
"""


@query
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = held_out("doc_id", 5, 0)
    model = toxicity.fit_on(docs.where(~out), labels.where(~out))
    return toxicity.score(docs, model, threshold=0.5).select("doc_id", out.alias("held_out"), "score", "predicted")


@query
def op10_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf, "documents"), min_words=50)


@query
def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    # the copy to be caught: text with A-Z in lower case in a fifth of the documents
    changed = F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", ascii_uppercase, ascii_lowercase)
    ).otherwise(F.col("text"))
    fields = ["doc_id", "source", "lang", "n_chars"]
    leaves = docs.select("doc_id", "source", merkle.row_digest(*fields, "text").alias("leaf"), merkle.row_digest(*fields, changed).alias("seen"))
    done = merkle.manifest(leaves).withColumn("folded_root", merkle.fold("seen"))
    return done.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


ORACLES["op11_merkle_manifest"] = """
WITH RECURSIVE
rows AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS g,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         text,
         CASE WHEN xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
           lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 5 = 0
           THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n
  FROM (SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
               sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS seen FROM rows)),
lower_levels AS (
  SELECT 0 AS level, g, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, g, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM lower_levels WHERE n > 1 GROUP BY level, g, i // 16),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM lower_levels WHERE n = 1),
upper_levels AS (
  SELECT 0 AS level, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM upper_levels WHERE n > 1 GROUP BY level, i // 16),
-- siblings of every node that has a parent
lower_sides AS (
  SELECT a.level, a.g, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM lower_levels a JOIN lower_levels b ON a.level = b.level AND a.g = b.g AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY ALL),
upper_sides AS (
  SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM upper_levels a JOIN upper_levels b ON a.level = b.level AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY ALL),
climb AS (
  SELECT g, i AS k, 0 AS level, i, seen AS h, '' AS sibs FROM leaves
  UNION ALL
  SELECT c.g, c.k, c.level + 1, c.i // 16, sha256(s.l || c.h || s.r), c.sibs || s.l || s.r
  FROM climb c JOIN lower_sides s ON c.level = s.level AND c.g = s.g AND c.i = s.i),
climbed AS (SELECT g, k, arg_max(h, level) AS h, arg_max(sibs, level) AS sibs FROM climb GROUP BY g, k),
climb_top AS (
  SELECT c.g, c.k, 0 AS level, s.i, c.h, c.sibs FROM climbed c JOIN subroots s ON c.g = s.g
  UNION ALL
  SELECT c.g, c.k, c.level + 1, c.i // 16, sha256(s.l || c.h || s.r), c.sibs || s.l || s.r
  FROM climb_top c JOIN upper_sides s ON c.level = s.level AND c.i = s.i),
done AS (SELECT g, k, arg_max(h, level) AS folded_root, arg_max(sibs, level) AS sibs FROM climb_top GROUP BY g, k)
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(d.sibs) AS proof_sha256, d.folded_root, d.folded_root = t.h AS verified
FROM leaves l JOIN done d ON l.g = d.g AND l.i = d.k JOIN subroots s ON l.g = s.g, (SELECT h FROM upper_levels WHERE n = 1) t
"""


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents with a periodic tail in every tenth text (by crc32 of the id), which the query then has to find."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # the words before a, as often as they go in the p words from there on, and the first of those for the rest
    planted = F.expr(
        "concat_ws(' ', slice(words, 1, a), array_repeat(concat_ws(' ', slice(words, a + 1, p)), CAST((size(words) - a) div p AS int)), slice(words, a + 1, (size(words) - a) % p))"
    )
    return (
        docs.withColumn("g", F.floor(h / 10))
        .withColumn("words", F.when((h % 10 == 0) & F.col("text").isNotNull(), words))
        .withColumn("a", F.expr("CASE WHEN size(words) > 0 THEN CAST(g % size(words) AS int) END"))
        .withColumn("p", F.expr("CAST(1 + (size(words) - a) div (3 + g % 8) AS int)"))
        .withColumn("text", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")))
    )


@query
def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = runs.periodic_runs(_with_planted_runs(table(spark, sf, "documents")).select("doc_id", "text"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        "runs_sha256", F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op13_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = suffixes.without_repeats(table(spark, sf, "documents"), least=50)
    return done.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
