"""Merging a duplicate pair into one entry."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.numbers import coerce_int
from ..functions.tags import expected_tier, tag_list
from ..functions.text import build_id, strip
from .history import diff_op
from ..session import cut_lineage
from .validate import with_row_errors

PICKED = tuple(f for f in S.FIELDS if f not in ("id", "files"))


def first_pairs(pairs: DataFrame):
    """(now, later): pairs that are the first for both of their rows, and the others.

    Merging deletes a row, so a row can be in one merge per pass; later pairs are reported.
    """
    ranked = pairs.withColumn("_p", F.struct("key_a", "key_b"))
    ends = ranked.select("_p", F.explode(F.array("key_a", "key_b")).alias("row"))
    first = ends.groupBy("row").agg(F.min("_p").alias("_first"))
    marked = (
        ranked.join(first.select(F.col("row").alias("key_a"), F.col("_first").alias("_fa")), "key_a")
        .join(first.select(F.col("row").alias("key_b"), F.col("_first").alias("_fb")), "key_b")
        .withColumn("_ok", (F.col("_p") == F.col("_fa")) & (F.col("_p") == F.col("_fb")))
    )
    cols = pairs.columns
    return marked.where("_ok").select(*cols), marked.where("NOT _ok").select(*cols)


def merged_entries(catalog: DataFrame, pairs: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """key_a, key_b and the merged entry of each pair; ``overrides`` forces a side per field."""
    fields = [c for c in catalog.columns if c != "row_id"]
    entry = F.struct(*fields)
    a = catalog.select(F.col("row_id").alias("key_a"), entry.alias("a"))
    b = catalog.select(F.col("row_id").alias("key_b"), entry.alias("b"))
    both = pairs.select("key_a", "key_b").where("key_a <> key_b").join(a, "key_a").join(b, "key_b")

    def wins_b(f):
        side = (overrides or {}).get(f)
        if side:
            return F.lit(side == "b")
        va, vb = F.col("a")[f], F.col("b")[f]
        if f == "tags":
            return F.size(tag_list(va)) < F.size(tag_list(vb))
        if f in S.INT_FIELDS:
            return (coerce_int(va) == 0) & (coerce_int(vb) != 0)
        return (strip(va) == "") & (strip(vb) != "")

    out = both.select(
        "key_a", "key_b", "a", "b",
        *[F.when(wins_b(f), F.col("b")[f]).otherwise(F.col("a")[f]).alias(f) for f in PICKED],
        F.array_union(tag_list(F.col("a")["files"]), tag_list(F.col("b")["files"])).alias("files"),
    )
    plain = F.filter(tag_list("tags"), lambda t: ~t.isin(*S.TAGS_TIER))
    out = out.withColumn("tags", F.array_append(plain, expected_tier("price_usd")))
    out = out.withColumn("id", build_id("brand", "model", "variant"))
    return out.select("key_a", "key_b", *[F.col(f) for f in fields])


def merge_pair(catalog: DataFrame, pairs: DataFrame, overrides: dict[str, str] | None = None, op_id: int = 1,
               last_year: int | None = None):
    """(catalog, change_log, rejected): A keeps its place with the winning fields, B goes."""
    fields = [c for c in catalog.columns if c != "row_id"]
    now, later = first_pairs(pairs.where("key_a <> key_b").select("key_a", "key_b").distinct())
    merged = merged_entries(catalog, now, overrides)
    judged = cut_lineage(with_row_errors(merged, last_year, "_errors"))

    # the new id may belong to A or B only, and to one merge of this pass
    owners = catalog.where("id <> ''").select("id", F.col("row_id").alias("_owner"))
    taken = (
        judged.select("key_a", "key_b", "id")
        .join(owners, "id")
        .where("_owner <> key_a AND _owner <> key_b")
        .select("key_a")
        .distinct()
        .withColumn("_taken", F.lit(True))
    )
    first = judged.where("size(_errors) = 0").groupBy("id").agg(F.min("key_a").alias("_first"))
    judged = judged.join(taken, "key_a", "left").join(first, "id", "left")
    reason = (
        F.when(F.size("_errors") > 0, F.get("_errors", F.lit(0)))
        .when(F.col("_taken"), F.concat(F.lit("id is used by another entry: "), F.col("id")))
        .when(F.col("_first") != F.col("key_a"), F.lit("another merge takes this id"))
    )
    judged = judged.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select(F.col("key_a").alias("row_id"), "key_b", *fields)

    gone = good.select(F.col("key_b").alias("row_id"))
    touched = good.select("row_id").unionByName(gone)
    kept = good.select("row_id", *fields)
    rest = catalog.join(touched, "row_id", "left_anti")
    log = diff_op(catalog.join(touched, "row_id", "left_semi"), kept, "row_id", op_id)
    rejected = judged.where("reason IS NOT NULL").select("key_a", "key_b", "reason").unionByName(
        later.select("key_a", "key_b", F.lit("a row of this pair is in an earlier merge").alias("reason"))
    )
    return rest.unionByName(kept), log, rejected
