"""Bulk find and replace, tag renames and applying the result."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import build_id
from .claims import settle_ids
from .history import diff_op
from ..session import cut_lineage
from .validate import with_row_errors


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def replace_text(c: Column, find: str, repl: str, mode: str = "contains", case_sensitive: bool = False) -> Column:
    """One text after a replacement. Regular expressions use Java's dialect, groups as $1."""
    flags = "" if case_sensitive else "(?iu)"
    if mode == "regex":
        try:
            re.compile(find)
        except re.error:
            return c
        return F.regexp_replace(c, flags + find, re.sub(r"\\(\d)", r"$\1", repl))
    if mode == "exact":
        same = c == find if case_sensitive else F.lower(c) == find.lower()
        return F.when(same, F.lit(repl)).otherwise(c)
    if case_sensitive:
        return F.replace(c, F.lit(find), F.lit(repl))
    quoted = "".join("\\" + ch if not ch.isalnum() and ch.isascii() else ch for ch in find)
    return F.regexp_replace(c, flags + quoted, _literal(repl))


def find_replace(df: DataFrame, field: str, find: str, repl: str, mode: str = "contains",
                 case_sensitive: bool = False, key: str = "row_id") -> DataFrame:
    """Rows that would change: key, old, new. List fields are edited element by element."""
    if not find.strip():
        return df.select(key, F.col(field).alias("old"), F.col(field).alias("new")).where(F.lit(False))
    if dict(df.dtypes)[field].startswith("array"):
        old = F.col(field)
        new = F.transform(old, lambda x: replace_text(x, find, repl, mode, case_sensitive))
    else:
        old = F.coalesce(F.col(field).cast("string"), F.lit(""))
        new = replace_text(old, find, repl, mode, case_sensitive)
    return df.select(key, old.alias("old"), new.alias("new")).where(~F.col("old").eqNullSafe(F.col("new")))


def rename_tag(df: DataFrame, find: str, repl: str = "", field: str = "tags", key: str = "row_id",
               approved=S.APPROVED_TAGS) -> DataFrame:
    """Rows whose tag list changes: a whole-tag rename, or a removal when ``repl`` is empty."""
    if repl and approved is not None and repl not in approved:
        raise ValueError(f"not an approved tag: {repl}")
    old = F.col(field)
    if repl:
        new = F.array_distinct(F.transform(old, lambda t: F.when(t == find, F.lit(repl)).otherwise(t)))
    else:
        new = F.array_remove(old, find)
    return (
        df.where(F.array_contains(old, find))
        .select(key, old.alias("old"), new.alias("new"))
        .where(F.col("old") != F.col("new"))
    )


def apply_edits(catalog: DataFrame, field: str, edits: DataFrame, op_id: int = 1, last_year: int | None = None):
    """(catalog, change_log, problems): edits(row_id, new) written where the entry stays valid."""
    fields = [c for c in catalog.columns if c != "row_id"]
    after = catalog.join(edits.select("row_id", F.col("new").alias("_new")), "row_id")
    after = after.withColumn("_old_id", F.col("id")).withColumn(field, F.col("_new").cast(catalog.schema[field].dataType))
    if field in ("brand", "model", "variant"):
        rebuilt = build_id("brand", "model", "variant")
        after = after.withColumn("id", F.when(rebuilt != "", rebuilt).otherwise(F.col("id")))
    judged = cut_lineage(with_row_errors(after, last_year, "_errors"))
    valid = judged.where("size(_errors) = 0")
    settled = settle_ids(
        valid.select(F.col("row_id").alias("seq"), F.col("_old_id").alias("old_id"), F.col("id").alias("new_id")),
        catalog.where("id <> ''").select("id"),
    )
    taken = settled.where(~F.col("accepted")).select(F.col("seq").alias("row_id"), "new_id")
    kept = valid.join(taken.select("row_id"), "row_id", "left_anti").select("row_id", *fields)
    problems = judged.where("size(_errors) > 0").select("row_id", F.get("_errors", F.lit(0)).alias("reason"))
    problems = problems.unionByName(
        taken.select("row_id", F.concat(F.lit("id is used by another entry: "), F.col("new_id")).alias("reason"))
    )
    rest = catalog.join(kept.select("row_id"), "row_id", "left_anti")
    log = diff_op(catalog.join(kept.select("row_id"), "row_id", "left_semi"), kept, "row_id", op_id)
    return rest.unionByName(kept), log, problems
