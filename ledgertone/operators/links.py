"""Catalog links against the files that exist, and links against each other."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import normalize_path, strip


def links(catalog: DataFrame, key: str = "row_id", array_col: str = "files") -> DataFrame:
    """One row per linked path: key, pos, raw, path (normalized), fold (lower case)."""
    return (
        catalog.select(key, F.posexplode(array_col).alias("pos", "raw"))
        .withColumn("path", normalize_path("raw"))
        .withColumn("fold", F.lower("path"))
    )


def disk_index(files: DataFrame, path: str = "path") -> DataFrame:
    """fold, disk: one on-disk spelling per case-folded path, the last in order."""
    return files.groupBy(F.lower(path).alias("fold")).agg(F.max(path).alias("disk"))


def missing_files(catalog: DataFrame, files: DataFrame, key: str = "row_id") -> DataFrame:
    """Links that no file matches, not even in another case: one row per (key, path)."""
    wanted = links(catalog, key).where("path <> ''").select(key, "path", "fold").distinct()
    return wanted.join(disk_index(files).select("fold"), "fold", "left_anti").select(key, "path")


def unlinked_files(catalog: DataFrame, files: DataFrame, key: str = "row_id") -> DataFrame:
    """Files no entry links (exact spelling)."""
    used = links(catalog, key).select("path")
    return files.select("path").distinct().join(used, "path", "left_anti")


def unlinked_report(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """path, n, first: a row per file that no entry links, and one with their number and first path."""
    rest = unlinked_files(catalog, files)
    none = F.lit(None).cast("string")
    return rest.select("path", F.lit(1).cast("bigint").alias("n"), none.alias("first")).unionByName(
        rest.agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 0").select(none.alias("path"), "n", "first")
    )


def repair_path_case(catalog: DataFrame, files: DataFrame, key: str = "row_id") -> DataFrame:
    """Links whose spelling differs from disk only in case: key, pos, old, new."""
    raw = catalog.select(key, F.posexplode("files").alias("pos", "old")).withColumn("fold", F.lower("old"))
    return (
        raw.join(disk_index(files), "fold")
        .where(F.col("old") != F.col("disk"))
        .select(key, "pos", "old", F.col("disk").alias("new"))
    )


def strip_phantom_files(catalog: DataFrame, files: DataFrame, key: str = "row_id") -> DataFrame:
    """key, kept, dropped: links that exist, in disk spelling and once each, and the rest.

    Exact spellings stay as they are; the grouping is per row, whose list is one cell.
    """
    exact = files.select(F.col("path").alias("exact")).distinct()
    found = (
        links(catalog, key)
        .join(exact, F.col("path") == F.col("exact"), "left")
        .join(disk_index(files), "fold", "left")
        .withColumn("use", F.when(strip("raw") != "", F.coalesce("exact", "disk")))
    )
    per_row = found.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "raw", "use"))).alias("items")
    )
    kept = F.filter(F.transform("items", lambda x: x["use"]), lambda x: x.isNotNull())
    folds = F.transform(kept, lambda x: F.lower(x))
    return per_row.select(
        key,
        F.filter(kept, lambda x, i: F.array_position(folds, F.lower(x)) == i + 1).alias("kept"),
        F.transform(F.filter("items", lambda x: x["use"].isNull()), lambda x: x["raw"]).alias("dropped"),
    )


def link_counts(df: DataFrame, key: str, array_col: str = "files", fold: bool = False) -> DataFrame:
    """Paths in two or more links: path, n_links, n_spellings, first and last key."""
    ends = (F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))
    # raw values are counted first, so each of them is normalized once
    raw = df.select(F.col(key).alias("k"), F.explode(array_col).alias("raw")).groupBy("raw")
    raw = raw.agg(F.count("*").alias("n"), F.min("k").alias("first_key"), F.max("k").alias("last_key"))
    spelled = raw.withColumn("path", normalize_path("raw")).where("path <> ''")
    if fold:
        spelled = spelled.groupBy("path").agg(F.sum("n").alias("n"), *ends).withColumn("fold", F.lower("path"))
    counted = spelled.groupBy("fold" if fold else "path")
    return counted.agg(F.sum("n").alias("n_links"), F.count("*").alias("n_spellings"), *ends).where("n_links > 1")


def available_files(files: DataFrame, catalog: DataFrame, text: str = "") -> DataFrame:
    """The files not linked yet that contain ``text``, in path order."""
    rest = unlinked_files(catalog, files)
    if text:
        rest = rest.where(F.lower("path").contains(text.lower()))
    return rest.orderBy("path")


def duplicate_ids(df: DataFrame, keys, order: str) -> DataFrame:
    """Rows that repeat an earlier row's key, with the first row's order value.

    The first row per key is a plain minimum joined back, so a key held by a third of all
    rows is never sorted in one task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    first = df.groupBy(*keys).agg(F.min(order).alias("first_row"), F.count("*").alias("_n")).where("_n > 1")
    return df.join(first.drop("_n"), keys).where(F.col(order) > F.col("first_row"))


def shared_files(linked: DataFrame, key: str = "row_id", path: str = "path"):
    """(groups, members): the paths that several keys link, and their keys.

    groups: path, n (keys), n_pairs, first_key. members: path, key, first_key. Every path has this one form whatever
    its size, so the result grows with the links and not with the pairs they make.
    """
    rows = linked.select(F.col(path).alias("path"), F.col(key).alias("key")).distinct()
    groups = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("key").alias("first_key")).where("n > 1")
    groups = groups.select("path", "n", F.expr("n * (n - 1) div 2").alias("n_pairs"), "first_key")
    return groups, rows.join(groups.select("path", "first_key"), "path")
