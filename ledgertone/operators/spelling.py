"""Majority spellings."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import brand_fold, strip


def _counts(df: DataFrame, column: str, fold: Column | None, clean=None) -> DataFrame:
    """fold, spelling, n. Raw values are counted first, so cleaning and folding see each of them once."""
    if fold is not None:
        counted = df.select(fold.alias("fold"), F.col(column).alias("raw")).groupBy("fold", "raw").agg(F.count("*").alias("n"))
    else:
        counted = df.groupBy(F.col(column).alias("raw")).agg(F.count("*").alias("n"))
    spelled = strip(clean(F.col("raw")) if clean else "raw").alias("spelling")
    counted = counted.select(*(["fold"] if fold is not None else []), spelled, "n")
    if fold is None:
        counted = counted.groupBy("spelling").agg(F.sum("n").alias("n")).select(brand_fold("spelling").alias("fold"), "spelling", "n")
    else:
        counted = counted.groupBy("fold", "spelling").agg(F.sum("n").alias("n"))
    return counted.where((F.col("fold") != "") & (F.col("spelling") != ""))


def _rank_key() -> Column:
    return F.struct((-F.col("n")).alias("neg"), F.col("spelling").alias("spelling"))


def canonical_spelling(df: DataFrame, column: str, fold: Column | None = None, clean=None) -> DataFrame:
    """fold, canonical, n, n_spellings: the most frequent spelling, ties alphabetical.

    ``clean`` is applied to distinct values. Occurrences are counted per spelling first, so a frequent fold reaches the second
    aggregation as a handful of rows.
    """
    return (
        _counts(df, column, fold, clean)
        .groupBy("fold")
        .agg(F.min(_rank_key()).alias("best"), F.count("*").alias("n_spellings"))
        .select("fold", F.col("best.spelling").alias("canonical"), (-F.col("best.neg")).alias("n"), "n_spellings")
    )


def spelling_fixes(df: DataFrame, column: str, fold: Column | None = None, clean=None) -> DataFrame:
    """spelling, canonical, summary, has_majority for every spelling that should change."""
    ranked = (
        _counts(df, column, fold, clean)
        .groupBy("fold")
        .agg(F.array_sort(F.collect_list(_rank_key())).alias("ranked"))
        .where(F.size("ranked") > 1)
    )
    shown = F.transform(
        "ranked", lambda r: F.concat(F.lit("'"), r["spelling"], F.lit("' ("), (-r["neg"]).cast("string"), F.lit(")"))
    )
    first, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    return ranked.select(
        "fold",
        first["spelling"].alias("canonical"),
        F.array_join(shown, ", ").alias("summary"),
        (first["neg"] < second["neg"]).alias("has_majority"),
        F.explode(F.expr("slice(ranked, 2, size(ranked))")).alias("other"),
    ).select("fold", F.col("other.spelling").alias("spelling"), "canonical", "summary", "has_majority")


def rows_to_respell(df: DataFrame, column: str, fold: Column | None = None) -> DataFrame:
    """The input rows whose spelling is not the canonical one, with the fix."""
    fixes = spelling_fixes(df, column, fold).withColumnRenamed("spelling", "_spelling")
    return df.join(fixes, strip(column) == F.col("_spelling")).drop("_spelling")
