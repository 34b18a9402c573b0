"""Suggestions, counts, labels and unique names."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.numbers import coerce_int
from ..functions.search import search
from ..functions.text import strip
from ..session import cut_lineage


def catalog_order() -> list[Column]:
    """Brand, model, variant without case; ties by row."""
    return [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("brand", "model", "variant")]


def suggest_values(df: DataFrame, field: str, text: str = "", prefer: tuple[str, str] | None = None) -> DataFrame:
    """Distinct values containing ``text``, sorted without case.

    ``prefer=(column, value)`` keeps to matching rows (a brand) and falls back to all values
    when there are none.
    """
    hits = df.where((F.col(field) != "") & F.lower(field).contains(text.lower()))
    if prefer:
        column, value = prefer
        near = F.lower(column) == value.strip().lower()
        hits = hits.groupBy(F.col(field).alias("value")).agg(F.max(near).alias("near"))
        any_near = hits.agg(F.max("near")).scalar()
        values = hits.where(F.col("near") | ~any_near).select("value")
    else:
        values = hits.select(F.col(field).alias("value")).distinct()
    return values.orderBy(F.lower("value"), "value")


def brand_counts(df: DataFrame, query: str = "", brand: str = "brand", columns: dict[str, str] | None = None) -> DataFrame:
    """Entries per brand, optionally after a search, brands in case-insensitive order."""
    if query:
        df = df.where(search(query, columns))
    return df.groupBy(F.col(brand).alias("brand")).agg(F.count("*").alias("n")).orderBy(F.lower("brand"), "brand")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """``unique_name``: later rows of a name (without case) become ``NAME (2)``, ``(3)``...

    Rows are dealt by (name, order) ranges and numbered within each range; the ranges' totals are added up. A name
    that very many rows bear spans several ranges, so no task sorts a whole group, whatever the order column holds.
    """
    fold = F.lower(F.col(name))
    dealt = df.withColumn("_fold", fold).repartitionByRange("_fold", order).withColumn("_slice", F.spark_partition_id())
    rows = cut_lineage(dealt)
    sizes = rows.groupBy("_fold", "_slice").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy("_fold").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select("_fold", "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = rows.join(offsets, ["_fold", "_slice"]).withColumn(
        "_i", F.col("_before") + F.row_number().over(Window.partitionBy("_fold", "_slice").orderBy(order))
    )
    stem, dot = F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", ""), F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))
    fresh = F.when(F.col("_i") == 1, F.concat(stem, dot)).otherwise(
        F.concat(stem, F.lit(" ("), F.col("_i").cast("string"), F.lit(")"), dot)
    )
    return numbered.withColumn("unique_name", fresh).select(*df.columns, "unique_name")


def missing_spec_gate(df: DataFrame) -> DataFrame:
    """``needs_confirm`` for wired entries without impedance or sensitivity."""
    wired = ~strip("form_factor").isin(S.TWS, S.WIRELESS_OVER_EAR)
    empty = (coerce_int("impedance") == 0) | (coerce_int("sensitivity") == 0)
    return df.withColumn("needs_confirm", wired & empty)
