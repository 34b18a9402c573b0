"""Working with issue tables: waivers, filters, counts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("error", "warning", "info")


def waiver_key() -> Column:
    return F.concat_ws("|", "subject", "category", "code")


def severity_rank(c="severity") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "error", 0).when(c == "warning", 1).when(c == "info", 2).otherwise(9)


def waive(issues: DataFrame, waivers: DataFrame, invert: bool = False) -> DataFrame:
    """Live issues, or with ``invert`` the waived ones. Errors are never waived."""
    keyed = issues.withColumn("waiver_key", waiver_key())
    known = waivers.select("waiver_key").distinct()
    if invert:
        return keyed.where("severity <> 'error'").join(known, "waiver_key", "left_semi").select(*issues.columns)
    hidden = known.withColumn("_hide", F.lit(True))
    live = keyed.join(hidden, "waiver_key", "left").where("_hide IS NULL OR severity = 'error'")
    return live.select(*issues.columns)


def add_waivers(waivers: DataFrame, issues: DataFrame):
    """(waivers, refused): keys of the issues added, except error issues, which are refused."""
    new = issues.where("severity <> 'error'").select(waiver_key().alias("waiver_key"))
    return waivers.select("waiver_key").unionByName(new).distinct(), issues.where("severity = 'error'")


def remove_waivers(waivers: DataFrame, issues: DataFrame) -> DataFrame:
    return waivers.join(issues.select(waiver_key().alias("waiver_key")), "waiver_key", "left_anti")


def filter_issues(issues: DataFrame, category: str | None = None, confidence: str | None = None,
                  waivers: DataFrame | None = None, ignored: bool = False) -> DataFrame:
    """One category, a confidence (duplicates only), and either the live or the waived side."""
    if category:
        issues = issues.where(F.col("category") == category)
    if confidence:
        issues = issues.where((F.col("category") != "Possible Duplicate") | (F.col("confidence") == confidence))
    return issues if waivers is None else waive(issues, waivers, invert=ignored)


def mark_waived(issues: DataFrame, waivers: DataFrame) -> DataFrame:
    known = waivers.select("waiver_key", F.lit(True).alias("_w")).distinct()
    joined = issues.withColumn("waiver_key", waiver_key()).join(known, "waiver_key", "left")
    waived = F.col("_w").isNotNull() & (F.col("severity") != "error")
    return joined.withColumn("waived", waived).select(*issues.columns, "waived")


def issue_summary(issues: DataFrame, waivers: DataFrame | None = None) -> DataFrame:
    """Per category: live, errors, warnings, infos, ignored, fixable."""
    df = issues.withColumn("waived", F.lit(False)) if waivers is None else mark_waived(issues, waivers)
    live = ~F.col("waived")
    return df.groupBy("category", "code").agg(
        F.count_if(live).alias("live"),
        F.count_if(live & (F.col("severity") == "error")).alias("errors"),
        F.count_if(live & (F.col("severity") == "warning")).alias("warnings"),
        F.count_if(live & (F.col("severity") == "info")).alias("infos"),
        F.count_if(F.col("waived")).alias("ignored"),
        F.count_if(live & F.col("fix").isNotNull()).alias("fixable"),
    )


def issues_by_entry(issues: DataFrame, waivers: DataFrame | None = None) -> DataFrame:
    """Per entry: number of issues, ignored, fixable, the worst severity and its message."""
    df = issues.withColumn("waived", F.lit(False)) if waivers is None else mark_waived(issues, waivers)
    df = df.where("row_id IS NOT NULL")
    worst = F.struct(severity_rank().alias("rank"), F.col("fix_order").alias("o"), F.col("message").alias("m"))
    return df.groupBy("entry_id", "row_id").agg(
        F.count("*").alias("n_issues"),
        F.count_if("waived").alias("n_ignored"),
        F.count_if(F.col("fix").isNotNull()).alias("n_fixable"),
        F.min(worst).alias("_w"),
    ).select(
        "entry_id", "row_id", "n_issues", "n_ignored", "n_fixable",
        F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("_w.rank") + 1).alias("worst"),
        F.col("_w.m").alias("message"),
    )


def sort_issues(issues: DataFrame, by: str = "severity", descending: bool = False) -> DataFrame:
    key = severity_rank() if by == "severity" else F.col("fix").isNotNull() if by == "fixable" else F.col(by)
    return issues.orderBy(key.desc() if descending else key.asc(), "row_id", "fix_order")
