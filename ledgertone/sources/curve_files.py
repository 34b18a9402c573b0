"""Measurement files: inventory, bulk reading and writing.

Files are read line by line, so one large file splits into many tasks; the order of lines
within a file is (offset of the split, running id), which a retry reproduces.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.curves import leading_numbers, loose_pair, split_fields
from ..functions.text import is_curve_file, strip
from ..session import cut_lineage, spread

# Accepted ranges of the strict and the lenient reading.
STRICT_FREQ, STRICT_SPL = (1.0, 200_000.0), (-200.0, 200.0)
LENIENT_FREQ, LENIENT_SPL = (2.0, 100_000.0), (-120.0, 140.0)
KHZ_SUSPECT_MAX = 100.0
MIN_POINTS = 2


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modified of every .txt below ``root``; contents are never read.

    Paths are relative to the folder that holds ``data``.
    """
    clean = root.rstrip("/")
    base = clean[: -len("/data")] if clean.lower().endswith("/data") else clean
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(
        clean if clean != base else clean + "/data"
    )
    full = F.regexp_replace(F.regexp_replace(F.col("path"), "^file:/+", "/"), "/+", "/")
    relative = F.substr(full, F.lit(len(base) + 2))
    return listed.where(F.lower("path").endswith(".txt")).select(
        F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))).alias("path"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """path, line_order, line for text files; ``line_order`` sorts lines within a file."""
    return with_line_order(spark.read.text(paths))


def with_line_order(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")
        ).alias("line_order"),
        F.translate(F.make_valid_utf8("value"), chr(0xFEFF), "").alias("line"),
    )


def _whole(c):
    return c == F.floor(c)


def _reading(start: int):
    """One reading of a line's fields, from the given column on."""
    n = leading_numbers(F.col("fields"), start)
    freq, spl, phase = n["freq"], n["spl"], n["phase"]
    dated = (
        (F.size("fields") >= 3) & phase.isNotNull() & _whole(freq) & _whole(spl) & _whole(phase)
        & freq.between(1900, 2100) & spl.between(1, 12) & phase.between(1, 31)
    )
    usable = freq.between(*STRICT_FREQ) & spl.between(*STRICT_SPL) & ~F.isnan(freq) & ~F.isnan(spl)
    finite_phase = F.when(~F.isnan(phase) & (F.abs(phase) < float("inf")), phase)
    return F.struct(
        F.lit(start).alias("start"), freq.alias("freq"), spl.alias("spl"), finite_phase.alias("phase"),
        F.coalesce(dated, F.lit(False)).alias("dated"), F.coalesce(usable, F.lit(False)).alias("usable"),
        F.coalesce(freq < STRICT_FREQ[0], F.lit(False)).alias("low"),
    )


def points_from_lines(lines: DataFrame):
    """(points, curve_errors) by the strict rules, from (path, line_order, line).

    One scan: fields are split once, both column readings are exploded from them, and one aggregate per (path,
    reading, frequency) is saved, from which the facts about files and the points come. The first line of a frequency
    wins by a minimum. Lines without a usable number are counted too, so files without data are seen.
    """
    fields = spread(lines).select("path", "line_order", split_fields("line").alias("fields"))
    both = fields.select("path", "line_order", F.explode(F.array(_reading(0), _reading(1))).alias("r")).select("path", "line_order", "r.*")
    value = F.struct("spl", "phase")
    good = F.col("usable")
    by_freq = both.groupBy("path", "start", F.when(good, F.col("freq")).alias("freq")).agg(
        F.min_by(value, F.when(good, F.col("line_order"))).alias("first_any"),
        F.min_by(F.when(good & ~F.col("dated"), value), F.when(good & ~F.col("dated"), F.col("line_order"))).alias("first_plain"),
        F.count_if("low").alias("n_low"),
    )
    by_freq = cut_lineage(by_freq)
    outside = F.col("first_any").isNotNull() & ((F.col("freq") < 1900) | (F.col("freq") > 2100))
    main = F.col("start") == 0
    plain = F.col("first_plain").isNotNull()
    any_ = F.col("freq").isNotNull()
    facts = by_freq.groupBy("path").agg(
        F.max(F.when(main, outside)).alias("has_sweep"),
        F.sum(F.when(main, F.col("n_low"))).alias("n_low"),
        *[
            agg.alias(f"{name}_{start}_{kind}")
            for start in (0, 1)
            for kind, there in (("plain", plain), ("any", any_))
            for name, agg in (
                ("n", F.count_if((F.col("start") == start) & there & any_)),
                ("lo", F.min(F.when((F.col("start") == start) & there, F.col("freq")))),
                ("hi", F.max(F.when((F.col("start") == start) & there, F.col("freq")))),
                ("int", F.min(F.when((F.col("start") == start) & there & any_, _whole(F.col("freq"))))),
            )
        ],
    )

    def fact(name, start):
        return F.when(F.col("has_sweep"), F.col(f"{name}_{start}_plain")).otherwise(F.col(f"{name}_{start}_any"))

    # distinct whole frequencies from 1 up to their own count are a row-number column
    index_column = (
        (fact("n", 0) >= 3) & fact("int", 0) & (fact("lo", 0) == 1.0) & (fact("hi", 0) - fact("lo", 0) + 1 == fact("n", 0))
    )
    facts = facts.withColumn("use", F.when(index_column & (F.col("n_1_plain") >= fact("n", 0)), 1).otherwise(0))
    n = F.coalesce(F.when(F.col("use") == 1, F.col("n_1_plain")).otherwise(fact("n", 0)), F.lit(0))
    hi = F.when(F.col("use") == 1, F.col("hi_1_plain")).otherwise(fact("hi", 0))
    reason = F.when(n < MIN_POINTS, F.lit("no usable data rows")).when(
        (hi <= KHZ_SUSPECT_MAX) & (F.col("n_low") > 0), F.lit("frequency column looks like kHz")
    )
    facts = facts.select("path", "has_sweep", "use", reason.alias("reason"))

    chosen = by_freq.join(facts.where("reason IS NULL"), "path").where("freq IS NOT NULL AND start = use")
    v = F.when(F.col("has_sweep") | (F.col("use") == 1), F.col("first_plain")).otherwise(F.col("first_any"))
    points = chosen.withColumn("v", v).where("v IS NOT NULL").select(
        F.col("path").alias("curve_id"), "freq", F.col("v.spl").alias("spl"), F.col("v.phase").alias("phase")
    )
    return points, facts.where("reason IS NOT NULL").select("path", "reason")


def lenient_points_from_lines(lines: DataFrame):
    """(points, curve_errors) by the lenient rules: comments skipped, prose accepted, no dedupe."""
    t = strip("line")
    body = spread(lines).withColumn("line", t).where((t != "") & ~t.startswith("#") & ~t.startswith("//"))
    n = leading_numbers(split_fields("line"))
    strict = F.struct(n["freq"].alias("freq"), n["spl"].alias("spl"))
    pair = F.when(n["freq"].isNotNull(), strict).otherwise(loose_pair("line"))
    rows = body.select("path", pair.alias("p")).where(
        F.col("p.freq").between(*LENIENT_FREQ) & F.col("p.spl").between(*LENIENT_SPL)
        & ~F.isnan("p.freq") & ~F.isnan("p.spl")
    )
    points = rows.select(
        F.col("path").alias("curve_id"), "p.freq", "p.spl", F.lit(None).cast("double").alias("phase")
    )
    empty = lines.select("path").distinct().join(rows.select("path"), "path", "left_anti")
    return points, empty.withColumn("reason", F.lit("no usable data rows"))


def ingest_curves(spark: SparkSession, paths, mode: str = "strict"):
    """(points, curve_errors) of files; points are curve_id, freq, spl, phase."""
    lines = read_lines(spark, paths)
    return points_from_lines(lines) if mode == "strict" else lenient_points_from_lines(lines)


def queue_paths(df: DataFrame, path: str = "path", fold_case: bool = False):
    """(queued, n_ignored): curve files once each, and how many other rows there were."""
    ok = is_curve_file(path)
    key = F.lower(path) if fold_case else F.col(path)
    queued = df.where(ok).groupBy(key.alias("_k")).agg(F.min(path).alias(path)).drop("_k")
    return queued, df.agg(F.count_if(~ok).alias("n_ignored"))


def write_curves(points: DataFrame, path: str, format: str = "parquet") -> None:
    """Points sorted by curve: parquet, or ``text`` with curve, frequency and level per line.

    Both write as many files as there are tasks; a reader of text tells curves apart by the first column.
    """
    dealt = points.repartitionByRange("curve_id", "freq").sortWithinPartitions("curve_id", "freq")
    if format != "text":
        dealt.write.mode("overwrite").parquet(path)
        return
    line = F.concat_ws("\t", F.col("curve_id").cast("string"), F.format_string("%.6f\t%.3f", "freq", "spl"))
    dealt.select(line.alias("value")).write.mode("overwrite").text(path)


def write_audit_report(issues: DataFrame, path: str) -> None:
    """One line per issue: severity, category, entry, message, and whether it is ignored."""
    ignored = F.when(F.col("waived"), F.lit(" [ignored]")).otherwise(F.lit("")) if "waived" in issues.columns else F.lit("")
    line = F.concat(
        F.lit("["), F.upper("severity"), F.lit("] "), F.col("category"), F.lit(" :: "), F.col("entry_id"),
        F.lit(" :: "), F.col("message"), ignored,
    )
    issues.select(line.alias("value")).write.mode("overwrite").text(path)


__all__ = [n for n in dir() if not n.startswith("_") and n != "F"]
