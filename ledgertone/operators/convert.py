"""From measurement files to standard curves: grouping, averaging, naming, linking."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_path, sanitize_filename
from ..session import cut_lineage
from .history import diff_op
from .points import b_on_a, mean_of, mismatch_of, pair_bounds

# What may stand before and after a pair number, before a side, and how far apart a pair may be.
BLANKS = " \t\n\x0b\f\r"
BEFORE_NUMBER, AFTER_NUMBER, BEFORE_SIDE = "_-([", "_-)]" + BLANKS, "_-" + BLANKS
MAX_MISMATCH_DB = 10.0


def stem(path) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def _ending(s: Column) -> tuple[Column, Column]:
    """(key, role) of a name by its last characters; both null without an ending.

    A number 1 or 2 counts behind one or more of its opening marks, whatever closes after it; a side L or R stands
    last, behind one mark or blank.
    """

    def last(c, n=0):
        return F.substr(c, F.length(c) - n, F.lit(1))

    def without(c, n):
        return F.substr(c, F.lit(1), F.greatest(F.length(c) - n, F.lit(0)))

    def one_of(c, marks):
        return (c != "") & F.lit(marks).contains(c)

    closed = F.rtrim(s, F.lit(AFTER_NUMBER))
    numbered = one_of(last(closed), "12") & one_of(last(closed, 1), BEFORE_NUMBER) & (F.length(closed) > 1)
    sided = one_of(last(s), "LRlr") & one_of(last(s, 1), BEFORE_SIDE) & (F.length(s) > 1)
    key = F.when(numbered, F.trim(F.rtrim(without(closed, 1), F.lit(BEFORE_NUMBER)))).when(sided, F.trim(without(s, 2)))
    return key, F.when(numbered, last(closed)).when(sided, F.upper(last(s)))


def pair_members(paths: DataFrame, path: str = "path") -> DataFrame:
    """path, key, role: the group a file name belongs to and its part in it."""
    name = stem(path)
    key, role = _ending(name)
    return paths.select(F.col(path).alias("path"), F.coalesce(key, name).alias("key"), role.alias("role"))


def plan_groups(paths: DataFrame, path: str = "path") -> DataFrame:
    """key, n_sources, averaged, out_name, first_path, second_path.

    A pair has exactly two members with roles 1 and 2, or L and R. The members themselves
    stay rows of ``pair_members``; a plan never collects them.
    """
    plans = pair_members(paths, path).groupBy("key").agg(
        F.count("*").alias("n_sources"),
        F.min("path").alias("first_path"),
        F.max("path").alias("last_path"),
        F.count("role").alias("_roles"),
        F.min("role").alias("_r0"),
        F.max("role").alias("_r1"),
    )
    both = F.concat("_r0", "_r1").isin("12", "LR")
    averaged = (F.col("n_sources") == 2) & (F.col("_roles") == 2) & F.coalesce(both, F.lit(False))
    return plans.select(
        "key",
        "n_sources",
        averaged.alias("averaged"),
        sanitize_filename(F.concat(F.upper("key"), F.lit(".txt"))).alias("out_name"),
        "first_path",
        F.when(F.col("n_sources") == 2, F.col("last_path")).alias("second_path"),
    )


def convert(paths: DataFrame, points: DataFrame, inventory: DataFrame | None = None, slice_of: str | None = None):
    """(points, outcomes): one standard curve per output name and what became of each file.

    A pair that covers a common band and differs by at most 10 dB on average becomes one
    curve; otherwise its members convert alone. The first file of a group takes the planned
    name; further ones take their own and never replace a curve that exists.
    """
    members, plans = pair_members(paths), plan_groups(paths)
    ends = points.groupBy("curve_id").agg(F.count("*").alias("n_points"))
    good = members.join(ends.select(F.col("curve_id").alias("path")), "path", "left_semi")
    unusable = members.join(ends.select(F.col("curve_id").alias("path")), "path", "left_anti").select(
        "key", "path", F.lit(None).cast("string").alias("out_name"), F.lit("SKIPPED").alias("status"),
        F.lit("no usable data rows").alias("reason"),
    )
    per_key = good.groupBy("key").agg(F.count("*").alias("n_good"), F.min("path").alias("lead"))
    plans = plans.join(per_key, "key")

    pairs = plans.where("averaged AND n_good = 2").select("key", "first_path", "second_path", "out_name")
    a = pairs.select("key", F.col("first_path").alias("curve_id")).join(points, "curve_id").select("key", "freq", "spl")
    b = pairs.select("key", F.col("second_path").alias("curve_id")).join(points, "curve_id").select("key", "freq", "spl")
    # interpolated once, read for the mismatch and for the average
    onto = cut_lineage(b_on_a(a, b, "key", slice_of))
    apart = mismatch_of(pair_bounds(a, b, "key"), onto, "key")
    mean = mean_of(onto, "key")
    has_mean = onto.select("key").distinct().withColumn("_mean", F.lit(True))
    judged = cut_lineage(pairs.join(apart, "key").join(has_mean, "key", "left"))
    ok = (F.col("mismatch") <= MAX_MISMATCH_DB) & F.coalesce("_mean", F.lit(False))
    fine = judged.where(ok).select("key", "out_name", "first_path", "second_path")
    averaged = mean.join(fine.select("key", "out_name"), "key").select(F.col("out_name").alias("curve_id"), "freq", "spl")
    demoted = judged.where(~ok).select(
        "key", F.col("first_path").alias("path"), F.lit(None).cast("string").alias("out_name"), F.lit("SKIPPED").alias("status"),
        F.when(F.col("mismatch") > MAX_MISMATCH_DB, F.lit("the pair differs too much")).otherwise(F.lit("no common range"))
        .alias("reason"),
    )
    demoted = demoted.withColumn(
        "reason", F.concat("reason", F.lit("; converting each file separately"))
    )

    alone = good.join(plans.select("key", "out_name", "lead"), "key").join(fine.select("key"), "key", "left_anti")
    is_lead = F.col("path") == F.col("lead")
    own = sanitize_filename(F.concat(F.upper(stem("path")), F.lit(".txt")))
    alone = alone.withColumn("lead_file", is_lead).withColumn(
        "target", F.when(is_lead, F.col("out_name")).otherwise(own)
    )
    alone = cut_lineage(alone)
    taken = plans.select(F.col("out_name").alias("target"))
    if inventory is not None:
        taken = taken.unionByName(inventory.select(F.regexp_extract("path", r"([^/\\]*)$", 1).alias("target")))
    extra = alone.where("NOT lead_file")
    first = extra.groupBy("target").agg(F.min("path").alias("_first"))
    extra = extra.join(first, "target").join(taken.distinct().withColumn("_taken", F.lit(True)), "target", "left")
    clash = F.col("_taken").isNotNull() | (F.col("path") != F.col("_first"))
    written = alone.where("lead_file").select("key", "path", "target").unionByName(
        extra.where(~clash).select("key", "path", "target")
    )
    refused = extra.where(clash).select(
        "key", "path", F.col("target").alias("out_name"), F.lit("SKIPPED").alias("status"),
        F.lit("a curve of this name exists").alias("reason"),
    )
    solo = written.select(F.col("path").alias("curve_id"), "target").join(points, "curve_id").select(
        F.col("target").alias("curve_id"), "freq", F.col("spl").cast("double").alias("spl")
    )
    done = written.select("key", "path", F.col("target").alias("out_name"), F.lit("OK").alias("status"), F.lit("").alias("reason"))
    both = fine.select(
        "key", F.explode(F.array("first_path", "second_path")).alias("path"), "out_name", F.lit("OK").alias("status"),
        F.lit("averaged").alias("reason"),
    )
    outcomes = done.unionByName(both).unionByName(refused).unionByName(demoted).unionByName(unusable)
    return averaged.unionByName(solo), outcomes


def link_files(catalog: DataFrame, links: DataFrame, inventory: DataFrame | None = None, op_id: int = 1):
    """(catalog, change_log): links(id, path, seq) appended to their entries in order of ``seq``, each file once.

    Without ``seq`` paths are in their own order.
    """
    seq = F.col("seq") if "seq" in links.columns else F.lit(0)
    wanted = links.select("id", normalize_path("path").alias("path"), seq.alias("seq")).where("path <> ''")
    if inventory is not None:
        wanted = wanted.join(inventory.select("path").distinct(), "path", "left_semi")
    wanted = wanted.withColumn("fold", F.lower("path")).groupBy("id", "fold").agg(F.min(F.struct("seq", "path")).alias("first"))
    target = catalog.where("id <> ''").groupBy("id").agg(F.min("row_id").alias("row_id"))
    fresh = wanted.join(target, "id").groupBy("row_id").agg(
        F.transform(F.array_sort(F.collect_list("first")), lambda x: x["path"]).alias("_more")
    )
    files = F.coalesce("files", F.array().cast("array<string>"))
    folds = F.transform(files, lambda x: F.lower(x))
    more = F.filter("_more", lambda p: ~F.array_contains(folds, F.lower(p)))
    touched = catalog.join(fresh, "row_id").where(F.size(more) > 0)
    after = touched.withColumn("files", F.concat(files, more)).select(*catalog.columns)
    log = diff_op(touched.select(*catalog.columns), after, "row_id", op_id)
    rest = catalog.join(after.select("row_id"), "row_id", "left_anti")
    return rest.unionByName(after), log
