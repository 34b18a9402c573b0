"""One JSON array in one file or in parts laid end to end, read by many tasks and written by many tasks.

A reader that starts in the middle of a file can't know whether it is inside a string. So each piece of text up to a
closing brace yields what it does to the state for either start: whether it ends the other way round (an odd number of
quotes), and how it changes the nesting if it starts outside or inside a string. Prefix sums within a byte range, then
over the ranges, one row each, fix the true state at every piece, and with it where elements begin. Only the pieces
of one element are ever brought together.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLANKS = " \t\r\n"


def _nesting(segments: Column) -> Column:
    """Opening less closing brackets in the given segments between quotes."""
    text = F.array_join(segments, "")
    return F.length(F.translate(text, "]}", "")) - F.length(F.translate(text, "[{", ""))


def _pieces(spark: SparkSession, path: str, parts: bool) -> DataFrame:
    """Pieces (array, file, at, k, value) up to each closing brace; (file, at) is the byte range and k the order in it."""
    text = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"), "value"
    )
    return text.withColumn("array", F.lit("") if parts else F.col("file"))


def read_elements(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(array, row_id, item): the elements of the JSON arrays under a path in order, as texts; row_id counts from 0.

    Each file is an array; with ``parts`` all files under the path, in order of their names, are one. Files may be
    compressed (then a file is read by one task, but never held as a whole) and may begin with a byte-order mark.
    What isn't an array, isn't closed or isn't JSON fails with a message that says where.
    """
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    quoted = F.split(bare, '"', -1)
    seen = _pieces(spark, path, parts).withColumn("s", quoted).select(
        "array", "file", "at", "k", "value", ((F.size("s") - 1) % 2).alias("q"),
        _nesting(F.filter("s", lambda x, i: i % 2 == 0)).alias("d0"), _nesting(F.filter("s", lambda x, i: i % 2 == 1)).alias("d1"),
    )
    # a byte range is what one task reads, so its windows are bounded
    here = Window.partitionBy("array", "file", "at")
    before, upto = (here.orderBy("k").rowsBetween(Window.unboundedPreceding, n) for n in (-1, 0))
    ranged = seen.withColumn("odd", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2)
    # for both states at the range's start: nesting before each piece, with the brace that follows every earlier one
    for s in (0, 1):
        inside = (F.col("odd") + s) % 2
        own = F.when(inside == 0, F.col("d0")).otherwise(F.col("d1")) - F.when((inside + F.col("q")) % 2 == 0, 1).otherwise(0)
        ranged = ranged.withColumn(f"own{s}", own).withColumn(f"deep{s}", F.coalesce(F.sum(f"own{s}").over(before), F.lit(0)))
    ranged = cut_lineage(ranged)
    total = ranged.groupBy("array", "file", "at").agg(
        (F.sum("q") % 2).alias("q"), F.sum("own0").alias("n0"), F.sum("own1").alias("n1"), F.max_by(F.struct("odd", "q"), "k").alias("end")
    )
    # one row per byte range: the state at its start, then the nesting; a file's last piece has no brace after it
    order = Window.partitionBy("array").orderBy("file", "at")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumn("final", F.lead("file").over(order).isNull() | (F.lead("file").over(order) != F.col("file")))
    total = total.withColumn("head", F.lag("file").over(order).isNull())
    total = total.withColumn("inside", F.coalesce(F.sum("q").over(ahead), F.lit(0)) % 2)
    outside = (F.col("inside") + F.col("end.odd") + F.col("end.q")) % 2 == 0
    grows = F.when(F.col("inside") == 0, F.col("n0")).otherwise(F.col("n1")) + F.when(F.col("final") & outside, 1).otherwise(0)
    total = total.withColumn("grows", grows).withColumn("deep", F.coalesce(F.sum("grows").over(ahead), F.lit(0)))
    closed = total.groupBy("array").agg(F.sum("grows").alias("left"), (F.sum("q") % 2).alias("open"))
    sound = F.when((F.col("left") == 0) & (F.col("open") == 0), True).otherwise(F.raise_error(F.lit("a catalog is a JSON array: it is not closed")))
    total = total.join(closed, "array").withColumn("sound", sound)
    ranged = ranged.join(total.select("array", "file", "at", "inside", F.col("deep").alias("base"), "head", "final", "sound"), ["array", "file", "at"]).where("sound")
    state = (F.col("inside") + F.col("odd")) % 2
    nesting = F.col("base") + F.when(F.col("inside") == 0, F.col("deep0")).otherwise(F.col("deep1"))
    # an element begins with a piece that starts between elements; a later file of the array goes on where the one before ended
    goes_on = ~F.col("head") & (F.col("at") == 0) & F.lag("k").over(here.orderBy("k")).isNull()
    starts = (state == 0) & (nesting <= 1) & ~F.col("goes_on")
    ranged = ranged.withColumn("goes_on", goes_on)
    ranged = ranged.withColumn("from", F.max(F.when(starts, F.struct("file", "at", "k"))).over(upto))
    borders = ranged.groupBy("array", "file", "at").agg(F.max("from").alias("latest"), F.max("k").alias("top"))
    borders = borders.withColumn("held", F.max("latest").over(ahead)).drop("latest")
    ranged = ranged.join(borders, ["array", "file", "at"])
    piece = F.concat("value", F.when(F.col("final") & (F.col("k") == F.col("top")), "").otherwise("}"))
    elements = (
        ranged.groupBy("array", F.coalesce("from", "held").alias("from"))
        .agg(F.array_sort(F.collect_list(F.struct("file", "at", "k", piece.alias("text")))).alias("p"))
        .select("array", "from", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    )
    # a group of elements up to one object: commas and the array's brackets at its ends are not part of it
    firsts = elements.groupBy("array").agg(F.min("from").alias("first"), F.max("from").alias("latest"))
    body = F.btrim(F.translate("text", chr(0xFEFF), ""), F.lit(BLANKS))
    opened = F.when(F.col("from") != F.col("first"), F.concat(F.lit("["), F.regexp_replace(body, "^,", ""))).when(body.startswith("["), body)
    opened = F.coalesce(opened, F.raise_error(F.lit("a catalog is a JSON array")).cast("string"))
    final = F.col("from") == F.col("latest")
    joined = (F.col("from") == F.col("first")) | body.startswith("]") | body.rlike(r"^,\s*[^\s\]]")
    whole = F.when(joined & (~final | body.endswith("]")), F.concat(opened, F.when(final, "").otherwise("]")))
    items = F.from_json(whole, "array<string>")
    wrong = F.raise_error(F.concat(F.lit("not JSON: "), F.substring("text", 1, 80))).cast("array<string>")
    groups = cut_lineage(elements.join(firsts, "array").select("array", "from", F.coalesce(items, wrong).alias("items")))
    # positions: elements of earlier ranges, of earlier groups in the range, and within the group
    sizes = groups.groupBy("array", F.col("from.file").alias("file"), F.col("from.at").alias("at")).agg(F.sum(F.size("items")).alias("n"))
    sizes = sizes.withColumn("offset", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    inner = Window.partitionBy("array", "file", "at").orderBy("from.k").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("file", F.col("from.file")).withColumn("at", F.col("from.at")).join(sizes, ["array", "file", "at"])
    placed = placed.withColumn("offset", F.col("offset") + F.coalesce(F.sum(F.size("items")).over(inner), F.lit(0)))
    return placed.select("array", "offset", F.posexplode("items").alias("i", "item")).select(
        "array", (F.col("offset") + F.col("i")).alias("row_id"), "item"
    )


def write_elements(items: DataFrame, order: list[Column], path: str, item: str = "item", compression: str | None = None) -> None:
    """A column of JSON texts as one array in parts: the files' bytes, joined in order of their names, are the array.

    Rows are sorted by ranges, so every task writes its own part; with ``gzip`` each part is a member, and members laid
    end to end are one gzip file. The array's first and last rows carry its brackets.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    rows = cut_lineage(items.select(F.col(item).alias("_item"), *[c.alias(k) for c, k in zip(order, keys, strict=True)], F.monotonically_increasing_id().alias("_u")))
    key = F.struct(*keys, "_u")
    ends = rows.agg(F.min(key).alias("_first"), F.max(key).alias("_last"))  # one row
    marked = rows.crossJoin(F.broadcast(ends)).orderBy(*keys, "_u").select(
        F.concat(F.when(key == F.col("_first"), "[\n").otherwise(""), "_item", F.when(key == F.col("_last"), "\n]").otherwise(",")).alias("value")
    )
    if rows.isEmpty():
        marked = items.sparkSession.sql("SELECT '[]' AS value")
    writer = marked.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)
