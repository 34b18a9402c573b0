"""Reading, cleaning and writing catalogs."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.arrow import gestalt_ratio
from ..functions.numbers import coerce_int, finite, half_up, py_float
from ..functions.text import strip
from ..operators.lookup import catalog_order
from .json_array import read_elements, write_elements

RAW = "map<string,string>"
HINT_FROM = 0.7


def read_catalog(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Raw entries: row_id, raw (field -> text), note.

    ``json`` is one JSON array per file (plain or ``.gz``, with or without a byte-order mark), positions become row
    ids; ``json-parts`` is one array laid out in the files of a folder, as ``write_catalog`` leaves it. Both are read
    by many tasks. ``jsonl`` and ``parquet`` are cheaper. Elements that are no objects come back as notes.
    """
    if format == "parquet":
        return spark.read.parquet(path)
    if format == "jsonl":
        lines = spark.read.text(path).where("trim(value) <> ''")
        numbered = lines.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.translate("value", chr(0xFEFF), "").alias("item"),
        )
    else:
        numbered = read_elements(spark, path, parts=format == "json-parts")
    is_object = F.ltrim(F.col("item")).startswith("{")
    return numbered.select(
        "row_id",
        F.when(is_object, F.from_json("item", RAW)).alias("raw"),
        F.when(~is_object | F.col("item").isNull(), F.lit("entry is not an object and was skipped")).alias("note"),
    )


def _readings(f: str) -> list[Column]:
    """The text of a field and its typed reading: ``t_`` and ``v_`` columns."""
    raw = F.col("raw")[f]
    if f in S.INT_FIELDS:
        return [strip(raw).alias(f"t_{f}")]
    if f in S.LIST_FIELDS:
        return [F.from_json(raw, "array<string>").alias(f"t_{f}")]
    return [strip(raw).alias(f"t_{f}")]


# JSON objects and lists among texts
NESTED = r"{0} RLIKE '^\\s*[\\[{{]' AND try_parse_json({0}) IS NOT NULL"


def _typed(f: str) -> list[Column]:
    t = F.col(f"t_{f}")
    if f in S.INT_FIELDS:
        # a decimal comma counts here, in text that also has a point
        dotted = t.contains(".") & ~t.rlike(r"^[+-]?\d+$")
        decimal = finite(py_float(F.replace(t, F.lit(","), F.lit("."))))
        return [F.when(dotted, half_up(decimal)).otherwise(coerce_int(t)).alias(f"v_{f}")]
    if f in S.LIST_FIELDS:
        return [F.expr(f"filter(t_{f}, x -> coalesce({NESTED.format('x')}, false))").alias(f"n_{f}")]
    return []


def _final(f: str) -> Column:
    if f in S.INT_FIELDS:
        return F.expr(
            f"CASE WHEN contains(t_{f}, '_') OR NOT v_{f} BETWEEN -2147483648 AND 2147483647 THEN 0 "
            f"ELSE coalesce(cast(v_{f} AS int), 0) END"
        ).alias(f)
    if f in S.LIST_FIELDS:
        flat = F.filter(f"t_{f}", lambda x: x.isNotNull() & ~F.array_contains(f"n_{f}", x))
        kept = F.filter(F.transform(flat, lambda x: strip(x)), lambda x: x != "")
        return F.coalesce(kept, F.array().cast("array<string>")).alias(f)
    return F.col(f"t_{f}").alias(f)


def _message(f: str) -> str:
    """SQL for the note a field earns, null when its value was taken as it is."""
    raw = f"raw['{f}']"
    if f in S.INT_FIELDS:
        reason = (
            f"CASE WHEN map_contains_key(raw, '{f}') AND {raw} IS NULL THEN 'no value; set to 0' "
            f"WHEN t_{f} = '' THEN NULL WHEN contains(t_{f}, '_') THEN 'underscores; set to 0' "
            f"WHEN v_{f} IS NULL THEN 'not a number; set to 0' "
            f"WHEN t_{f} <> cast(f_{f} AS string) THEN concat('changed to ', cast(f_{f} AS string)) END"
        )
        return f"concat('\\'', coalesce({raw}, 'null'), '\\' ', {reason})"
    if f in S.LIST_FIELDS:
        return (
            f"CASE WHEN t_{f} IS NULL AND trim({raw}) NOT IN ('', '{{}}') THEN 'not a list; emptied' "
            f"WHEN size(n_{f}) > 0 THEN concat(cast(size(n_{f}) AS string), ' structured items dropped') END"
        )
    return f"CASE WHEN {NESTED.format(raw)} THEN 'structured value kept as text' END"


def clean_catalog(raw: DataFrame, hints: bool = True):
    """(catalog, notes): exactly the schema's fields, and a note for every value changed.

    One projection makes the typed row and its notes together. Unknown keys are noted with
    the field they resemble; that comparison runs on the distinct keys only.
    """
    raw = raw.withColumn("raw", F.col("raw").cast(RAW))
    entries = raw.where("raw IS NOT NULL")
    read = entries.select("row_id", "raw", *[c for f in S.FIELDS for c in _readings(f)])
    typed = read.select("*", *[c for f in S.FIELDS for c in _typed(f)])
    final = typed.select("*", *[_final(f).alias(f"f_{f}") for f in S.FIELDS])
    catalog = final.select("row_id", *[F.col(f"f_{f}").alias(f) for f in S.FIELDS])

    # concat with a null reason is null, so quiet fields drop out of the array
    records = ", ".join(f"named_struct('field', '{f}', 'message', {_message(f)})" for f in S.FIELDS)
    found = final.select(
        "row_id", F.explode(F.expr(f"filter(array({records}), n -> n.message IS NOT NULL)")).alias("n")
    ).select("row_id", "n.field", "n.message")

    unknown = entries.select(
        "row_id", F.explode(F.array_except(F.map_keys("raw"), F.array(*[F.lit(f) for f in S.FIELDS]))).alias("field")
    )
    message = F.lit("unknown field dropped")
    if hints:
        keys = unknown.select("field").distinct().withColumn("low", F.lower(strip("field")))
        tried = keys.withColumn("known", F.explode(F.array(*[F.lit(f) for f in S.FIELDS])))
        best = (
            tried.withColumn("ratio", gestalt_ratio("known", "low"))
            .where(F.col("ratio") >= HINT_FROM)
            .groupBy("field")
            .agg(F.max_by("known", F.struct("ratio", "known")).alias("hint"))
        )
        unknown = unknown.join(best, "field", "left")
        message = F.when(
            F.col("hint").isNotNull(), F.concat(message, F.lit("; did you mean "), F.col("hint"))
        ).otherwise(message)
    notes = found.unionByName(unknown.select("row_id", "field", message.alias("message")))
    if "note" in raw.columns:
        notes = notes.unionByName(
            raw.where("note IS NOT NULL").select("row_id", F.lit("").alias("field"), F.col("note").alias("message"))
        )
    return catalog, notes


def write_catalog(df: DataFrame, path: str, format: str = "parquet", compression: str | None = None) -> None:
    """Catalog order and field order. ``json`` is one array in parts; their bytes, joined in order of names, are the file."""
    numbered = ["row_id"] if "row_id" in df.columns else []
    if format == "json":
        entry = F.to_json(F.struct(*S.FIELDS), {"pretty": "true", "ignoreNullFields": "false"})
        order = [*catalog_order(), *[F.col(c) for c in numbered or ["id"]]]
        write_elements(df.withColumn("_entry", entry), order, path, "_entry", compression)
        return
    writer = df.select(*numbered, *S.FIELDS).orderBy(*catalog_order()).write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    (writer.json if format == "jsonl" else writer.parquet)(path)


def written_size(spark: SparkSession, path: str) -> DataFrame:
    """Number of files and bytes under a path, from the listing alone."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))
    )


def empty_catalog(spark: SparkSession) -> DataFrame:
    fields = [T.StructField("row_id", T.LongType()), *S.CATALOG.fields]
    return spark.createDataFrame([], T.StructType(fields))
