"""Side tables: waivers, change logs and vocabularies."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import strip

# Words of the hobby that are always known.
DOMAIN_TERMS = (
    "acoustic", "acoustics", "anniversary", "armature", "armatures", "audio", "audiophile", "bass", "bluetooth",
    "brass", "budget", "cable", "cables", "carbon", "classic", "collab", "collaboration", "conduction", "connector",
    "connectors", "copper", "custom", "customs", "detachable", "driver", "drivers", "dynamic", "dynamics", "earbud",
    "earbuds", "earphone", "earphones", "eartip", "eartips", "edition", "editions", "electrostatic", "faceplate",
    "faceplates", "flagship", "gold", "headphone", "headphones", "headset", "headsets", "hybrid", "hybrids", "iem",
    "iems", "imaging", "impedance", "limited", "lite", "mems", "midrange", "mids", "mini", "monitor", "monitors",
    "nano", "nozzle", "nozzles", "piezo", "piezoelectric", "planar", "planars", "plus", "premium", "proprietary",
    "reference", "remastered", "resin", "retro", "retune", "sensitivities", "sensitivity", "shell", "shells",
    "silver", "soundstage", "studio", "titanium", "tonality", "treble", "tribrid", "tuning", "tws", "ultra",
    "universal", "wireless",
)


def read_waivers(spark: SparkSession, path: str) -> DataFrame:
    """waiver_key rows; a missing table is an empty one."""
    return _read_or_empty(spark, path, "waiver_key string")


def write_waivers(waivers: DataFrame, path: str) -> None:
    waivers.select("waiver_key").distinct().write.mode("overwrite").parquet(path)


def waivers_from_json(df: DataFrame, text_col: str = "value") -> DataFrame:
    """Keys out of waiver documents: a JSON list, or an object with a ``waived`` list."""
    c = F.trim(text_col)
    listed = F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(
        F.from_json(c, "struct<waived:array<string>>")["waived"]
    )
    return df.select(F.explode(listed).alias("waiver_key")).distinct()


def read_change_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _read_or_empty(spark, path, schema)


def write_change_log(log: DataFrame, path: str) -> None:
    """Appends an operation; the folder per operation makes a rewrite of one harmless."""
    log.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("op_id").parquet(path)


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def ranked_words(lines: DataFrame, column: str = "value", order: str = "line_order") -> DataFrame:
    """word, rank: lower-cased words, ranked by where they first stand in a word list."""
    words = lines.select(F.lower(strip(column)).alias("word"), F.col(order).alias("rank")).where("word <> ''")
    return words.groupBy("word").agg(F.min("rank").alias("rank"))


def load_vocabulary(spark: SparkSession, common: DataFrame, full: DataFrame | None = None, dynamic: DataFrame | None = None):
    """(pool, known): words suggestions come from with their rank, and every accepted key.

    ``common(word, rank)``, ``full(word)`` and ``dynamic(key)`` are tables; the domain terms
    are always part of both.
    """
    terms = spark.createDataFrame([(w,) for w in DOMAIN_TERMS], "word string")
    pool = common.select("word", F.col("rank").cast("bigint").alias("rank"))
    extra = terms if dynamic is None else terms.unionByName(dynamic.select(F.col("key").alias("word")))
    pool = (
        pool.unionByName(extra.withColumn("rank", F.lit(None).cast("bigint")))
        .groupBy("word")
        .agg(F.min("rank").alias("rank"))
    )
    known = pool.select("word")
    if full is not None:
        known = known.unionByName(full.select("word")).distinct()
    return pool, known
