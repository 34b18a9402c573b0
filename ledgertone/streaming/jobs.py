"""The two batch jobs in their streaming form."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import changes as C
from ..operators.metrics import curve_metrics, curve_tags
from ..session import written
from ..sources.change_docs import ingest_change_docs
from ..sources.curve_files import points_from_lines


def stream_ingest_curves(spark: SparkSession, root: str, sink: str, checkpoint: str) -> StreamingQuery:
    """New measurement files under ``root`` become points, errors and tagged metrics below ``sink``.

    Every file is read once; a batch writes to its own folder, so a repeated batch replaces
    its own output. A file rewritten under the same path is not read again.
    """
    lines = spark.readStream.format("text").option("recursiveFileLookup", True).load(root)
    # the file columns are only visible on the stream itself
    lines = lines.select("value", "_metadata.file_path", "_metadata.file_block_start")

    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.select(
            F.col("file_path").alias("path"),
            F.struct(
                F.col("file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")
            ).alias("line_order"),
            F.translate(F.make_valid_utf8("value"), chr(0xFEFF), "").alias("line"),
        )
        points, errors = points_from_lines(numbered)
        folder = f"batch={batch_id}"
        points.write.mode("overwrite").parquet(f"{sink}/points/{folder}")
        errors.write.mode("overwrite").parquet(f"{sink}/errors/{folder}")
        # read back what was written: the files are parsed once
        stored = batch.sparkSession.read.parquet(f"{sink}/points/{folder}")
        curve_tags(curve_metrics(stored)).write.mode("overwrite").parquet(f"{sink}/tags/{folder}")

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_apply_changes(docs: DataFrame, path: str, checkpoint: str, files: DataFrame | None = None,
                         text_col: str = "text", doc_id: str = "doc_id") -> StreamingQuery:
    """Reply documents applied to a catalog, one folder of the catalog, its change log and the problems per batch.

    The stream starts from the catalog in ``path/catalog/version=0``; batch n reads version n and writes version n + 1, so
    a batch that is repeated after a failure replaces its own output. Changes apply in the order of (doc_id, place in the
    document); ids may be of any type that sorts. Problems are (doc_id, error).
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, after_it = batch.sparkSession, f"version={batch_id + 1}"
        catalog = spark.read.parquet(f"{path}/catalog/version={batch_id}")
        found, errors = ingest_change_docs(batch, text_col, doc_id)
        # numbers that grow along the sorted partitions; written, so that they stay as they are
        ordered = written(found.orderBy("doc_id", "seq").withColumn("change_id", F.monotonically_increasing_id()))
        ready = C.normalize_prices(C.normalize_brands(ordered, catalog))
        proposals = C.classify_changes(catalog, ready)
        staged, problems, _ = C.stage(C.merge_fields(proposals), catalog, files)
        new, log = C.apply_changes(catalog, staged, op_id=batch_id + 1)
        new.write.mode("overwrite").parquet(f"{path}/catalog/{after_it}")
        log.write.mode("overwrite").parquet(f"{path}/log/{after_it}")
        refused = problems.join(ordered.select("change_id", "doc_id"), "change_id").select("doc_id", "error")
        refused.unionByName(errors).write.mode("overwrite").parquet(f"{path}/problems/{after_it}")

    return (
        docs.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
