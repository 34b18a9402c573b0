"""Session defaults and lineage cutting."""

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "ledgertone", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster, master, memory and shuffle partitions come from spark-submit; only the
    settings results or skew handling rely on are set here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call sites are looked up per column expression and cost more than building it
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, seen by the driver and all executors.

    Only a local master, as in tests, may go without the setting; it then uses a folder of this machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = sc.getCheckpointDir() or _local_folder()
    return folder.rstrip("/")


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="ledgertone-ckpt-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives executor loss, unlike a local checkpoint."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores, for costly work per row: a small file of many short rows is read by one task."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read back: for loops, whose checkpoints would hand on what the optimiser
    knows about ever more columns (their constraints double with each round)."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
