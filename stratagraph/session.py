"""Session set-up and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "stratagraph", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine relies on (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines of the cluster share, from spark.checkpoint.dir.

    Only where Spark runs in one process, as in tests, a temporary folder stands in for it; on a cluster a
    folder of one machine would be of no use, so there the setting is required.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not context.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    key = f"stratagraph.shared.{context.applicationId}"
    if key not in _TEMPORARY:
        _TEMPORARY[key] = "file://" + tempfile.mkdtemp(prefix=f"stratagraph-{os.getpid()}-")
    return _TEMPORARY[key]


_TEMPORARY: dict[str, str] = {}


def _work(spark: SparkSession):
    """This application's folder below the shared one and its file system; it goes when the application ends."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/stratagraph-{context.applicationId}")
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    return path, files


def durable(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Cut lineage by a table written to the shared folder, which survives the loss of executors.

    The rows are made once. The table that ``replaces`` stands for, an earlier round of a loop whose
    rows nobody needs any more, is deleted. All tables go when the application ends, or by ``release``.
    """
    spark = df.sparkSession
    _, files = _work(spark)
    table = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(table)
    if replaces is not None and (old := _TABLES.pop(id(replaces), None)):
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old), True)
    out = spark.read.schema(df.schema).parquet(table)
    _TABLES[id(out)] = table
    weakref.finalize(out, _TABLES.pop, id(out), None)
    return out


_TABLES: dict[int, str] = {}


def work_folder(spark: SparkSession) -> str:
    """This application's folder below the shared one, for tables that a query writes and reads again."""
    path, files = _work(spark)
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return str(path)


def release(spark: SparkSession) -> None:
    """Delete the tables of all queries so far; their results must have been read."""
    path, files = _work(spark)
    if files.exists(path):
        files.delete(path, True)
    _TABLES.clear()


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan or projection of a scan over at least as many partitions as there are cores.

    Work in Python on a few small files would else run on a few cores. Where the files give enough
    partitions, as large tables do, nothing is shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
