"""Telemetry streams: exactly-once journal by day, retention, compaction, windows and bursts."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_observations(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Observations as a stream of the Parquet files of a folder, or of one file, with the schema of the files that are there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(str(place.getParent()))
    return reader.parquet(path)


def once(stream: DataFrame, key: str = "event_id", at: str = "recorded_at", kept: str = "14 days") -> DataFrame:
    """Each key once among rows at most ``kept`` apart; state older than that is dropped. The first to arrive stays."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, kept).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, by: list[str], at: str = "recorded_at", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and errors per window and group; windows close when the watermark passes them."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width), *by).agg(F.count("*").alias("events"), F.count_if(F.coalesce(F.col("status") >= 500, F.lit(False))).alias("errors"))


def bursts(rows: DataFrame, by: str, at: str, gap: str = "5 seconds") -> DataFrame:
    """Bursts of changes: a group's rows with less than ``gap`` between them; works on batches and watermarked streams."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).groupBy(by, F.session_window(at, gap).alias("burst")).agg(F.count("*").alias("changes")).select(by, F.col("burst.start").alias("started"), F.col("burst.end").alias("due"), "changes")


def write_journal(stream: DataFrame, path: str, checkpoint: str, at: str = "recorded_at"):
    """Appends a stream to a journal partitioned by day of recording. Late rows go to their day, none is dropped.

    The file sink's log makes a batch that runs again replace itself, so nothing is written twice.
    """
    days = stream.withColumn("day", F.to_date(at))
    return days.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def within_retention(journal: DataFrame, today: date, days: int = 14) -> DataFrame:
    """Rows of the last ``days`` days; the filter is on the partition column, so older days aren't read."""
    return journal.where(F.col("day") > F.lit(today - timedelta(days=days)))


def compact(journal: DataFrame, order: str, size: str, most_rows: int = 5000, budget: int = 24 << 20) -> DataFrame:
    """The newest rows of each day within a number of rows and a byte budget.

    A row that doesn't fit is skipped and smaller older rows may still fit, so the choice is made one row
    after the other; a day comes to that step with at most ``most_rows`` rows.
    """
    newest = journal.withColumn("__n", F.row_number().over(W.partitionBy("day").orderBy(F.col(order).desc()))).where(F.col("__n") <= most_rows).drop("__n")

    def choose(day: pd.DataFrame) -> pd.DataFrame:
        left, keep = budget, []
        for i, n in enumerate(day.sort_values(order, ascending=False)[size]):
            if n <= left:
                left -= n
                keep.append(i)
        return day.sort_values(order, ascending=False).iloc[keep]

    return newest.groupBy("day").applyInPandas(choose, newest.schema)


def latest_claims(stream: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """State of a claim log: (claim_id, status, seq, heartbeat), one row per change; a claim without heartbeat expires.

    The state of a claim is its row of the highest seq. Timers run on event time: a claim is expired when
    the watermark has passed its heartbeat by more than its time to live.
    """
    schema = "claim_id long, status string, seq long, heartbeat timestamp"

    def step(key, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seq, status, at = state.get
            state.remove()
            if status == "active":
                yield pd.DataFrame([(key[0], "expired", seq, pd.Timestamp(at, unit="ms"))], columns=["claim_id", "status", "seq", "heartbeat"])
            return
        seq, status, at = state.get if state.exists else (-1, "", 0)
        before = seq
        for part in rows:
            last = part.loc[part.seq.idxmax()]
            if last.seq > seq:
                seq, status, at = int(last.seq), str(last.status), int(last.heartbeat.value // 1_000_000)
        if seq > before:
            state.update((seq, status, at))
            yield pd.DataFrame([(key[0], status, seq, pd.Timestamp(at, unit="ms"))], columns=["claim_id", "status", "seq", "heartbeat"])
        if status == "active":
            state.setTimeoutTimestamp(max(at + ttl_ms, state.getCurrentWatermarkMs() + 1))

    timed = stream.withColumn("heartbeat", F.col("heartbeat").cast("timestamp")).withWatermark("heartbeat", "0 seconds")
    return timed.groupBy("claim_id").applyInPandasWithState(step, schema, "seq long, status string, at long", "append", "EventTimeTimeout")


def push(stream: DataFrame, send, checkpoint: str, journal: str):
    """Sends every batch of a stream by ``send(batch, number)`` once: a batch whose number the journal holds is not sent again.

    The number is noted after the sending, so a batch that broke off is sent again as a whole with the same
    number, by which the receiver can tell it (``send`` is given the number for that).
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{journal}/{number}")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(path):
            return
        send(batch, number)
        files.mkdirs(path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def correlated_again(journal: DataFrame, routes: DataFrame, today: date, days: int = 30) -> DataFrame:
    """Unmatched rows of the last ``days`` days that a new analysis's routes (shape, entry_point_id) now fit; ``journal`` has day, id, path, match_status."""
    from stratagraph.functions.text import route_shape

    recent = journal.where((F.col("day") > F.lit(today - timedelta(days=days))) & (F.coalesce("match_status", F.lit("unmatched")) == "unmatched"))
    one = routes.groupBy("shape").agg(F.min("entry_point_id").alias("entry_point_id"))
    return recent.withColumn("shape", route_shape(F.col("path"))).join(one, "shape").drop("shape")
