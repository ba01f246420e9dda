"""Changes between full snapshots by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.session import durable


def current_rows(rows: DataFrame, group: str, version: str, key: str, order: str, compared: dict[str, Column]) -> DataFrame:
    """One row (grp, version, key, digest) per key and snapshot: the latest by ``order``.

    ``digest`` is 128 bits over the compared columns, null kept apart from empty. Equal ``order``
    values are decided by the greater digest, so the result does not depend on the order of rows;
    rows with a null group, version or key are left out.
    """
    parts = [F.when(c.isNull(), F.lit("\x00n")).otherwise(F.concat(F.lit("\x00v"), c.cast("string"))) for c in compared.values()]
    slim = rows.select(F.col(group).alias("grp"), F.col(version).alias("version"), F.col(key).alias("key"), F.col(order).alias("at"), F.unhex(F.md5(F.concat(*parts))).alias("digest"))
    slim = slim.where("grp is not null and version is not null and key is not null")
    return slim.groupBy("grp", "version", "key").agg(F.max(F.struct("at", "digest")).alias("last")).select("grp", "version", "key", F.col("last.digest").alias("digest"))


def consecutive(sizes: DataFrame, announced: DataFrame) -> DataFrame:
    """Pairs (grp, version, before) of complete snapshots; ``sizes`` and ``announced`` have (grp, version, size).

    A snapshot is complete if its number of keys equals an announced size; several announcements of
    one snapshot must agree with its size in at least one row. The window runs over snapshots, whose
    number per group is small and does not grow with their rows.
    """
    complete = sizes.join(announced.where("size is not null").distinct(), ["grp", "version", "size"], "left_semi").select("grp", "version")
    before = F.lag("version").over(W.partitionBy("grp").orderBy("version"))
    return complete.select("grp", "version", before.alias("before"))


def chunked(current: DataFrame, mean_rows: int = 64) -> DataFrame:
    """Rows with the label of the content-defined chunk that they fall into, written once: grp, version, key, digest, chunk.

    A chunk is opened by a key whose hash is a multiple of ``mean_rows`` and is named by it; keys before the
    first such key of a group are the chunk ''. So a chunk depends on keys alone, not on how rows were
    spread over tasks: digests of one run can be compared with those of another, and an insertion
    moves no other border. Snapshots are range-partitioned and sorted by group and key, a large group over
    many ranges; rows at the start of a range continue the chunk that is open at the end of the ranges before it.
    """
    ordered = current.withColumn("opens", F.pmod(F.xxhash64("key"), F.lit(mean_rows)) == 0).repartitionByRange("grp", "key").sortWithinPartitions("grp", "key", "version")
    fields = {f.name: f.dataType.simpleString() for f in current.schema}
    schema = ", ".join(f"{n} {t}" for n, t in fields.items()) + ", part int, chunk string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, label, group = TaskContext.get().partitionId(), None, object()
        for batch in batches:
            keys, groups, opens = batch.column("key"), batch.column("grp"), batch.column("opens").to_numpy(zero_copy_only=False)
            # Only the rows that open a chunk or a group are looked at in Python.
            encoded = groups.dictionary_encode()
            codes = encoded.indices.to_numpy(zero_copy_only=False)
            turns = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.array([], int)
            edges = np.union1d(turns, np.flatnonzero(opens))
            labels, counts = [], []
            for edge, until in zip(edges, [*edges[1:], len(codes)]):
                if opens[edge]:
                    label = keys[int(edge)].as_py()
                elif groups[int(edge)].as_py() != group:
                    label = None
                group = groups[int(edge)].as_py()
                labels.append(label)
                counts.append(until - edge)
            column = pc.take(pa.array(labels, pa.string()), pa.array(np.repeat(np.arange(len(labels)), counts)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in fields), pa.array(np.full(len(codes), part, np.int32)), column], names=[*fields, "part", "chunk"])

    table = durable(ordered.select(*fields, "opens").mapInArrow(run, schema))
    # One row per range and group: the chunk that is open when the range begins.
    ends = table.groupBy("grp", "part").agg(F.max("chunk").alias("last"))
    carried = F.last("last", ignorenulls=True).over(W.partitionBy("grp").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    open_at = ends.select("grp", "part", F.coalesce(carried, F.lit("")).alias("carried"))
    return table.join(open_at, ["grp", "part"]).select(*fields, F.coalesce("chunk", "carried").alias("chunk"))


def chunk_digests(rows: DataFrame) -> DataFrame:
    """grp, version, chunk and sum of chunked rows: the number of rows and two order-free sums over their hashes."""
    mixed = F.xxhash64("key", "digest").cast("decimal(38,0)")
    return rows.groupBy("grp", "version", "chunk").agg(F.struct(F.count("*").alias("rows"), F.sum(mixed).alias("a"), F.sum(F.xxhash64("digest", "key", F.lit(7)).cast("decimal(38,0)")).alias("b")).alias("sum"))


def unmatched_chunks(digests: DataFrame, pairs: DataFrame) -> DataFrame:
    """grp, version, before and chunk of the chunks that differ between the snapshots of each pair (grp, version, before)."""
    newer = digests.join(pairs, ["grp", "version"]).select("grp", "version", "before", "chunk", F.col("sum").alias("now"))
    older = digests.withColumnRenamed("version", "before").join(pairs, ["grp", "before"]).select("grp", "version", "before", "chunk", F.col("sum").alias("past"))
    return newer.join(older, ["grp", "version", "before", "chunk"], "full").where(~F.col("now").eqNullSafe(F.col("past"))).select("grp", "version", "before", "chunk")


def classified(now: DataFrame, past: DataFrame, unmatched: DataFrame) -> DataFrame:
    """grp, version, before, key and change of the rows of unmatched chunks; ``now`` and ``past`` are chunked rows."""
    new = now.join(unmatched, ["grp", "version", "chunk"]).select("grp", "version", "before", "key", F.col("digest").alias("now"))
    old = past.withColumnRenamed("version", "before").join(unmatched, ["grp", "before", "chunk"]).select("grp", "version", "before", "key", F.col("digest").alias("past"))
    change = F.when(F.col("past").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("past"), "changed")
    return new.join(old, ["grp", "version", "before", "key"], "full").withColumn("change", change).where("change is not null").select("grp", "version", "before", "key", "change")


def snapshot_changes(rows: DataFrame, announced: DataFrame, group: str, version: str, key: str, order: str, compared: dict[str, Column], mean_rows: int = 64) -> DataFrame:
    """Keys added, removed or changed between consecutive complete snapshots: grp, version, before, key, change.

    Chunks whose digest is the same in both snapshots are dropped before any row is joined, and rows that
    remain are compared by their 128-bit digests. The first complete snapshot of a group yields nothing.
    """
    current = current_rows(rows, group, version, key, order, compared)
    table = durable(chunked(current, mean_rows))
    digests = durable(chunk_digests(table))
    # A snapshot's number of rows is known from its chunks.
    sizes = digests.groupBy("grp", "version").agg(F.sum("sum.rows").alias("size"))
    pairs = consecutive(sizes, announced).where("before is not null")
    return classified(table, table, unmatched_chunks(digests, pairs))


class SnapshotStore:
    """Snapshots kept as chunks, so that a delivery is compared with what is kept by digests, and only rows of chunks that differ are read.

    ``digests`` below the folder has one row per chunk and version, ``rows`` has the rows of a chunk once per content,
    however many versions hold it. A delivery is written before its changes are given; delivering
    it again gives the same changes and adds nothing twice.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, like: DataFrame) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(like.schema).parquet(str(path)) if there else like.limit(0)

    def deliver(self, current: DataFrame, announced: DataFrame, mean_rows: int = 64) -> DataFrame:
        """Changes of the versions in ``current`` (see ``current_rows``) against the nearest earlier complete one of their group.

        Versions must be delivered in order; incomplete ones are kept too and passed over.
        """
        table = durable(chunked(current, mean_rows))
        new = durable(chunk_digests(table))
        kept = self._read("digests", new)
        fresh = new.join(kept.select("grp", "version", "chunk"), ["grp", "version", "chunk"], "left_anti")
        contents = table.join(new, ["grp", "version", "chunk"]).groupBy("grp", "chunk", "sum", "key").agg(F.first("digest").alias("digest"))
        old_rows = self._read("rows", contents)
        added = durable(contents.join(kept.select("grp", "chunk", "sum").distinct(), ["grp", "chunk", "sum"], "left_anti"))
        everything = durable(kept.unionByName(fresh))
        sizes = everything.groupBy("grp", "version").agg(F.sum("sum.rows").alias("size"))
        pairs = consecutive(sizes, announced).where("before is not null").join(current.select("grp", "version").distinct(), ["grp", "version"], "left_semi")
        unmatched = durable(unmatched_chunks(everything, pairs))
        # Rows of the earlier side come from the store, by the contents of its unmatched chunks.
        wanted = everything.join(unmatched.select("grp", F.col("before").alias("version"), "chunk").distinct(), ["grp", "version", "chunk"])
        past = durable(old_rows.unionByName(added).join(wanted, ["grp", "chunk", "sum"]).select("grp", "version", "key", "digest", "chunk").distinct())
        added.write.mode("append").parquet(f"{self.folder}/rows")
        durable(fresh).write.mode("append").parquet(f"{self.folder}/digests")
        return classified(table, past, unmatched)


def node_changes(nodes: DataFrame, entries: DataFrame, mean_rows: int = 64) -> DataFrame:
    """Changes of nodes between consecutive complete snapshots of a project: project_id, snapshot_no, before, id, change.

    White space at both ends of a description does not count and null equals empty there; in the
    other compared columns null and empty differ.
    """
    blank = r"(?U)^\s+|\s+$"
    compared = {c: F.col(c) for c in ("name", "type", "qualified_name", "category", "level")}
    compared["description"] = F.regexp_replace(F.coalesce(F.col("description"), F.lit("")), blank, "")
    compared["file"] = F.col("source")["file"]
    announced = entries.select(F.col("project_id").alias("grp"), F.col("snapshot_no").alias("version"), F.col("node_count").alias("size"))
    found = snapshot_changes(nodes, announced, "project_id", "snapshot_no", "id", "recorded_at", compared, mean_rows)
    return found.select(F.col("grp").alias("project_id"), F.col("version").alias("snapshot_no"), "before", F.col("key").alias("id"), "change")
