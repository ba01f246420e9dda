"""Percentiles with bounded rank error from mergeable randomised compactor hierarchies."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sketch:
    """Levels of values; a value at level h stands for 2**h values of the stream.

    A level that exceeds its capacity is sorted and every second value moves up, the first or second
    by a coin; capacities shrink by 2/3 per level below the top, never under 8. With parameter ``k``
    the rank error is about 1.7 / k of the count with a probability of 99 %; up to ``k`` values the
    sketch is exact. Coins come from a seeded generator, so a sketch built again is the same.
    """

    __slots__ = ("k", "count", "levels", "coins")

    def __init__(self, k: int, seed: int = 0):
        self.k, self.count, self.levels, self.coins = k, 0, [np.empty(0)], np.random.default_rng(seed)

    def capacity(self, level: int) -> int:
        return max(8, math.ceil(self.k * (2 / 3) ** (len(self.levels) - 1 - level)))

    def add(self, values: np.ndarray) -> None:
        self.count += len(values)
        self.levels[0] = np.concatenate((self.levels[0], values))
        self._compact()

    def merge(self, other: Sketch) -> None:
        self.count += other.count
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0))
        for i, values in enumerate(other.levels):
            self.levels[i] = np.concatenate((self.levels[i], values))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            values = self.levels[level]
            if len(values) > self.capacity(level):
                if level + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                values = np.sort(values)
                # An odd value out stays where it is, so the weights always add up to the count.
                odd, even = values[: len(values) % 2], values[len(values) % 2 :]
                self.levels[level] = odd
                self.levels[level + 1] = np.concatenate((self.levels[level + 1], even[int(self.coins.integers(2)) :: 2]))
            level += 1

    def percentiles(self, shares: list[float]) -> list[float]:
        """Values of nearest rank ceil(share * count)."""
        values = np.concatenate(self.levels)
        weights = np.repeat(2 ** np.arange(len(self.levels), dtype=np.int64), [len(v) for v in self.levels])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        return [float(values[order[np.searchsorted(ranks, min(max(1, math.ceil(s * self.count)), self.count))]]) for s in shares]

    def to_bytes(self) -> bytes:
        head = struct.pack("<iqi", self.k, self.count, len(self.levels)) + struct.pack(f"<{len(self.levels)}i", *map(len, self.levels))
        return head + np.concatenate(self.levels).astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, seed: int = 0) -> Sketch:
        k, count, n = struct.unpack_from("<iqi", data)
        sizes = struct.unpack_from(f"<{n}i", data, 16)
        out = cls(k, seed)
        out.count = count
        out.levels = [a.copy() for a in np.split(np.frombuffer(data, "<f8", offset=16 + 4 * n), np.cumsum(sizes)[:-1])]
        return out


def _seed(key: tuple) -> int:
    """A seed of a sketch's own: tasks draw different coins for one group, and a task that runs again draws the same."""
    from pyspark import TaskContext

    context = TaskContext.get()
    key = (context.partitionId(), *key) if context else key
    return zlib.crc32(repr(key).encode("utf-8", "surrogatepass"))


def sketches(df: DataFrame, by: list[str], value: str, k: int = 1600, most_values: int = 2_000_000) -> DataFrame:
    """Partial sketches: ``by`` columns, count and sketch, several per group (one per task that saw it).

    Null and NaN values are not counted; null keys are a group. A task holds at most ``most_values``
    values and gives its sketches off and starts new ones when there are more groups than that allows.
    """
    kept = df.select(*by, F.col(value).cast("double").alias("__value")).where(F.col("__value").isNotNull() & ~F.isnan("__value"))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "count bigint", "sketch binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        types = None

        def give() -> pa.RecordBatch:
            keys = list(zip(*held)) or [[] for _ in by]
            columns = [pa.array(c, t) for c, t in zip(keys, types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([s.count for s in held.values()], pa.int64()), pa.array([s.to_bytes() for s in held.values()], pa.binary())], names=[*by, "count", "sketch"])

        size = 0
        for batch in batches:
            types = types or [c.type for c in batch.columns[:-1]]
            values = batch.column(len(by)).to_numpy(zero_copy_only=False)
            codes = np.zeros(len(values), np.int64)
            for column in batch.columns[:-1]:
                own = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                codes = np.unique(codes * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            for at, part in zip(starts, np.split(values[order], starts[1:])):
                key = tuple(c[int(order[at])].as_py() for c in batch.columns[:-1])
                sketch = held.get(key)
                if sketch is None:
                    sketch = held[key] = Sketch(k, _seed(key))
                size -= sum(map(len, sketch.levels))
                sketch.add(part)
                size += sum(map(len, sketch.levels))
            if size > most_values:
                yield give()
                held, size = {}, 0
        if held:
            yield give()

    return kept.mapInArrow(run, schema)


def _combine(parts: DataFrame, by: list[str], place: list[str]) -> DataFrame:
    """Sketches of equal ``place`` columns merged; rows come sorted, so one group is held at a time."""
    schema = ", ".join([*(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in by), "count bigint", "sketch binary"])
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done, types = None, None, [], None

        def give(rows):
            columns = [pa.array([r[0][i] for r in rows], types[i]) for i in range(n)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=[*by, "count", "sketch"])

        for batch in batches:
            types = types or [c.type for c in batch.columns[:n]]
            for *own, data in zip(*(c.to_pylist() for c in (*batch.columns[:n], batch.column("sketch")))):
                if key != (own := tuple(own)):
                    if held is not None:
                        done.append((key, held.count, held.to_bytes()))
                    key, held = own, Sketch.from_bytes(data, _seed(("merged", *own)))
                else:
                    held.merge(Sketch.from_bytes(data))
                if len(done) >= 2000:
                    yield give(done)
                    done = []
        if held is not None:
            yield give([*done, (key, held.count, held.to_bytes())])

    return parts.repartition(*place).sortWithinPartitions(*place).select(*by, "sketch").mapInArrow(run, schema)


def merge_sketches(parts: DataFrame, by: list[str], fan_in: int = 64) -> DataFrame:
    """One sketch per group from any number of partial ones: of tasks, files or days.

    Partial sketches of a group are first merged in up to ``fan_in`` salted portions, so that a group
    which every task has seen does not bring all its sketches to one task at once. The salt is made
    from the sketch, not drawn, so a task that runs again sends its rows to the same place.
    """
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64("sketch"), F.lit(fan_in)))
    return _combine(_combine(salted, by, [*by, "__salt"]), by, by)


def percentiles(merged: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """``by``, count and one column per share with the value of its nearest rank."""
    schema = ", ".join([*(f"`{c}` {merged.schema[c].dataType.simpleString()}" for c in by), "count bigint", *(f"`{c}` double" for c in shares)])
    wanted = list(shares.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Sketch.from_bytes(s).percentiles(wanted) for s in batch.column("sketch").to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(wanted))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by) + 1], *columns], names=[*by, "count", *shares])

    return merged.select(*by, "count", "sketch").mapInArrow(run, schema)


def clean_events(observations: DataFrame) -> DataFrame:
    """Countable durations, one per event: method, path, duration_ms and day of the observation.

    method is trimmed and upper-case; path loses its query part and one trailing slash, and segments of
    digits become ':id'. Null methods and paths and null, NaN and negative durations do not count. A
    repeated event counts once, with its least (method, path, duration, day); events without an
    event_id can't be told to be repeated and count per row.
    """
    event = F.col("event")
    method = F.upper(F.regexp_replace(event["method"], r"(?U)^\s+|\s+$", ""))
    bare = F.regexp_replace(F.regexp_replace(event["path"], r"(?s)\?.*", ""), r"/$", "")
    path = F.regexp_replace(bare, r"(?<=/)[0-9]+(?=/|$)", ":id")
    rows = observations.select(event["event_id"].alias("event_id"), F.struct(method.alias("method"), path.alias("path"), event["duration_ms"].alias("duration_ms"), F.to_date("recorded_at").alias("day")).alias("e"))
    valid = rows.where(F.col("e.method").isNotNull() & F.col("e.path").isNotNull() & (F.col("e.duration_ms") >= 0) & ~F.isnan("e.duration_ms"))
    named = valid.where("event_id is not null").groupBy("event_id").agg(F.min("e").alias("e"))
    return named.select("e.*").unionByName(valid.where("event_id is null").select("e.*"))


def path_percentiles(observations: DataFrame, k: int = 1600) -> DataFrame:
    """method, path, count, p50, p95 and p99 of the duration of each group of all observations."""
    by = ["method", "path"]
    return percentiles(merge_sketches(sketches(clean_events(observations), by, "duration_ms", k), by), by, {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def daily_sketches(observations: DataFrame, k: int = 1600) -> DataFrame:
    """One sketch per day, method and path, to be kept and merged into any span of days."""
    by = ["day", "method", "path"]
    return merge_sketches(sketches(clean_events(observations), by, "duration_ms", k), by)
