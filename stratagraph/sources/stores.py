"""Whole analyses as files: JSON in and out, records by key, and indexes with interned strings."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_whole(tables: dict[str, DataFrame], path: str, codec: str = "gzip") -> None:
    """Tables as JSON lines, one folder each, compressed; a folder is seen only when its write is complete."""
    for name, table in tables.items():
        table.write.mode("overwrite").option("compression", codec).json(f"{path}/{name}")


def read_whole(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a stored analysis with given schemas; fields that a file lacks are null, broken lines are left out."""
    return {name: spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{path}/{name}") for name, schema in schemas.items()}


def write_records(table: DataFrame, path: str, key: str, partitions: int) -> None:
    """Records sorted by key within ranges, so that few row groups of few files hold any key."""
    table.repartitionByRange(partitions, key).sortWithinPartitions(key).write.mode("overwrite").option("parquet.block.size", str(1 << 20)).parquet(path)


def read_records(spark: SparkSession, path: str, key: str, wanted: list, most: int = 1000) -> DataFrame:
    """Records of given keys, in one read with the keys pushed down to the files; more than ``most`` keys raise."""
    if len(wanted) > most:
        raise ValueError(f"{len(wanted)} keys are more than {most}; join instead")
    return spark.read.parquet(path).where(F.col(key).isin(list(wanted)))


def bounded(rows: DataFrame, order: list, size: str, budget: int = 20_000, most: int = 1000) -> DataFrame:
    """The first rows whose sizes (a column of bytes) fit a budget, with truncated: whether more follow.

    At most ``most`` + 1 rows are looked at, so the running sum is over a page and not over the table.
    """
    page = rows.orderBy(*order).limit(most + 1)
    upto = W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = page.withColumns({"__upto": F.sum(size).over(upto), "__n": F.row_number().over(W.orderBy(*order))})
    kept = summed.withColumn("__fits", (F.col("__upto") <= budget) & (F.col("__n") <= most))
    return kept.withColumn("truncated", F.min(F.col("__fits").cast("int")).over(W.partitionBy()) == 0).where("__fits").drop("__upto", "__n", "__fits")


def unpack(data: bytes):
    """The value of a MessagePack text, read with a stack of its own."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("cut off")
        at += n
        return data[at - n : at]

    fixed = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    lengths = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I", 0xD9: ">B", 0xDA: ">H", 0xDB: ">I", 0xDC: ">H", 0xDD: ">I", 0xDE: ">H", 0xDF: ">I"}
    root: list = []
    stack: list[list] = [[root, 1, None, False]]  # container, items left, key, whether a key is due
    while stack:
        top = stack[-1]
        if top[1] == 0:
            stack.pop()
            continue
        mark = take(1)[0]
        opened = None
        if mark <= 0x7F:
            value = mark
        elif mark >= 0xE0:
            value = mark - 256
        elif mark <= 0x9F:
            value, opened = ({}, mark & 15) if mark <= 0x8F else ([], mark & 15)
        elif mark <= 0xBF:
            value = take(mark & 31).decode()
        elif mark in (0xC0, 0xC2, 0xC3):
            value = {0xC0: None, 0xC2: False, 0xC3: True}[mark]
        elif mark in fixed:
            value = struct.unpack(fixed[mark], take(struct.calcsize(fixed[mark])))[0]
        elif mark in lengths:
            n = struct.unpack(lengths[mark], take(struct.calcsize(lengths[mark])))[0]
            if mark <= 0xC6:
                value = take(n)
            elif mark <= 0xDB:
                value = take(n).decode()
            else:
                value, opened = ([], n) if mark <= 0xDD else ({}, n)
        else:
            raise ValueError(f"mark {mark:#x}")
        if isinstance(top[0], dict):
            if not top[3]:
                top[2], top[3] = value, True
                continue
            top[0][top[2]] = value
            top[3] = False
        else:
            top[0].append(value)
        top[1] -= 1
        if opened is not None:
            stack.append([value, opened, None, False])
    return root[0]


def interned_nodes(files: DataFrame) -> DataFrame:
    """Nodes of index files (path, content): path, position, name, kind and parent.

    Such a file is a MessagePack list: first the table of strings, then rows of (name, kind, parent), in
    which a negative number -n stands for the n-th string. Files that can't be read give one row with error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    strings, nodes = unpack(content)
                    word = lambda x: strings[-x - 1] if isinstance(x, int) and x < 0 else x
                    rows += [(path, i, *(None if x is None else str(word(x)) for x in n[:3]), None) for i, n in enumerate(nodes)]
                except (ValueError, TypeError, IndexError, KeyError, UnicodeDecodeError, RecursionError) as error:
                    rows.append((path, None, None, None, None, str(error) or type(error).__name__))
            columns = zip(*rows) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), *(pa.string(),) * 4))], names=["path", "position", "name", "kind", "parent", "error"])

    return files.where("content is not null").select("path", "content").mapInArrow(run, "path string, position int, name string, kind string, parent string, error string")
