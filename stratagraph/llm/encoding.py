"""Encoding of texts with a public byte-level vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm import transducer
from stratagraph.session import spread


def encode_texts(df: DataFrame, key: str, text: str, folder: str = transducer.FOLDER, name: str = transducer.NAME) -> DataFrame:
    """``key`` and ids (list of int) of each row's text, without special tokens; no shuffle.

    Null and empty texts give an empty list, strings of special tokens are ordinary text, a null key
    stays null and repeated rows stay repeated. Other columns, also one named ids, are ignored.
    """
    schema = f"key {df.schema[key].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer.load(folder, name).encode
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for value in batch.column(1):
                if value.is_valid:
                    flat += encode(value.as_py())
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    return spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, schema).withColumnRenamed("key", key)


def decode_ids(df: DataFrame, key: str, ids: str, folder: str = transducer.FOLDER, name: str = transducer.NAME) -> DataFrame:
    """``key`` and the text of each id list, decoded as a stream; a null list gives null, an empty one ''."""
    schema = f"key {df.schema[key].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = transducer.load(folder, name).bytes_of
        for batch in batches:
            texts = ["".join(transducer.decode_stream(v.as_py(), bytes_of)) if v.is_valid else None for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, schema).withColumnRenamed("key", key)


def count_tokens(df: DataFrame, text: str, carry: list[str], folder: str = transducer.FOLDER, name: str = transducer.NAME) -> DataFrame:
    """The columns ``carry`` and tokens (long) of each row's text; null and empty texts have 0."""
    kept = df.select(F.col(text).alias("__text"), *carry)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry), "tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer.load(folder, name).encode
        for batch in batches:
            counts = [len(encode(v.as_py())) if v.is_valid else 0 for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], names=[*carry, "tokens"])

    return spread(kept).mapInArrow(run, schema)
