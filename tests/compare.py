"""Runs queries on Spark and their SQL on DuckDB and compares rows; also a command: python tests/compare.py SF_DIR [NAME...]."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path


def connect(root: str):
    import duckdb

    con = duckdb.connect()
    for path in Path(root).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(value):
    """One spelling for values of both engines."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if type(value).__name__ == "Row":
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    if type(value).__name__ == "Decimal":
        return plain(float(value)) if value % 1 else int(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, root: str, name: str, build, sql: str) -> str:
    """'' if equal, else what differs."""
    df = build(spark, root)
    got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if got != want:
        some = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
        return f"{len(got)} rows against {len(want)}; only Spark {some[0]}; only SQL {some[1]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as entry
    from stratagraph.session import get_spark

    spark = get_spark(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    root, names = sys.argv[1], sys.argv[2:]
    con, sqls, builds = connect(root), entry.oracle_sql(), entry.queries()
    for name in names or builds:
        start = time.time()
        try:
            if name in sqls:
                said = compare(spark, con, root, name, builds[name], sqls[name]) or "ok"
            else:
                said = f"rows {builds[name](spark, root).count()} (no SQL)"
        except Exception as error:
            said = "ERROR " + str(error).strip()[:600]
        print(f"{name}: {said} [{time.time() - start:.1f}s]", flush=True)
