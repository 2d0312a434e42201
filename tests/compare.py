"""Run registered queries next to their SQL: python tests/compare.py [folder] [names...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool) or isinstance(x, str):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 6)
    return str(x)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))


def difference(left, right) -> str | None:
    """None when both (columns, rows) agree, else a short description."""
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def check(spark, con, folder: str, name: str) -> tuple[str | None, int, float, float]:
    start = time.time()
    df = entry.queries()[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    spark_seconds = time.time() - start
    got = normalise(df.columns, rows)
    start = time.time()
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = normalise(columns, cur.fetchall())
    return difference(got, want), len(rows), spark_seconds, time.time() - start


if __name__ == "__main__":
    from arealcast.session import get_spark

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = get_spark(
        **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), []
    for name in names:
        if name not in entry.oracle_sql():
            print(f"{name:32s} no SQL, rows {entry.queries()[name](spark, folder).count()}")
            continue
        try:
            diff, n, a, b = check(spark, con, folder, name)
        except Exception as exc:  # noqa: BLE001
            diff, n, a, b = f"{type(exc).__name__}: {" ".join(str(exc).split())[:300]}", -1, 0.0, 0.0
        print(f"{name:32s} rows {n:7d} spark {a:6.2f}s sql {b:6.2f}s {'ok' if diff is None else 'DIFF ' + diff}", flush=True)
        if diff:
            failed.append(name)
    print("failed:", failed)
