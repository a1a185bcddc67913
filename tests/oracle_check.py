"""Run registered queries next to their SQL in DuckDB and compare rows; also usable from the shell."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def multiset(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda c: columns[c])
    return Counter(tuple(plain(r[c]) for c in order) for r in rows)


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    started = time.time()
    df = entry.queries()[name](spark, folder)
    columns, rows = df.columns, df.collect()
    took = time.time() - started
    started = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(rows)} rows, no SQL ({took:.1f} s)"
    result = con.execute(sql)
    wanted_columns = [d[0] for d in result.description]
    wanted = result.fetchall()
    note = f"{len(rows)} rows, {took:.1f} s; SQL {len(wanted)} rows, {time.time() - started:.1f} s"
    if sorted(columns) != sorted(wanted_columns):
        return False, f"columns {sorted(columns)} != {sorted(wanted_columns)}; {note}"
    got, want = multiset(columns, rows), multiset(wanted_columns, wanted)
    if got != want:
        return False, f"{note}; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    return True, note


if __name__ == "__main__":
    from clearway.session import get_session

    folder = sys.argv[1]
    session = get_session(master="local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    for query in sys.argv[2:] or entry.queries():
        try:
            ok, message = compare(session, connection, query, folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        print("ok  " if ok else "FAIL", query, message, flush=True)
