"""Runs registered queries and their SQL twins side by side.

`python tests/oracle.py [folder] [name ...]` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (float(f"{value:.9g}") + 0.0)
    if isinstance(value, Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, bool):
        return value
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def _table(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str, folder: str) -> str:
    """Empty text when both sides agree, else what differs."""
    frame = query(spark, folder)
    left_names, left = _table(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    right_names, right = _table([c[0] for c in cursor.description], cursor.fetchall())
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if left != right:
        more, less = left - right, right - left
        return (f"rows {sum(left.values())} / {sum(right.values())}, only spark {sum(more.values())}: "
                f"{list(more)[:2]}, only sql {sum(less.values())}: {list(less)[:2]}")
    return "" if left else "both empty"


def main() -> int:
    from tripweave.plans.registry import ORACLE, QUERIES
    from tripweave.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(ORACLE)
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), 0
    for name in names:
        start = time.time()
        try:
            result = compare(spark, con, name, QUERIES[name], ORACLE[name], folder)
        except Exception as error:  # one broken query must not hide the others
            result = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(result)
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if not result else result}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
