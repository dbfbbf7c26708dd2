"""Run registered queries and their SQL side by side: python -m catalog.compare [sf] [name...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from catalog.oracle import statements
from catalog.queries import registered

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        if Path(f"{sf}/{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value))
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark: SparkSession, sf: str, name: str) -> str | None:
    """None if the query agrees with its SQL, else what differs."""
    frame = registered()[name](spark, sf)
    mine = rows_of(frame.columns, frame.collect())
    sql = statements().get(name)
    if sql is None:
        return None if mine else "no rows"
    result = duck(sf).execute(sql)
    theirs_columns = [d[0] for d in result.description]
    if sorted(frame.columns) != sorted(theirs_columns):
        return f"columns {sorted(frame.columns)} against {sorted(theirs_columns)}"
    theirs = rows_of(theirs_columns, result.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(wrong)} of {len(mine)} rows, first {wrong[0]}" if wrong else None


def main() -> int:
    from gapcast.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registered())
    spark, failed = local_session(8), 0
    for name in names:
        began = time.time()
        try:
            found = difference(spark, sf, name)
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        checked = "sql" if name in statements() else "rows"
        print(f"{'FAIL' if found else 'ok':5}{name:34}{checked:5}{time.time() - began:6.1f}s {found or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main())
