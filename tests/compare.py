"""Runs registered queries and their SQL side by side: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null" if value is None else "nan"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> str | None:
    left_columns, left = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    right_columns, right = canonical([c[0] for c in cursor.description], cursor.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}; first {left[:1]} {right[:1]}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        a, b = wrong[0]
        return f"{len(wrong)} of {len(left)} rows differ: " + "; ".join(
            f"{c}: {x[:300]} | {y[:300]}" for c, x, y in zip(left_columns, a, b) if x != y)
    return None


def main(argv: list[str]) -> int:
    from driftwood.catalog import REGISTRY
    from driftwood.session import get_session

    sf_dir = f"/root/testdata/{argv[0] if argv else 'sf0.01'}"
    spark = get_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in argv[1:] or list(REGISTRY):
        entry = REGISTRY[name]
        started = time.time()
        try:
            if entry.sql is None:
                problem = None if entry.build(spark, sf_dir).count() > 0 else "no rows"
            else:
                problem = differences(entry.build(spark, sf_dir), con, entry.sql)
        except Exception as error:  # noqa: BLE001 - the report shows it
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        rows = "" if entry.sql else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.2f}s{rows} {problem or ''}", flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
