"""Run queries on Spark and their SQL on DuckDB over the same tables and compare the rows.

    python -m vacancylake.checks.compare SF_DIR [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

from vacancylake.checks.oracle import ORACLE
from vacancylake.checks.queries import QUERIES
from vacancylake.session import local_session


def _plain(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return value


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def differences(spark, con, sf_dir: str, name: str) -> tuple[str, int, float, float]:
    """``("", rows, seconds on Spark, seconds on DuckDB)``, or what differs in place of ``""``."""
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    middle = time.time()
    if name not in ORACLE:
        return "", len(rows), middle - start, 0.0
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    end = time.time()
    problem = ""
    if sorted(columns) != sorted(df.columns):
        problem = f"columns {sorted(df.columns)} against {sorted(columns)}"
    else:
        got, want = rows_of(df.columns, rows), rows_of(columns, expected)
        if got != want:
            more, less = got - want, want - got
            problem = (
                f"{sum(more.values())} rows too many {list(more)[:2]}, "
                f"{sum(less.values())} missing {list(less)[:2]}"
            )
    return problem, len(rows), middle - start, end - middle


def main(sf_dir: str, names: list[str]) -> int:
    spark, con, bad = local_session(8), connect(sf_dir), 0
    for name in names or QUERIES:
        try:
            problem, n, spark_time, sql_time = differences(spark, con, sf_dir, name)
        except Exception as error:
            problem, n, spark_time, sql_time = f"{type(error).__name__}: {str(error)[:600]}", 0, 0, 0
        bad += bool(problem)
        state = problem[:900] or ("ok" if name in ORACLE else "no SQL")
        print(f"{name:34s} {n:8d} {spark_time:6.1f}s {sql_time:6.1f}s {state}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
