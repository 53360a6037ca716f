"""Runs queries on Spark and their SQL on DuckDB and compares the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from helmtrace.checks.oracle import ORACLE
from helmtrace.checks.queries import QUERIES
from helmtrace.session import local_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return v
        return float(v) if isinstance(v, (int, float)) else str(v)

    ordered = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in ordered.itertuples(index=False)), key=repr)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(set(spark_rows.columns) ^ set(sql_rows.columns))}"
    kinds = [
        (c, str(spark_rows[c].dtype), str(sql_rows[c].dtype))
        for c in spark_rows.columns
        if len(spark_rows) and spark_rows[c].dtype.kind in "iuf" and sql_rows[c].dtype.kind in "iuf"
        and spark_rows[c].dtype.kind != sql_rows[c].dtype.kind
    ]
    if kinds:
        return f"types {kinds}"
    a, b = rows(spark_rows), rows(sql_rows)
    if len(a) != len(b):
        return f"{len(a)} rows, SQL has {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main(sf_dir: str, names: list[str]) -> int:
    spark, con, failed = local_session(), connect(sf_dir), 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - start
            verdict = difference(got, con.sql(ORACLE[name]).df()) if name in ORACLE else "no SQL"
        except Exception as error:  # report and go on with the next query
            got, took, verdict = [], time.time() - start, f"error {str(error)[:600]}"
        if verdict and verdict != "no SQL":
            failed += 1
        print(f"{name:32s} {len(got):7d} rows {took:6.2f} s  {verdict or 'same'}"[:900], flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
