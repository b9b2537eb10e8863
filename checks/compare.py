"""Run registered queries next to their SQL and report differences.

Usage: python -m checks.compare [data directory] [query ...]
"""

from __future__ import annotations

import datetime as dt
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLES
from checks.queries import QUERIES
from forecourt import build_session


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.date().isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    found = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(found, key=lambda row: [(v is None, str(type(v)), v) if v is not None
                                          else (True, "", 0) for v in row])


def differences(spark: SparkSession, connection, sf_dir: str, name: str) -> list[str]:
    """What differs between a query and its SQL; empty when they agree."""
    got = QUERIES[name](spark, sf_dir)
    expected = connection.sql(ORACLES[name])
    if sorted(got.columns) != sorted(expected.columns):
        return [f"columns {got.columns} != {expected.columns}"]
    ours = _rows(got.columns, got.collect())
    theirs = _rows(expected.columns, expected.fetchall())
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows != {len(theirs)}"]
    found = []
    for mine, other in zip(ours, theirs):
        if mine != other or [type(v) for v in mine] != [type(v) for v in other]:
            found.append(f"{sorted(got.columns)}\n    {mine}\n    {other}")
    return found


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = tables(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        if name not in ORACLES:
            print(f"{name}: no SQL, {QUERIES[name](spark, sf_dir).count()} rows")
            continue
        try:
            found = differences(spark, connection, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        verdict = "ok" if not found else f"{len(found)} DIFFER\n  {found[0]}"
        print(f"{name}: {verdict} ({time.time() - start:.1f} s)", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
