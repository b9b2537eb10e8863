"""Writing listing tables, one task per partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from forecourt.sources.readers import DATE_FORMAT, SEPARATOR, strip_quotes


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``;``-separated files with a header."""
    df.write.csv(path, sep=SEPARATOR, header=True, dateFormat=DATE_FORMAT, mode=mode)


def write_extract(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a database extract without any double quotes in it."""
    write_csv(strip_quotes(df), path, mode)


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """Write Parquet, clustered by the partition columns so files stay few and large.

    A hot partition value is spread over several tasks: adaptive execution splits an
    over-sized shuffle partition of a ``rebalance``.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.parquet(path, mode=mode, partitionBy=list(partition_by) or None)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write one JSON object per row."""
    df.write.json(path, mode=mode, dateFormat=DATE_FORMAT, ignoreNullFields=False)
