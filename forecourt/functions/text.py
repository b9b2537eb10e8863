"""Text predicates and keys."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.errors import SparkRuntimeException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def is_valid_pattern(pattern: str) -> bool:
    """Whether Spark's regular expression engine accepts the pattern.

    The check is a constant query, which Spark folds without starting a job.
    """
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("a Spark session is needed to check a pattern")
    try:
        spark.sql("SELECT '' RLIKE :p", args={"p": pattern}).collect()
    except SparkRuntimeException:
        return False
    return True


def like(column: Column, value: str) -> Column:
    """``*abc`` ends with, ``abc*`` starts with, anything else is a regex search.

    A leading star wins over a trailing one and all stars are removed. A pattern that
    is not a valid regular expression matches nothing.
    """
    plain = value.replace("*", "")
    if value.startswith("*"):
        return column.endswith(plain)
    if value.endswith("*"):
        return column.startswith(plain)
    if not is_valid_pattern(value):
        return F.lit(False)
    return column.rlike(value)


def any_like(columns: Iterable[str], value: str) -> Column:
    """Case-blind ``like`` that holds if any of the columns matches."""
    wanted = value.lower()
    return reduce(or_, [like(F.lower(F.col(c)), wanted) for c in columns])


def normalised(column: Column) -> Column:
    """Upper case, blanks removed: the key under which spellings count as one."""
    return F.upper(F.regexp_replace(column.cast("string"), " ", ""))


def text_or(column: Column, default: str) -> Column:
    """The value as text, or the default where it is null."""
    return F.coalesce(column.cast("string"), F.lit(default))
