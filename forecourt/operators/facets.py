"""Facet lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.functions.text import normalised
from forecourt.operators.filters import require_columns
from forecourt.operators.ordering import distinct_values

# The facets offered, and the text that stands for an unknown value.
FACETS = ("make", "engine", "gearbox", "source")
UNKNOWN = "NOTFOUND"


def facet(df: DataFrame, column: str) -> DataFrame:
    """Known distinct values of a facet column, sorted."""
    if column not in FACETS:
        raise ValueError(f"unknown facet {column!r}; known: {FACETS}")
    require_columns(df, [column])
    # A null is not unequal to the unknown text, so it goes too.
    return distinct_values(df.filter(F.upper(column) != UNKNOWN), column)


def models_of(df: DataFrame, make: str) -> DataFrame:
    """Distinct models of a make, sorted."""
    require_columns(df, ["make", "model"])
    of_make = df.filter((F.col("make") == make) & F.col("model").isNotNull())
    return distinct_values(of_make, "model")


def distinct_spellings(df: DataFrame, column: str) -> DataFrame:
    """Distinct (value, key) pairs, the key being the value in upper case and without
    blanks; sorted by value, null last."""
    require_columns(df, [column])
    pairs = df.select(
        F.col(column).alias("value"), normalised(F.col(column)).alias("key")
    ).distinct()
    return pairs.orderBy(F.asc_nulls_last("value"))


#: Collations under which spellings count as one: ASCII and Unicode case, or only looks.
BLIND_TO_CASE = "UTF8_LCASE"
BLIND_TO_CASE_UNICODE = "UNICODE_CI"
BLIND_TO_CASE_AND_ACCENTS = "UNICODE_CI_AI"


def collated(df: DataFrame, columns: Sequence[str], collation: str = BLIND_TO_CASE) -> DataFrame:
    """The table with text columns under a collation: groups, joins and filters compare by it."""
    require_columns(df, columns)
    return df.withColumns({c: F.collate(c, collation) for c in columns})


def collated_values(df: DataFrame, column: str, collation: str = BLIND_TO_CASE) -> DataFrame:
    """Per value, spellings counting as one: ``value`` (the least by bytes), ``spellings``, ``listings``.

    Sorted by value, null last. Spellings are counted before they are put together, so that
    a value most listings share arrives as its few spellings.
    """
    require_columns(df, [column])
    plain = F.collate(column, "UTF8_BINARY")
    counted = df.groupBy(plain.alias("value")).agg(F.count(F.lit(1)).alias("listings"))
    together = counted.groupBy(F.collate("value", collation).alias("key")).agg(
        F.min("value").alias("value"), F.count("value").alias("spellings"),
        F.sum("listings").alias("listings"))
    return together.select("value", "spellings", "listings").orderBy(F.asc_nulls_last("value"))


def listings_spelt(
    df: DataFrame, wishes: DataFrame, columns: Sequence[str], collation: str = BLIND_TO_CASE
) -> DataFrame:
    """Listings whose columns equal those of some row of ``wishes``, spellings counting as one."""
    require_columns(df, columns)
    require_columns(wishes, columns)
    own = wishes.select(*[F.collate(c, collation).alias(f"fc_{c}") for c in columns]).distinct()
    same = [F.collate(c, collation) == F.col(f"fc_{c}") for c in columns]
    return df.join(own, same, "left_semi")
