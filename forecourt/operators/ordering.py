"""Sorting, limits and distinct rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Order(NamedTuple):
    """A sort key; nulls come last in either direction."""

    column: str
    asc: bool = True

    def to_column(self) -> Column:
        direction = F.asc_nulls_last if self.asc else F.desc_nulls_last
        return direction(self.column)


def orders_of(requested: Sequence[Order | tuple | dict | str]) -> list[Order]:
    """Accept orders as names, (name, asc) pairs or ``{"column":, "asc":}``."""
    found = []
    for entry in requested:
        if isinstance(entry, str):
            found.append(Order(entry))
        elif isinstance(entry, dict):
            found.append(Order(entry["column"], entry.get("asc", True)))
        else:
            found.append(Order(*entry))
    return found


def sort_by(df: DataFrame, order: Sequence) -> DataFrame:
    """Sort by the requested keys, nulls last; unchanged when none is given."""
    keys = [o.to_column() for o in orders_of(order)]
    return df.orderBy(*keys) if keys else df


def first_rows(
    df: DataFrame, limit: int, stable_key: Sequence[str] | None = None
) -> DataFrame:
    """The first rows by a stable key, each task keeping only ``limit`` of them.

    Without a key any ``limit`` rows, which lets the scan stop early.
    """
    if not stable_key:
        return df.limit(limit)
    return df.orderBy(*[F.asc_nulls_last(c) for c in stable_key]).limit(limit)


def top_k(df: DataFrame, order: Sequence, k: int) -> DataFrame:
    """The k best rows by the requested order."""
    return sort_by(df, order).limit(k)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, sorted, null last."""
    return df.select(column).distinct().orderBy(F.asc_nulls_last(column))


def distinct_on(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row, any, per combination of the columns."""
    return df.dropDuplicates(list(columns))


RANGES = 64


def positions(df: DataFrame, order: Sequence, name: str = "position", ranges: int = RANGES) -> DataFrame:
    """Number the rows in the requested order, gapless from 0, without sorting all in one task.

    Rows with equal keys are in the order of a hash of all their columns, so that the numbers
    do not depend on how the table is stored. Up to ``ranges`` rows, found by their hashes, part
    the table into ranges; these are counted, sorted by themselves, and numbered from where the
    one before ends. A key that most rows share is parted, too; equal rows are not.
    """
    keys = orders_of(order)
    sortable = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    # Inside a struct a null is a value like any other; here nulls come last in either direction.
    numbered = df.select(
        F.struct("*").alias("fc_row"),
        F.struct(*[F.col(k.column).alias(f"k{i}") for i, k in enumerate(keys)],
                 F.xxhash64(*sortable).alias("tie")).alias("fc_key"))
    numbered = numbered.withColumn("fc_draw", F.xxhash64("fc_key.tie", F.lit(17)))
    splitters = numbered.groupBy(F.pmod("fc_draw", F.lit(ranges)).alias("fc_bucket")).agg(
        F.min_by("fc_key", "fc_draw").alias("fc_at")).agg(F.collect_list("fc_at")).scalar()

    def not_after(split: Column) -> Column:
        own = F.col("fc_key")
        found = split["tie"] <= own["tie"]
        for i, key in reversed(list(enumerate(keys))):
            a, b = split[f"k{i}"], own[f"k{i}"]
            ahead = a < b if key.asc else a > b
            ahead = F.coalesce(ahead, a.isNotNull() & b.isNull())
            found = ahead | (a.eqNullSafe(b) & found)
        return found

    ranged = numbered.withColumn("fc_splitters", splitters).withColumn(
        "fc_range", F.size(F.filter("fc_splitters", not_after))).drop("fc_splitters", "fc_draw")
    counts = ranged.groupBy("fc_range").agg(F.count("*").alias("fc_n"))
    earlier = Window.orderBy("fc_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "fc_range", F.coalesce(F.sum("fc_n").over(earlier), F.lit(0)).alias("fc_offset"))
    inside = Window.partitionBy("fc_range").orderBy(
        *[(F.asc_nulls_last if k.asc else F.desc_nulls_last)(f"fc_key.k{i}")
          for i, k in enumerate(keys)], "fc_key.tie")
    placed = ranged.withColumn("fc_place", F.row_number().over(inside))
    # One row a range.
    return placed.join(F.broadcast(offsets), "fc_range").select(
        "fc_row.*", (F.col("fc_offset") + F.col("fc_place") - 1).alias(name))
