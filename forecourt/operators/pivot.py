"""Pivots, and series for charts."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from forecourt.functions.measures import quoted
from forecourt.functions.text import text_or
from forecourt.operators.filters import require_columns

NO_LABEL = "Unknown"
NO_VALUE = "null"
CELLS = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "count": F.count}


def pivot_values(df: DataFrame, column: str) -> list[str]:
    """The distinct values of a column as Spark writes them, in order, null last as ``null``.

    Runs a query, as values must be known before they can become columns.
    """
    value = F.col(quoted(column))
    found = df.select(value.alias("v"), text_or(value, NO_VALUE).alias("name")).distinct()
    return [row.name for row in found.orderBy(F.asc_nulls_last("v")).collect()]


def pivot_names(df: DataFrame, column: str, values: Sequence[Any]) -> list[str]:
    """Given pivot values as Spark writes them in the column's type; texts are names already."""
    field = StructField("v", df.schema[column].dataType)
    given = [(v,) for v in values if not isinstance(v, str)]
    frame = df.sparkSession.createDataFrame(given, StructType([field]))
    texts = iter([row[0] for row in frame.select(text_or(F.col("v"), NO_VALUE)).collect()])
    return [v if isinstance(v, str) else next(texts) for v in values]


def _checked_cell(cell: str) -> None:
    if cell not in CELLS:
        raise ValueError(f"unknown cell function {cell!r}; known: {sorted(CELLS)}")


def pivot(
    grouped: DataFrame,
    index: Sequence[str],
    column: str,
    value: str,
    values: Sequence[Any],
    cell: str = "sum",
) -> DataFrame:
    """Spread ``value`` over one column per pivot value; gaps are 0.

    Rows of the grouped table that share a cell are combined by ``cell``. A null pivot
    value goes by the name ``null``. Raises if a pivot value is also the name of an index
    column.
    """
    require_columns(grouped, [*index, column, value])
    _checked_cell(cell)
    named = pivot_names(grouped, column, values)
    clash = sorted({n.lower() for n in named} & {c.lower() for c in index})
    if clash:
        raise ValueError(f"pivot values are names of index columns: {', '.join(clash)}")
    keys = [F.col(quoted(c)) for c in index]
    keyed = grouped.select(
        *keys, text_or(F.col(quoted(column)), NO_VALUE).alias("fc_pivot"),
        F.col(quoted(value)).alias("fc_cell"),
    )
    wide = keyed.groupBy(*keys).pivot("fc_pivot", named).agg(CELLS[cell]("fc_cell"))
    filled = [F.coalesce(F.col(quoted(n)), F.lit(0).cast(wide.schema[n].dataType)).alias(n)
              for n in named]
    return wide.select(*keys, *filled)


def pivot_objects(
    grouped: DataFrame, index: Sequence[str], column: str, value: str, cell: str = "sum",
    name: str = "cells",
) -> DataFrame:
    """One row per index key, its cells as one VARIANT object from pivot value to value.

    Like ``pivot``, but the pivot values need not be known: nothing is asked for while the plan is
    built, and keys have only the cells they have rows for. A null pivot value goes by the name
    ``null``. An object holds as many cells as one key has pivot values. Read a cell with
    ``variant_get``.
    """
    require_columns(grouped, [*index, column, value])
    _checked_cell(cell)
    if name in index:
        raise ValueError(f"{name} is the name of an index column")
    keys = [F.col(quoted(c)) for c in index]
    cells = grouped.select(
        *keys, text_or(F.col(quoted(column)), NO_VALUE).alias("fc_pivot"),
        F.col(quoted(value)).alias("fc_cell"),
    ).groupBy(*keys, "fc_pivot").agg(CELLS[cell]("fc_cell").alias("fc_cell"))
    entries = F.collect_list(F.struct("fc_pivot", "fc_cell"))
    return cells.groupBy(*keys).agg(
        F.to_variant_object(F.map_from_entries(F.array_sort(entries))).alias(name))


def labels(df: DataFrame, x: str) -> DataFrame:
    """Sorted distinct axis labels; a null is ``Unknown``."""
    return (
        df.select(text_or(F.col(quoted(x)), NO_LABEL).alias("x_label"))
        .distinct()
        .orderBy("x_label")
    )


def _checked_base(base: Sequence[str]) -> None:
    clash = sorted({"label", "value"} & {c.lower() for c in base})
    if clash:
        raise ValueError(f"a series has columns of its own by the name of {', '.join(clash)}")


def _number(column: Column) -> Column:
    return F.coalesce(column.try_cast("double"), F.lit(0.0))


def series(pivoted: DataFrame, base: Sequence[str]) -> DataFrame:
    """Every column outside the base as a series: rows of (base, label, value).

    Values are doubles; nulls and text that is no number are 0.
    """
    require_columns(pivoted, base)
    _checked_base(base)
    spread = [c for c in pivoted.columns if c not in base]
    keys = [F.col(quoted(c)) for c in base]
    numbers = pivoted.select(*keys, *[_number(F.col(quoted(c))).alias(c) for c in spread])
    return numbers.unpivot(keys, [F.col(quoted(c)) for c in spread], "label", "value")


def cell_series(
    grouped: DataFrame,
    base: Sequence[str],
    column: str,
    value: str,
    values: Sequence[Any] | None = None,
    cell: str = "sum",
) -> DataFrame:
    """The series of a pivot, without the pivot: rows of (base, label, value).

    Every base has a row for every label (of ``values``, or all that occur); gaps are 0. One
    lazy plan: the grouped table is reduced to cells, each base gets the array of labels, and
    the cells are joined to them.
    """
    require_columns(grouped, [*base, column, value])
    _checked_cell(cell)
    _checked_base(base)
    at = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(base)])
    cells = (
        grouped.select(at.alias("fc_at"), text_or(F.col(quoted(column)), NO_VALUE).alias("label"),
                       F.col(quoted(value)).alias("fc_cell"))
        .groupBy("fc_at", "label")
        .agg(_number(CELLS[cell]("fc_cell")).alias("value"))
    )
    if values is None:
        every = cells.agg(F.collect_set("label")).scalar()
    else:
        every = F.array(*[F.lit(n) for n in pivot_names(grouped, column, values)])
    grid = cells.select("fc_at").distinct().withColumn("label", F.explode(every.cast("array<string>")))
    return grid.join(cells, ["fc_at", "label"], "left").select(
        *[F.col(f"fc_at.c{i}").alias(c) for i, c in enumerate(base)],
        "label", F.coalesce("value", F.lit(0.0)).alias("value"))


def grouped_series(df: DataFrame, x: str, value: str, others: Sequence[str]) -> DataFrame:
    """A grouped table as series: rows of (label, x, value).

    The label joins the other group columns; values are truncated to whole numbers of
    at least 0.
    """
    require_columns(df, [x, value, *others])
    _checked_base([x])
    # concat_ws of nothing is the empty label.
    label = F.concat_ws(", ", *[text_or(F.col(quoted(c)), NO_LABEL) for c in others])
    number = F.coalesce(F.col(quoted(value)).try_cast("bigint"), F.lit(0))
    return df.select(
        label.alias("label"),
        F.col(quoted(x)),
        F.greatest(number, F.lit(0)).cast("bigint").alias("value"),
    )
