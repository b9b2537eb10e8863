"""Results in the shape clients expect.

Row results stay tables, and so do ``series_lists`` (a row per series) and
``dimension_summary`` (a row per dimension). The shapes that are one JSON text are for
answers that have been aggregated: they hold the whole table in one row. Other results
are written with ``write_json``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, FractionalType, IntegralType, StringType

from forecourt.functions.measures import quoted
from forecourt.functions.text import text_or
from forecourt.operators.filters import require_columns
from forecourt.operators.ordering import positions
from forecourt.sources.schemas import visible_columns


def _gathered(df: DataFrame) -> DataFrame:
    """One row holding the list of all rows in their order."""
    position = F.monotonically_increasing_id()
    rows = df.select(position.alias("fc_at"), F.struct("*").alias("row"))
    listed = rows.agg(
        F.array_sort(
            F.collect_list(F.struct("fc_at", "row")),
            lambda a, b: F.when(a["fc_at"] < b["fc_at"], -1).otherwise(1),
        ).alias("rows")
    )
    return listed.select(F.transform("rows", lambda r: r["row"]).alias("rows"))


def columnar_json(df: DataFrame) -> DataFrame:
    """One JSON text: the row count, one list per column, and column metadata.

    A null text is ``""``, a null number ``null``, a date its ISO form.
    """
    shown = set(visible_columns(df))
    metadata = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(i).alias("column_index"),
                F.lit(f.dataType.simpleString()).alias("column_dtype"),
                F.lit(f.name in shown).alias("visible"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, DateType))}

    def listed(name: str) -> Column:
        def value(row: Column) -> Column:
            return text_or(row[name], "") if name in texts else row[name]

        return F.transform("rows", value).alias(name)

    body = F.struct(
        F.size("rows").alias("itemsCount"),
        *[listed(c) for c in df.columns],
        metadata.alias("metadata"),
    )
    return _gathered(df).select(
        F.to_json(body, {"ignoreNullFields": "false"}).alias("json")
    )


def _dimension_text(df: DataFrame, name: str) -> Column:
    number = isinstance(df.schema[name].dataType, IntegralType)
    return text_or(F.col(name), "0" if number else "")


def dimension_summary(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Per dimension of a grouped table, its place and its number of distinct values."""
    require_columns(df, dimensions)
    texts = df.select(*[_dimension_text(df, d).alias(d) for d in dimensions])
    tall = texts.unpivot([], list(dimensions), "dimension", "text")
    places = F.create_map(*[F.lit(v) for d in enumerate(dimensions) for v in reversed(d)])
    return tall.groupBy("dimension").agg(
        F.count_distinct("text").alias("distinct_count")
    ).select("dimension", places[F.col("dimension")].alias("column_index"), "distinct_count")


def grouped_response(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """One row with metadata, dimensions, measures and the total of a grouped table."""
    require_columns(df, dimensions)
    measures = [c for c in df.columns if c not in dimensions]
    metadata = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(i).alias("column_index"))
            for i, c in enumerate(df.columns)
        ]
    )
    rows = df.select(*[_dimension_text(df, d).alias(d) for d in dimensions], *measures)

    def dimension(i: int, name: str) -> Column:
        data = F.transform("rows", lambda r: r[name])
        return F.struct(
            F.lit(name).alias("label"),
            F.lit(name).alias("column_name"),
            F.lit(i).alias("column_index"),
            F.size(F.array_distinct(data)).alias("distinct_count"),
            data.alias("data"),
        )

    return _gathered(rows).select(
        metadata.alias("metadata"),
        F.array(*[dimension(i, d) for i, d in enumerate(dimensions)]).alias("dimensions"),
        F.transform(
            "rows", lambda r: F.struct(*[r[m].alias(m) for m in measures])
        ).alias("data"),
        F.size("rows").alias("total_count"),
    )


def json_pages(df: DataFrame, order: Sequence, rows_per_page: int = 1000) -> DataFrame:
    """A result of any size in pages: ``page`` (from 0), ``first`` (position), ``items``, ``json``.

    ``json`` is the page's rows as one text, a list of objects with all columns, nulls included.
    Rows are numbered in order (see ``positions``), so pages are the same whenever they are asked
    for, and no task holds more than the rows of a page.
    """
    if rows_per_page < 1:
        raise ValueError("a page needs at least one row")
    numbered = positions(df, order, "fc_position")
    row = F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row")
    page = F.call_function("div", F.col("fc_position"), F.lit(rows_per_page)).alias("page")
    listed = numbered.select(page, F.struct(F.col("fc_position").alias("at"), row).alias("entry"))
    gathered = listed.groupBy("page").agg(F.array_sort(
        F.collect_list("entry"), lambda a, b: F.when(a["at"] < b["at"], -1).otherwise(1)
    ).alias("entries"))
    return gathered.select(
        "page", (F.col("page") * rows_per_page).alias("first"), F.size("entries").alias("items"),
        F.to_json(F.transform("entries", lambda e: e["row"]), {"ignoreNullFields": "false"})
        .alias("json"))


def series_lists(series: DataFrame, x: str) -> DataFrame:
    """One row per series with its points in order of x."""
    require_columns(series, ["label", x, "value"])
    return (
        series.groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct(x, "value"))).alias("points"))
    )


def whole_numbers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Truncate fractional columns to whole numbers, as clients show them."""
    chosen = columns or [
        f.name for f in df.schema.fields if isinstance(f.dataType, FractionalType)
    ]
    return df.withColumns({c: F.col(c).cast("bigint") for c in chosen})
