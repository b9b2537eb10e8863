"""Bins: ordered half-open intervals over one column."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from forecourt.functions.measures import Measure, is_whole, quoted
from forecourt.operators.filters import require_columns
from forecourt.operators.ranks import COUNT, VALUE, measures_of_counts, slice_of, value_counts
from forecourt.operators.running import UPTO, last_before, measured_runs, running_counts

BIN_FIELDS = "column string, start int, end int, category string, index int"

BIN_MEASURES = (
    Measure("min", "min"),
    Measure("max", "max"),
    Measure("count", "count"),
    Measure("mean", "mean"),
    Measure("median", "median"),
    Measure("rsd", "rsd_percent"),
)


class Bin(NamedTuple):
    """Values from start (included) to end (excluded)."""

    start: int
    end: int
    category: str


def checked(bins: Sequence[Bin]) -> list[Bin]:
    """The bins in order of start; raises when empty, reversed or overlapping."""
    if not bins:
        raise ValueError("no bins given")
    ordered = sorted(bins, key=lambda b: (b.start, b.end))
    for b in ordered:
        if b.start > b.end:
            raise ValueError(f"bin starts after its end: {b}")
    for left, right in zip(ordered, ordered[1:]):
        if right.start < left.end:
            raise ValueError(f"bins overlap: {left} and {right}")
    return ordered


def add_bin(bins: Sequence[Bin], new: Bin) -> list[Bin]:
    """The bins with one more, in order; raises if it overlaps any."""
    return checked([*bins, new])


def bins_frame(spark: SparkSession, column: str, bins: Sequence[Bin]) -> DataFrame:
    """The bins as a table ``(column, start, end, category, index)``."""
    rows = [(column, *b, i) for i, b in enumerate(checked(bins))]
    return spark.createDataFrame(rows, BIN_FIELDS)


def overlapping(bins: DataFrame) -> DataFrame:
    """Bins of a table that are reversed or run into the next one of their column.

    The next start is looked for in slices of starts; that of the last bin of a slice is the first
    one of the next slice.
    """
    sliced = bins.selectExpr("*", f"{slice_of('start', bins.schema['start'].dataType)} AS fc_slice")
    return bins.sparkSession.sql(
        """
        WITH followed AS (
          SELECT *, lead(start) OVER (PARTITION BY column, fc_slice ORDER BY start, end) AS fc_here
          FROM {sliced}
        ),
        slices AS (
          SELECT column AS its_column, fc_slice AS its_slice, min(start) AS fc_first
          FROM {sliced} GROUP BY column, fc_slice
        ),
        places AS (
          SELECT *, lead(fc_first) OVER (PARTITION BY its_column ORDER BY its_slice) AS fc_later
          FROM slices
        )
        SELECT *, coalesce(fc_here, fc_later) AS next_start
        FROM followed JOIN places ON column = its_column AND fc_slice = its_slice
        """,
        sliced=sliced,
    ).select(*bins.columns, "next_start").filter(
        (F.col("start") > F.col("end")) | (F.col("next_start") < F.col("end")))


def numbered_bins(bins: DataFrame, column: str) -> DataFrame:
    """The bins of a table that are of one column, ``index`` being their place in the order of starts.

    Their starts must differ.
    """
    own = bins.filter(F.col("column") == column)
    starts = running_counts(
        value_counts(own, [], "start"), bins.schema["start"].dataType)
    return own.drop("index").join(
        starts.selectExpr(f"{VALUE} AS start", f"cast({UPTO} - 1 AS int) AS index"), "start").select(
        "column", "start", "end", "category", "index")


def bins_between_values(values: DataFrame, column: str) -> DataFrame:
    """A table of bins from each distinct value of a column to the next one; the last one is closed up.

    ``(column, start, end, category, index)``, categories and indices being the places of the
    starts, from 0. Values are ordered in slices, so they may be many.
    """
    require_columns(values, [column])
    dtype = values.schema[column].dataType
    index = running_counts(values.select(
        F.col(column).alias(VALUE), F.lit(1).cast("long").alias(COUNT)).distinct(), dtype)
    starts = index.selectExpr(f"{UPTO} AS at", f"{VALUE} AS start")
    ends = index.selectExpr(f"{UPTO} - 1 AS at", f"{VALUE} AS end")
    return starts.join(ends, "at").select(
        F.lit(column).alias("column"), "start", "end", (F.col("at") - 1).cast("string").alias("category"),
        (F.col("at") - 1).cast("int").alias("index"))


def place_in_bins(entries: DataFrame, bins: DataFrame, dtype: DataType, last_closed: bool) -> DataFrame:
    """Entries (``fc_value`` and more) with ``index`` and ``category`` of the bin of a table they lie in.

    Both are null for values in no bin. Bins must not overlap (see ``overlapping``).
    """
    starts = bins.select(
        F.col("start").cast(dtype).alias(VALUE),
        F.struct("start", "end", "index", "category").alias("fc_start"))
    placed = last_before(entries, starts, dtype)
    inside = F.col(VALUE) < F.col("fc_start.end")
    if last_closed:
        # The end of the last bin is in it; nothing starts behind that bin.
        top = bins.agg(F.max(F.struct("start", "end", "index")).alias("top")).scalar()
        placed = placed.withColumn("fc_top", top)
        inside |= (F.col("fc_start.index") == F.col("fc_top.index")) & (
            F.col(VALUE) == F.col("fc_top.end"))
    columns = [c for c in entries.columns]
    return placed.select(
        *columns, F.when(inside, F.col("fc_start.index")).alias("index"),
        F.when(inside, F.col("fc_start.category")).alias("category"))


def bin_table_statistics(
    df: DataFrame, column: str, bins: DataFrame, last_closed: bool = False
) -> DataFrame:
    """Measures of every bin of a table that holds a value, in bin order.

    Like ``bin_statistics``, for any number of bins: they are merged with the sorted
    values, and ``index`` may be any number that orders them. Only bins of this column are used.
    Nothing is fetched to the driver.
    """
    require_columns(df, [column])
    dtype = df.schema[column].dataType
    own = bins.filter(F.col("column") == column)
    index = running_counts(value_counts(df, [], column), dtype)
    placed = place_in_bins(index, own, dtype, last_closed).where("index IS NOT NULL")
    measured = measured_runs(placed, ["index", "category"], dtype, few=False)
    median = F.col("median").cast(dtype) if is_whole(dtype) else F.col("median")
    return measured.select(
        F.lit(column).alias("column"), "category", "index", "min", "max", median.alias("median"),
        "count", "mean", "rsd").orderBy("index")


def bin_extent(bins: DataFrame) -> DataFrame:
    """Per column the number of bins, the lowest start and the highest end."""
    return bins.groupBy("column").agg(
        F.count(F.lit(1)).alias("bin_count"),
        F.min("start").alias("first_start"),
        F.max("end").alias("last_end"),
    )


def bin_at(bins: DataFrame, index: int) -> DataFrame:
    """The bin with the given index; no row when there is none."""
    return bins.filter(F.col("index") == index)


def axis_values(bins: DataFrame) -> DataFrame:
    """Sorted distinct end points, one per row."""
    return (
        bins.select("column", F.explode(F.array("start", "end")).alias("axis_value"))
        .distinct()
        .orderBy("column", "axis_value")
    )


def bin_index(column: str, bins: Sequence[Bin], last_closed: bool = False) -> Column:
    """0-based place of the bin holding the value, null when in none."""
    c = quoted(column)
    inside = [f"WHEN {c} >= {b.start} AND {c} < {b.end} THEN {i}" for i, b in enumerate(bins)]
    if bins and last_closed:
        last = bins[-1]
        inside[-1] = f"WHEN {c} BETWEEN {last.start} AND {last.end} THEN {len(bins) - 1}"
    return F.expr(f"CASE {' '.join(inside)} END" if bins else "cast(NULL AS int)")


def bins_array(bins: Sequence[Bin]) -> Column:
    """The categories of the bins as an array, in order."""
    return F.array(*[F.lit(b.category) for b in bins]).cast("array<string>")


def label_bins(
    df: DataFrame, column: str, bins: Sequence[Bin], last_closed: bool = False,
    name: str = "category",
) -> DataFrame:
    """Add the category of the bin each row's value falls in, null when in none."""
    require_columns(df, [column])
    ordered = checked(bins)
    place = bin_index(column, ordered, last_closed)
    return df.withColumn(name, F.get(bins_array(ordered), place))


def bin_statistics(
    df: DataFrame, column: str, bins: Sequence[Bin], last_closed: bool = False
) -> DataFrame:
    """Measures of every bin that holds a value, in bin order.

    Rows at the end of the last bin are in no bin unless ``last_closed``.
    """
    require_columns(df, [column])
    ordered = checked(bins)
    within = df.filter(F.col(column).between(ordered[0].start, ordered[-1].end))
    return statistics_of_bins(
        value_counts(within, [], column),
        column,
        df.schema[column].dataType,
        bin_index(VALUE, ordered, last_closed),
        bins_array(ordered),
    )


def statistics_of_bins(
    counts: DataFrame, column: str, dtype: DataType, place: Column, categories: Column
) -> DataFrame:
    """Measures of value counts per bin, given each value's place and all categories.

    Values in no bin count as none instead of being filtered away: the filter would
    sink to the listings and be evaluated per listing instead of per distinct value.
    """
    return measured_bins(counts, column, dtype, place, F.get(categories, place))


def measured_bins(
    counts: DataFrame, column: str, dtype: DataType, place: Column, category: Column
) -> DataFrame:
    """Measures of value counts per bin, given each value's place and category.

    Medians of whole numbers are whole, those of others doubles.
    """
    binned = counts.select(
        place.alias("index"), category.alias("category"), VALUE, COUNT
    ).selectExpr(
        "index", "category", VALUE, f"CASE WHEN index IS NULL THEN 0 ELSE {COUNT} END AS {COUNT}"
    )
    measured = measures_of_counts(
        binned, ["index", "category"], dtype, BIN_MEASURES, keep_empty=False, few_keys=True
    )
    median = F.col("median").cast(dtype) if is_whole(dtype) else F.col("median")
    return measured.select(
        F.lit(column).alias("column"),
        "category",
        "index",
        "min",
        "max",
        median.alias("median"),
        "count",
        "mean",
        "rsd",
    ).orderBy("index")
