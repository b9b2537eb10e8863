"""Outlier-trimmed distributions over equal-width or equal-frequency bins.

Everything is one lazy plan over one running-count index of the values (``operators.running``), so
the listings are scanned once. Trim bounds, cut points and the median of every bin are
lookups in it. Bounds and cuts are joined to the index as one row; nothing is run, fetched or
cached while a distribution is built.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from forecourt.functions.measures import Measure, is_whole
from forecourt.operators.bins import Bin
from forecourt.operators.filters import ListingFilter, require_columns
from forecourt.operators.ranks import COUNT, VALUE, measures_of_counts, value_counts
from forecourt.operators.running import (
    TOTAL,
    UPTO,
    entry_at,
    even_values,
    measured_runs,
    rank_of,
    running_counts,
    with_row,
)
from forecourt.plans.statistics import even_quantiles, with_quantile_list

Kind = Literal["interval", "quantile"]

# More rows than this, trimmed to these two quantiles.
TRIM_TIERS = ((1000, 0.0005, 0.995), (500, 0.03, 0.97), (50, 0.05, 0.95))
Tiers = Sequence[tuple[int, float, float]]


def _bounds(index: DataFrame, dtype: DataType, tiers: Tiers, trim: bool) -> DataFrame:
    """One row: ``lower`` and ``upper``, the first and the last index entry of the (trimmed) range.

    Besides, the extremes of all and the number of rows.
    """
    entry = f"struct({VALUE}, {UPTO}, {COUNT})"
    found = [f"min({entry}) AS least", f"max({entry}) AS most", f"max({TOTAL}) AS {TOTAL}"]
    sides = {"lower": "least", "upper": "most"}
    if trim and tiers:
        largest_first = sorted(tiers, reverse=True)
        for i, (_, low, high) in enumerate(largest_first):
            for side, q in (("lower", low), ("upper", high)):
                found.append(f"{entry_at(rank_of(repr(float(q)) + 'D', TOTAL))} AS {side}_{i}")
        for side, whole in list(sides.items()):
            arms = " ".join(f"WHEN {TOTAL} > {size} THEN {side}_{i}"
                            for i, (size, _, _) in enumerate(largest_first))
            sides[side] = f"CASE {arms} ELSE {whole} END"
    return index.agg(*[F.expr(f) for f in found]).selectExpr(
        TOTAL, f"least.{VALUE} AS orig_start", f"most.{VALUE} AS orig_end",
        *[f"{sql} AS {side}" for side, sql in sides.items()],
    ).selectExpr(
        "*", f"lower.{VALUE} AS start", f"upper.{VALUE} AS end",
        f"lower.{UPTO} - lower.{COUNT} AS fc_before", f"upper.{UPTO} AS fc_last",
        f"upper.{UPTO} - lower.{UPTO} + lower.{COUNT} AS fc_rows_within").drop("lower", "upper")


def _whole(counts: DataFrame) -> DataFrame:
    """The columns of ``_bounds`` without trimming, which need no value in order."""
    return counts.where(F.col(VALUE).isNotNull()).agg(
        F.min(VALUE).alias("start"), F.max(VALUE).alias("end"), F.sum(COUNT).alias(TOTAL),
    ).selectExpr(TOTAL, "start AS orig_start", "end AS orig_end", "start", "end",
                 "0L AS fc_before", f"{TOTAL} AS fc_last", f"{TOTAL} AS fc_rows_within")


def trim_range(
    df: DataFrame,
    column: str,
    listing_filter: ListingFilter = ListingFilter(),
    as_of: dt.date | None = None,
    tiers: Tiers = TRIM_TIERS,
) -> DataFrame:
    """One row with the column's range without outliers.

    ``tiers`` are (rows, low, high): with more rows than the first that applies, largest
    first, the range is that between these two quantiles; with fewer than all, it is whole.
    By default, the more rows, the less is cut off, and 50 rows or fewer keep their range.
    """
    require_columns(df, [column])
    dtype = df.schema[column].dataType
    counts = value_counts(listing_filter.apply(df, as_of), [], column)
    bounds = _bounds(running_counts(counts, dtype), dtype, tiers, trim=True)
    whole = measures_of_counts(
        counts, [], dtype, [Measure("rsd", "rsd_percent"), Measure("count", "count")])
    # Both have one row.
    return whole.join(bounds, F.col("count") == F.coalesce(TOTAL, F.lit(0))).select(
        F.lit(column).alias("column"), "orig_start", "orig_end", "rsd", "count", "start", "end")


@dataclass(frozen=True)
class Distribution:
    """Per-bin measures, overall measures, and one row with the edges between bins.

    Each is a plan of its own, put together when it is first asked for.
    """

    build_bins: Callable[[], DataFrame]
    build_summary: Callable[[], DataFrame]
    build_edges: Callable[[], DataFrame]

    @cached_property
    def bins(self) -> DataFrame:
        return self.build_bins()

    @cached_property
    def summary(self) -> DataFrame:
        return self.build_summary()

    @cached_property
    def edges(self) -> DataFrame:
        return self.build_edges()


def equal_width_bins(start: int, end: int, n: int) -> list[Bin]:
    """n bins of one whole step, numbered from 0; one bin when the step would be 0."""
    step = (end - start) // n
    if step == 0:
        return [Bin(start, end, "0")]
    return [Bin(start + i * step, start + (i + 1) * step, str(i)) for i in range(n)]


def bins_between(cuts: Sequence[int]) -> list[Bin]:
    """Bins between neighbouring cut points, numbered from 1; those of no width hold
    nothing and are left out."""
    return [
        Bin(left, right, str(i))
        for i, (left, right) in enumerate(zip(cuts, cuts[1:]), start=1)
        if left < right
    ]


def _interval_places(
    n: int, last_closed: bool, dtype: DataType, x: Column
) -> tuple[Column, Column, Column]:
    """Index and category of a value in n equal bins, and the edges, over ``fc_bounds``."""
    start, end = F.col("fc_bounds.start"), F.col("fc_bounds.end")
    last = F.lit(n - 1)
    if is_whole(dtype):
        step = F.call_function("div", end.cast("decimal(20,0)") - start, F.lit(n))
        place = F.call_function("div", x.cast("decimal(20,0)") - start, step)
        edge = lambda i: (start + i * step).cast(dtype)
    else:
        step = (end - start) / n
        place = F.floor((x - start) / step)
        edge = lambda i: (start + i * step).cast(dtype)
    beyond = last if last_closed else F.lit(None)
    index = F.when(step == 0, 0).when(place < n, place).otherwise(beyond).cast("int")
    ends = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: edge(i))
    if last_closed:
        ends = F.concat(F.slice(ends, 1, n), F.array(end))
    edges = F.when(start.isNull(), F.array().cast(ends_type(dtype))).when(
        step == 0, F.array_distinct(F.array(start, end))).otherwise(ends)
    return index, index.cast("string"), edges


def ends_type(dtype: DataType) -> str:
    return f"array<{dtype.simpleString()}>"


def _wide_bins(n: int) -> Column:
    """The numbers of the bins between ``fc_cuts`` that have any width."""
    cuts = F.col("fc_cuts")
    return F.filter(
        F.sequence(F.lit(1), F.lit(n)), lambda i: F.get(cuts, i - 1) < F.get(cuts, i))


def _quantile_places(
    n: int, last_closed: bool, dtype: DataType, x: Column
) -> tuple[Column, Column, Column]:
    """Index and category of a value between the n + 1 ``fc_cuts``, and the edges.

    ``fc_wide`` are the bins that have any width.
    """
    cuts, wide = F.col("fc_cuts"), F.col("fc_wide")
    number = F.size(F.filter(cuts, lambda c: c <= x))
    closed = F.when(F.size(wide) > 0, F.array_max(wide)).otherwise(n)
    number = F.when(number <= n, number)
    if last_closed:
        number = F.coalesce(number, closed)
    # The variable of a lambda is computed once, not for each bin.
    index = F.get(F.transform(F.array(number), lambda k: F.when(
        k.isNotNull(), F.size(F.filter(wide, lambda i: i < k)))), F.lit(0))
    edges = F.array_distinct(F.filter(cuts, lambda c: c.isNotNull()))
    if not last_closed:
        # Without a bin that has any width there are no edges.
        edges = F.when(F.size(wide) > 0, edges).otherwise(F.array().cast(ends_type(dtype)))
    return index.cast("int"), number.cast("string"), edges


def distribution(
    df: DataFrame,
    column: str,
    n: int,
    kind: Kind = "interval",
    trim: bool = True,
    listing_filter: ListingFilter = ListingFilter(),
    last_closed: bool = False,
    as_of: dt.date | None = None,
    tiers: Tiers = TRIM_TIERS,
) -> Distribution:
    """Split the filtered column, of any numeric type, into n bins of equal width or frequency.

    ``trim`` cuts outliers off first. Bins are half-open: values at the very end are in
    no bin, and equal-width bins of whole numbers have a whole step, so a remainder at the
    top is in none either. ``last_closed`` puts both into the last bin. Where the range is
    narrower than the bins are many (or has no width), there is one equal-width bin, closed.
    """
    if n < 2:
        raise ValueError("at least two bins are required")
    if kind not in ("interval", "quantile"):
        raise ValueError(f"unknown kind of distribution {kind!r}")
    require_columns(df, [column])
    dtype = df.schema[column].dataType
    counts = value_counts(listing_filter.apply(df, as_of), [], column)
    index = running_counts(counts, dtype)
    bounds = (_bounds(index, dtype, tiers, trim) if trim and tiers else _whole(counts)).withColumn(
        "fc_bounds", F.struct("start", "end"))
    given = bounds.select(TOTAL, "fc_bounds", "fc_before", "fc_last", "fc_rows_within")
    # The values within the bounds are the rows after the first and up to the last of them.
    within = with_row(index, given).where(
        (F.col(UPTO) > F.col("fc_before")) & (F.col(UPTO) <= F.col("fc_last")))
    cuts = even_values(within, n, "fc_before", "fc_rows_within")
    if kind == "quantile":
        places = _quantile_places
        row = given.join(F.broadcast(cuts.withColumn("fc_wide", _wide_bins(n))), TOTAL)
        placed = with_row(index, row).where(
            (F.col(UPTO) > F.col("fc_before")) & (F.col(UPTO) <= F.col("fc_last")))
    else:
        places, row, placed = _interval_places, given, within
    place, category, edges = places(n, last_closed, dtype, F.col(VALUE))

    def bins() -> DataFrame:
        return _bins(placed.select(
            place.alias("index"), category.alias("category"), VALUE, COUNT, UPTO), column, dtype)

    def summary() -> DataFrame:
        # The same with one bin, beside the quantiles.
        one = measured_runs(within.select(F.lit(0).alias("index"), VALUE, COUNT, UPTO), ["index"], dtype)
        values = df.sparkSession.range(1).select(cuts.select("fc_cuts").scalar().alias("fc_cuts"))
        whole = values.join(one, F.col("index") == 0, "left").selectExpr(
            "coalesce(count, 0) AS count", "min", "max", "mean", "median", "rsd",
            *[f"get(fc_cuts, {i}) AS {m.name}" for i, m in enumerate(even_quantiles(n), start=1)])
        return with_quantile_list(whole.selectExpr(
            "count", "min", "max", "mean", "median", "rsd",
            *[f"cast({m.name} AS double) AS {m.name}" for m in even_quantiles(n)]), column, n)

    def ends() -> DataFrame:
        wanted = [c for c in row.columns if c in ("fc_bounds", "fc_cuts")]
        found = df.sparkSession.range(1).select(*[row.select(c).scalar().alias(c) for c in wanted])
        if kind == "quantile":
            none = F.array().cast(ends_type(dtype))
            found = found.withColumn("fc_cuts", F.coalesce("fc_cuts", none))
            found = found.withColumn("fc_wide", _wide_bins(n))
        return found.select(edges.alias("edges"))

    return Distribution(bins, summary, ends)


def _bins(placed: DataFrame, column: str, dtype: DataType) -> DataFrame:
    """Measures of every bin that holds a value, in order. Medians of whole numbers are whole."""
    measured = measured_runs(placed.where("index IS NOT NULL"), ["index", "category"], dtype)
    median = F.col("median").cast(dtype) if is_whole(dtype) else F.col("median")
    return measured.select(
        F.lit(column).alias("column"), "category", "index", "min", "max", median.alias("median"),
        "count", "mean", "rsd").orderBy("index")


def distribution_chart(parts: Distribution, column: str) -> DataFrame:
    """One row in the shape of a chart: axis, overall measures, and the list of bins.

    The list holds one entry per bin, so its size is the number of bins asked for.
    Means, medians and deviations are whole numbers.
    """
    entries = parts.bins.selectExpr(
        "struct(index, column, category, min, max, bigint(median) AS median, count,"
        " bigint(mean) AS mean, bigint(rsd) AS rsd) AS entry"
    ).agg(
        F.transform(
            F.array_sort(F.collect_list("entry")), lambda e: e.dropFields("index")
        ).alias("data")
    )
    return parts.summary.select(
        F.lit(column).alias("axis_label"),
        F.lit("stat_category").alias("data_label"),
        parts.edges.scalar().alias("axis_values"),
        "min",
        "max",
        F.col("median").cast("int").alias("median"),
        "count",
        F.col("mean").cast("bigint").alias("mean"),
        F.col("rsd").cast("bigint").alias("rsd"),
        entries.scalar().alias("data"),
    )
