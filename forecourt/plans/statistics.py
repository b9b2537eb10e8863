"""Grouped statistics, chart statistics and summaries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.functions.bands import price_band, price_band_order
from forecourt.functions.measures import Measure, quantile
from forecourt.operators.filters import (
    ListingFilter,
    in_range,
    payload_predicates,
    require_columns,
    typed_filter,
)
from forecourt.operators.grouping import aggregate_map, group_measures
from forecourt.operators.ordering import Order, orders_of, sort_by

DEFAULT_STAT_COLUMN = "price_in_eur"


@dataclass(frozen=True)
class StatRequest:
    """What to group by, what to measure and how to sort."""

    filter: ListingFilter = ListingFilter()
    group: Sequence[str] = ()
    aggregators: Sequence[str] = ()
    order: Sequence[Order | tuple | dict | str] = field(default=())
    stat_column: str | None = None

    @classmethod
    def from_payload(cls, payload: Mapping[str, Any]) -> StatRequest:
        """Build from a JSON request, which also holds the filter's fields."""
        return cls(
            filter=ListingFilter.from_payload(payload),
            group=tuple(payload.get("group") or ()),
            aggregators=tuple(payload.get("aggregators") or ()),
            order=tuple(orders_of(payload.get("order") or ())),
            stat_column=payload.get("stat_column"),
        )

    def check(self) -> None:
        if not self.group:
            raise ValueError("at least one column to group by is required")
        if not self.aggregators:
            raise ValueError("at least one aggregator is required")


def grouped_statistics(
    df: DataFrame, request: StatRequest, as_of: dt.date | None = None
) -> DataFrame:
    """Filter, group, measure, sort."""
    request.check()
    grouped = group_measures(
        request.filter.apply(df, as_of),
        request.group,
        request.stat_column or DEFAULT_STAT_COLUMN,
        request.aggregators,
    )
    return sort_by(grouped, request.order)


def chart_statistics(
    df: DataFrame, request: StatRequest, as_of: dt.date | None = None
) -> DataFrame:
    """Grouped statistics for a chart.

    Without a group the result is empty. Listings are only counted when no column or no
    aggregator is named. The default order is by count, then by group.
    """
    column = request.stat_column or "advert_id"
    wanted = request.aggregators
    if column == "advert_id" or not wanted:
        wanted = ("count",)
    listings = request.filter.apply(df, as_of)
    if not request.group:
        return group_measures(listings, [], column, wanted).filter(F.lit(False))
    grouped = group_measures(listings, request.group, column, wanted)
    if request.order:
        return sort_by(grouped, request.order)
    by_count = ["count"] if "count" in wanted else []
    return sort_by(grouped, [*by_count, *request.group])


def even_fractions(n: int) -> list[tuple[int, float, str]]:
    """(bin, i/n, alias) for i = 1..n; empty when n < 1."""
    # The alias rounds half up.
    return [(i, i / n, f"q{int(100 * (i / n) + 0.5)}") for i in range(1, n + 1)]


def even_quantiles(n: int) -> list[Measure]:
    return [quantile(p, f"fc_q{i}") for i, p, _ in even_fractions(n)]


SUMMARY_MEASURES = (
    Measure("count", "count"),
    Measure("min", "min"),
    Measure("max", "max"),
    Measure("mean", "mean"),
    Measure("median", "median"),
    Measure("rsd", "rsd_percent"),
)


def with_quantile_list(df: DataFrame, column: str, n: int) -> DataFrame:
    """Gather the even quantile columns into one list of structs."""
    entries = [
        F.struct(
            F.lit(column).alias("column"),
            F.lit(p).alias("quantile"),
            F.col(f"fc_q{i}").alias("value"),
            F.lit(i).alias("bin"),
            F.lit(alias).alias("alias"),
        )
        for i, p, alias in even_fractions(n)
    ]
    return df.select(*[m.name for m in SUMMARY_MEASURES], F.array(*entries).alias("quantiles"))


def summary(
    df: DataFrame,
    column: str,
    listing_filter: ListingFilter = ListingFilter(),
    n: int = 4,
    interval: tuple[int, int] | None = None,
    as_of: dt.date | None = None,
) -> DataFrame:
    """One row: count, extremes, mean, median, relative deviation and n even quantiles
    of the filtered column, optionally within a closed interval."""
    if n < 1:
        raise ValueError("at least one quantile is required")
    require_columns(df, [column])
    listings = listing_filter.apply(df, as_of)
    if interval is not None:
        listings = in_range(listings, column, *interval)
    wanted = [*SUMMARY_MEASURES, *even_quantiles(n)]
    return with_quantile_list(group_measures(listings, [], column, wanted), column, n)


def price_band_distribution(
    df: DataFrame,
    column: str = DEFAULT_STAT_COLUMN,
    listing_filter: ListingFilter | None = None,
    as_of: dt.date | None = None,
) -> DataFrame:
    """Count, mean, median and relative deviation, all whole, per fixed price band."""
    require_columns(df, [column])
    listings = listing_filter.apply(df, as_of) if listing_filter else df
    banded = listings.select(
        price_band(column).alias("price_breakdown"),
        price_band_order(column).alias("price_breakdown_order"),
        column,
    )
    grouped = group_measures(
        banded,
        ["price_breakdown", "price_breakdown_order"],
        column,
        ["count", "mean", "median", Measure("rsd", "rsd_whole")],
    )
    return grouped.select(
        "price_breakdown",
        "price_breakdown_order",
        "count",
        F.col("mean").cast("int").alias("mean"),
        F.col("median").cast("int").alias("median"),
        "rsd",
    ).orderBy("price_breakdown_order")


def typed_query(df: DataFrame, payload: Mapping[str, Any]) -> DataFrame:
    """Answer a typed request: predicates per type, an aggregate map, and sort keys.

    ``sort`` entries are ``{"asc": [column, flag]}`` or ``{"desc": [column, flag]}``.
    Without an aggregate map the matching rows are returned.
    """
    predicates = [
        p
        for kind in ("filter_string", "filter_i32", "filter_f64", "filter_date")
        for p in payload_predicates(payload.get(kind) or ())
    ]
    rows = typed_filter(df, *predicates)
    if payload.get("search") is not None:
        rows = ListingFilter(search=payload["search"]).apply(rows)
    functions = {
        column: [("quantile", f["quantile"]) if isinstance(f, Mapping) else f for f in fs]
        for column, fs in (payload.get("aggregate") or {}).items()
    }
    if functions:
        rows = aggregate_map(rows, payload.get("group_by") or [], functions)
    order = [
        Order(arguments[0], direction == "asc")
        for entry in payload.get("sort") or ()
        for direction, arguments in entry.items()
    ]
    return sort_by(rows, order)
