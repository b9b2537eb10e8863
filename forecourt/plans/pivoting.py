"""Pivot tables and pivot charts over grouped statistics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any, NamedTuple

from pyspark.sql import DataFrame

from forecourt.operators import pivot as p
from forecourt.operators.filters import require_columns
from forecourt.operators.ordering import sort_by
from forecourt.plans.statistics import StatRequest, grouped_statistics


@dataclass(frozen=True)
class PivotRequest:
    """Grouped statistics to be spread over columns.

    ``y_function`` names the measure that fills the cells. ``values`` are the pivot
    values when known; otherwise a query over the pivot column finds them. ``cell``
    combines groups that fall into one cell.
    """

    stat: StatRequest
    y_function: str
    pivot_column: str | None = None
    x_column: str | None = None
    second_x_column: str | None = None
    values: Sequence[Any] | None = None
    cell: str = "sum"

    @classmethod
    def from_payload(cls, payload: Mapping[str, Any]) -> PivotRequest:
        """Build from a JSON request."""
        return cls(
            stat=StatRequest.from_payload(payload["filter"]),
            y_function=payload["y_function"],
            pivot_column=payload.get("pivot_column"),
            x_column=payload.get("x_column"),
            second_x_column=payload.get("second_x_column"),
        )

    def check(self) -> None:
        self.stat.check()
        if self.y_function not in self.stat.aggregators:
            raise ValueError(f"{self.y_function!r} is not among the aggregators")
        for name in (self.pivot_column, self.x_column, self.second_x_column):
            if name is not None and name not in self.stat.group:
                raise ValueError(f"column {name!r} is not among the groups")

    def pivot_values(self, df: DataFrame, as_of: dt.date | None) -> Sequence[Any]:
        if self.values is not None:
            return self.values
        return p.pivot_values(self.stat.filter.apply(df, as_of), self.pivot_column)


def pivot_table(
    df: DataFrame, request: PivotRequest, as_of: dt.date | None = None
) -> DataFrame:
    """Grouped statistics with one group column spread over columns, then sorted.

    Without a pivot column, the grouped statistics.
    """
    request.check()
    if request.pivot_column is None:
        return grouped_statistics(df, request.stat, as_of)
    unsorted = StatRequest(
        request.stat.filter,
        request.stat.group,
        [request.y_function],
        (),
        request.stat.stat_column,
    )
    wide = p.pivot(
        grouped_statistics(df, unsorted, as_of),
        [c for c in request.stat.group if c != request.pivot_column],
        request.pivot_column,
        request.y_function,
        request.pivot_values(df, as_of),
        request.cell,
    )
    return sort_by(wide, request.stat.order)


def pivot_object_table(
    df: DataFrame, request: PivotRequest, as_of: dt.date | None = None, name: str = "cells"
) -> DataFrame:
    """Grouped statistics with one row per index key and its cells as one VARIANT object.

    One lazy plan: unlike ``pivot_table`` it does not ask which pivot values there are.
    """
    request.check()
    if request.pivot_column is None:
        raise ValueError("a pivot column is required")
    unsorted = StatRequest(
        request.stat.filter, request.stat.group, [request.y_function], (),
        request.stat.stat_column,
    )
    objects = p.pivot_objects(
        grouped_statistics(df, unsorted, as_of),
        [c for c in request.stat.group if c != request.pivot_column],
        request.pivot_column,
        request.y_function,
        request.cell,
        name,
    )
    return sort_by(objects, request.stat.order)


class Chart(NamedTuple):
    """Axis labels and series, each a table."""

    labels: DataFrame
    series: DataFrame


def pivot_chart(
    df: DataFrame, request: PivotRequest, as_of: dt.date | None = None
) -> Chart:
    """Labels of the x axis and one series per pivot value.

    Group columns other than x, the second x and the pivot are combined. Without a pivot
    column, the other group columns make up the series. Building a chart runs no query.
    """
    request.check()
    if request.x_column is None:
        raise ValueError("an x column is required")
    x = request.x_column
    if request.pivot_column is None:
        grouped = grouped_statistics(df, request.stat, as_of)
        others = [c for c in request.stat.group if c != x]
        return Chart(
            p.labels(grouped, x), p.grouped_series(grouped, x, request.y_function, others)
        )
    base = [x] if request.second_x_column is None else [x, request.second_x_column]
    unsorted = StatRequest(
        request.stat.filter,
        request.stat.group,
        [request.y_function],
        (),
        request.stat.stat_column,
    )
    grouped = grouped_statistics(df, unsorted, as_of)
    require_columns(grouped, [*base, request.pivot_column])
    return Chart(
        p.labels(grouped, x),
        p.cell_series(
            grouped, base, request.pivot_column, request.y_function, request.values,
            request.cell,
        ),
    )
