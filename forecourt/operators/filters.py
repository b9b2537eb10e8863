"""Filter requests turned into one boolean column."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.text import any_like, like

# The columns each field of a filter request reads.
SEARCHED = ("title", "equipment")
AT_LEAST = {
    "estimated_price": "estimated_price_in_eur",
    "price": "price_in_eur",
    "discount_from": "discount",
    "save_diff_from": "save_diff_in_eur",
    "price_from": "price_in_eur",
}
AT_MOST = {
    "discount_to": "discount",
    "save_diff_to": "save_diff_in_eur",
    "price_to": "price_in_eur",
}
EXACT = ("make", "model", "gearbox")
EXACT_OR_RANGE = ("year", "power", "mileage", "cc")


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Raise one error naming every column the table lacks."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; have: {df.columns}")


@dataclass(frozen=True)
class ListingFilter:
    """The facets of a listing search; a field left at None does not restrict.

    An exact ``year``, ``power``, ``mileage`` or ``cc`` replaces its range. ``price``
    and ``estimated_price`` are lower limits. ``created_on_from`` and
    ``created_on_to`` count days back from ``as_of``.
    """

    search: str | None = None
    make: str | None = None
    model: str | None = None
    engine: Sequence[str] | None = None
    gearbox: str | None = None
    year: int | None = None
    year_from: int | None = None
    year_to: int | None = None
    power: int | None = None
    power_from: int | None = None
    power_to: int | None = None
    mileage: int | None = None
    mileage_from: int | None = None
    mileage_to: int | None = None
    cc: int | None = None
    cc_from: int | None = None
    cc_to: int | None = None
    price: int | None = None
    price_from: int | None = None
    price_to: int | None = None
    estimated_price: int | None = None
    discount_from: float | None = None
    discount_to: float | None = None
    save_diff_from: int | None = None
    save_diff_to: int | None = None
    created_on_from: int | None = None
    created_on_to: int | None = None

    @classmethod
    def from_payload(cls, payload: Mapping[str, Any]) -> ListingFilter:
        """Build from a JSON request with camelCase keys; other keys are ignored."""
        fields = {}
        for field in dataclasses.fields(cls):
            head, *rest = field.name.split("_")
            camel = head + "".join(part.capitalize() for part in rest)
            value = payload.get(camel, payload.get(field.name))
            if value is not None:
                fields[field.name] = value
        return cls(**fields)

    def replace(self, **changes: Any) -> ListingFilter:
        return dataclasses.replace(self, **changes)

    def conditions(self, as_of: dt.date | None = None) -> list[tuple[tuple[str, ...], Column]]:
        """The given fields as (columns read, predicate) pairs."""
        found: list[tuple[tuple[str, ...], Column]] = []

        def add(column: str, op: Any, value: Any) -> None:
            if value is not None:
                found.append(((column,), op(F.col(column), F.lit(value))))

        if self.search is not None:
            found.append((SEARCHED, any_like(SEARCHED, self.search)))
        for name in EXACT:
            add(name, eq, getattr(self, name))
        if self.engine:
            found.append((("engine",), F.col("engine").isin(list(self.engine))))
        for name in EXACT_OR_RANGE:
            exact = getattr(self, name)
            add(name, eq, exact)
            if exact is None:
                add(name, ge, getattr(self, f"{name}_from"))
                add(name, le, getattr(self, f"{name}_to"))
        for name, column in AT_LEAST.items():
            add(column, ge, getattr(self, name))
        for name, column in AT_MOST.items():
            add(column, le, getattr(self, name))
        if self.created_on_from is not None or self.created_on_to is not None:
            today = as_of or dt.datetime.now(dt.timezone.utc).date()
            for op, days in ((ge, self.created_on_from), (le, self.created_on_to)):
                if days is not None:
                    add("created_on", op, today - dt.timedelta(days=days))
        return found

    def to_column(self, as_of: dt.date | None = None) -> Column:
        """One predicate; with no field given, listings that have a make."""
        found = self.conditions(as_of)
        if not found:
            return F.col("make") != "x"
        return reduce(and_, [predicate for _, predicate in found])

    def apply(self, df: DataFrame, as_of: dt.date | None = None) -> DataFrame:
        """Keep the matching rows; raises if the table lacks a filtered column."""
        found = self.conditions(as_of)
        needed = [c for columns, _ in found for c in columns] or ["make"]
        require_columns(df, needed)
        return df.filter(self.to_column(as_of))


def in_range(df: DataFrame, column: str, start: Any, end: Any) -> DataFrame:
    """Keep rows whose value lies in the closed range."""
    return df.filter(F.col(column).between(start, end))


COMPARISONS = {"Eq": eq, "Gt": gt, "Lt": lt, "Gte": ge, "Lte": le}


def typed_predicate(
    kind: str, values: Mapping[str, Any], match_all: bool = True
) -> Column:
    """Compare several columns with one operator each, all or any of which must hold.

    ``kind`` is Like, Eq, Gt, Lt, Gte or Lte.
    """
    if kind == "Like":
        parts = [like(F.col(c), v) for c, v in values.items()]
    elif kind in COMPARISONS:
        parts = [COMPARISONS[kind](F.col(c), F.lit(v)) for c, v in values.items()]
    else:
        raise ValueError(f"unknown predicate {kind!r}")
    if not parts:
        raise ValueError(f"predicate {kind} names no column")
    return reduce(and_ if match_all else or_, parts)


def payload_predicates(filters: Sequence[Mapping[str, Any]]) -> list[Column]:
    """Predicates of a JSON request: ``{"Gte": [{"year": 2016}, true]}``,
    ``{"In": ["year", [2016, 2017]]}`` and so on."""
    found = []
    for entry in filters:
        for kind, arguments in entry.items():
            if kind == "In":
                column, values = arguments
                found.append(F.col(column).isin(list(values)))
            else:
                values, match_all = arguments
                found.append(typed_predicate(kind, values, match_all))
    return found


def typed_filter(df: DataFrame, *predicates: Column) -> DataFrame:
    """Keep rows for which every predicate holds."""
    return df.filter(reduce(and_, predicates)) if predicates else df
