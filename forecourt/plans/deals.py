"""Deal search."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from forecourt.operators.filters import ListingFilter
from forecourt.operators.ordering import first_rows, sort_by, top_k
from forecourt.sources.schemas import with_visibility

# Fixed value: the most deals a search answers with; a caller who wants it asks for it.
MOST_DEALS = 100


def search_deals(
    df: DataFrame,
    listing_filter: ListingFilter = ListingFilter(),
    order: Sequence = (),
    limit: int | None = None,
    stable_key: Sequence[str] | None = None,
    as_of: dt.date | None = None,
) -> DataFrame:
    """The matching listings, or any ``limit`` of them, then sorted.

    A limit comes before the sort. ``stable_key`` decides which listings are taken;
    without it the scan stops as soon as enough are found. The best listings by the
    requested order are ``best_deals``.
    """
    found = listing_filter.apply(df, as_of)
    if limit is not None:
        found = first_rows(found, limit, stable_key)
    return with_visibility(sort_by(found, order))


def best_deals(
    df: DataFrame,
    order: Sequence,
    listing_filter: ListingFilter = ListingFilter(),
    limit: int | None = None,
    as_of: dt.date | None = None,
) -> DataFrame:
    """The matching listings by the requested order, or the ``limit`` best of them."""
    found = listing_filter.apply(df, as_of)
    best = sort_by(found, order) if limit is None else top_k(found, order, limit)
    return with_visibility(best)
