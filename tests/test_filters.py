"""Filter requests, text matching and typed predicates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from forecourt.functions.text import is_valid_pattern, like
from forecourt.operators.filters import (
    ListingFilter,
    payload_predicates,
    typed_filter,
    typed_predicate,
)
from forecourt.plans.statistics import StatRequest, typed_query


def ids(df):
    return sorted(row["advert_id"] for row in df.select("advert_id").collect())


@pytest.mark.parametrize(
    "wanted, expected",
    [
        (ListingFilter(make="Audi"), ["a1", "a2", "a3", "a4"]),
        (ListingFilter(engine=["Diesel"]), ["a2", "a3"]),
        (ListingFilter(engine=[]), ["a1", "a2", "a3", "a4", "b1", "b2"]),
        (ListingFilter(), ["a1", "a2", "a3", "a4", "b1", "b2"]),
        (ListingFilter(gearbox="Manual"), ["a2", "b2", "n1"]),
        (ListingFilter(year=2018, year_from=2030), ["a1", "a2", "b1", "b2"]),
        (ListingFilter(year_from=2016, year_to=2017), ["a3", "a4"]),
        (ListingFilter(price=20_000), ["a2", "a3", "b1", "b2"]),
        (ListingFilter(price_from=20_000, price_to=28_000), ["a2", "a3", "b1"]),
        (ListingFilter(price=0, make="Audi", model="A6"), []),
        (ListingFilter(make="nobody"), []),
    ],
)
def test_fields_are_anded_and_nulls_never_match(listings, wanted, expected):
    assert ids(wanted.apply(listings)) == expected


def test_missing_columns_are_named(listings):
    with pytest.raises(ValueError, match="equipment, title"):
        ListingFilter(search="x", make="Audi").apply(listings)
    with pytest.raises(ValueError, match="missing columns: make"):
        ListingFilter().apply(listings.drop("make"))


def test_days_count_back_from_the_given_day(spark):
    df = spark.createDataFrame(
        [("old", dt.date(2024, 1, 1)), ("new", dt.date(2024, 3, 1)), ("none", None)],
        "advert_id string, created_on date",
    )
    today = dt.date(2024, 3, 11)
    assert ids(ListingFilter(created_on_from=10).apply(df, today)) == ["new"]
    assert ids(ListingFilter(created_on_to=11).apply(df, today)) == ["old"]
    assert ids(ListingFilter(created_on_from=70, created_on_to=10).apply(df, today)) == ["new", "old"]
    # Today is the clock's when not given.
    assert ids(ListingFilter(created_on_from=0).apply(df)) == []


@pytest.mark.parametrize(
    "value, expected",
    [
        ("QUATTRO", ["1", "2"]),
        ("*quattro", ["1"]),
        ("quattro*", ["2"]),
        ("*a4*", ["3"]),
        ("a[46]", ["1", "3"]),
        ("(", []),
        ("leather", ["3"]),
    ],
)
def test_search_reads_title_and_equipment(spark, value, expected):
    df = spark.createDataFrame(
        [("1", "Audi A6 Quattro", None), ("2", "quattro Audi", "none"), ("3", "The A4", "Leather A4")],
        "advert_id string, title string, equipment string",
    )
    assert ids(ListingFilter(search=value).apply(df)) == expected


def test_patterns_are_checked_by_spark(spark):
    assert is_valid_pattern("a.*b") and not is_valid_pattern("a(b")
    assert not is_valid_pattern("*")


def test_like_is_case_sensitive_on_its_own(spark):
    df = spark.createDataFrame([("Audi",)], "m string")
    assert df.filter(like(F.col("m"), "Au*")).count() == 1
    assert df.filter(like(F.col("m"), "au*")).count() == 0


def test_payload_keys_are_camel_case(listings):
    wanted = ListingFilter.from_payload(
        {"make": "Audi", "yearFrom": 2017, "engine": ["Diesel"], "priceTo": 100_000,
         "ccFrom": None, "group": ["make"], "unknown": 1}
    )
    assert wanted == ListingFilter(make="Audi", year_from=2017, engine=["Diesel"], price_to=100_000)
    assert ids(wanted.apply(listings)) == ["a2", "a3"]


def test_typed_predicates(listings):
    both = typed_predicate("Gte", {"year": 2018, "power": 185})
    either = typed_predicate("Gte", {"year": 2018, "power": 185}, match_all=False)
    assert ids(typed_filter(listings, both)) == ["a2"]
    assert ids(typed_filter(listings, either)) == ["a1", "a2", "a4", "b1", "b2"]
    assert len(ids(typed_filter(listings))) == 7
    with pytest.raises(ValueError, match="unknown predicate"):
        typed_predicate("Ne", {"year": 1})
    with pytest.raises(ValueError, match="no column"):
        typed_predicate("Eq", {})


def test_typed_payload(listings):
    found = payload_predicates(
        [{"Gt": [{"year": 2015}, True]}, {"Lt": [{"year": 2018}, True]}, {"In": ["make", ["Audi"]]},
         {"Like": [{"model": "A[46]"}, True]}]
    )
    assert ids(typed_filter(listings, *found)) == ["a3", "a4"]


def test_typed_query_groups_and_sorts_downwards(listings):
    rows = typed_query(
        listings,
        {
            "group_by": ["model"],
            "aggregate": {"price_in_eur": ["count", {"quantile": 0.25}]},
            "filter_string": [{"In": ["make", ["Audi", "BMW"]]}],
            "sort": [{"desc": ["model", True]}],
        },
    ).collect()
    assert [tuple(r) for r in rows] == [("A6", 0, None), ("A4", 3, 20_000.0), ("320", 2, 28_000.0)]
    plain = typed_query(listings, {"filter_i32": [{"Eq": [{"year": 2015}, True]}]})
    assert ids(plain) == ["n1"]


def test_request_needs_group_and_aggregators(listings):
    from forecourt.plans.statistics import grouped_statistics

    with pytest.raises(ValueError, match="group"):
        grouped_statistics(listings, StatRequest(aggregators=["count"]))
    with pytest.raises(ValueError, match="aggregator"):
        grouped_statistics(listings, StatRequest(group=["make"]))


def test_request_from_payload(listings):
    from forecourt.plans.statistics import grouped_statistics

    payload = {
        "make": "Audi", "group": ["make", "model"], "aggregators": ["count", "avg"],
        "order": [{"column": "model", "asc": False}], "stat_column": "price_in_eur",
    }
    rows = grouped_statistics(listings, StatRequest.from_payload(payload)).collect()
    assert [tuple(r) for r in rows] == [("Audi", "A6", 0, None), ("Audi", "A4", 3, 16_666)]
