"""Pivots, series and result shapes."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from forecourt.operators.ordering import first_rows, sort_by, top_k
from forecourt.operators.facets import distinct_spellings, facet, models_of
from forecourt.operators.pivot import cell_series, pivot, pivot_values, series
from forecourt.plans.deals import best_deals, search_deals
from forecourt.plans.pivoting import PivotRequest, pivot_chart, pivot_table
from forecourt.plans.statistics import StatRequest, chart_statistics
from forecourt.operators.filters import ListingFilter
from forecourt.sources.results import (
    columnar_json,
    dimension_summary,
    grouped_response,
    series_lists,
    whole_numbers,
)

STAT = StatRequest(group=["year", "make", "engine"], aggregators=["count", "sum"], order=["year"])


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_pivot_table_fills_gaps_in_value_columns_only(listings):
    request = PivotRequest(
        StatRequest(group=["make", "gearbox", "engine"], aggregators=["sum"], order=["make", ("gearbox", False)]),
        "sum", "engine",
    )
    wide = pivot_table(listings, request)
    assert wide.columns == ["make", "gearbox", "Diesel", "Petrol"]
    assert rows(wide) == [
        ("Audi", "Manual", 20_000, 0), ("Audi", "Automatic", 0, 10_000), ("Audi", None, 20_000, 0),
        ("BMW", "Manual", 0, 30_000), ("BMW", "Automatic", 0, 28_000),
    ]


def test_null_pivot_values_have_a_column(listings):
    assert pivot_values(listings, "gearbox") == ["Automatic", "Manual", "null"]
    request = PivotRequest(StatRequest(group=["year", "gearbox"], aggregators=["count"], order=["year"]), "count", "gearbox")
    wide = pivot_table(listings, request)
    assert wide.columns == ["year", "Automatic", "Manual", "null"]
    assert rows(wide)[1] == (2017, 0, 0, 1)


def test_given_values_need_no_query_and_choose_columns(listings):
    request = PivotRequest(STAT, "count", "engine", values=["Petrol"])
    assert pivot_table(listings, request).columns == ["year", "make", "Petrol"]


def test_pivot_values_may_be_dotted_fractional_or_bigger_than_double(spark):
    rows_ = [("x", "1.6 TDI", 0.1, 1e7, 2**53 + 1), ("x", "2.0", 2.5, 1.5, 3), ("y", "a`b", 0.1, 1e7, 3)]
    df = spark.createDataFrame(rows_, "i string, name string, f float, d double, n bigint")
    df = df.withColumn("v", F.lit(1))
    for column, names in (("name", ["1.6 TDI", "2.0", "a`b"]), ("f", ["0.1", "2.5"]),
                          ("d", ["1.5", "1.0E7"]), ("n", ["3", "9007199254740993"])):
        wide = pivot(df, ["i"], column, "v", pivot_values(df, column)).orderBy("i")
        assert wide.columns == ["i", *names]
        assert sum(sum(r[1:]) for r in wide.collect()) == 3
        long_form = {(r.i, r.label): r.value for r in cell_series(df, ["i"], column, "v").collect()}
        assert long_form == {(r.i, n): float(r[n]) for r in wide.collect() for n in names}
    given = pivot(df, ["i"], "d", "v", [1e7, 1.5, "1.0E7"][:2]).orderBy("i")
    assert given.columns == ["i", "1.0E7", "1.5"] and given.first()["1.0E7"] == 1


def test_names_that_clash_are_refused(listings):
    df = listings.withColumns({"label": F.lit(1), "year2": F.lit("make")})
    with pytest.raises(ValueError, match="index columns: make"):
        pivot(df, ["make"], "year2", "cc", ["make"])
    with pytest.raises(ValueError, match="label"):
        cell_series(df, ["label"], "make", "cc")
    with pytest.raises(ValueError, match="label"):
        series(df.select("label", "cc"), ["label"])


def test_cells_combine_collapsed_groups(listings):
    request = PivotRequest(STAT, "sum", "engine", x_column="year")
    chart = pivot_chart(listings, request)
    points = {(r["year"], r["label"]): r["value"] for r in chart.series.collect()}
    assert points[2018, "Petrol"] == 68_000.0 and points[2017, "Petrol"] == 0.0
    highest = pivot_chart(listings, PivotRequest(STAT, "sum", "engine", x_column="year", cell="max"))
    assert {(r["year"], r["label"]): r["value"] for r in highest.series.collect()}[2018, "Petrol"] == 58_000.0
    assert rows(chart.labels) == [("2016",), ("2017",), ("2018",)]


def test_chart_without_pivot_labels_by_the_other_groups(listings):
    stat = StatRequest(group=["year", "make", "gearbox"], aggregators=["mean"])
    chart = pivot_chart(listings, PivotRequest(stat, "mean", x_column="year"))
    points = {(r["label"], r["year"]): r["value"] for r in chart.series.collect()}
    assert points["Audi, Unknown", 2017] == 20_000
    assert points["Audi, Automatic", 2016] == 0
    lists = {r["label"]: [tuple(p) for p in r["points"]] for r in series_lists(chart.series, "year").collect()}
    assert lists["Audi, Automatic"] == [(2016, 0), (2018, 10_000)]
    alone = pivot_chart(listings, PivotRequest(StatRequest(group=["year"], aggregators=["count"]), "count", x_column="year"))
    assert {r["label"] for r in alone.series.collect()} == {""}


def test_text_that_is_no_number_is_zero(spark):
    df = spark.createDataFrame([(1, "12.5", "x", None)], "year int, a string, b string, c int")
    assert sorted(rows(series(df, ["year"]))) == [(1, "a", 12.5), (1, "b", 0.0), (1, "c", 0.0)]


@pytest.mark.parametrize(
    "request_, message",
    [
        (PivotRequest(StatRequest(aggregators=["count"]), "count", "make"), "group"),
        (PivotRequest(StatRequest(group=["make"]), "count", "make"), "aggregator"),
        (PivotRequest(STAT, "count", "gearbox"), "not among the groups"),
        (PivotRequest(STAT, "mean", "make"), "not among the aggregators"),
        (PivotRequest(STAT, "count", "make", x_column="cc"), "not among the groups"),
    ],
)
def test_pivot_requests_are_checked(listings, request_, message):
    with pytest.raises(ValueError, match=message):
        pivot_table(listings, request_)


def test_pivot_chart_needs_an_axis(listings):
    with pytest.raises(ValueError, match="x column"):
        pivot_chart(listings, PivotRequest(STAT, "count", "make"))
    with pytest.raises(ValueError, match="cell function"):
        pivot(listings, ["make"], "year", "cc", [2018], cell="mode")


def test_pivot_request_from_payload():
    payload = {
        "x_column": "year", "y_column": "ignored", "y_function": "count", "pivot_column": "make",
        "filter": {"group": ["year", "make"], "aggregators": ["count"], "order": [], "yearFrom": 2017},
    }
    request = PivotRequest.from_payload(payload)
    assert (request.x_column, request.pivot_column, request.stat.filter.year_from) == ("year", "make", 2017)


def test_nulls_sort_last_both_ways(listings):
    up = [r["gearbox"] for r in sort_by(listings, ["gearbox"]).collect()]
    down = [r["gearbox"] for r in sort_by(listings, [{"column": "gearbox", "asc": False}]).collect()]
    assert up[-1] is None and down[-1] is None and down[0] == "Manual" and up[0] == "Automatic"
    assert sort_by(listings, []) is listings


def test_limit_comes_before_sort(listings):
    found = search_deals(listings, ListingFilter(), [("price_in_eur", False)], limit=2, stable_key=["advert_id"])
    assert [r["advert_id"] for r in found.collect()] == ["a2", "a1"]
    assert found.schema["advert_id"].metadata["visible"] is False
    assert found.schema["make"].metadata["visible"] is True
    best = best_deals(listings, [("price_in_eur", False)], limit=2)
    assert [r["advert_id"] for r in best.collect()] == ["b2", "b1"]
    assert search_deals(listings, limit=3).count() == 3
    assert first_rows(listings, 1, ["advert_id"]).first()["advert_id"] == "a1"
    assert top_k(listings, ["advert_id"], 1).first()["advert_id"] == "a1"


def test_facets(spark, listings):
    df = spark.createDataFrame([("Auto",), ("notFound",), (None,), ("Auto",), ("Abc",)], "gearbox string")
    assert rows(facet(df, "gearbox")) == [("Abc",), ("Auto",)]
    assert rows(models_of(listings, "Audi")) == [("A4",), ("A6",)]
    with pytest.raises(ValueError, match="unknown facet"):
        facet(listings, "price_in_eur")


def test_spellings(spark):
    df = spark.createDataFrame([("a b",), ("ab",), (None,), ("ab",)], "v string")
    assert rows(distinct_spellings(df, "v")) == [("a b", "AB"), ("ab", "AB"), (None, None)]


def test_chart_statistics_only_counts_without_a_column(listings):
    counted = chart_statistics(listings, StatRequest(group=["make"], aggregators=["max"]))
    assert rows(counted) == [("BMW", 2), ("Audi", 4)]
    none = chart_statistics(listings, StatRequest())
    assert none.columns == ["count"] and none.count() == 0
    unsorted = chart_statistics(listings, StatRequest(group=["make"], aggregators=["max"], stat_column="power"))
    assert rows(unsorted) == [("Audi", 250), ("BMW", 184)]


def test_columnar_json(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('x', 1, 1.5D, DATE'2024-02-03'), (NULL, NULL, NULL, NULL)"
        " AS t(advert_id, n, f, created_on) ORDER BY n NULLS LAST"
    )
    found = json.loads(columnar_json(df).first()["json"])
    assert found["itemsCount"] == 2
    assert found["advert_id"] == ["x", ""] and found["n"] == [1, None] and found["f"] == [1.5, None]
    assert found["created_on"] == ["2024-02-03", ""]
    assert [m["visible"] for m in found["metadata"]] == [False, True, True, True]
    assert found["metadata"][1] == {"column_name": "n", "column_index": 1, "column_dtype": "int", "visible": True}


def test_responses_have_no_cap_and_keep_the_order(spark):
    df = spark.range(12_345).orderBy(F.desc("id"))
    assert json.loads(columnar_json(df).first()["json"])["id"] == list(range(12_344, -1, -1))
    points = df.select(F.lit("a").alias("label"), F.col("id").alias("x"), F.lit(1.0).alias("value"))
    row, = series_lists(points, "x").collect()
    assert [p.x for p in row.points] == list(range(12_345))


def test_grouped_response(listings):
    grouped = chart_statistics(listings, StatRequest(group=["gearbox", "year"]))
    row = grouped_response(grouped, ["gearbox", "year"]).first()
    assert row["total_count"] == len(row["data"]) == grouped.count()
    gearbox, year = row["dimensions"]
    assert gearbox["distinct_count"] == 3 and "" in gearbox["data"] and year["column_index"] == 1
    assert [m["column"] for m in row["metadata"]] == ["gearbox", "year", "count"]
    assert sorted(rows(dimension_summary(grouped, ["gearbox", "year"]))) == [("gearbox", 0, 3), ("year", 1, 3)]


def test_whole_numbers_truncate(spark):
    df = spark.sql("SELECT 'a' AS k, 2.9D AS mean, -2.9D AS low")
    assert rows(whole_numbers(df)) == [("a", 2, -2)]
    assert rows(whole_numbers(df, ["mean"]).select(F.col("low"))) == [(-2.9,)]
