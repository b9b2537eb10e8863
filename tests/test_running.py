"""The running-count index, bins as a table, numbered rows and pages."""

import bisect
import decimal
import json
import random

import pytest
from pyspark.sql import functions as F

from forecourt.operators.bins import (
    Bin,
    bin_statistics,
    bin_table_statistics,
    bins_between_values,
    bins_frame,
    numbered_bins,
    overlapping,
)
from forecourt.operators.ordering import positions
from forecourt.operators.ranks import COUNT, VALUE, value_counts
from forecourt.operators.running import TOTAL, UPTO, last_before, running_counts
from forecourt.plans.distribution import distribution
from forecourt.sources.results import json_pages

_draw = random.Random(12)


def _values(kind):
    if kind == "int":
        return [_draw.choice([_draw.randint(-50, 50), _draw.randint(-2**31, 2**31 - 1), 7]) for _ in range(900)]
    if kind == "bigint":
        return [_draw.choice([1, 2**62, 10**15]) + _draw.randint(0, 4000) for _ in range(3000)]
    if kind == "double":
        return [_draw.choice([1e-9, 1.0, 1e9, -3e200]) * _draw.random() for _ in range(900)]
    return [decimal.Decimal(_draw.randint(-10**7, 10**7)) / 100 for _ in range(900)]


KINDS = ["int", "bigint", "double", "decimal(12,2)"]


@pytest.mark.parametrize("kind", KINDS)
def test_running_counts(spark, kind):
    values = [*_values(kind.split("(")[0]), None, None]
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    index = running_counts(value_counts(df, [], "x"), df.schema["x"].dataType)
    known = sorted(v for v in values if v is not None)
    rows = {r[VALUE]: (r[COUNT], r[UPTO], r[TOTAL]) for r in index.collect()}
    assert rows == {
        v: (known.count(v), bisect.bisect_right(known, v), len(known)) for v in set(known)}


def test_running_counts_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x int")
    assert running_counts(value_counts(df, [], "x"), df.schema["x"].dataType).collect() == []


def test_successive_large_integers_fall_into_many_slices(spark):
    df = spark.range(200_000).selectExpr("cast(1200000000 + id AS int) AS x")
    index = running_counts(value_counts(df, [], "x"), df.schema["x"].dataType)
    assert index.where(f"{UPTO} <> {VALUE} - 1200000000 + 1").isEmpty()
    from forecourt.operators.ranks import slice_of

    sizes = df.groupBy(F.expr(slice_of("x", df.schema["x"].dataType)).alias("s")).count()
    assert sizes.agg(F.max("count")).first()[0] <= 8192


@pytest.mark.parametrize("kind", ["int", "double"])
def test_last_before(spark, kind):
    values = sorted(set(_values(kind)))
    starts = sorted(_draw.sample(values, 60))
    entries = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{VALUE} {kind}, n int")
    table = spark.createDataFrame([(v, (v, i)) for i, v in enumerate(starts)],
                                  f"{VALUE} {kind}, fc_start struct<at: {kind}, i: int>")
    rows = last_before(entries, table, entries.schema[VALUE].dataType).collect()
    assert len(rows) == len(values)
    for r in rows:
        place = bisect.bisect_right(starts, r[VALUE]) - 1
        assert (r.fc_start.i if r.fc_start else -1) == place


@pytest.mark.parametrize("last_closed", [False, True])
def test_a_table_of_bins_is_like_a_list_of_them(spark, prices, last_closed):
    bins = [Bin(0, 10, "a"), Bin(10, 20, "b"), Bin(20, 20, "none"), Bin(20, 30, "c"), Bin(90, 200, "d")]
    df = prices([None, -3, 0, 5, 5, 9, 10, 20, 29, 30, 60, 90, 150, 199, 200, 200, 201])
    frame = bins_frame(spark, "price_in_eur", bins).unionByName(
        bins_frame(spark, "other", [Bin(0, 1000, "not this column")]))
    listed = bin_statistics(df, "price_in_eur", bins, last_closed).collect()
    assert bin_table_statistics(df, "price_in_eur", frame, last_closed).collect() == listed
    assert bin_table_statistics(df.where("false"), "price_in_eur", frame).collect() == []


def test_thousands_of_bins(spark, prices):
    values = [_draw.randint(0, 60_000) for _ in range(4000)]
    starts = sorted(_draw.sample(range(60_000), 3000))
    frame = numbered_bins(spark.createDataFrame(
        [("price_in_eur", a, b, f"from {a}") for a, b in zip(starts, [*starts[1:], 70_000])],
        "column string, start int, end int, category string").repartition(5), "price_in_eur")
    expected = {}
    for v in values:
        place = bisect.bisect_right(starts, v) - 1
        if place >= 0:
            expected.setdefault(place, []).append(v)
    rows = bin_table_statistics(prices(values), "price_in_eur", frame).collect()
    assert [r["index"] for r in rows] == sorted(expected)
    for r in rows:
        own = expected[r["index"]]
        assert (r["count"], r["min"], r["max"], r["category"]) == (
            len(own), min(own), max(own), f"from {starts[r['index']]}")


def test_bins_between_values(spark):
    df = spark.createDataFrame([(v,) for v in (5, 3, 3, 900, None, -4)], "x int")
    assert sorted(tuple(r) for r in bins_between_values(df, "x").collect()) == [
        ("x", -4, 3, "0", 0), ("x", 3, 5, "1", 1), ("x", 5, 900, "2", 2)]


def test_overlaps_are_found_across_slices(spark):
    bins = [("a", i * 1000, i * 1000 + (1001 if i % 7 == 0 else 1000), "", i) for i in range(2000)]
    bins += [("b", 5, 3, "reversed", 0), ("b", 0, 10**6, "long", 1), ("c", 0, 9, "fine", 0)]
    frame = spark.createDataFrame(bins, "column string, start int, end int, category string, index int")
    found = {(r["column"], r["start"]) for r in overlapping(frame.repartition(6)).collect()}
    assert found == {("a", i * 1000) for i in range(0, 1999, 7)} | {("b", 5), ("b", 0)}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("n", [2, 37])
def test_even_bins_hold_even_shares(spark, kind, n):
    values = _values(kind.split("(")[0])
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    parts = distribution(df.withColumn("make", F.lit("m")), "x", n, kind="quantile", trim=False, last_closed=True)
    known = sorted(values)
    cuts = [known[int((len(known) - 1) * (i / n) + 0.5)] for i in range(n + 1)]
    expected = {}
    for v in known:
        place = max((i for i in range(n) if cuts[i] < cuts[i + 1] and cuts[i] <= v), default=None)
        if place is not None:
            expected.setdefault(str(place + 1), []).append(v)
    rows = parts.bins.collect()
    assert {r["category"]: (r["min"], r["max"], r["count"]) for r in rows} == {
        k: (min(v), max(v), len(v)) for k, v in expected.items()}
    assert parts.edges.first()["edges"] == sorted(set(cuts))


def test_positions_are_gapless_and_do_not_depend_on_storage(spark):
    rows = [(_draw.choice([None, 1, 1, 1, 2, 3]), _draw.choice("abc"), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, s string, i int")
    order = [("k", False), "s", ("i", False)]
    got = positions(df.repartition(7), order).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1], -r[2]))
    assert [(r.k, r.s, r.i) for r in sorted(got, key=lambda r: r.position)] == ordered
    assert sorted(r.position for r in got) == list(range(3000))
    # Ties are in the order of a hash.
    once = positions(df, ["k"], "at").collect()
    again = positions(df.repartition(3), ["k"], "at", ranges=64).collect()
    assert set(once) == set(again) and len(once) == len(again)
    assert positions(df.where("false"), ["k"]).collect() == []


def test_a_hot_key_is_spread_over_ranges(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, id, 7) AS k", "id")
    plan = positions(df, ["k"])
    rows = plan.where("k = 7").selectExpr("min(position)", "max(position)", "count(*)").first()
    assert rows[1] - rows[0] + 1 == rows[2]


def test_pages(spark):
    df = spark.createDataFrame([(i, None if i % 4 else f'x"{i}') for i in range(23)], "i int, t string")
    pages = json_pages(df, [("i", False)], 5).orderBy("page").collect()
    assert [(p.page, p.first, p["items"]) for p in pages] == [(i, 5 * i, 5 if i < 4 else 3) for i in range(5)]
    rows = [row for p in pages for row in json.loads(p.json)]
    assert rows == [{"i": i, "t": None if i % 4 else f'x"{i}'} for i in reversed(range(23))]
    with pytest.raises(ValueError, match="at least one row"):
        json_pages(df, ["i"], 0)


def test_quantile_bins_without_trimming_order_values_for_cuts_and_measures_only(spark):
    """Once for each of two passes and for the cuts of each; not for extremes or slices' totals."""
    from forecourt.plans.distribution import distribution

    rows = spark.range(5000).selectExpr("'m' AS make", "id * 1000003 + 1000000000000000 AS number")
    bins = distribution(rows, "number", 7, kind="quantile", trim=False, last_closed=True).bins
    plan = bins._jdf.queryExecution().optimizedPlan().toString()
    ordered = [line for line in plan.splitlines() if "Window [" in line and "AS fc_here" in line]
    assert len(ordered) == 4
    assert [r["count"] for r in bins.collect()] == [714, 714, 714, 715, 714, 714, 715]
