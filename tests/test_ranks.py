"""Order statistics against sorting, on random and awkward tables."""

import math
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType

from forecourt.functions.measures import Measure, quantile
from forecourt.operators.grouping import aggregate_map, group_measures
from forecourt.operators.ranks import slice_of

FRACTIONS = (0.0, 0.0005, 0.25, 0.5, 0.66, 0.9, 0.995, 1.0)
MEASURES = [
    "count", "min", "max", "sum", "mean", "std", "median",
    *[quantile(p, f"q{i}") for i, p in enumerate(FRACTIONS)],
]


def nearest(values, p):
    return sorted(values)[math.floor((len(values) - 1) * p + 0.5)]


def check(row, values):
    kept = [v for v in values if v is not None]
    assert row["count"] == len(kept)
    if not kept:
        assert row["sum"] == 0
        assert all(row[c] is None for c in ("min", "max", "mean", "std", "median", "q0"))
        return
    assert (row["min"], row["max"]) == (min(kept), max(kept))
    assert row["sum"] == pytest.approx(sum(kept))
    assert row["mean"] == pytest.approx(statistics.fmean(kept))
    assert row["median"] == pytest.approx(statistics.median(kept))
    if len(kept) > 1:
        assert row["std"] == pytest.approx(statistics.stdev(kept), rel=1e-7, abs=1e-7)
    else:
        assert row["std"] is None
    for i, p in enumerate(FRACTIONS):
        assert row[f"q{i}"] == nearest(kept, p)


def grouped(values):
    groups = {}
    for key, value in values:
        groups.setdefault(key, []).append(value)
    return groups


KEYS = st.sampled_from(["a", "b", None])
INTS = st.one_of(
    st.none(), st.integers(-5, 5), st.integers(-(2**31), 2**31 - 1),
    st.sampled_from([65_535, 65_536, -65_536, -65_537]),
)


@settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(rows=st.lists(st.tuples(KEYS, INTS), min_size=1, max_size=60))
def test_random_groups_match_sorting(spark, rows):
    df = spark.createDataFrame(rows, "k string, v int")
    found = {row["k"]: row for row in group_measures(df, ["k"], "v", MEASURES).collect()}
    expected = grouped(rows)
    assert found.keys() == expected.keys()
    for key, values in expected.items():
        check(found[key], values)


@settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    values=st.lists(
        st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False, width=32)), max_size=40
    )
)
def test_random_fractions_match_sorting(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    (row,) = group_measures(df, [], "v", MEASURES).collect()
    check(row, values)


@pytest.mark.parametrize(
    "values", [[], [None], [7], [7, 9], [3, 3, 3, 3], [1, 2, 2, 2, 9], [5, None, 1]]
)
def test_small_global_tables(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    (row,) = group_measures(df, [], "v", MEASURES).collect()
    check(row, values)


def test_wide_integers_keep_their_precision(spark):
    values = [2**53 + i for i in range(5)] + [-(2**60), 0]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    (row,) = group_measures(df, [], "v", ["min", "max", "sum", "avg", "std", "median"]).collect()
    assert (row["min"], row["max"], row["sum"]) == (-(2**60), 2**53 + 4, sum(values))
    assert row["avg"] == math.trunc(sum(values) / 7) or abs(row["avg"] - sum(values) / 7) < 100
    assert row["std"] == pytest.approx(statistics.stdev(values), rel=1e-9)


@pytest.mark.parametrize(
    "dtype, values",
    [
        (IntegerType(), [-(2**31), -65_537, -65_536, -1, 0, 1, 65_535, 65_536, 2**31 - 1]),
        (LongType(), [-(2**62), -9, -1, 0, 1, 5, 2**40, 2**62]),
        (DoubleType(), [-1e300, -2.5, -1e-300, 0.0, 1e-300, 1.0, 1.0000001, 3.5, 1e300]),
        (FloatType(), [-8.0, -0.5, 0.0, 0.25, 0.5, 1.5, 1e30]),
    ],
)
def test_slices_keep_order(spark, dtype, values):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype.simpleString()}")
    rows = df.select("v", F.expr(slice_of("v", dtype)).alias("s")).orderBy("v").collect()
    slices = [row["s"] for row in rows]
    assert slices == sorted(slices)
    assert None not in slices


def test_a_hot_key_matches_plain_aggregates(spark):
    """A third of all rows under one key, with few distinct values."""
    df = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"),
        ((F.col("id") * 7919) % 1009 * 130).cast("int").alias("v"),
    )
    ours = group_measures(df, ["k"], "v", ["count", "std", "median"])
    plain = df.groupBy("k").agg(
        F.count("v").alias("n"), F.stddev_samp("v").alias("s"), F.median("v").alias("m")
    )
    off = ours.join(plain, "k").filter(
        (F.col("n") != F.col("count"))
        | (F.abs(F.col("s") - F.col("std")) > 1e-6)
        | (F.col("m") != F.col("median"))
    )
    assert off.count() == 0
    assert ours.count() == plain.count()


def test_simple_measures_agree_in_both_forms(spark, listings):
    names = ["count", "min", "max", "sum", "mean", "avg", "std", "rsd", "rsd_percent", "rsd_whole"]
    plain = group_measures(listings, ["make"], "price_in_eur", names)
    ranked = group_measures(listings, ["make"], "price_in_eur", [*names, "median"]).drop("median")
    assert plain.schema.names == ranked.schema.names
    a = {r["make"]: r.asDict() for r in plain.collect()}
    b = {r["make"]: r.asDict() for r in ranked.collect()}
    assert a.keys() == b.keys()
    for key in a:
        assert a[key] == pytest.approx(b[key], nan_ok=True)
        assert [type(v) for v in a[key].values()] == [type(v) for v in b[key].values()]


def test_rsd_variants(prices):
    df = prices([10, 11, 13])
    wanted = ["mean", "std", "rsd", "rsd_percent", "rsd_whole", "avg"]
    (row,) = group_measures(df, [], "price_in_eur", wanted).collect()
    std = statistics.stdev([10, 11, 13])
    assert row["rsd"] == pytest.approx(std / (34 / 3))
    assert row["rsd_percent"] == pytest.approx(std * 100 / 11)
    assert row["rsd_whole"] == int(std * 100 / (34 / 3))
    assert row["avg"] == 11


def test_a_zero_mean_has_no_relative_deviation(prices):
    (row,) = group_measures(prices([-1, 1]), [], "price_in_eur", ["rsd", "rsd_percent", "median"]).collect()
    assert row["rsd"] is None and row["rsd_percent"] is None


def test_aggregate_map_over_different_types(spark):
    df = spark.createDataFrame(
        [("x", 1, 0.5), ("x", 3, None), ("y", None, 2.5)], "k string, n int, f float"
    )
    found = aggregate_map(
        df, ["k"], {"n": ["min", "sum", "median", "count"], "f": ["max", "mean", ("quantile", 0.5)]}
    )
    assert found.schema["n_min"].dataType == IntegerType()
    assert found.schema["n_sum"].dataType == LongType()
    rows = {r["k"]: r for r in found.collect()}
    assert (rows["x"]["n_min"], rows["x"]["n_sum"], rows["x"]["n_median"]) == (1, 4, 2.0)
    assert (rows["x"]["f_max"], rows["x"]["f_mean"], rows["x"]["f_Q_0_5"]) == (0.5, 0.5, 0.5)
    assert (rows["y"]["n_min"], rows["y"]["n_sum"], rows["y"]["n_count"]) == (None, 0, 0)


def test_a_key_may_itself_be_measured(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "year int")
    found = aggregate_map(df, ["year"], {"year": ["median", "count"]}).orderBy("year").collect()
    assert [tuple(r) for r in found] == [(1, 1.0, 2), (2, 2.0, 1)]
    again = group_measures(df, ["year"], "year", ["count", "median"]).orderBy("year").collect()
    assert [tuple(r) for r in again] == [(1, 2, 1.0), (2, 1, 2.0)]


def test_approximate_answers_are_close(spark):
    df = spark.range(10_001).select(F.col("id").cast("int").alias("v"))
    (row,) = group_measures(df, [], "v", ["median", "quantile_90", "count"], approx=True).collect()
    assert row["count"] == 10_001
    assert abs(row["median"] - 5_000) <= 2 and abs(row["quantile_90"] - 9_000) <= 2


@pytest.mark.parametrize("name", ["mode", "quantile", "quantile_x", "Count", ""])
def test_unknown_measures_are_refused(listings, name):
    with pytest.raises(ValueError, match="unknown measure"):
        group_measures(listings, ["make"], "price_in_eur", [name])


def test_quantile_fractions_are_checked():
    with pytest.raises(ValueError, match="outside"):
        quantile(1.5, "q")
    assert Measure("median", "median").ranked and not Measure("count", "count").ranked
