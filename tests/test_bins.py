"""Bins, distributions and bands."""

import pytest
from pyspark.sql import functions as F

from forecourt.functions.bands import (
    MILEAGE_BANDS,
    POWER_BANDS,
    band_label,
    band_number,
    band_of,
    price_band,
    price_band_order,
)
from forecourt.operators.bins import (
    Bin,
    add_bin,
    axis_values,
    bin_at,
    bin_extent,
    bin_statistics,
    bins_frame,
    checked,
    label_bins,
    overlapping,
)
from forecourt.plans.distribution import (
    bins_between,
    distribution,
    distribution_chart,
    equal_width_bins,
    trim_range,
)
from forecourt.plans.statistics import even_fractions, summary

TOUCHING = [Bin(1, 2, "a"), Bin(2, 3, "b"), Bin(3, 4, "c")]


def test_bins_are_kept_in_order():
    assert add_bin([Bin(5, 6, "z"), Bin(1, 2, "a")], Bin(2, 5, "m")) == [
        Bin(1, 2, "a"), Bin(2, 5, "m"), Bin(5, 6, "z"),
    ]


@pytest.mark.parametrize(
    "new", [Bin(1, 2, "x"), Bin(0, 5, "x"), Bin(3, 10, "x"), Bin(2, 4, "x")]
)
def test_overlapping_bins_are_refused(new):
    with pytest.raises(ValueError, match="overlap"):
        add_bin(TOUCHING, new)


def test_reversed_and_missing_bins_are_refused():
    with pytest.raises(ValueError, match="after its end"):
        checked([Bin(3, 1, "x")])
    with pytest.raises(ValueError, match="no bins"):
        checked([])


def test_bins_as_a_table(spark):
    frame = bins_frame(spark, "price", [TOUCHING[2], TOUCHING[0], TOUCHING[1]])
    assert [r["index"] for r in frame.orderBy("start").collect()] == [0, 1, 2]
    assert [r["axis_value"] for r in axis_values(frame).collect()] == [1, 2, 3, 4]
    assert tuple(bin_extent(frame).first()) == ("price", 3, 1, 4)
    assert bin_at(frame, 1).first()["category"] == "b"
    assert bin_at(frame, 9).count() == 0
    assert overlapping(frame).count() == 0
    clash = frame.union(spark.createDataFrame([("price", 2, 9, "x", 3)], frame.schema))
    assert {r["category"] for r in overlapping(clash).collect()} == {"b", "x"}


def test_even_fractions():
    assert [a for _, _, a in even_fractions(5)] == ["q20", "q40", "q60", "q80", "q100"]
    assert [a for _, _, a in even_fractions(7)] == ["q14", "q29", "q43", "q57", "q71", "q86", "q100"]
    assert even_fractions(8)[0] == (1, 0.125, "q13")
    assert even_fractions(0) == []


def test_values_at_the_end_or_in_gaps_are_in_no_bin(prices):
    bins = [Bin(0, 10, "10"), Bin(20, 30, "top")]
    df = prices([0, 9, 10, 15, 20, 30, 31, None])
    rows = bin_statistics(df, "price_in_eur", bins).collect()
    assert [(r["category"], r["count"], r["min"], r["max"]) for r in rows] == [("10", 2, 0, 9), ("top", 1, 20, 20)]
    closed = bin_statistics(df, "price_in_eur", bins, last_closed=True).collect()
    assert [r["count"] for r in closed] == [2, 2]
    labels = label_bins(df, "price_in_eur", bins).collect()
    assert [r["category"] for r in labels] == ["10", "10", None, None, "top", None, None, None]


def test_empty_bins_vanish(prices):
    bins = [Bin(0, 10, "a"), Bin(10, 20, "b"), Bin(20, 20, "none"), Bin(20, 30, "c")]
    rows = bin_statistics(prices([1, 25]), "price_in_eur", bins).collect()
    assert [(r["category"], r["index"]) for r in rows] == [("a", 0), ("c", 3)]
    assert bin_statistics(prices([]), "price_in_eur", bins).count() == 0
    assert bin_statistics(prices([None]), "price_in_eur", bins).count() == 0


def test_equal_width_leaves_the_remainder_out():
    assert equal_width_bins(0, 11, 3) == [Bin(0, 3, "0"), Bin(3, 6, "1"), Bin(6, 9, "2")]
    assert equal_width_bins(5, 6, 3) == [Bin(5, 6, "0")]
    assert bins_between([1, 4, 4, 9]) == [Bin(1, 4, "1"), Bin(4, 9, "3")]


def counts(parts):
    return [(r["category"], r["count"]) for r in parts.bins.collect()]


def test_distribution_remainder_and_closing(prices):
    df = prices(range(12))
    parts = distribution(df, "price_in_eur", 3, trim=False)
    assert parts.edges.first()["edges"] == [0, 3, 6, 9]
    assert counts(parts) == [("0", 3), ("1", 3), ("2", 3)]
    assert parts.summary.first()["count"] == 12
    closed = distribution(df, "price_in_eur", 3, trim=False, last_closed=True)
    assert counts(closed) == [("0", 3), ("1", 3), ("2", 6)]
    assert closed.edges.first()["edges"] == [0, 3, 6, 11]


def test_tied_quantiles_make_no_bin(prices):
    df = prices([1, 1, 1, 1, 1, 1, 5, 9])
    parts = distribution(df, "price_in_eur", 4, kind="quantile", trim=False)
    # Cut points 1, 1, 1, 1 and 9: the bins of no width are left out.
    assert counts(parts) == [("4", 7)]
    closed = distribution(df, "price_in_eur", 4, kind="quantile", trim=False, last_closed=True)
    assert sum(n for _, n in counts(closed)) == 8


@pytest.mark.parametrize("kind", ["interval", "quantile"])
def test_degenerate_distributions(prices, kind):
    nothing = distribution(prices([None]), "price_in_eur", 4, kind=kind)
    assert counts(nothing) == [] and nothing.summary.first()["count"] == 0
    equal = distribution(prices([7, 7, 7]), "price_in_eur", 4, kind=kind, last_closed=True)
    assert [n for _, n in counts(equal)] == [3]
    half_open = distribution(prices([7, 7, 7]), "price_in_eur", 4, kind=kind)
    assert [n for _, n in counts(half_open)] == ([3] if kind == "interval" else [])


def test_rows_at_the_very_top_are_in_no_bin(spark):
    """All but the two rows at the maximum are in a bin; closing the last takes them in."""
    kind = "quantile"
    df = spark.range(2_000).select(
        F.lit("m").alias("make"),
        F.when(F.col("id") >= 1_998, 206_900).otherwise(7_000 + F.col("id") * 90).cast("int").alias("price_in_eur"),
    )
    parts = distribution(df, "price_in_eur", 4, kind=kind, trim=False)
    chart = distribution_chart(parts, "price_in_eur").first()
    assert chart["count"] == 2_000
    assert sum(d["count"] for d in chart["data"]) == 1_998
    assert chart["axis_values"][0] == 7_000
    assert len(chart["data"]) == 4
    closed = distribution(df, "price_in_eur", 4, kind=kind, trim=False, last_closed=True)
    assert sum(n for _, n in counts(closed)) == 2_000


def test_requests_are_checked(prices):
    with pytest.raises(ValueError, match="two bins"):
        distribution(prices([1]), "price_in_eur", 1)
    with pytest.raises(ValueError, match="unknown kind"):
        distribution(prices([1]), "price_in_eur", 2, kind="other")
    with pytest.raises(ValueError, match="missing columns"):
        distribution(prices([1]), "mileage", 2)
    with pytest.raises(ValueError, match="quantile"):
        summary(prices([1]), "price_in_eur", n=0)


@pytest.mark.parametrize(
    "n, cut", [(50, (0.0, 1.0)), (51, (0.05, 0.95)), (500, (0.05, 0.95)), (501, (0.03, 0.97)),
               (1000, (0.03, 0.97)), (1001, (0.0005, 0.995))],
)
def test_trim_tiers_change_above_their_size(spark, n, cut):
    df = spark.range(n).select(F.lit("m").alias("make"), (F.col("id") * 10).cast("int").alias("p"))
    row = trim_range(df, "p").first()
    low, high = (int((n - 1) * q + 0.5) * 10 for q in cut)
    assert (row["orig_start"], row["orig_end"]) == (0, (n - 1) * 10)
    assert (row["start"], row["end"], row["count"]) == (low, high, n)


def test_trim_range_of_nothing(prices):
    row = trim_range(prices([]), "price_in_eur").first()
    assert row["count"] == 0 and row["start"] is None and row["rsd"] is None


def test_bands_are_closed(spark):
    df = spark.createDataFrame([(v,) for v in (-1, 0, 20_000, 20_001, 150_001, 1_000_000, None)], "v int")
    found = df.select(band_number("v", MILEAGE_BANDS).alias("n"), band_label("v", MILEAGE_BANDS).alias("l")).collect()
    assert [r["n"] for r in found] == [None, 1, 1, 2, 8, None, None]
    assert found[0]["l"] is None and found[1]["l"] == "Less than 20 000 km"
    assert band_of(90, POWER_BANDS).end == 90 and band_of(91, POWER_BANDS).start == 91
    assert band_of(None, POWER_BANDS) is None and band_of(10_000, POWER_BANDS) is None


def test_price_bands(spark):
    df = spark.createDataFrame([(v,) for v in (0, 4_999, 5_000, 19_999, 99_999, 100_000, None)], "p int")
    rows = df.select(price_band("p").alias("b"), price_band_order("p").alias("c")).collect()
    assert [tuple(r) for r in rows] == [
        ("5K", 1), ("5K", 1), ("10K", 2), ("20K", 5), ("100K", 14), ("100K+", 15), ("100K+", 15),
    ]
