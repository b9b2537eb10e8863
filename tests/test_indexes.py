"""Search index, mergeable states, variant pivots, collations."""

import random

import pytest
from pyspark.sql import functions as F
from test_plans import jobs_run

from forecourt.functions.text import any_like
from forecourt.operators.facets import (
    BLIND_TO_CASE_AND_ACCENTS,
    collated,
    collated_values,
    listings_spelt,
)
from forecourt.operators.grouping import group_measures
from forecourt.operators.pivot import pivot, pivot_objects
from forecourt.operators.search_index import (
    indexed_search,
    needed_trigrams,
    texts_found,
    trigram_index,
)
from forecourt.operators.sketches import (
    distinct_states,
    facet_overlap,
    merged_moments,
    merged_quantiles,
    moment_states,
    quantile_states,
)

WORDS = ["red", "blue", "Widget", "gear", "bolt", "URGENT", "4.2", "a+b", "ab", ""]


@pytest.fixture(scope="module")
def adverts(spark):
    draw = random.Random(3)

    def text():
        return None if draw.random() < 0.1 else " ".join(draw.choices(WORDS, k=draw.randint(0, 3)))

    return spark.createDataFrame([(i, text(), text()) for i in range(500)], "id int, title string, equipment string")


@pytest.mark.parametrize("value", [
    "red", "RED*", "*bolt", "*ed*", "gear bolt", "re", "r.d", "red.*gear", "red|gear", "[rb]", "(", "a+b",
    "4.2", "*a+b", "x", "", "blue .+bolt", "widget$"])
def test_indexed_search_is_the_plain_search(adverts, value):
    index = trigram_index(adverts)
    columns = ("title", "equipment")
    plain = {r.id for r in adverts.where(any_like(columns, value)).collect()}
    found = indexed_search(adverts, index, value)
    assert found.columns == adverts.columns
    assert sorted(r.id for r in found.collect()) == sorted(plain)


def test_what_a_pattern_needs():
    assert needed_trigrams("*Bolt") == ["bol", "olt"]
    assert needed_trigrams("re.*get x") == ["get", "et ", "t x"]
    assert needed_trigrams("ab") is None and needed_trigrams("red|blue") is None
    assert needed_trigrams("rare?") is None


def test_the_index_leaves_few_texts_to_match(adverts):
    index = trigram_index(adverts)
    texts = index.select("column", "value").distinct().count()
    assert 0 < texts_found(index, "gear bolt").count() < texts / 10


def test_quantile_states_merge(spark):
    df = spark.range(40_000).selectExpr(
        "id % 4 AS k", "id % 7 AS part", "cast(id * 7919 % 40000 AS int) AS x", "id / 3.0D AS y")
    for column, kind in (("x", "bigint"), ("y", "double")):
        states = quantile_states(df, ["k", "part"], column)
        rows = merged_quantiles(states, ["k"], [0.25, 0.75], kind).collect()
        assert len(rows) == 8 and {r.rows for r in rows} == {10_000}
        top = 40_000 if column == "x" else 40_000 / 3
        assert all(abs(r.value / top - r.fraction) < 0.02 for r in rows)
    none = df.selectExpr("k", "part", "cast(NULL AS int) AS x")
    assert merged_quantiles(quantile_states(none, ["k", "part"], "x"), ["k"], [0.5]).collect() == []


def test_overlaps_below_the_size_of_a_sketch_are_exact(spark):
    df = spark.range(6000).selectExpr("id % 3 AS make", "id % 1000 AS price", "id % 5 = 0 AS cheap")
    rows = facet_overlap(df, "make", "price", F.col("cheap")).collect()
    assert {tuple(r) for r in rows} == {(m, 1000, 200, 800, 1000) for m in range(3)}
    nobody = facet_overlap(df, "make", "price", F.lit(None).cast("boolean")).collect()
    assert {(r.shared, r.either) for r in nobody} == {(0, 1000)}
    assert distinct_states(df, ["make"], "price").count() == 3


def test_merged_moments_are_those_of_all_rows(spark):
    df = spark.range(5000).selectExpr(
        "id % 3 AS k", "id % 11 AS part", "if(id % 13 = 0, NULL, 1e12D + id % 97) AS x")
    merged = {r.k: r for r in merged_moments(moment_states(df, ["k", "part"], "x"), ["k"]).collect()}
    for r in group_measures(df, ["k"], "x", ["count", "mean", "std", "rsd"]).collect():
        own = merged[r.k]
        assert own["count"] == r["count"] and own["mean"] == pytest.approx(r["mean"])
        shifted = df.where(f"k = {r.k}").agg(F.stddev_samp(F.col("x") - 1e12)).first()[0]
        assert own["std"] == pytest.approx(shifted, rel=1e-6)
    whole = merged_moments(moment_states(df, ["part"], "x"), []).collect()
    assert len(whole) == 1 and whole[0]["count"] == df.where("x IS NOT NULL").count()
    one = spark.createDataFrame([(1, 5.0)], "k int, x double")
    assert merged_moments(moment_states(one, ["k"], "x"), ["k"]).first()["std"] is None


def test_pivot_objects_are_the_pivot(spark):
    grouped = spark.createDataFrame(
        [("a", "p", 1), ("a", "q", 2), ("a", "p", 4), ("b", None, 8), (None, "x y", 16), ("c", "p", None)],
        "k string, c string, v int")
    n, objects = jobs_run(spark, lambda: pivot_objects(grouped, ["k"], "c", "v"))
    assert n == 0
    wide = {r["k"]: r for r in pivot(grouped, ["k"], "c", "v", ["p", "q", None, "x y"]).collect()}
    got = objects.select("k", *[
        F.coalesce(F.expr(f"variant_get(cells, '$[\"{c}\"]', 'bigint')"), F.lit(0)).alias(c)
        for c in ("p", "q", "null", "x y")]).collect()
    assert {tuple(r) for r in got} == {tuple(r[c] for c in ("k", "p", "q", "null", "x y")) for r in wide.values()}
    with pytest.raises(ValueError, match="name of an index column"):
        pivot_objects(grouped, ["k"], "c", "v", name="k")


def test_spellings(spark):
    df = spark.createDataFrame(
        [(v,) for v in ("Audi", "AUDI", "audi", "Škoda", "SKODA", None, "Audi")], "make string")
    rows = [tuple(r) for r in collated_values(df, "make").collect()]
    assert rows == [("AUDI", 3, 4), ("SKODA", 1, 1), ("Škoda", 1, 1), (None, 0, 1)]
    blind = [tuple(r) for r in collated_values(df, "make", BLIND_TO_CASE_AND_ACCENTS).collect()]
    assert ("SKODA", 2, 2) in blind
    assert collated(df, ["make"]).where("make = 'aUDI'").count() == 4
    wishes = spark.createDataFrame([("auDI",), ("nobody",)], "make string")
    assert listings_spelt(df, wishes, ["make"]).count() == 4
