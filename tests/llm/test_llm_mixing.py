"""Mixing: targets, shares, odd rows, and a hot group of equal rows."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from forecourt.llm.mixing import mix, mixed_documents, targets


def _filled(sizes, weights, budget, most=2):
    """Targets by sharing again and again, as plain numbers."""
    got = {}
    while True:
        left = budget - sum(got.values())
        open_ones = [s for s in sizes if s not in got]
        total = sum(weights[s] for s in open_ones)
        share = {s: left * weights[s] / total for s in open_ones} if total else {}
        above = [s for s in open_ones if share[s] > most * sizes[s]]
        if not above:
            return got | share
        got |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [
    [10, 20, 30], [1000, 1, 1, 1], [5, 5, 5, 5, 5, 5, 5], [1, 1_000_000], [7], [0, 10, 0, 20],
    [3, 50, 800, 2, 9000, 17]])
def test_targets_are_shared_until_none_is_above(spark, sizes):
    rows = spark.createDataFrame(
        [(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in targets(rows).collect()}
    weights = {f"s{i}": (5, 2, 1)[i % 3] for i in range(len(sizes))}
    wanted = _filled({f"s{i}": n for i, n in enumerate(sizes)}, weights, 1.5 * sum(sizes))
    assert got == pytest.approx(wanted)


def test_null_source_comes_last(spark):
    rows = spark.createDataFrame(
        [(None, 100), ("b", 100), ("a", 100)], "source string, source_size long")
    assert [(r.source, r.weight) for r in targets(rows).orderBy("weight").collect()] == [
        (None, 1), ("b", 2), ("a", 5)]


def test_queue_is_in_order_of_finish_times(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mix(docs, rows_per_range=20).collect()
    assert len(rows) == 2 * docs.count()
    rows.sort(key=lambda r: (r.start, r.size > 0))
    at, finish = 0, 0
    for r in (r for r in rows if r.size):
        assert r.start == at and r.finish >= finish
        at, finish = at + r.size, r.finish
    total = sum(r.size for r in rows) // 2
    assert sum(r.taken for r in rows) == total * 3 // 2
    by, most, goal = defaultdict(int), defaultdict(int), {}
    for r in rows:
        by[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
        goal[r.source] = r.target
    slack = sum(most.values())
    assert all(goal[s] - most[s] <= by[s] <= goal[s] + slack for s in by)


def test_ranges_do_not_change_the_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = mixed_documents(docs).collect()
    many = mixed_documents(docs.repartition(7), rows_per_range=9).collect()
    assert sorted(one) == sorted(many)


def test_odd_rows(odd, none):
    frame = mixed_documents(odd)
    rows = frame.collect()
    assert frame.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert len(rows) == odd.count()
    total = sum(r.size for r in rows)
    assert sum(r.taken for r in rows) == total * 3 // 2  # one source: everything, half of it twice
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert mixed_documents(none).collect() == []


def test_equal_rows_each_have_a_place(spark):
    docs = spark.range(3000).select(
        F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"),
        F.lit(None).cast("string").alias("source"))
    rows = mixed_documents(docs, rows_per_range=100).collect()
    assert len(rows) == 3000 and sum(r.taken for r in rows) == 13_500
    assert {r.taken for r in rows} == {3, 6}
