"""Properties of the plans that matter at scale."""

import re

import pytest

from checks.adverts import adverts
from checks.queries import QUERIES
from forecourt.operators.filters import ListingFilter
from forecourt.operators.grouping import group_measures
from forecourt.plans.distribution import distribution
from forecourt.plans.estimate import estimate_prices
from forecourt.plans.pivoting import PivotRequest, pivot_chart
from forecourt.plans.statistics import StatRequest, grouped_statistics, summary
from forecourt.sources.readers import read_parquet
from forecourt.sources.writers import write_parquet


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df):
    df.collect()
    return planned(df).split("== Initial Plan ==")[0]


def scans(plan):
    return plan.count("FileScan")


@pytest.fixture(scope="module")
def parquet(spark, tmp_path_factory, sf_dir):
    path = str(tmp_path_factory.mktemp("plans") / "adverts")
    write_parquet(adverts(spark, sf_dir), path)
    return read_parquet(spark, path)


def test_filters_and_columns_reach_the_scan(parquet):
    wanted = ListingFilter(make="Brand#1", year_from=1996, price_to=50_000, engine=["2-HIGH"])
    request = StatRequest(wanted, ["model"], ["count", "avg"], stat_column="mileage")
    plan = planned(grouped_statistics(parquet, request))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan)[1]
    for part in ("EqualTo(make,Brand#1)", "GreaterThanOrEqual(year,1996)",
                 "LessThanOrEqual(price_in_eur,50000)", "EqualTo(engine,2-HIGH)"):
        assert part in pushed
    read = set(re.search(r"ReadSchema: struct<(.*?)>", plan)[1].split(","))
    assert {c.split(":")[0] for c in read} == {"make", "model", "year", "engine", "mileage", "price_in_eur"}


def test_simple_measures_take_one_shuffle(parquet):
    plan = planned(group_measures(parquet, ["make"], "price_in_eur", ["count", "avg", "std", "rsd"]))
    assert plan.count("Exchange") == 1 and "partial_" in plan and "Window" not in plan


@pytest.mark.parametrize("keys", [[], ["make"], ["make", "gearbox"]])
def test_order_statistics_scan_once(parquet, keys):
    wanted = ["count", "min", "mean", "std", "median", "quantile_90"]
    plan = executed(group_measures(parquet, keys, "price_in_eur", wanted))
    assert scans(plan) == 1 and "ReusedExchange" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_summary_filters_at_the_scan(parquet):
    one = summary(parquet, "price_in_eur", ListingFilter(make="Brand#2"), 4, (10_000, 20_000))
    plan = planned(one)
    assert "GreaterThanOrEqual(price_in_eur,10000)" in plan and "EqualTo(make,Brand#2)" in plan


def test_limits_keep_few_rows_per_task(spark, sf_dir):
    plan = planned(QUERIES["deals"](spark, sf_dir))
    assert "TakeOrderedAndProject" in plan


def test_unused_lookups_are_not_joined(spark, sf_dir):
    plan = planned(QUERIES["facet_source"](spark, sf_dir))
    assert scans(plan) == 1 and "Join" not in plan


NAMES = [
    "stat_ordered", "agg_map_ranked", "trim_range_all", "dist_quantile", "bin_stats", "pivoted_null",
    "pivot_series", "deals", "estimate_relaxed", "estimate_batch", "estimate_batch_engines",
    "result_columns",
]


@pytest.mark.parametrize("name", NAMES)
def test_no_pairing_and_no_python(spark, sf_dir, name):
    plan = planned(QUERIES[name](spark, sf_dir))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert word not in plan


def test_batch_never_pairs_a_hot_model(spark):
    """A third of requests and adverts share all fields: joins stay linear in them."""
    n = 6_000
    rows = spark.range(n).selectExpr(
        "id AS request_id",
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('m', id % 700) END AS make",
        "CASE WHEN id % 3 = 0 THEN 1000 ELSE int(id % 5) END AS cc",
        "int(1000 + id % 97) AS price_in_eur",
    )
    answered = estimate_prices(rows.drop("price_in_eur"), rows.drop("request_id"))
    assert answered.count() == n
    hot = answered.filter("request_id = 0").first()
    assert hot["count"] == n // 3
    answered.collect()
    metrics = []

    def visit(node):
        if "Join" in node.nodeName():
            found = node.metrics().get("numOutputRows")
            if found.isDefined():
                metrics.append(found.get().value())
        if node.nodeName() == "AdaptiveSparkPlan":
            visit(node.executedPlan())
        elif hasattr(node, "plan") and "QueryStage" in node.nodeName():
            visit(node.plan())
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(answered._jdf.queryExecution().executedPlan())
    assert metrics and max(metrics) <= 2 * n


def jobs_run(spark, build):
    """How many jobs building a query runs."""
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    built = build()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before, built


@pytest.mark.parametrize("kind", ["interval", "quantile"])
def test_a_distribution_is_one_lazy_plan(spark, parquet, kind):
    n, parts = jobs_run(spark, lambda: distribution(parquet, "price_in_eur", 4, kind=kind))
    assert n == 0
    plan = executed(parts.bins)
    assert scans(plan) == 1 and "InMemoryTableScan" not in plan
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_a_chart_is_built_without_a_query(spark, parquet):
    stat = StatRequest(group=["year", "engine"], aggregators=["avg"])
    request = PivotRequest(stat, "avg", "engine", x_column="year")
    n, chart = jobs_run(spark, lambda: pivot_chart(parquet, request))
    assert n == 0
    plan = planned(chart.series)
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_wide_values_are_ordered_in_small_parts(spark):
    """Consecutive microseconds, large doubles: no part holds more than a few thousand values."""
    for kind, low in (("bigint", 1_700_000_000_000_000), ("double", 1e13), ("double", 1e200)):
        step = 1 if low < 1e100 else 1e195
        df = spark.range(60_000).selectExpr(f"cast({low!r} + id * {step!r} AS {kind}) AS x")
        found = group_measures(df, [], "x", ["median", "quantile_10"])
        row = found.first()
        assert abs(row["quantile_10"] - (low + 6000 * step)) <= abs(step)
        plan = found._jdf.queryExecution().executedPlan()
        assert "fc_part" in plan.toString()


def test_keyed_ranks_share_one_partitioning(spark, parquet):
    """Without broadcasts, join and window of the values looked into use the same exchange."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = planned(group_measures(parquet, ["make", "gearbox"], "price_in_eur", ["median"]))
    finally:
        spark.conf.set(key, before)
    # Twice the value counts, slices, slices by key, both sides of the join, the result.
    assert plan.count("Exchange hashpartitioning") <= 7
    for line in plan.splitlines():
        assert "coalesce(fc_key" not in line and "isnull(fc_key" not in line


def test_engine_requests_are_counted_before_their_texts_are_sorted(spark, sf_dir):
    """Spark drops a distinct below a minimum again, and sorts all rows for texts."""
    plan = QUERIES["estimate_batch_engines"](spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    below = plan.toString().split("min(engine")[1].splitlines()[1:4]
    assert any("Filter (count" in line for line in below)


@pytest.mark.parametrize("name", ["estimate_batch", "estimate_batch_limits", "estimate_batch_ranges"])
def test_batches_neither_sort_requests_for_texts_nor_sort_by_structs(spark, sf_dir, name):
    """an aggregate of texts sorts its rows, and a struct is compared field by field."""
    plan = planned(QUERIES[name](spark, sf_dir))
    assert "first(fc_" not in plan
    sorts = [line for line in plan.splitlines() if "Sort [" in line or "Window [" in line]
    assert sorts
    for line in sorts:
        assert not any(f"{key}#" in line for key in ("strict", "wish", "cell_0", "cell_1", "cell_2", "fc_key"))


def test_a_batch_moves_line_items_and_requests_once(spark, sf_dir):
    """requests and adverts are the same line items, and wishes come from the requests moved."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = executed(QUERIES["estimate_batch"](spark, sf_dir))
    finally:
        spark.conf.set(key, before)

    def moved(what):
        lines = [line for line in plan.splitlines() if what in line and "ReusedExchange" not in line]
        return {re.search(r"plan_id=(\d+)", line).group(1) for line in lines}

    assert len(moved("Exchange hashpartitioning(l_partkey")) == 1
    assert len(moved("REPARTITION_BY_COL")) == 1
    # No wishes, cells and adverts looked up by each other.
    assert not moved("Exchange hashpartitioning(cell_0_a")


def test_adverts_are_narrowed_before_they_are_joined(spark, sf_dir):
    """what a line item alone gives is taken below the joins, and the rows are all there."""
    columns = ["advert_id", "make", "year", "mileage", "price_in_eur"]
    plain, pinned = adverts(spark, sf_dir, columns), adverts(spark, sf_dir, columns, [*columns, "gearbox"])
    for rows in (plain, pinned):
        below = planned(rows).split("Join [l_partkey")[-1]
        assert "AS year" in below and "AS price_in_eur" in below
    assert plain.exceptAll(pinned).isEmpty() and plain.count() == pinned.count()


@pytest.mark.parametrize("name, grouped", [("estimate_batch_limits", True), ("estimate_batch", False)])
def test_prices_met_in_many_nodes_are_ordered_once(spark, sf_dir, name, grouped):
    """below the window, the rows of a wish with limits are added up by price, without another shuffle."""
    plan = planned(QUERIES[name](spark, sf_dir))
    below = plan.split("Window [")[-1].split("Exchange")[0]
    assert ("HashAggregate(keys=[wish_a" in below) == grouped


def test_adverts_go_up_their_tree_in_compiled_code(spark, sf_dir):
    """a function of an array's elements is called per advert and level; only wishes have them."""
    plan = planned(QUERIES["estimate_batch_ranges"](spark, sf_dir))
    for line in plan.splitlines():
        assert not ("Generate explode" in line and "at_year" in line and "lambda" in line)
    assert "Generate explode" in plan and "bin(" not in plan.split("Generate explode")[-1].split("\n")[0]
