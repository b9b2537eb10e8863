"""One query per operator, over the test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from checks.adverts import ADVERT_COLUMNS, AS_OF, adverts, id_of_key
from forecourt.functions.bands import (
    MILEAGE_BANDS,
    POWER_BANDS,
    band_label,
    band_number,
    price_band,
    price_band_order,
)
from forecourt.functions.measures import Measure, quantile
from forecourt.operators.bins import (
    Bin,
    axis_values,
    bin_at,
    bin_extent,
    bin_statistics,
    bin_table_statistics,
    bins_between_values,
    label_bins,
    numbered_bins,
    overlapping,
)
from forecourt.operators.facets import collated_values, distinct_spellings, facet, models_of
from forecourt.operators.filters import ListingFilter, in_range, typed_filter, typed_predicate
from forecourt.operators.grouping import aggregate_map, group_measures, row_count
from forecourt.operators.ordering import distinct_on, distinct_values, sort_by
from forecourt.operators.search_index import indexed_search, trigram_index
from forecourt.operators.sketches import (
    distinct_error,
    facet_overlap,
    merged_moments,
    merged_quantiles,
    moment_states,
    quantile_states,
)
from forecourt.plans import estimate as est
from forecourt.plans.deals import MOST_DEALS, best_deals, search_deals
from forecourt.plans.distribution import distribution, distribution_chart, trim_range
from forecourt.plans.pivoting import (
    PivotRequest,
    pivot_chart,
    pivot_object_table,
    pivot_table,
)
from forecourt.plans.statistics import (
    StatRequest,
    chart_statistics,
    grouped_statistics,
    price_band_distribution,
    summary,
    typed_query,
)
from forecourt.sources.readers import bad_lines, parse_lines, strip_quotes
from forecourt.sources.results import (
    columnar_json,
    dimension_summary,
    grouped_response,
    json_pages,
    series_lists,
    whole_numbers,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6
PRICE = "price_in_eur"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Fractional columns rounded, so that engines can be compared; ``digits`` for some of them."""
    kinds = (DoubleType, FloatType)
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`").cast("double"), digits.get(f.name, DIGITS)).alias(f.name)
            if isinstance(f.dataType, kinds)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


# --- minimum slice -------------------------------------------------------------------


@query
def price_by_make(spark, sf_dir):
    request = StatRequest(
        ListingFilter(year_from=1996, year_to=1998),
        ["make"],
        ["count", "min", "max", "avg"],
        ["make"],
    )
    return grouped_statistics(adverts(spark, sf_dir, ["make", "year", PRICE]), request)


# --- filters -------------------------------------------------------------------------

FILTERS: dict[str, tuple[ListingFilter, Sequence[str]]] = {
    "filter_make": (ListingFilter(make="Brand#3"), ["make"]),
    "filter_model": (ListingFilter(model="STANDARD"), ["model"]),
    "filter_engine": (ListingFilter(engine=["2-HIGH", "5-LOW"]), ["engine"]),
    "filter_engine_empty": (ListingFilter(engine=[], make="Brand#4"), ["engine", "make"]),
    "filter_gearbox": (ListingFilter(gearbox="A"), ["gearbox"]),
    "filter_estimated_price": (
        ListingFilter(estimated_price=40_000), ["estimated_price_in_eur"]
    ),
    "filter_price": (ListingFilter(price=90_000), [PRICE]),
    "filter_price_range": (ListingFilter(price_from=20_000, price_to=25_000), [PRICE]),
    "filter_year": (ListingFilter(year=1997, year_from=1999), ["year"]),
    "filter_year_range": (ListingFilter(year_from=1996, year_to=1997), ["year"]),
    "filter_discount": (ListingFilter(discount_from=3, discount_to=6), ["discount"]),
    "filter_save_diff": (
        ListingFilter(save_diff_from=0, save_diff_to=20_000), ["save_diff_in_eur"]
    ),
    "filter_power": (ListingFilter(power=140, power_from=400), ["power"]),
    "filter_power_range": (ListingFilter(power_from=100, power_to=150), ["power"]),
    "filter_mileage": (ListingFilter(mileage=40_000, mileage_to=8_000), ["mileage"]),
    "filter_mileage_range": (
        ListingFilter(mileage_from=20_000, mileage_to=40_000), ["mileage"]
    ),
    "filter_cc": (ListingFilter(cc=1_200, cc_to=500), ["cc"]),
    "filter_cc_range": (ListingFilter(cc_from=1_000, cc_to=1_600), ["cc"]),
    "filter_created_on": (
        ListingFilter(created_on_from=900, created_on_to=300), ["created_on"]
    ),
    "filter_none": (ListingFilter(), ["make"]),
    "filter_all_of": (
        ListingFilter(
            make="Brand#7", engine=["1-URGENT", "3-MEDIUM"], year_from=1997,
            mileage_to=120_000, price=10_000, price_to=90_000, search="widget",
        ),
        ["make", "engine", "year", "mileage", PRICE, "title", "equipment"],
    ),
    "search_contains": (ListingFilter(search="Re.*get"), ["title", "equipment"]),
    "search_equipment": (ListingFilter(search="urgent"), ["title", "equipment"]),
    "search_prefix": (ListingFilter(search="Blue*"), ["title", "equipment"]),
    "search_suffix": (ListingFilter(search="*GEAR"), ["title", "equipment"]),
    "search_star_both": (ListingFilter(search="*bolt*"), ["title", "equipment"]),
}


def _filter_query(name: str) -> None:
    wanted, columns = FILTERS[name]

    def run(spark, sf_dir):
        return wanted.apply(adverts(spark, sf_dir, ["advert_id", *columns]), AS_OF)

    QUERIES[name] = run


for _name in FILTERS:
    _filter_query(_name)


@query
def filter_in_range(spark, sf_dir):
    return in_range(adverts(spark, sf_dir, ["advert_id", PRICE]), PRICE, 50_000, 60_000)


@query
def filter_typed_all(spark, sf_dir):
    columns = ["advert_id", "gearbox", "save_diff_in_eur", "power", "discount", "created_on"]
    return typed_filter(
        adverts(spark, sf_dir, columns),
        typed_predicate("Gt", {"save_diff_in_eur": -5_000, "power": 59}),
        typed_predicate("Lt", {"created_on": dt.date(1999, 3, 14)}),
        typed_predicate("Eq", {"gearbox": "N"}),
        typed_predicate("Lte", {"discount": 8.5}),
        F.col("power").isin([60, 90, 250, 400, 410]),
    ).select("advert_id", "gearbox", "save_diff_in_eur", "power", "created_on")


@query
def filter_typed_any(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["advert_id", "title", "make", "year", "discount"])
    return typed_filter(
        rows.select("advert_id", "title", "make", "year"),
        typed_predicate("Like", {"title": "red*", "make": "*5"}, match_all=False),
        typed_predicate("Eq", {"year": 1996, "make": "Brand#15"}, match_all=False),
    )


# --- aggregates ----------------------------------------------------------------------

SIMPLE = ["count", "min", "max", "sum", "mean", "avg", "std", "rsd"]
RSDS = [Measure("rsd_percent", "rsd_percent"), Measure("rsd_whole", "rsd_whole")]


@query
def stat_group(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["make", "model", PRICE])
    return rounded(group_measures(rows, ["make", "model"], PRICE, [*SIMPLE, *RSDS]))


@query
def stat_group_null_key(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["gearbox", "year", "estimated_price_in_eur"])
    return rounded(
        group_measures(
            rows, ["gearbox", "year"], "estimated_price_in_eur",
            [*SIMPLE, *RSDS, "median", "quantile_90"],
        )
    )


@query
def stat_global(spark, sf_dir):
    return rounded(group_measures(adverts(spark, sf_dir, [PRICE]), [], PRICE, SIMPLE))


@query
def stat_global_ranked(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["save_diff_in_eur"])
    return rounded(
        group_measures(
            rows, [], "save_diff_in_eur", [*SIMPLE, "median", "quantile_75"]
        )
    )


@query
def stat_ordered(spark, sf_dir):
    """A group key and a measured column with nulls, two ways to sort."""
    request = StatRequest(
        ListingFilter(power_from=80, mileage_to=150_000),
        ["gearbox", "engine", "model"],
        ["quantile_5", "quantile_33", "rsd", "max", "count", "median", "sum"],
        [("gearbox", True), ("count", False), ("engine", True), ("model", True)],
        "estimated_price_in_eur",
    )
    columns = ["gearbox", "engine", "model", "power", "mileage", "estimated_price_in_eur"]
    return rounded(grouped_statistics(adverts(spark, sf_dir, columns), request))


@query
def quantile_nearest(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["model", PRICE])
    names = [f"quantile_{p}" for p in (60, 66, 70, 75, 80, 85, 90)]
    return group_measures(rows, ["model"], PRICE, names)


@query
def quantile_trim(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["make", PRICE])
    cuts = {"q0005": 0.0005, "q03": 0.03, "q05": 0.05, "q95": 0.95, "q97": 0.97, "q995": 0.995}
    return group_measures(
        rows, ["make"], PRICE, [quantile(p, name) for name, p in cuts.items()]
    )


@query
def quantile_even(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["make", PRICE])
    one_row = summary(rows, PRICE, ListingFilter(), 7)
    return rounded(one_row.select(F.inline("quantiles")))


@query
def quantile_fractional(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["engine", "discount"])
    wanted = ["count", "min", "max", "mean", "std", "median", "quantile_33", "quantile_90"]
    return rounded(group_measures(rows, ["engine"], "discount", wanted))


@query
def agg_map(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["make", "mileage", PRICE])
    return rounded(
        aggregate_map(
            rows, ["make"], {PRICE: ["min", "max", "sum", "count"], "mileage": ["mean", "count"]}
        )
    )


@query
def agg_map_ranked(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["make", "gearbox", "mileage", PRICE])
    functions = {
        PRICE: ["sum", "min", "max", "mean", "median", ("quantile", 0.25)],
        "mileage": ["median", "count", ("quantile", 0.9)],
    }
    return rounded(aggregate_map(rows, ["make", "gearbox"], functions))


@query
def typed_request(spark, sf_dir):
    """Predicates of every type, some of which need only one column to hold; null keys and
    values in the groups; two measured columns."""
    payload = {
        "filter_string": [{"Like": [{"title": "*widget", "equipment": "5*"}, False]}],
        "filter_i32": [{"Lt": [{"cc": 4_100}, True]}, {"In": ["power", [60, 120, 240, 350, 360]]}],
        "filter_f64": [{"Gte": [{"discount": 0.5, "increase": 3.5}, False]}],
        "filter_date": [
            {"Gte": [{"created_on": "1996-03-01"}, True]}, {"Lt": [{"created_on": "2000-07-01"}, True]},
        ],
        "group_by": ["gearbox", "model"],
        "aggregate": {
            "save_diff_in_eur": ["count", {"quantile": 0.4}, "max"],
            "mileage": ["mean", "median"],
        },
        "sort": [{"desc": ["gearbox", True]}, {"asc": ["model", True]}],
    }
    columns = ["title", "equipment", "cc", "power", "discount", "increase", "created_on",
               "gearbox", "model", "save_diff_in_eur", "mileage"]
    return rounded(typed_query(adverts(spark, sf_dir, columns), payload))


@query
def rows_counted(spark, sf_dir):
    return row_count(ListingFilter(make="Brand#1").apply(adverts(spark, sf_dir, ["make"])))


# --- chart statistics and summaries ----------------------------------------------------


@query
def chart_stat(spark, sf_dir):
    request = StatRequest(group=["year", "gearbox"])
    return chart_statistics(
        adverts(spark, sf_dir, ["advert_id", "make", "year", "gearbox"]), request
    )


@query
def chart_stat_measures(spark, sf_dir):
    request = StatRequest(
        ListingFilter(year_from=1996),
        ["year"],
        ["count", "sum", "avg", "min", "max", "median", "rsd", "quantile_66"],
        [("avg", False)],
        PRICE,
    )
    return rounded(chart_statistics(adverts(spark, sf_dir, ["year", PRICE]), request))


@query
def summary_all(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["engine", PRICE])
    one_row = summary(rows, PRICE, ListingFilter(engine=["2-HIGH", "5-LOW"]), 4)
    return rounded(_with_quantiles(one_row, 4))


@query
def summary_interval(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["make", PRICE])
    one_row = summary(rows, PRICE, ListingFilter(make="Brand#2"), 3, (20_000, 70_000))
    return rounded(_with_quantiles(one_row, 3))


def _with_quantiles(one_row: DataFrame, n: int) -> DataFrame:
    return one_row.select(
        "*",
        *[F.get("quantiles", F.lit(i))["value"].alias(f"value_{i + 1}") for i in range(n)],
        *[F.get("quantiles", F.lit(i))["alias"].alias(f"alias_{i + 1}") for i in range(n)],
    ).drop("quantiles")


# --- distributions ---------------------------------------------------------------------

TIERS = {
    "trim_range_1000": ListingFilter(make="Brand#1"),
    "trim_range_500": ListingFilter(make="Brand#1", engine=["2-HIGH", "5-LOW"]),
    "trim_range_50": ListingFilter(make="Brand#1", engine=["2-HIGH"]),
    "trim_range_small": ListingFilter(
        make="Brand#1", engine=["2-HIGH"], year=1998, gearbox="A"
    ),
}
TIER_COLUMNS = ["make", "engine", "year", "gearbox", PRICE]


def _trim_query(name: str) -> None:
    def run(spark, sf_dir):
        return rounded(trim_range(adverts(spark, sf_dir, TIER_COLUMNS), PRICE, TIERS[name]))

    QUERIES[name] = run


for _name in TIERS:
    _trim_query(_name)


@query
def trim_range_all(spark, sf_dir):
    return rounded(trim_range(adverts(spark, sf_dir, ["make", PRICE]), PRICE))


def _distribution(spark, sf_dir, **options):
    rows = adverts(spark, sf_dir, ["make", PRICE])
    listing_filter = options.pop("listing_filter", ListingFilter(make="Brand#1"))
    return distribution(rows, PRICE, 5, listing_filter=listing_filter, **options)


@query
def dist_interval(spark, sf_dir):
    return rounded(_distribution(spark, sf_dir, kind="interval").bins)


@query
def dist_interval_full(spark, sf_dir):
    return rounded(_distribution(spark, sf_dir, kind="interval", trim=False).bins)


@query
def dist_interval_closed(spark, sf_dir):
    return rounded(_distribution(spark, sf_dir, kind="interval", last_closed=True).bins)


@query
def dist_interval_all(spark, sf_dir):
    everything = ListingFilter()
    return rounded(
        _distribution(spark, sf_dir, kind="interval", listing_filter=everything).bins
    )


@query
def dist_quantile(spark, sf_dir):
    return rounded(_distribution(spark, sf_dir, kind="quantile").bins)


@query
def dist_quantile_full(spark, sf_dir):
    return rounded(_distribution(spark, sf_dir, kind="quantile", trim=False).bins)


@query
def dist_quantile_closed(spark, sf_dir):
    return rounded(_distribution(spark, sf_dir, kind="quantile", last_closed=True).bins)


@query
def dist_summary(spark, sf_dir):
    return rounded(_with_quantiles(_distribution(spark, sf_dir).summary, 5))


@query
def dist_chart(spark, sf_dir):
    chart = distribution_chart(_distribution(spark, sf_dir, kind="quantile"), PRICE)
    return chart.withColumns({c: F.to_json(c) for c in ("axis_values", "data")})


BINS = [
    Bin(5_000, 20_000, "low"),
    Bin(20_000, 50_000, "middle"),
    Bin(60_000, 90_000, "high"),
]


@query
def bin_stats(spark, sf_dir):
    rows = ListingFilter(year=1998).apply(adverts(spark, sf_dir, ["year", PRICE]))
    return rounded(bin_statistics(rows, PRICE, BINS))


@query
def bin_stats_single(spark, sf_dir):
    return rounded(
        bin_statistics(adverts(spark, sf_dir, ["mileage"]), "mileage",
                       [Bin(40_000, 80_000, "all")])
    )


@query
def bin_labels(spark, sf_dir):
    return label_bins(adverts(spark, sf_dir, ["advert_id", PRICE]), PRICE, BINS)


def _model_bins(spark, sf_dir):
    """Bins made of the tables: the price range of every model in a make and year."""
    rows = adverts(spark, sf_dir, ["make", "model", "year", PRICE])
    ranges = rows.groupBy("make", "model", "year").agg(
        F.min(PRICE).alias("start"), F.max(PRICE).alias("end")
    )
    return ranges.select(
        F.concat_ws(" ", "make", "model").alias("column"),
        "start",
        "end",
        F.col("year").cast("string").alias("category"),
        (F.col("year") - 1995).alias("index"),
    )


@query
def bins_overlapping(spark, sf_dir):
    return overlapping(_model_bins(spark, sf_dir))


@query
def bins_extent(spark, sf_dir):
    return bin_extent(_model_bins(spark, sf_dir))


@query
def bins_axis(spark, sf_dir):
    return axis_values(_model_bins(spark, sf_dir))


@query
def bins_at_index(spark, sf_dir):
    return bin_at(_model_bins(spark, sf_dir), 2)


@query
def bins_sorted(spark, sf_dir):
    return sort_by(_model_bins(spark, sf_dir), ["column", "start", ("end", False)])


# --- bands -----------------------------------------------------------------------------


@query
def bands_price(spark, sf_dir):
    return adverts(spark, sf_dir, ["advert_id", PRICE]).select(
        "advert_id", price_band(PRICE).alias("band"), price_band_order(PRICE).alias("code")
    )


@query
def bands_mileage(spark, sf_dir):
    return adverts(spark, sf_dir, ["advert_id", "mileage"]).select(
        "advert_id",
        band_label("mileage", MILEAGE_BANDS).alias("band"),
        band_number("mileage", MILEAGE_BANDS).alias("number"),
    )


@query
def bands_power(spark, sf_dir):
    return adverts(spark, sf_dir, ["advert_id", "power"]).select(
        "advert_id",
        band_label("power", POWER_BANDS).alias("band"),
        band_number("power", POWER_BANDS).alias("number"),
    )


@query
def price_bands(spark, sf_dir):
    return price_band_distribution(adverts(spark, sf_dir, [PRICE]))


# --- pivots ----------------------------------------------------------------------------


def _pivot_request(group, y, pivot_column=None, order=(), listing_filter=None, **more):
    stat = StatRequest(
        listing_filter or ListingFilter(), group, ["count", y] if y != "count" else ["count"],
        order,
    )
    return PivotRequest(stat, y, pivot_column, **more)


@query
def pivoted(spark, sf_dir):
    request = _pivot_request(["make", "engine"], "avg", "engine", ["make"])
    return pivot_table(adverts(spark, sf_dir, ["make", "engine", PRICE]), request)


@query
def pivoted_null(spark, sf_dir):
    request = _pivot_request(["make", "model", "gearbox"], "median", "gearbox", ["make", "model"])
    return rounded(
        pivot_table(adverts(spark, sf_dir, ["make", "model", "gearbox", PRICE]), request)
    )


@query
def pivoted_not(spark, sf_dir):
    request = _pivot_request(["make", "year"], "avg", None, ["year", "make"])
    return pivot_table(adverts(spark, sf_dir, ["make", "year", PRICE]), request)


def _pivot_chart(spark, sf_dir):
    request = _pivot_request(
        ["year", "engine", "make"], "count", "engine", x_column="year",
        listing_filter=ListingFilter(year_to=1999),
    )
    return pivot_chart(adverts(spark, sf_dir, ["year", "engine", "make", PRICE]), request)


@query
def pivot_series(spark, sf_dir):
    return _pivot_chart(spark, sf_dir).series


@query
def pivot_labels(spark, sf_dir):
    return _pivot_chart(spark, sf_dir).labels


@query
def pivot_labels_null(spark, sf_dir):
    request = _pivot_request(["gearbox", "engine"], "count", "engine", x_column="gearbox")
    rows = adverts(spark, sf_dir, ["make", "gearbox", "engine", PRICE])
    return pivot_chart(rows, request).labels


@query
def pivot_series_two_axes(spark, sf_dir):
    request = _pivot_request(
        ["year", "gearbox", "engine", "model"], "mean", "engine", x_column="year",
        second_x_column="gearbox",
    )
    rows = adverts(spark, sf_dir, ["make", "year", "gearbox", "engine", "model", PRICE])
    return rounded(pivot_chart(rows, request).series)


@query
def pivot_series_plain(spark, sf_dir):
    request = _pivot_request(["year", "gearbox", "model"], "mean", x_column="year")
    rows = adverts(spark, sf_dir, ["make", "year", "gearbox", "model", PRICE])
    return pivot_chart(rows, request).series


@query
def pivot_series_lists(spark, sf_dir):
    request = _pivot_request(["year", "engine"], "avg", x_column="year")
    rows = adverts(spark, sf_dir, ["make", "year", "engine", PRICE])
    lists = series_lists(pivot_chart(rows, request).series, "year")
    return lists.select("label", F.to_json("points").alias("points"))


# --- search, facets, distinct ----------------------------------------------------------


@query
def deals(spark, sf_dir):
    wanted = ListingFilter(make="Brand#2", year_from=1996, price_to=40_000)
    return rounded(
        search_deals(
            adverts(spark, sf_dir), wanted, [(PRICE, False), "advert_id"], MOST_DEALS,
            stable_key=["created_on", *ADVERT_COLUMNS],
        )
    )


@query
def top_deals(spark, sf_dir):
    order = [("save_diff_in_eur", False), "gearbox", "advert_id"]
    wanted = ListingFilter(make="Brand#9")
    return rounded(best_deals(adverts(spark, sf_dir), order, wanted, MOST_DEALS))


@query
def top_deals_nulls_last(spark, sf_dir):
    columns = ["advert_id", "make", "gearbox"]
    rows = adverts(spark, sf_dir, columns)
    return best_deals(rows, [("gearbox", False), "advert_id"])


def _facet_query(column: str) -> None:
    def run(spark, sf_dir):
        return facet(adverts(spark, sf_dir, [column]), column)

    QUERIES[f"facet_{column}"] = run


for _name in ("make", "engine", "gearbox", "source"):
    _facet_query(_name)


@query
def facet_models(spark, sf_dir):
    return models_of(adverts(spark, sf_dir, ["make", "model"]), "Brand#11")


@query
def distinct_sorted(spark, sf_dir):
    return distinct_values(adverts(spark, sf_dir, ["gearbox"]), "gearbox")


@query
def distinct_normalised(spark, sf_dir):
    return distinct_spellings(adverts(spark, sf_dir, ["title"]), "title")


@query
def distinct_pairs(spark, sf_dir):
    """The third column follows from the first two, whichever row is kept."""
    rows = adverts(spark, sf_dir, ["make", "model"])
    return distinct_on(
        rows.withColumn("spelled", F.upper(F.concat_ws("/", "make", "model"))), ["make", "model"]
    )


# --- estimates -------------------------------------------------------------------------

ESTIMATE_COLUMNS = [
    "title", "equipment", "make", "model", "year", "engine", "gearbox", "cc", "power",
    "mileage", PRICE,
]
COMPARABLE = ListingFilter(make="Brand#1", engine=["2-HIGH"], mileage=55_000, power=160)
UNMET = COMPARABLE.replace(cc=1_250, search="no such text")


@query
def estimate(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["make", "engine", "power", "mileage", PRICE])
    return est.estimate_price(rows, COMPARABLE)


@query
def estimate_wide(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["make", "model", PRICE])
    return est.estimate_price(rows, ListingFilter(make="Brand#3", model="PROMO"))


@query
def estimate_relaxed(spark, sf_dir):
    return est.estimate_price(adverts(spark, sf_dir, ESTIMATE_COLUMNS), UNMET)


@query
def estimate_none(spark, sf_dir):
    nobody = ListingFilter(make="Brand#99", cc=1_200)
    return est.estimate_price(adverts(spark, sf_dir, ["make", "cc", PRICE]), nobody)


@query
def estimate_statistics(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["make", "engine", "power", "mileage", PRICE])
    return rounded(est.comparable_statistics(rows, COMPARABLE))


@query
def comparable_count(spark, sf_dir):
    return est.comparable_count(adverts(spark, sf_dir, ESTIMATE_COLUMNS), UNMET)


@query
def estimate_batch(spark, sf_dir):
    """Every advert asks for its own estimate; those with an odd mileage band ask for a
    displacement nobody has, and are answered without it."""
    columns = ["advert_key", "make", "model", "year", "gearbox", "power", "mileage", "cc"]
    together = [*columns, PRICE]
    requests = adverts(spark, sf_dir, columns, together).withColumnRenamed("advert_key", "request_id")
    odd = band_number("mileage", MILEAGE_BANDS) % 2 == 1
    requests = requests.withColumn("cc", F.col("cc") + F.when(odd, 50).otherwise(0))
    rows = adverts(spark, sf_dir, [*columns[1:], PRICE], together)
    # An id is moved as its key, which is shorter, and written out at the end.
    return est.estimate_prices(requests, rows).withColumn("request_id", id_of_key("request_id"))


@query
def estimate_batch_engines(spark, sf_dir):
    """One request per order of the top priority: the makes of a year, two engines."""
    columns = ["make", "year", "engine"]
    requests = (
        adverts(spark, sf_dir, columns)
        # The least and the last text of a group are found by sorting its rows: few, counted first.
        .groupBy(*columns).count().where("count > 0")
        .groupBy("make", "year")
        .agg(F.min("engine").alias("first"), F.max("engine").alias("last"))
        .select(
            F.concat_ws("-", "make", "year").alias("request_id"),
            "make",
            F.when(F.col("year") % 2 == 0, F.col("year")).alias("year"),
            F.array("last", "first", "last").alias("engine"),
            F.lit(1_200).alias("cc"),
        )
    )
    rows = adverts(spark, sf_dir, ["title", "equipment", *columns, "cc", PRICE])
    return est.estimate_prices(requests, rows, search="red*")


@query
def estimate_alternative(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["make", "year", PRICE])
    return rounded(est.alternative_estimates(rows, ["make", "year"]))


# --- result shapes ---------------------------------------------------------------------


@query
def result_columns(spark, sf_dir):
    request = StatRequest(
        group=["gearbox", "year"], aggregators=["count", "min", "sum"],
        order=["year", "gearbox"],
    )
    rows = adverts(spark, sf_dir, ["make", "gearbox", "year", PRICE])
    return columnar_json(grouped_statistics(rows, request))


@query
def result_dimensions(spark, sf_dir):
    request = StatRequest(group=["gearbox", "year"], aggregators=["count"])
    rows = adverts(spark, sf_dir, ["make", "gearbox", "year", PRICE])
    return dimension_summary(grouped_statistics(rows, request), ["gearbox", "year"])


@query
def result_grouped(spark, sf_dir):
    request = StatRequest(
        group=["gearbox", "year"], aggregators=["count", "avg"], order=["year", "gearbox"]
    )
    rows = adverts(spark, sf_dir, ["make", "gearbox", "year", PRICE])
    answer = grouped_response(grouped_statistics(rows, request), ["gearbox", "year"])
    return answer.select(
        "total_count", *[F.to_json(c).alias(c) for c in ("metadata", "dimensions", "data")]
    )


@query
def result_whole(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["make", PRICE])
    return whole_numbers(group_measures(rows, ["make"], PRICE, ["mean", "median", "std"]))


@query
def result_hidden(spark, sf_dir):
    """Listings as one response: the advert's number is marked as hidden."""
    rows = adverts(spark, sf_dir, ["advert_id", "make", "gearbox", "created_on", PRICE])
    wanted = ListingFilter(make="Brand#6")
    return columnar_json(best_deals(rows, [(PRICE, False), "advert_id"], wanted, 7))


# --- wide, fractional and mixed types --------------------------------------------------


def _wide(spark, sf_dir, *columns: str) -> DataFrame:
    """Adverts with numbers no double or 32-bit integer holds: ``number`` around 10^15,
    ``huge`` beyond 2^53; and ``tax``, a price times a fraction."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(
        *columns,
        (F.lit(10**15) + F.col("l_orderkey") * 1_000_003 + F.col("l_linenumber")).alias("number"),
        (F.lit(2**53 + 1) + F.col("l_orderkey") * 2).alias("huge"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("tax"),
        F.lit("line").alias("make"),
    )


@query
def quantile_wide(spark, sf_dir):
    wanted = ["count", "min", "max", *[quantile(p, f"q{i}", own=True)
                                       for i, p in enumerate((0.0, 0.1, 0.5, 0.777, 1.0))]]
    rows = _wide(spark, sf_dir, "l_returnflag")
    return group_measures(rows, ["l_returnflag"], "number", wanted)


@query
def quantile_double(spark, sf_dir):
    rows = _wide(spark, sf_dir, "l_returnflag")
    wanted = ["count", "median", "quantile_1", "quantile_37", "quantile_99"]
    return rounded(group_measures(rows, ["l_returnflag"], "tax", wanted))


@query
def std_wide(spark, sf_dir):
    """The deviation with and without a median next to it."""
    rows = _wide(spark, sf_dir, "l_linestatus")
    alone = group_measures(rows, ["l_linestatus"], "number", ["std"])
    beside = group_measures(rows, ["l_linestatus"], "number", [Measure("with_median", "std"), "median"])
    return alone.join(beside, "l_linestatus").select(
        "l_linestatus",
        *[F.round(F.col(c) / 1e6, 4).alias(c) for c in ("std", "with_median")])


@query
def agg_map_mixed_types(spark, sf_dir):
    rows = _wide(spark, sf_dir, "l_returnflag", "l_linenumber")
    return rounded(aggregate_map(rows, ["l_returnflag"], {
        "huge": ["min", "max", "median", "count"], "l_linenumber": ["sum", "max", ("quantile", 0.9)],
        "tax": ["max", "median"],
    }))


@query
def dist_fractional(spark, sf_dir):
    bins = distribution(_wide(spark, sf_dir), "tax", 6, trim=False, last_closed=True).bins
    return rounded(bins, mean=8)


@query
def dist_fractional_quantile(spark, sf_dir):
    bins = distribution(
        _wide(spark, sf_dir), "tax", 6, kind="quantile", trim=False, last_closed=True).bins
    return rounded(bins, mean=8)


@query
def dist_wide(spark, sf_dir):
    bins = distribution(_wide(spark, sf_dir), "number", 7, trim=False, last_closed=True).bins
    return bins.select("column", "category", "index", "min", "max", "median", "count")


@query
def dist_wide_quantile(spark, sf_dir):
    bins = distribution(
        _wide(spark, sf_dir), "number", 7, kind="quantile", trim=False, last_closed=True).bins
    return bins.select("column", "category", "index", "min", "max", "median", "count")


# --- pivots over awkward values --------------------------------------------------------


def _awkward(spark, sf_dir):
    rows = adverts(spark, sf_dir, ["make", "year", "engine", "discount", PRICE])
    dotted = F.concat(F.lit("1."), F.substring("engine", 1, 1), F.lit(" `x`"))
    return rows.select("make", "year", dotted.alias("engine"),
                       F.round("discount").alias("discount"), PRICE)


@query
def pivoted_dotted(spark, sf_dir):
    request = _pivot_request(["make", "engine"], "count", "engine", ["make"])
    return pivot_table(_awkward(spark, sf_dir), request)


@query
def pivoted_float(spark, sf_dir):
    request = _pivot_request(["year", "discount"], "max", "discount", ["year"])
    return pivot_table(_awkward(spark, sf_dir), request)


@query
def pivot_series_tall(spark, sf_dir):
    request = _pivot_request(["year", "engine"], "min", "engine", x_column="year",
                             listing_filter=ListingFilter(make="Brand#3"))
    return pivot_chart(_awkward(spark, sf_dir), request).series


# --- bins out of the data --------------------------------------------------------------


@query
def bins_of_years(spark, sf_dir):
    """A bin per year that occurs, one more put in before them, as a table."""
    rows = adverts(spark, sf_dir, ["year"])
    years = rows.select("year").distinct()
    bins = years.select(
        F.lit("year").alias("column"), F.col("year").alias("start"), (F.col("year") + 1).alias("end"),
        F.concat(F.lit("in "), "year").alias("category"))
    before = years.agg(F.min("year").alias("end")).select(
        F.lit("year").alias("column"), F.lit(1900).alias("start"), "end", F.lit("before").alias("category"))
    frame = numbered_bins(bins.unionByName(before), "year")
    counted = rows.groupBy(F.col("year").alias("start")).count()
    return frame.join(counted, "start", "left").select(
        "column", "start", "end", "category", "index", F.coalesce("count", F.lit(0)).alias("adverts"))


def _price_bins(spark, sf_dir):
    """Bins between the distinct prices of half of the makes."""
    some = adverts(spark, sf_dir, ["make", PRICE]).where("make < 'Brand#19'")
    return bins_between_values(some, PRICE)


@query
def bins_table_stats(spark, sf_dir):
    """Measures of thousands of bins, which are a table made from the data."""
    rows = adverts(spark, sf_dir, [PRICE])
    return rounded(bin_table_statistics(rows, PRICE, _price_bins(spark, sf_dir)))


@query
def bins_table_overlaps(spark, sf_dir):
    """Of thousands of bins, made longer where their start is even, those that run into the next."""
    bins = _price_bins(spark, sf_dir)
    longer = bins.withColumn("end", F.col("end") + F.when(F.col("start") % 2 == 0, 3).otherwise(0))
    return overlapping(longer)


@query
def dist_index_quantile(spark, sf_dir):
    """A hundred bins of equal frequency over the trimmed prices of all adverts."""
    rows = adverts(spark, sf_dir, ["make", PRICE])
    return rounded(distribution(rows, PRICE, 100, kind="quantile").bins)


@query
def dist_index_interval(spark, sf_dir):
    """Sixty bins of equal width over the trimmed differences, many of which are null."""
    rows = adverts(spark, sf_dir, ["make", "save_diff_in_eur"])
    return rounded(distribution(rows, "save_diff_in_eur", 60, last_closed=True).bins)


# --- delimited text --------------------------------------------------------------------

PRICE_FIELDS = (
    "make", "model", "year", "engine", "gearbox", "power", "mileage", "cc", None, None,
    PRICE, "estimated_price_in_eur", "save_diff_in_eur", None, "discount", "increase",
)


def _lines(spark, sf_dir, year=None):
    """Adverts as lines of the price files; ``year`` takes the place of the year."""
    rows = adverts(spark, sf_dir, [c for c in PRICE_FIELDS if c])
    rows = rows.withColumns({c: F.round(c).cast("int") for c in ("discount", "increase")})
    fields = [
        F.lit("") if c is None
        else F.coalesce((year if c == "year" and year is not None else F.col(c)).cast("string"),
                        F.lit(""))
        for c in PRICE_FIELDS
    ]
    return rows.select(F.concat_ws(";", *fields).alias("line"))


@query
def source_parsed(spark, sf_dir):
    return rounded(parse_lines(_lines(spark, sf_dir), "line", "prices"))


@query
def source_bad_rows(spark, sf_dir):
    bad = F.when(F.col("gearbox").isNull(), F.lit("n/a")).otherwise(F.col("year").cast("string"))
    found = parse_lines(_lines(spark, sf_dir, bad), "line", "prices", keep_corrupt=True)
    return bad_lines(found).select("row_count", "bad_row_count")


@query
def source_quotes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = docs.select("doc_id", F.replace("text", F.lit(" a"), F.lit(' "a"')).alias("text"), "n_chars")
    return strip_quotes(marked)


@query
def estimate_batch_ranges(spark, sf_dir):
    """One request per make and month of sale: some with limits, some open, some that only
    a relaxed try can meet."""
    columns = ["make", "year", "mileage", "cc", "discount"]
    month = F.col("month") % 4
    requests = (
        adverts(spark, sf_dir, ["make", "created_on"])
        .select("make", F.month("created_on").alias("month")).distinct()
        .select(
            F.concat_ws("-", "make", "month").alias("request_id"),
            "make",
            F.when(month == 0, F.lit(1997)).alias("year"),
            F.when(month < 2, 1996 + F.col("month") % 3).alias("year_from"),
            F.when(month != 2, F.lit(1998)).alias("year_to"),
            F.when(month != 3, F.col("month") * 12_000).alias("mileage_to"),
            F.when(month == 1, F.lit(1_250)).alias("cc"),
            F.when(month == 1, F.lit(2_000)).alias("cc_from"),
            F.when(month == 2, F.lit(30_000)).alias("price_from"),
            F.when(month == 3, F.lit(4.5)).alias("discount_to"),
        )
    )
    return est.estimate_prices(requests, adverts(spark, sf_dir, [*columns, PRICE]))


@query
def estimate_batch_limits(spark, sf_dir):
    """Requests for one make, each with limits of its own around a mileage and power that occurs."""
    columns = ["make", "mileage", "power", "created_on"]
    rows = adverts(spark, sf_dir, [*columns, PRICE])
    day = F.date_diff(F.lit(AS_OF), "created_on")
    requests = (
        rows.where("make = 'Brand#1'").groupBy("make", "mileage", "power")
        .agg(F.max(day).alias("day"))
        .select(
            F.concat_ws("-", "mileage", "power").alias("request_id"),
            "make",
            (F.col("mileage") - 24_000).alias("mileage_from"),
            F.when(F.col("power") % 3 != 0, F.col("mileage") + 16_000).alias("mileage_to"),
            F.when(F.col("power") % 3 == 1, F.col("power")).alias("power_to"),
            F.when(F.col("mileage") % 3 == 0, F.col("day")).alias("created_on_from"),
            F.when(F.col("mileage") % 5 == 0, F.lit(60_000)).alias("price_to"),
        )
    )
    return est.estimate_prices(requests, rows, as_of=AS_OF)


# --- indexes and mergeable states ------------------------------------------------------


@query
def search_indexed(spark, sf_dir):
    """Two searches by way of a trigram index, a pattern and the end of a text."""
    columns = ["advert_id", "title", "equipment", PRICE]
    rows = adverts(spark, sf_dir, columns)
    index = trigram_index(rows)
    parts = [indexed_search(rows, index, value).withColumn("search", F.lit(value))
             for value in ("RED.*get", "*bolt", "urgent")]
    return parts[0].union(parts[1]).union(parts[2])


@query
def quantile_sketch(spark, sf_dir):
    """Quantiles per make from sketches kept per year, beside exact ranks: within the bound or not."""
    rows = adverts(spark, sf_dir, ["make", "year", PRICE])
    states = quantile_states(rows, ["make", "year"], PRICE)
    found = merged_quantiles(states, ["make"], [0.1, 0.5, 0.9, 0.99])
    exact = rows.join(found, "make").groupBy("make", "fraction", "rows").agg(
        F.sum((F.col(PRICE) < F.col("value")).cast("int")).alias("below"),
        F.sum((F.col(PRICE) <= F.col("value")).cast("int")).alias("upto"))
    slack = F.col("rows") * 0.02 + 1
    wanted = F.col("fraction") * F.col("rows")
    within = (F.col("below") <= wanted + slack) & (F.col("upto") >= wanted - slack)
    return exact.select("make", "fraction", F.col("rows").cast("long").alias("rows"), within.alias("within"))


@query
def facet_overlap_sketch(spark, sf_dir):
    """Distinct prices per make shared with the adverts of one engine, from sketches: within 5 percent."""
    rows = adverts(spark, sf_dir, ["make", "engine", PRICE])
    chosen = F.col("engine") == "2-HIGH"
    found = facet_overlap(rows, "make", PRICE, chosen)
    exact = rows.groupBy("make", PRICE).agg(F.max(chosen).alias("here"))
    everywhere = rows.where(chosen).select(F.col(PRICE).alias("p")).distinct()
    exact = exact.join(everywhere, F.col(PRICE) == F.col("p"), "left").groupBy("make").agg(
        F.count(PRICE).alias("n"), F.count("p").alias("both"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= distinct_error() * F.col("n") + 1
    return found.join(exact, "make").select(
        "make", F.col("n").alias("distinct_prices"), F.col("both").alias("shared_prices"),
        (near("distinct_count", "n") & near("shared", "both")).alias("within"))


@query
def stat_merged(spark, sf_dir):
    """Measures per make from states of its years."""
    rows = adverts(spark, sf_dir, ["make", "year", PRICE])
    return rounded(merged_moments(moment_states(rows, ["make", "year"], PRICE), ["make"]))


@query
def pivoted_variant(spark, sf_dir):
    request = _pivot_request(["make", "year", "gearbox"], "sum", "gearbox", ["make", "year"])
    found = pivot_object_table(adverts(spark, sf_dir, ["make", "year", "gearbox", PRICE]), request)
    return found.select("make", "year", F.to_json("cells").alias("cells"))


@query
def spellings_collated(spark, sf_dir):
    """Titles in mixed case, counted as one whatever their case."""
    rows = adverts(spark, sf_dir, ["title", "year"])
    spelt = F.when(F.col("year") % 3 == 0, F.upper("title")).when(
        F.col("year") % 3 == 1, F.initcap("title")).otherwise(F.col("title"))
    return collated_values(rows.select(spelt.alias("title")), "title")


@query
def result_pages(spark, sf_dir):
    """Adverts of a make in pages of 150, dearest first."""
    rows = adverts(spark, sf_dir, ["advert_id", "make", "gearbox", PRICE]).where("make = 'Brand#2'")
    return json_pages(rows, [(PRICE, False), "advert_id"], 150)
