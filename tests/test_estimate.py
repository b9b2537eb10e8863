"""Price estimates."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from forecourt.functions.bands import MILEAGE_BANDS, POWER_BANDS, band_of
from forecourt.operators.filters import ListingFilter
from forecourt.plans import estimate as est


def estimation(spark, expression, **measures):
    row = spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in measures.items()])
    return row.select(expression.alias("e")).first()["e"]


def test_low_dispersion(spark):
    found = estimation(
        spark, est.estimate_of(), rsd=0.025693577133200966, mean=28809.75, median=28789,
        quantile_66=29035, quantile_75=0, quantile_80=29171, max=30337,
    )
    assert found == pytest.approx(29463.82658382678, abs=1e-6)


def test_middle_dispersion_is_normalised(spark):
    same = dict(mean=100, median=100, quantile_66=100, quantile_75=100, quantile_80=100, max=900)
    assert estimation(spark, est.estimate_of(), rsd=0.2, **same) == pytest.approx(100)
    mixed = dict(mean=10, median=20, quantile_66=30, quantile_75=40, quantile_80=50, max=900)
    weights = 0.16, 0.16, 0.24, 0.15, 0.24
    expected = sum(w * v for w, v in zip(weights, (10, 20, 30, 40, 50))) / sum(weights)
    assert estimation(spark, est.estimate_of(), rsd=0.2, **mixed) == pytest.approx(expected)


def test_middle_dispersion_near_a_sum_of_one_is_left_alone(spark):
    same = dict(mean=100, median=100, quantile_66=100, quantile_75=100, quantile_80=100, max=900)
    assert estimation(spark, est.estimate_of(), rsd=0.15005, **same) == pytest.approx(99.995)


def test_high_dispersion(spark):
    found = estimation(
        spark, est.estimate_of(), rsd=0.31, mean=10, median=20, quantile_66=30,
        quantile_75=40, quantile_80=50, max=60,
    )
    assert found == pytest.approx(2 + 4 + 7.5 + 6 + 5 + 6)


def test_alternative(spark):
    golden = dict(
        mean=30358.79301745636, median=28950, std=8244.372185288039, rsd=0.2715645572782657,
        quantile_60=29990, quantile_66=31300, quantile_75=32900, quantile_80=33990,
        quantile_90=37180,
    )
    found = estimation(spark, est.alternative_estimate_of(), **golden)
    assert found == pytest.approx(31363.198, abs=1e-3)
    spread = {**golden, "rsd": 0.4, "std": 12_000}
    assert estimation(spark, est.alternative_estimate_of(), **spread) == pytest.approx(31363.198 * 1.1 * 1.05, abs=1e-2)
    tight = {**golden, "rsd": 0.05, "std": 100}
    assert estimation(spark, est.alternative_estimate_of(), **tight) == pytest.approx(31363.198 * 0.95 * 0.95, abs=1e-2)


def test_snapping():
    assert est.snapped(ListingFilter(mileage=55_000, power=150)) == ListingFilter(
        mileage_from=40_001, mileage_to=60_000, power_from=131, power_to=150
    )
    # Outside all bands there is nothing to compare by.
    assert est.snapped(ListingFilter(mileage=-5, power=20_000)) == ListingFilter()


def test_no_and_single_comparables(listings):
    assert est.estimate_price(listings, ListingFilter(make="nobody")).count() == 0
    row = est.estimate_price(listings, ListingFilter(make="Audi", engine=["Petrol"], model="A4")).first()
    assert (row["count"], row["mean"], row["rsd"], row["estimation"]) == (1, 10_000, None, None)
    # A comparable without a price still counts as one being there.
    row = est.estimate_price(listings, ListingFilter(model="A6")).first()
    assert (row["count"], row["mean"]) == (0, None)


def test_relaxing_drops_displacement_only_when_nothing_matches(listings):
    strict = ListingFilter(make="Audi", cc=2000)
    assert est.comparable_count(listings, strict).first()[:] == (0, 2)
    assert est.comparable_count(listings, strict.replace(cc=999)).first()[:] == (1, 4)
    assert est.comparable_count(listings, ListingFilter(make="nobody", cc=1)).count() == 0
    # Dropping an exact displacement brings its range back.
    ranged = ListingFilter(make="Audi", cc=999, cc_from=1_700)
    assert est.comparable_count(listings, ranged).first()[:] == (1, 3)


def test_the_measured_column_is_a_choice(listings):
    row = est.estimate_price(listings, ListingFilter(make="BMW"), column="mileage").first()
    assert (row["count"], row["max"]) == (2, 70_000)


def brute_force(requests, adverts):
    """Every request against every advert."""
    answers = {}
    for request in requests:
        def meets(advert, relaxed):
            for field in ("make", "model", "year", "gearbox"):
                if request[field] is not None and advert[field] != request[field]:
                    return False
            if request["engine"] and advert["engine"] not in request["engine"]:
                return False
            for field, bands in (("mileage", MILEAGE_BANDS), ("power", POWER_BANDS)):
                band = band_of(request[field], bands)
                if band and not (band.start <= advert[field] <= band.end):
                    return False
            return relaxed or request["cc"] is None or advert["cc"] == request["cc"]

        met = [a for a in adverts if meets(a, False)] or [a for a in adverts if meets(a, True)]
        prices = [a["price_in_eur"] for a in met if a["price_in_eur"] is not None]
        answers[request["request_id"]] = (
            len(prices),
            max(prices, default=None),
            statistics.median(prices) if prices else None,
        )
    return answers


def test_batch_matches_brute_force(spark):
    random.seed(5)

    def pick(*values):
        return random.choice(values)

    def advert():
        # One model holds most of the adverts.
        return {
            "make": pick("A|", "A|", "A|", "B", None), "model": pick("m", "m", "|m", "\\N"),
            "year": pick(2018, 2019), "engine": pick("Petrol", "Diesel", "E,\"x", None),
            "gearbox": pick("Auto", "Manual", None), "cc": pick(1000, 2000, None),
            "power": pick(80, 120, 160), "mileage": pick(10_000, 30_000, 70_000, 2_000_000),
            "price_in_eur": pick(None, *range(1_000, 90_000, 1_500)),
        }

    adverts = [advert() for _ in range(400)]
    requests = []
    for i in range(120):
        request = advert()
        request.pop("price_in_eur")
        request["request_id"] = i
        request["engine"] = pick(None, [], ["Petrol"], ["Diesel", "Petrol", "Petrol"], ["E,\"x", None])
        request["engine"] = request["engine"] and [e for e in request["engine"]]
        request["cc"] = pick(None, 1000, 999)
        requests.append(request)
    expected = brute_force(
        [{**r, "engine": [e for e in r["engine"] or [] if e]} for r in requests], adverts
    )
    fields = "make string, model string, year int, gearbox string, cc int, power int, mileage int"
    asked = spark.createDataFrame(requests, f"request_id int, engine array<string>, {fields}")
    known = spark.createDataFrame(adverts, f"engine string, {fields}, price_in_eur int")
    rows = est.estimate_prices(asked, known).collect()
    found = {r["request_id"]: (r["count"], r["max"], r["median"]) for r in rows}
    assert len(rows) == len(requests)
    rounded = {
        k: (n, top, None if m is None else int(m + 0.5)) for k, (n, top, m) in expected.items()
    }
    assert found == rounded
    assert any(n > 1 for n, _, _ in found.values()) and any(n == 0 for n, _, _ in found.values())


@pytest.mark.parametrize("kind, search", [("int", "red"), ("double", None)])
def test_batch_of_single_values_matches_brute_force(spark, kind, search):
    """requests without lists and limits are answered by fields; ids and rows may repeat."""
    rng = random.Random(11)

    def advert():
        return {
            "make": rng.choice(["A", "A", "A", "B", None]), "model": rng.choice(["m", "n", None]),
            "year": rng.choice([2018, 2019, None]), "engine": rng.choice(["Petrol", "Diesel", None]),
            "gearbox": rng.choice(["Auto", None]), "cc": rng.choice([1000, 2000, None]),
            "power": rng.choice([80, 120, None]), "mileage": rng.choice([10_000, 30_000, None]),
            "title": rng.choice(["a red one", "blue", None]), "equipment": None,
            "price_in_eur": rng.choice([None, *range(1_000, 90_000, 1_500)]),
        }

    adverts = [advert() for _ in range(300)] * 2
    requests = [{**advert(), "request_id": i // 2 if i % 10 else None} for i in range(150)]
    for request in requests:
        request["cc"] = rng.choice([None, 1000, 999])
        for name in ("make", "model", "year", "gearbox", "power", "mileage"):
            if rng.random() < 0.5:
                request[name] = None
    nothing = dict.fromkeys(requests[0])
    requests += [{**nothing, "request_id": 900}, {**nothing, "request_id": 901, "cc": 1000}]

    def meets(advert, request, relaxed):
        for name in ("make", "model", "year", "gearbox", "engine", *(() if relaxed else ("cc",))):
            if request[name] is not None and advert[name] != request[name]:
                return False
        for name, bands in (("mileage", MILEAGE_BANDS), ("power", POWER_BANDS)):
            band = band_of(request[name], bands)
            if band and (advert[name] is None or not band.start <= advert[name] <= band.end):
                return False
        return relaxed or not search or search in (advert["title"] or "")

    expected = Counter()
    for request in requests:
        met = [a for a in adverts if meets(a, request, False)] or [a for a in adverts if meets(a, request, True)]
        prices = [a["price_in_eur"] for a in met if a["price_in_eur"] is not None]
        median = int(statistics.median(prices) + 0.5) if prices else None
        expected[request["request_id"], len(prices), max(prices, default=None), median] += 1
    fields = "make string, model string, year int, gearbox string, cc int, power int, mileage int"
    asked = spark.createDataFrame(requests, f"request_id int, engine string, {fields}")
    known = spark.createDataFrame(
        [{**a, "price_in_eur": a["price_in_eur"] and (float if kind == "double" else int)(a["price_in_eur"])} for a in adverts],
        f"title string, equipment string, engine string, {fields}, price_in_eur {kind}")
    rows = est.estimate_prices(asked, known, search=search).collect()
    assert Counter((r["request_id"], r["count"], r["max"], r["median"]) for r in rows) == expected
    if search:
        return
    assert not est.estimate_prices(asked.limit(0), known).collect()
    none = est.estimate_prices(asked, known.limit(0)).collect()
    assert len(none) == len(requests) and not any(r["count"] for r in none)


def test_batch_agrees_with_single_requests(spark, listings):
    asked = spark.createDataFrame(
        [(1, "Audi", "A4", 2000), (2, "BMW", None, 999), (3, "nobody", None, None)],
        "request_id int, make string, model string, cc int",
    )
    batch = {r["request_id"]: r for r in est.estimate_prices(asked, listings).collect()}
    for number, wanted in ((1, ListingFilter(make="Audi", model="A4", cc=2000)), (2, ListingFilter(make="BMW", cc=999))):
        single = est.estimate_price(listings, wanted).first().asDict()
        assert {k: v for k, v in batch[number].asDict().items() if k != "request_id"} == single
    assert (batch[3]["count"], batch[3]["estimation"]) == (0, None)


def test_batch_search_holds_for_all_and_is_dropped(spark, listings):
    adverts = listings.withColumns(
        {"title": F.concat_ws(" ", "make", "model"), "equipment": F.lit("none")}
    )
    asked = spark.createDataFrame([(1, "Audi"), (2, "BMW")], "request_id int, make string")
    rows = {r["request_id"]: r["count"] for r in est.estimate_prices(asked, adverts, search="a4").collect()}
    assert rows == {1: 3, 2: 2}


def test_batch_needs_fields(spark, listings):
    with pytest.raises(ValueError, match="no field"):
        est.estimate_prices(spark.createDataFrame([(1,)], "request_id int"), listings)
    asked = spark.createDataFrame([(1, "x")], "request_id int, make string")
    with pytest.raises(ValueError, match="missing columns"):
        est.estimate_prices(asked, listings.drop("make"))


def test_a_batch_knows_every_limit_a_single_request_knows(spark):
    rows = spark.range(400).selectExpr(
        "if(id % 2 = 0, 'A', 'B') AS make", "cast(2000 + id % 9 AS int) AS year",
        "cast(60 + id % 7 * 30 AS int) AS power", "cast(id % 11 * 9000 AS int) AS mileage",
        "cast(1000 + id % 5 * 200 AS int) AS cc", "cast(id % 13 AS double) AS discount",
        "cast(if(id % 6 = 0, null, id * 10 - 900) AS int) AS save_diff_in_eur",
        "cast(5000 + id * 37 % 900 AS int) AS price_in_eur",
        "cast(5000 + id * 31 % 700 AS int) AS estimated_price_in_eur")
    asked = [
        {"make": "A", "year_from": 2003, "year_to": 2005}, {"make": "B", "power_to": 120},
        {"make": "A", "year": 2004, "year_from": 2008}, {"mileage_from": 9000, "mileage_to": 45_000},
        {"make": "B", "cc": 1_111, "cc_from": 1_600}, {"make": "B", "cc": 1_200, "cc_to": 1_000},
        {"price": 5_100, "price_to": 5_500}, {"estimated_price": 5_300, "discount_from": 2.0},
        {"save_diff_from": -100, "save_diff_to": 900, "discount_to": 7.5}, {"make": "C", "year_to": 1},
        {"price_from": 5_890},
    ]
    names = sorted({k for one in asked for k in one})
    kinds = {"make": "string", "discount_from": "double", "discount_to": "double"}
    requests = spark.createDataFrame(
        [(i, *(one.get(k) for k in names)) for i, one in enumerate(asked)],
        "request_id int, " + ", ".join(f"{k} {kinds.get(k, 'int')}" for k in names))
    got = {r.request_id: r[1:] for r in est.estimate_prices(requests, rows).collect()}
    for i, one in enumerate(asked):
        single = est.estimate_price(rows, ListingFilter(**one)).collect()
        assert got[i] == (tuple(single[0]) if single else (0, *[None] * 9)), one


def test_a_batch_refuses_columns_it_does_not_know(listings):
    requests = listings.select(F.col("advert_id").alias("request_id"), "make", F.lit(1).alias("doors"))
    with pytest.raises(ValueError, match="unknown request columns: doors"):
        est.estimate_prices(requests, listings)


RANGES = {
    "year": ("year_from", "year_to"), "power": ("power_from", "power_to"),
    "mileage": ("mileage_from", "mileage_to"), "cc": ("cc_from", "cc_to"),
    "discount": ("discount_from", "discount_to"), "save_diff_in_eur": ("save_diff_from", "save_diff_to"),
    "price_in_eur": ("price_from", "price_to"),
}


def test_limits_match_brute_force(spark):
    """Up to five ranges a request, beyond what occurs on either side, empty ones, nulls, days."""
    import datetime as dt

    draw = random.Random(9)
    today = dt.date(2020, 1, 1)
    kinds = {
        "make": lambda: draw.choice(["hot", "hot", "hot", "b", None]), "year": lambda: draw.randint(2000, 2009),
        "power": lambda: draw.choice([None, *range(60, 200, 20)]), "mileage": lambda: draw.randint(0, 99) * 1500,
        "cc": lambda: draw.choice([1000, 1200, 3000]), "discount": lambda: draw.choice([None, 0.5, 2.25, 7.0]),
        "save_diff_in_eur": lambda: draw.choice([None, -900, -1, 0, 35, 800]),
        "price_in_eur": lambda: draw.choice([None, *range(900, 90_000, 777)]),
        "created_on": lambda: draw.choice([None, *[today - dt.timedelta(days=d) for d in range(0, 400, 37)]]),
    }
    adverts = [{k: f() for k, f in kinds.items()} for _ in range(700)]
    requests = []
    for i in range(150):
        one = {"request_id": i, "make": draw.choice(["hot", "b", None]), "cc": draw.choice([None, None, 1200, 7])}
        for column in draw.sample(list(RANGES), draw.randint(0, 4)):
            low, high = RANGES[column]
            step = draw.choice([0.5, 1.0]) if column == "discount" else draw.choice([1, 20, 3000])
            at = kinds[column]() or (0.0 if column == "discount" else 0)
            one[low] = draw.choice([None, at - step, at, at + 3 * step])
            one[high] = draw.choice([None, at + step, at, at + 5 * step, at - 2 * step])
        if draw.random() < 0.4:
            one["created_on_from"] = draw.choice([0, 100, 10_000])
        if draw.random() < 0.3:
            one["created_on_to"] = draw.choice([0, 74, 9_999])
        requests.append(one)

    def met(request, advert, relaxed):
        if request["make"] is not None and advert["make"] != request["make"]:
            return False
        exact = None if relaxed else request["cc"]
        if exact is not None and advert["cc"] != exact:
            return False
        limits = {c: (request.get(a), request.get(b)) for c, (a, b) in RANGES.items()}
        if exact is not None:
            limits.pop("cc")
        days = [request.get(f"created_on_{side}") for side in ("from", "to")]
        limits["created_on"] = tuple(d if d is None else today - dt.timedelta(days=d) for d in days)
        for column, (low, high) in limits.items():
            x = advert[column]
            if (low is not None and (x is None or x < low)) or (high is not None and (x is None or x > high)):
                return False
        return True

    names = ["request_id", "make", "cc", *[n for pair in RANGES.values() for n in pair],
             "created_on_from", "created_on_to"]
    kind = {"make": "string", "discount_from": "double", "discount_to": "double", "power_to": "bigint"}
    asked = spark.createDataFrame(
        [tuple(r.get(n) for n in names) for r in requests], ", ".join(f"{n} {kind.get(n, 'int')}" for n in names))
    known = spark.createDataFrame(
        [tuple(a.values()) for a in adverts],
        "make string, year int, power int, mileage int, cc int, discount double, save_diff_in_eur int,"
        " price_in_eur int, created_on date")
    found = {r["request_id"]: r for r in est.estimate_prices(asked, known, as_of=today).collect()}
    assert len(found) == len(requests)
    sizes = set()
    for request in requests:
        own = [a for a in adverts if met(request, a, False)] or [a for a in adverts if met(request, a, True)]
        paid = [a["price_in_eur"] for a in own if a["price_in_eur"] is not None]
        got = found[request["request_id"]]
        middle = int(statistics.median(paid) + 0.5) if paid else None
        assert (got["count"], got["max"], got["median"]) == (len(paid), max(paid, default=None), middle), request
        sizes.add(len(paid))
    assert 0 in sizes and len(sizes) > 20


def test_limits_over_one_hot_make_read_nodes_not_adverts(spark):
    """Two thousand requests with ranges of their own over thousands of adverts of one make."""
    adverts = spark.range(8_000).selectExpr(
        "'hot' AS make", "cast(id % 500 * 300 AS int) AS mileage", "cast(1000 + id % 5 AS int) AS price_in_eur")
    asked = spark.range(2_000).selectExpr(
        "id AS request_id", "'hot' AS make", "cast(id % 250 * 300 AS int) AS mileage_from",
        "cast(100000 + id * 20 AS int) AS mileage_to")
    answered = est.estimate_prices(asked, adverts)
    rows = answered.collect()
    assert len(rows) == 2_000
    one = next(r for r in rows if r["request_id"] == 7)
    assert one["count"] == sum(2100 <= i % 500 * 300 <= 100_140 for i in range(8_000))
    outputs = []

    def visit(node):
        if "Join" in node.nodeName() and node.metrics().get("numOutputRows").isDefined():
            outputs.append(node.metrics().get("numOutputRows").get().value())
        if node.nodeName() == "AdaptiveSparkPlan":
            visit(node.executedPlan())
        elif hasattr(node, "plan") and "QueryStage" in node.nodeName():
            visit(node.plan())
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    visit(answered._jdf.queryExecution().executedPlan())
    # Every pair of a request and an advert in its range would be some 7 million.
    assert outputs and max(outputs) <= 2_000 * 64 * 5


def test_a_batch_refuses_adverts_with_lists_of_engines(spark):
    adverts = spark.createDataFrame([(["Petrol"], 1_000)], "engine array<string>, price_in_eur int")
    requests = spark.createDataFrame([(1, "Petrol")], "request_id int, engine string")
    with pytest.raises(ValueError, match="engine"):
        est.estimate_prices(requests, adverts)
