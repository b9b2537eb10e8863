"""What every query must return, as SQL for an independent engine.

The SQL restates each operator from its definition over plain rows; it shares nothing
with the library but the fixed values.
"""

from __future__ import annotations

from checks.adverts import ADVERT_COLUMNS, ADVERTS_SQL

ORACLES: dict[str, str] = {}
P = "price_in_eur"


def oracle(name: str, sql: str, more: str = "") -> None:
    """Register a statement over ``adverts``; ``more`` holds further WITH steps."""
    steps = f"{ADVERTS_SQL.strip()}{', ' + more.strip() if more else ''}"
    ORACLES[name] = f"WITH {steps}\n{sql.strip()}"


def r(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6)"


def nearest(p: float | str, x: str = P) -> str:
    """The value at 0-based rank floor((n - 1) * p + 0.5)."""
    return (
        f"CAST(list_sort(list({x}) FILTER ({x} IS NOT NULL))"
        f"[CAST(floor((count({x}) - 1) * ({p})::DOUBLE + 0.5) AS BIGINT) + 1] AS DOUBLE)"
    )


def simple(x: str = P) -> dict[str, str]:
    return {
        "count": f"count({x})",
        "min": f"min({x})",
        "max": f"max({x})",
        "sum": f"CAST(coalesce(sum({x}), 0) AS BIGINT)",
        "mean": r(f"avg({x})"),
        "avg": f"CAST(trunc(sum({x})::DECIMAL(38,4) / nullif(count({x}), 0)) AS BIGINT)",
        "std": r(f"stddev_samp({x})"),
        "rsd": r(f"stddev_samp({x}) / nullif(avg({x}), 0)"),
        "rsd_percent": r(rsd_percent(x)),
        "rsd_whole": f"CAST(trunc(stddev_samp({x}) * 100 / avg({x})) AS INTEGER)",
        "median": r(f"median({x})"),
    }


def rsd_percent(x: str = P) -> str:
    return f"stddev_samp({x}) * 100 / nullif(CAST(trunc(avg({x})) AS INTEGER), 0)"


def aliased(names: list[str], x: str = P) -> str:
    known = simple(x)
    found = []
    for name in names:
        if name.startswith("quantile_"):
            found.append(f"{r(nearest(int(name[9:]) / 100, x))} AS {name}")
        else:
            found.append(f'{known[name]} AS "{name}"')
    return ", ".join(found)


SIMPLE = ["count", "min", "max", "sum", "mean", "avg", "std", "rsd"]
RSDS = ["rsd_percent", "rsd_whole"]

oracle("price_by_make", f"""
SELECT make, {aliased(['count', 'min', 'max', 'avg'])}
FROM adverts WHERE year BETWEEN 1996 AND 1998 GROUP BY make
""")

# --- filters -------------------------------------------------------------------------

FILTERS = {
    "filter_make": ("make", "make = 'Brand#3'"),
    "filter_model": ("model", "model = 'STANDARD'"),
    "filter_engine": ("engine", "engine IN ('2-HIGH', '5-LOW')"),
    "filter_engine_empty": ("engine, make", "make = 'Brand#4'"),
    "filter_gearbox": ("gearbox", "gearbox = 'A'"),
    "filter_estimated_price": ("estimated_price_in_eur", "estimated_price_in_eur >= 40000"),
    "filter_price": (P, f"{P} >= 90000"),
    "filter_price_range": (P, f"{P} >= 20000 AND {P} <= 25000"),
    "filter_year": ("year", "year = 1997"),
    "filter_year_range": ("year", "year >= 1996 AND year <= 1997"),
    "filter_discount": ("discount", "discount >= 3 AND discount <= 6"),
    "filter_save_diff": (
        "save_diff_in_eur", "save_diff_in_eur >= 0 AND save_diff_in_eur <= 20000"
    ),
    "filter_power": ("power", "power = 140"),
    "filter_power_range": ("power", "power >= 100 AND power <= 150"),
    "filter_mileage": ("mileage", "mileage = 40000"),
    "filter_mileage_range": ("mileage", "mileage >= 20000 AND mileage <= 40000"),
    "filter_cc": ("cc", "cc = 1200"),
    "filter_cc_range": ("cc", "cc >= 1000 AND cc <= 1600"),
    "filter_created_on": (
        "created_on",
        "created_on >= DATE '2001-12-31' - INTERVAL 900 DAY"
        " AND created_on <= DATE '2001-12-31' - INTERVAL 300 DAY",
    ),
    "filter_none": ("make", "make <> 'x'"),
    "filter_all_of": (
        f"make, engine, year, mileage, {P}, title, equipment",
        f"make = 'Brand#7' AND engine IN ('1-URGENT', '3-MEDIUM') AND year >= 1997"
        f" AND mileage <= 120000 AND {P} >= 10000 AND {P} <= 90000"
        " AND (contains(title, 'widget') OR contains(equipment, 'widget'))",
    ),
    "search_contains": (
        "title, equipment",
        "regexp_matches(lower(title), 're.*get') OR regexp_matches(lower(equipment), 're.*get')",
    ),
    "search_equipment": (
        "title, equipment", "contains(lower(title), 'urgent') OR contains(lower(equipment), 'urgent')"
    ),
    "search_prefix": (
        "title, equipment", "title LIKE 'blue%' OR equipment LIKE 'blue%'"
    ),
    "search_suffix": ("title, equipment", "title LIKE '%gear' OR equipment LIKE '%gear'"),
    "search_star_both": ("title, equipment", "title LIKE '%bolt' OR equipment LIKE '%bolt'"),
    "filter_in_range": (P, f"{P} BETWEEN 50000 AND 60000"),
    "filter_typed_all": (
        "gearbox, save_diff_in_eur, power, created_on",
        "save_diff_in_eur > -5000 AND power IN (60, 90, 250, 400, 410)"
        " AND created_on < DATE '1999-03-14' AND gearbox = 'N' AND discount <= 8.5",
    ),
    "filter_typed_any": (
        "title, make, year",
        "(title LIKE 'red%' OR make LIKE '%5') AND (year = 1996 OR make = 'Brand#15')",
    ),
}
for _name, (_columns, _where) in FILTERS.items():
    oracle(_name, f"SELECT advert_id, {_columns} FROM adverts WHERE {_where}")

# --- aggregates ----------------------------------------------------------------------

oracle("stat_group", f"""
SELECT make, model, {aliased(SIMPLE + RSDS)} FROM adverts GROUP BY make, model
""")
oracle("stat_group_null_key", f"""
SELECT gearbox, year,
  {aliased([*SIMPLE, *RSDS, 'median', 'quantile_90'], 'estimated_price_in_eur')}
FROM adverts GROUP BY gearbox, year
""")
oracle("stat_global", f"SELECT {aliased(SIMPLE)} FROM adverts")
oracle("stat_global_ranked", f"""
SELECT {aliased([*SIMPLE, 'median', 'quantile_75'], 'save_diff_in_eur')} FROM adverts
""")
oracle("stat_ordered", f"""
SELECT gearbox, engine, model, {aliased([
    'count', 'sum', 'max', 'median', 'rsd', 'quantile_5', 'quantile_33'],
    'estimated_price_in_eur')}
FROM adverts WHERE power >= 80 AND mileage <= 150000 GROUP BY gearbox, engine, model
""")
oracle("quantile_nearest", f"""
SELECT model, {aliased([f'quantile_{p}' for p in (60, 66, 70, 75, 80, 85, 90)])}
FROM adverts GROUP BY model
""")
oracle("quantile_trim", f"""
SELECT make, {nearest(0.0005)} AS q0005, {nearest(0.03)} AS q03, {nearest(0.05)} AS q05,
  {nearest(0.95)} AS q95, {nearest(0.97)} AS q97, {nearest(0.995)} AS q995
FROM adverts GROUP BY make
""")
oracle("quantile_even", "\nUNION ALL\n".join(f"""
SELECT '{P}' AS "column", {r(f'{i} / 7.0::DOUBLE')} AS quantile, {nearest(f'{i} / 7.0::DOUBLE')} AS value,
  {i} AS bin, 'q{alias}' AS alias FROM adverts
""" for i, alias in enumerate((14, 29, 43, 57, 71, 86, 100), start=1)))
oracle("quantile_fractional", f"""
SELECT engine, count(discount) AS "count", {r('min(discount)')} AS "min",
  {r('max(discount)')} AS "max", {r('avg(discount)')} AS mean,
  {r('stddev_samp(discount)')} AS std, {r('median(discount)')} AS median,
  {r(nearest(0.33, 'discount'))} AS quantile_33, {r(nearest(0.9, 'discount'))} AS quantile_90
FROM adverts GROUP BY engine
""")
oracle("agg_map", f"""
SELECT make, min({P}) AS {P}_min, max({P}) AS {P}_max,
  CAST(sum({P}) AS BIGINT) AS {P}_sum, count({P}) AS {P}_count,
  {r('avg(mileage)')} AS mileage_mean, count(mileage) AS mileage_count
FROM adverts GROUP BY make
""")
oracle("agg_map_ranked", f"""
SELECT make, gearbox, CAST(sum({P}) AS BIGINT) AS {P}_sum, min({P}) AS {P}_min,
  max({P}) AS {P}_max, {r(f'avg({P})')} AS {P}_mean, {r(f'median({P})')} AS {P}_median,
  {nearest(0.25)} AS {P}_Q_0_25, {r('median(mileage)')} AS mileage_median,
  count(mileage) AS mileage_count, {nearest(0.9, 'mileage')} AS mileage_Q_0_9
FROM adverts GROUP BY make, gearbox
""")
oracle("typed_request", f"""
SELECT gearbox, model, count(save_diff_in_eur) AS save_diff_in_eur_count,
  {nearest(0.4, 'save_diff_in_eur')} AS save_diff_in_eur_Q_0_4,
  max(save_diff_in_eur) AS save_diff_in_eur_max,
  {r('avg(mileage)')} AS mileage_mean, {r('median(mileage)')} AS mileage_median
FROM adverts
WHERE (ends_with(title, 'widget') OR starts_with(equipment, '5')) AND cc < 4100
  AND power IN (60, 120, 240, 350, 360) AND (discount >= 0.5 OR increase >= 3.5)
  AND created_on >= DATE '1996-03-01' AND created_on < DATE '2000-07-01'
GROUP BY gearbox, model
""")
oracle("rows_counted", "SELECT count(*) AS row_count FROM adverts WHERE make = 'Brand#1'")

# --- chart statistics and summaries ----------------------------------------------------

oracle("chart_stat", """
SELECT year, gearbox, count(advert_id) AS "count" FROM adverts GROUP BY year, gearbox
""")
oracle("chart_stat_measures", f"""
SELECT year, {aliased(['count', 'sum', 'avg', 'min', 'max', 'median', 'rsd', 'quantile_66'])}
FROM adverts WHERE year >= 1996 GROUP BY year
""")

def summary_sql(n: int, where: str, source: str = "adverts") -> str:
    values = ", ".join(
        f"{r(nearest(f'{i} / {n}::DOUBLE'))} AS value_{i}" for i in range(1, n + 1)
    )
    aliases = ", ".join(
        f"'q{int(100 * i / n + 0.5)}' AS alias_{i}" for i in range(1, n + 1)
    )
    return f"""
SELECT {aliased(['count', 'min', 'max', 'mean', 'median'])}, {r(rsd_percent())} AS rsd,
  {values}, {aliases}
FROM {source} WHERE {where}
"""


oracle("summary_all", summary_sql(4, "engine IN ('2-HIGH', '5-LOW')"))
oracle("summary_interval", summary_sql(3, f"make = 'Brand#2' AND {P} BETWEEN 20000 AND 70000"))

# --- distributions ---------------------------------------------------------------------

TRIM = f"""
SELECT '{P}' AS "column", min({P}) AS orig_start, max({P}) AS orig_end,
  {r(rsd_percent())} AS rsd, count({P}) AS "count",
  CAST(CASE WHEN count({P}) > 1000 THEN {nearest(0.0005)}
       WHEN count({P}) > 500 THEN {nearest(0.03)}
       WHEN count({P}) > 50 THEN {nearest(0.05)} ELSE min({P}) END AS INTEGER) AS start,
  CAST(CASE WHEN count({P}) > 1000 THEN {nearest(0.995)}
       WHEN count({P}) > 500 THEN {nearest(0.97)}
       WHEN count({P}) > 50 THEN {nearest(0.95)} ELSE max({P}) END AS INTEGER) AS "end"
FROM adverts
"""
TIERS = {
    "trim_range_1000": "make = 'Brand#1'",
    "trim_range_500": "make = 'Brand#1' AND engine IN ('2-HIGH', '5-LOW')",
    "trim_range_50": "make = 'Brand#1' AND engine IN ('2-HIGH')",
    "trim_range_small":
        "make = 'Brand#1' AND engine = '2-HIGH' AND year = 1998 AND gearbox = 'A'",
    "trim_range_all": "make <> 'x'",
}
for _name, _where in TIERS.items():
    oracle(_name, f"{TRIM} WHERE {_where}")


def bin_measures(x: str = P) -> str:
    return f"""min({x}) AS "min", max({x}) AS "max",
  CAST(trunc(median({x})) AS INTEGER) AS median, count({x}) AS "count",
  {r(f'avg({x})')} AS mean, {r(rsd_percent(x))} AS rsd"""


def range_steps(trim: bool, where: str = "make = 'Brand#1'") -> str:
    bounds = f"""
    bounds AS (SELECT start AS lo, "end" AS hi FROM ({TRIM} WHERE {where}))
    """ if trim else f"""
    bounds AS (SELECT min({P}) AS lo, max({P}) AS hi FROM adverts WHERE {where})
    """
    return f"""{bounds},
    trimmed AS (SELECT {P}, lo, hi FROM adverts, bounds
                WHERE {where} AND {P} BETWEEN lo AND hi)"""


def interval_dist(name: str, trim: bool, closed: bool = False,
                  where: str = "make = 'Brand#1'") -> None:
    within = "true" if closed else "bin < 5"
    oracle(name, f"""
SELECT '{P}' AS "column", CAST(bin AS VARCHAR) AS category, bin AS "index",
  {bin_measures()}
FROM placed WHERE {within} GROUP BY bin
""", f"""{range_steps(trim, where)},
    placed AS (SELECT {P}, CAST({'least(4, ' if closed else '('}
      ({P} - lo) // ((hi - lo) // 5)) AS INTEGER) AS bin FROM trimmed)
""")


interval_dist("dist_interval", True)
interval_dist("dist_interval_full", False)
interval_dist("dist_interval_closed", True, closed=True)
interval_dist("dist_interval_all", True, where="make <> 'x'")


def quantile_steps(trim: bool) -> str:
    cuts = ", ".join(
        f"CAST({nearest(f'{i} / 5::DOUBLE')} AS INTEGER) AS c{i}" for i in range(1, 6)
    )
    return f"""{range_steps(trim)},
    cuts AS (SELECT min({P}) AS c0, {cuts} FROM trimmed)"""


def quantile_dist(name: str, trim: bool, closed: bool = False) -> None:
    end = "<=" if closed else "<"
    arms = " ".join(
        f"WHEN {P} >= c{i} AND {P} {end if i == 4 else '<'} c{i + 1} THEN {i}"
        for i in range(5)
    )
    oracle(name, f"""
SELECT '{P}' AS "column", CAST(bin + 1 AS VARCHAR) AS category, bin AS "index",
  {bin_measures()}
FROM placed WHERE bin IS NOT NULL GROUP BY bin
""", f"""{quantile_steps(trim)},
    placed AS (SELECT {P}, CAST(CASE {arms} END AS INTEGER) AS bin FROM trimmed, cuts)
""")


quantile_dist("dist_quantile", True)
quantile_dist("dist_quantile_full", False)
quantile_dist("dist_quantile_closed", True, closed=True)
oracle("dist_summary", summary_sql(5, "true", "trimmed"), range_steps(True))
_arms = " ".join(f"WHEN {P} >= c{i} AND {P} < c{i + 1} THEN {i + 1}" for i in range(5))
oracle("dist_chart", f"""
SELECT '{P}' AS axis_label, 'stat_category' AS data_label,
  (SELECT concat('[', concat_ws(',', c0, c1, c2, c3, c4, c5), ']') FROM cuts) AS axis_values,
  min({P}) AS "min", max({P}) AS "max", CAST(trunc(median({P})) AS INTEGER) AS median,
  count({P}) AS "count", CAST(trunc(avg({P})) AS BIGINT) AS mean,
  CAST(trunc({rsd_percent()}) AS BIGINT) AS rsd,
  (SELECT concat('[', string_agg(entry, ',' ORDER BY bin), ']') FROM entries) AS data
FROM trimmed
""", f"""{quantile_steps(True)},
    placed AS (SELECT {P}, CASE {_arms} END AS bin FROM trimmed, cuts),
    entries AS (
      SELECT bin, concat('{{"column":"{P}","category":"', bin, '","min":', min({P}),
        ',"max":', max({P}), ',"median":', CAST(trunc(median({P})) AS INTEGER),
        ',"count":', count({P}), ',"mean":', CAST(trunc(avg({P})) AS BIGINT),
        ',"rsd":', CAST(trunc({rsd_percent()}) AS BIGINT), '}}') AS entry
      FROM placed WHERE bin IS NOT NULL GROUP BY bin
    )""")

BIN_CASE = f"""CASE WHEN {P} >= 5000 AND {P} < 20000 THEN 'low'
    WHEN {P} >= 20000 AND {P} < 50000 THEN 'middle'
    WHEN {P} >= 60000 AND {P} < 90000 THEN 'high' END"""
oracle("bin_stats", f"""
SELECT '{P}' AS "column", category,
  CAST(CASE category WHEN 'low' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END AS INTEGER) AS "index",
  {bin_measures()}
FROM (SELECT {P}, {BIN_CASE} AS category FROM adverts WHERE year = 1998)
WHERE category IS NOT NULL GROUP BY category
""")
oracle("bin_stats_single", f"""
SELECT 'mileage' AS "column", 'all' AS category, 0 AS "index", {bin_measures('mileage')}
FROM adverts WHERE mileage >= 40000 AND mileage < 80000 HAVING count(*) > 0
""")
oracle("bin_labels", f"SELECT advert_id, {P}, {BIN_CASE} AS category FROM adverts")

MODEL_BINS = f"""
bins AS (
  SELECT concat_ws(' ', make, model) AS "column", min({P}) AS start, max({P}) AS "end",
    CAST(year AS VARCHAR) AS category, year - 1995 AS "index"
  FROM adverts GROUP BY make, model, year
)
"""
oracle("bins_overlapping", """
SELECT * FROM (
  SELECT *, lead(start) OVER (PARTITION BY "column" ORDER BY start, "end") AS next_start
  FROM bins
) WHERE start > "end" OR next_start < "end"
""", MODEL_BINS)
oracle("bins_extent", """
SELECT "column", count(*) AS bin_count, min(start) AS first_start, max("end") AS last_end
FROM bins GROUP BY "column"
""", MODEL_BINS)
oracle("bins_axis", """
SELECT "column", start AS axis_value FROM bins UNION SELECT "column", "end" FROM bins
""", MODEL_BINS)
oracle("bins_at_index", 'SELECT * FROM bins WHERE "index" = 2', MODEL_BINS)
oracle("bins_sorted", "SELECT * FROM bins", MODEL_BINS)

# --- bands -----------------------------------------------------------------------------

PRICE_LIMITS = (
    (5, 1), (10, 2), (15, 3), (20, 5), (25, 6), (30, 7), (40, 8), (50, 9), (60, 10),
    (70, 11), (80, 12), (90, 13), (100, 14),
)
BAND = f"""CASE {' '.join(f"WHEN {P} < {k}000 THEN '{k}K'" for k, _ in PRICE_LIMITS)}
  ELSE '100K+' END"""
CODE = f"""CAST(CASE {' '.join(f'WHEN {P} < {k}000 THEN {code}' for k, code in PRICE_LIMITS)}
  ELSE 15 END AS INTEGER)"""
oracle("bands_price", f"SELECT advert_id, {BAND} AS band, {CODE} AS code FROM adverts")
oracle("price_bands", f"""
SELECT {BAND} AS price_breakdown, {CODE} AS price_breakdown_order, count({P}) AS "count",
  CAST(trunc(avg({P})) AS INTEGER) AS mean, CAST(trunc(median({P})) AS INTEGER) AS median,
  CAST(trunc(stddev_samp({P}) * 100 / avg({P})) AS INTEGER) AS rsd
FROM adverts GROUP BY 1, 2
""")
MILEAGE = {
    20: "Less than 20 000 km", 40: "Between 20 000 km. and 40 000 km.",
    60: "Between 40 000 km. and 60 000 km.", 80: "Between 60 000 km. and 80 000 km.",
    100: "Between 80 000 km. and 100 000 km.", 120: "Between 100 000 km. and 120 000 km.",
    150: "Between 120 000 km. and 150 000 km.", 1000: "Over 150 000 km.",
}
MILEAGE_NUMBER = "CASE " + " ".join(
    f"WHEN {{c}} <= {limit}000 THEN {i}" for i, limit in enumerate(MILEAGE, start=1)
) + " END"
oracle("bands_mileage", f"""
SELECT advert_id,
  CASE {' '.join(f"WHEN mileage <= {k}000 THEN '{v}'" for k, v in MILEAGE.items())} END AS band,
  CAST({MILEAGE_NUMBER.format(c='mileage')} AS INTEGER) AS number
FROM adverts
""")
POWER = (90, 130, 150, 200, 252, 303, 358, 404, 454, 9999)
POWER_NUMBER = "CASE " + " ".join(
    f"WHEN {{c}} <= {limit} THEN {i}" for i, limit in enumerate(POWER, start=1)
) + " END"
POWER_LABEL = "CASE " + " ".join(
    f"WHEN power <= {end} THEN '{start}-{end}'"
    for start, end in zip((0, *[p + 1 for p in POWER]), POWER)
) + " END"
oracle("bands_power", f"""
SELECT advert_id, {POWER_LABEL} AS band,
  CAST({POWER_NUMBER.format(c='power')} AS INTEGER) AS number
FROM adverts
""")

# --- pivots ----------------------------------------------------------------------------

ENGINES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
AVG = simple()["avg"]
oracle("pivoted", f"""
SELECT make, {', '.join(
    f'''CAST(coalesce(sum(y) FILTER (engine = '{e}'), 0) AS BIGINT) AS "{e}"''' for e in ENGINES)}
FROM (SELECT make, engine, {AVG} AS y FROM adverts GROUP BY make, engine) GROUP BY make
""")
oracle("pivoted_null", f"""
SELECT make, model, {', '.join(
    f'''{r(f"coalesce(sum(y) FILTER (coalesce(gearbox, 'null') = '{g}'), 0)")} AS "{g}"'''
    for g in ('A', 'N', 'null'))}
FROM (SELECT make, model, gearbox, median({P}) AS y FROM adverts GROUP BY ALL)
GROUP BY make, model
""")
oracle("pivoted_not", f"""
SELECT make, year, count({P}) AS "count", {AVG} AS avg FROM adverts GROUP BY make, year
""")
oracle("pivot_series", f"""
SELECT year, label, CAST(count({P}) AS DOUBLE) AS value
FROM (SELECT DISTINCT year FROM adverts WHERE year <= 1999)
CROSS JOIN (SELECT DISTINCT engine AS label FROM adverts WHERE year <= 1999)
LEFT JOIN (SELECT year AS y, engine, {P} FROM adverts) ON y = year AND engine = label
GROUP BY year, label
""")
oracle("pivot_labels", """
SELECT DISTINCT CAST(year AS VARCHAR) AS x_label FROM adverts WHERE year <= 1999
""")
oracle("pivot_labels_null", """
SELECT DISTINCT coalesce(gearbox, 'Unknown') AS x_label FROM adverts
""")
oracle("pivot_series_two_axes", f"""
SELECT axes.year, axes.gearbox, label, {r('coalesce(sum(y), 0)')} AS value
FROM (SELECT DISTINCT year, gearbox FROM adverts) axes
CROSS JOIN (SELECT DISTINCT engine AS label FROM adverts)
LEFT JOIN (
  SELECT year, gearbox, engine, avg({P}) AS y FROM adverts GROUP BY year, gearbox, engine, model
) cells ON cells.year = axes.year AND cells.gearbox IS NOT DISTINCT FROM axes.gearbox
  AND engine = label
GROUP BY axes.year, axes.gearbox, label
""")
oracle("pivot_series_plain", f"""
SELECT concat(coalesce(gearbox, 'Unknown'), ', ', model) AS label, year,
  CAST(trunc(avg({P})) AS BIGINT) AS value
FROM adverts GROUP BY year, gearbox, model
""")
oracle("pivot_series_lists", f"""
SELECT engine AS label,
  concat('[', string_agg(concat('{{"year":', year, ',"value":', y, '}}'), ',' ORDER BY year), ']')
    AS points
FROM (SELECT year, engine, {AVG} AS y FROM adverts GROUP BY year, engine) GROUP BY engine
""")

# --- search, facets, distinct ----------------------------------------------------------

ALL_COLUMNS = ", ".join(ADVERT_COLUMNS)
ROUNDED_COLUMNS = ", ".join(
    f"{r(c)} AS {c}" if c in ("discount", "increase") else c for c in ADVERT_COLUMNS
)
STABLE = ", ".join(f"{c} NULLS LAST" for c in ("created_on", *ADVERT_COLUMNS))
oracle("deals", f"""
SELECT {ROUNDED_COLUMNS} FROM (
  SELECT * FROM adverts WHERE make = 'Brand#2' AND year >= 1996 AND {P} <= 40000
  ORDER BY {STABLE} LIMIT 100
)
""")
oracle("top_deals", f"""
SELECT {ROUNDED_COLUMNS} FROM (
  SELECT * FROM adverts WHERE make = 'Brand#9'
  ORDER BY save_diff_in_eur DESC NULLS LAST, gearbox NULLS LAST, advert_id LIMIT 100
)
""")
oracle("top_deals_nulls_last", """
SELECT advert_id, make, gearbox FROM adverts ORDER BY gearbox DESC NULLS LAST, advert_id
""")
for _name in ("make", "engine", "gearbox", "source"):
    oracle(f"facet_{_name}", f"""
SELECT DISTINCT {_name} FROM adverts WHERE upper({_name}) <> 'NOTFOUND'
""")
oracle("facet_models", "SELECT DISTINCT model FROM adverts WHERE make = 'Brand#11'")
oracle("distinct_sorted", "SELECT DISTINCT gearbox FROM adverts")
oracle("distinct_normalised", """
SELECT DISTINCT title AS value, upper(replace(title, ' ', '')) AS key FROM adverts
""")
oracle("distinct_pairs", """
SELECT make, model, any_value(upper(concat(make, '/', model))) AS spelled
FROM adverts GROUP BY make, model
""")

# --- estimates -------------------------------------------------------------------------

# Named measures over rows, and the estimate over those.
MEASURED = f"""count({P}) AS n, min({P}) AS lo, avg({P}) AS mean, median({P}) AS median,
  {nearest(0.66)} AS q66, {nearest(0.75)} AS q75, {nearest(0.8)} AS q80,
  {nearest(0.85)} AS q85, CAST(max({P}) AS DOUBLE) AS hi, stddev_samp({P}) AS std,
  stddev_samp({P}) / nullif(avg({P}), 0) AS rsd"""
ESTIMATION = """CASE
  WHEN rsd IS NULL THEN NULL
  WHEN rsd <= 0.1
    THEN (1 - rsd) * (0.4 * mean + 0.4 * median + 0.12 * q66 + 0.1 * q80) + rsd * hi
  WHEN rsd <= 0.3
    THEN ((1 - rsd) * (0.2 * mean + 0.2 * median + 0.3 * q66 + 0.3 * q80) + 0.15 * q75)
         / CASE WHEN abs((1 - rsd) * 1.0 + 0.15 - 1) > 0.0001
                THEN (1 - rsd) * 1.0 + 0.15 ELSE 1 END
  ELSE 0.2 * mean + 0.2 * median + 0.25 * q66 + 0.15 * q75 + 0.1 * q80 + 0.1 * hi
END"""


def whole(expression: str) -> str:
    return f"CAST(round(CAST({expression} AS DOUBLE)) AS INTEGER)"


ANSWER = f"""n AS "count", {whole('mean')} AS mean, {whole('median')} AS median,
  {whole('q66')} AS quantile_66, {whole('q75')} AS quantile_75, {whole('q80')} AS quantile_80,
  {whole('q85')} AS quantile_85, {whole('hi')} AS "max", {whole('rsd * 100')} AS rsd,
  {whole(ESTIMATION)} AS estimation"""
COMPARABLE = """make = 'Brand#1' AND engine = '2-HIGH' AND mileage BETWEEN 40001 AND 60000
  AND power BETWEEN 151 AND 200"""
# The relaxed request asks for a text and a displacement nothing has; without them it is
# the same request.
for _name in ("estimate", "estimate_relaxed"):
    oracle(_name, f"""
SELECT {ANSWER} FROM (SELECT {MEASURED} FROM adverts WHERE {COMPARABLE} HAVING count(*) > 0)
""")
oracle("estimate_wide", f"""
SELECT {ANSWER} FROM (
  SELECT {MEASURED} FROM adverts WHERE make = 'Brand#3' AND model = 'PROMO' HAVING count(*) > 0
)
""")
oracle("estimate_none", f"""
SELECT {ANSWER} FROM (SELECT {MEASURED} FROM adverts WHERE make = 'Brand#99' HAVING count(*) > 0)
""")
oracle("estimate_statistics", f"""
SELECT n AS "count", lo AS "min", {r('mean')} AS mean, {r('median')} AS median,
  q66 AS quantile_66, q75 AS quantile_75, q80 AS quantile_80, q85 AS quantile_85,
  CAST(hi AS INTEGER) AS "max", {r('std')} AS std, {r('rsd')} AS rsd
FROM (SELECT {MEASURED} FROM adverts WHERE {COMPARABLE} HAVING count(*) > 0)
""")
oracle("comparable_count", f"""
SELECT CAST(1 AS INTEGER) AS level, count(*) AS row_count FROM adverts WHERE {COMPARABLE}
HAVING count(*) > 0
""")
oracle("estimate_batch", f"""
SELECT request_id, {ANSWER.replace('n AS "count"', 'coalesce(n, 0) AS "count"')}
FROM asked LEFT JOIN (
  SELECT {MEASURED}, w_make, w_model, w_year, w_gearbox, w_m, w_p, w_cc
  FROM chosen GROUP BY w_make, w_model, w_year, w_gearbox, w_m, w_p, w_cc
) ON make = w_make AND model = w_model AND year = w_year
  AND gearbox IS NOT DISTINCT FROM w_gearbox AND m = w_m AND p = w_p AND cc = w_cc
""", f"""
banded AS (
  SELECT advert_id AS request_id, make, model, year, gearbox, cc, {P},
    {MILEAGE_NUMBER.format(c='mileage')} AS m, {POWER_NUMBER.format(c='power')} AS p
  FROM adverts
),
asked AS (
  SELECT request_id, make, model, year, gearbox, m, p,
    cc + CASE WHEN m % 2 = 1 THEN 50 ELSE 0 END AS cc
  FROM banded
),
wishes AS (SELECT DISTINCT make AS w_make, model AS w_model, year AS w_year,
  gearbox AS w_gearbox, m AS w_m, p AS w_p, cc AS w_cc FROM asked),
met AS (
  SELECT wishes.*, {P}, banded.cc = w_cc AS strict,
    max(banded.cc = w_cc) OVER (
      PARTITION BY w_make, w_model, w_year, w_gearbox, w_m, w_p, w_cc) AS any_strict
  FROM wishes JOIN banded ON make = w_make AND model = w_model AND year = w_year
    AND (w_gearbox IS NULL OR gearbox = w_gearbox) AND m = w_m AND p = w_p
),
chosen AS (SELECT * FROM met WHERE strict = any_strict)
""")
oracle("estimate_batch_engines", f"""
SELECT request_id, {ANSWER.replace('n AS "count"', 'coalesce(n, 0) AS "count"')}
FROM requests LEFT JOIN (SELECT request_id AS id, {MEASURED} FROM chosen GROUP BY request_id)
  ON id = request_id
""", f"""
requests AS (
  SELECT concat_ws('-', make, year) AS request_id, make AS w_make,
    CASE WHEN year % 2 = 0 THEN year END AS w_year, min(engine) AS e1, max(engine) AS e2
  FROM adverts GROUP BY make, year
),
met AS (
  SELECT request_id, {P},
    cc = 1200 AND (title LIKE 'red%' OR equipment LIKE 'red%') AS strict
  FROM requests JOIN adverts ON make = w_make AND (w_year IS NULL OR year = w_year)
    AND engine IN (e1, e2)
),
chosen AS (
  SELECT * FROM (SELECT *, max(strict) OVER (PARTITION BY request_id) AS any_strict FROM met)
  WHERE strict = any_strict
)
""")
ALTERNATIVE = ["count", "mean", "median", "std", "rsd", "quantile_60", "quantile_66",
               "quantile_75", "quantile_80", "quantile_90"]
oracle("estimate_alternative", f"""
SELECT make, year, {aliased(ALTERNATIVE)}, {r(f'''
  (0.25 * avg({P}) + 0.25 * median({P}) + 0.1 * {nearest(0.6)} + 0.1 * {nearest(0.66)}
   + 0.1 * {nearest(0.75)} + 0.1 * {nearest(0.8)} + 0.1 * {nearest(0.9)})
  * CASE WHEN stddev_samp({P}) / avg({P}) > 0.3 THEN 1.1
         WHEN stddev_samp({P}) / avg({P}) < 0.1 THEN 0.95
         WHEN stddev_samp({P}) IS NOT NULL THEN 1.0 END
  * CASE WHEN stddev_samp({P}) > 10000 THEN 1.05 WHEN stddev_samp({P}) < 5000 THEN 0.95
         WHEN stddev_samp({P}) IS NOT NULL THEN 1.0 END''')} AS estimation
FROM adverts GROUP BY make, year
""")

# --- result shapes ---------------------------------------------------------------------

BY_YEAR = f"""
grouped AS (
  SELECT gearbox, year, count({P}) AS n, min({P}) AS lo, CAST(sum({P}) AS BIGINT) AS total,
    {AVG} AS average
  FROM adverts GROUP BY gearbox, year
)
"""


def listed(expression: str) -> str:
    return (
        f"concat('[', string_agg({expression}, ',' ORDER BY year, gearbox NULLS LAST), ']')"
    )


GEARBOX_TEXT = """concat('"', coalesce(gearbox, ''), '"')"""
_meta = ",".join(
    f'{{"column_name":"{c}","column_index":{i},"column_dtype":"{t}","visible":true}}'
    for i, (c, t) in enumerate(
        [("gearbox", "string"), ("year", "int"), ("count", "bigint"), ("min", "int"),
         ("sum", "bigint")]
    )
)
oracle("result_columns", f"""
SELECT concat('{{"itemsCount":', count(*), ',"gearbox":', {listed(GEARBOX_TEXT)},
  ',"year":', {listed('CAST(year AS VARCHAR)')}, ',"count":', {listed('CAST(n AS VARCHAR)')},
  ',"min":', {listed('CAST(lo AS VARCHAR)')}, ',"sum":', {listed('CAST(total AS VARCHAR)')},
  ',"metadata":[{_meta}]}}') AS json
FROM grouped
""", BY_YEAR)
oracle("result_dimensions", """
SELECT 'gearbox' AS dimension, 0 AS column_index,
  count(DISTINCT coalesce(gearbox, '')) AS distinct_count FROM grouped
UNION ALL
SELECT 'year', 1, count(DISTINCT year) FROM grouped
""", BY_YEAR)


def dimension(i: int, name: str, text: str) -> str:
    return (
        f"""'{{"label":"{name}","column_name":"{name}","column_index":{i},"distinct_count":',"""
        f" count(DISTINCT {text}), ',\"data\":', {listed(text)}, '}}'"""
    )


YEAR_TEXT = """concat('"', year, '"')"""
_columns = ",".join(
    f'{{"column":"{c}","column_index":{i}}}'
    for i, c in enumerate(["gearbox", "year", "count", "avg"])
)
oracle("result_grouped", f"""
SELECT CAST(count(*) AS INTEGER) AS total_count, '[{_columns}]' AS metadata,
  concat('[', {dimension(0, 'gearbox', GEARBOX_TEXT)}, ',',
    {dimension(1, 'year', YEAR_TEXT)}, ']') AS dimensions,
  {listed('''concat('{"count":', n, ',"avg":', average, '}')''')} AS data
FROM grouped
""", BY_YEAR)
oracle("result_whole", f"""
SELECT make, CAST(trunc(avg({P})) AS BIGINT) AS mean,
  CAST(trunc(median({P})) AS BIGINT) AS median,
  CAST(trunc(stddev_samp({P})) AS BIGINT) AS std
FROM adverts GROUP BY make
""")

_hidden = ",".join(
    f'{{"column_name":"{c}","column_index":{i},"column_dtype":"{t}","visible":{v}}}'
    for i, (c, t, v) in enumerate(
        [("advert_id", "string", "false"), ("make", "string", "true"),
         ("gearbox", "string", "true"), ("created_on", "date", "true"), (P, "int", "true")]
    )
)


def chosen_list(expression: str) -> str:
    return f"concat('[', string_agg({expression}, ',' ORDER BY {P} DESC, advert_id), ']')"


def text(expression: str) -> str:
    return f"""concat('"', coalesce({expression}, ''), '"')"""


oracle("result_hidden", f"""
SELECT concat('{{"itemsCount":', count(*), ',"advert_id":', {chosen_list(text('advert_id'))},
  ',"make":', {chosen_list(text('make'))}, ',"gearbox":', {chosen_list(text('gearbox'))},
  ',"created_on":', {chosen_list(text('CAST(created_on AS VARCHAR)'))},
  ',"{P}":', {chosen_list(f'CAST({P} AS VARCHAR)')}, ',"metadata":[{_hidden}]}}') AS json
FROM (SELECT * FROM adverts WHERE make = 'Brand#6'
      ORDER BY {P} DESC NULLS LAST, advert_id LIMIT 7)
""")

# --- wide, fractional and mixed types --------------------------------------------------

WIDE = """
lines AS (
  SELECT *, 1000000000000000 + l_orderkey * 1000003 + l_linenumber AS number,
    9007199254740993 + l_orderkey * 2 AS huge, l_extendedprice * l_tax AS tax
  FROM lineitem
)
"""


def ranked(p: float, x: str) -> str:
    """``nearest`` in the column's own type."""
    return (
        f"list_sort(list({x}) FILTER ({x} IS NOT NULL))"
        f"[CAST(floor((count({x}) - 1) * ({p})::DOUBLE + 0.5) AS BIGINT) + 1]"
    )


oracle("quantile_wide", f"""
SELECT l_returnflag, count(number) AS "count", min(number) AS "min", max(number) AS "max",
  {', '.join(f"{ranked(p, 'number')} AS q{i}" for i, p in enumerate((0.0, 0.1, 0.5, 0.777, 1.0)))}
FROM lines GROUP BY l_returnflag
""", WIDE)
oracle("quantile_double", f"""
SELECT l_returnflag, {aliased(['count', 'median', 'quantile_1', 'quantile_37', 'quantile_99'], 'tax')}
FROM lines GROUP BY l_returnflag
""", WIDE)
oracle("std_wide", """
SELECT l_linestatus, round(stddev_samp(number - 1000000000000000) / 1e6, 4) AS std,
  round(stddev_samp(number - 1000000000000000) / 1e6, 4) AS with_median
FROM lines GROUP BY l_linestatus
""", WIDE)
oracle("agg_map_mixed_types", f"""
SELECT l_returnflag, min(huge) AS huge_min, max(huge) AS huge_max, {r('median(huge)')} AS huge_median,
  count(huge) AS huge_count, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber_sum,
  max(l_linenumber) AS l_linenumber_max, {nearest(0.9, 'l_linenumber')} AS "l_linenumber_Q_0_9",
  {r('max(tax)')} AS tax_max, {r('median(tax)')} AS tax_median
FROM lines GROUP BY l_returnflag
""", WIDE)


def closed_bins(x: str, n: int, place: str, category: str) -> tuple[str, str]:
    """Equal bins over the whole range, the last one closed."""
    whole_type = x == "number"
    middle = f"CAST(trunc(median({x})) AS BIGINT)" if whole_type else r(f"median({x})")
    # A mean of a thousand values of four digits may lie in the middle of two numbers of six.
    more = "" if whole_type else (
        f", round(CAST(avg({x}) AS DOUBLE), 8) AS mean, {r(rsd_percent(x))} AS rsd")
    shown = (lambda e: e) if whole_type else r
    return f"""
SELECT '{x}' AS "column", CAST({category} AS VARCHAR) AS category, bin AS "index",
  {shown(f'min({x})')} AS "min", {shown(f'max({x})')} AS "max", {middle} AS median,
  count({x}) AS "count"{more}
FROM placed GROUP BY bin
""", f"""{WIDE.strip()}, span AS (SELECT min({x}) AS lo, max({x}) AS hi FROM lines),
{place}"""


for _name, _x, _n in (("dist_fractional", "tax", 6), ("dist_wide", "number", 7)):
    _index = (f"({_x} - lo) // ((hi - lo) // {_n})" if _x == "number"
              else f"floor(({_x} - lo) / ((hi - lo) / {_n}))")
    oracle(_name, *closed_bins(_x, _n, f"""placed AS (SELECT {_x},
      CAST(least({_n - 1}, {_index}) AS INTEGER) AS bin FROM lines, span)""", "bin"))
    _cuts = ", ".join(f"{ranked(i / _n, _x)} AS c{i}" for i in range(1, _n + 1))
    _arms = " ".join(f"WHEN {_x} < c{i} THEN {i - 1}" for i in range(1, _n))
    oracle(f"{_name}_quantile", *closed_bins(_x, _n, f"""cuts AS (SELECT {_cuts} FROM lines),
    placed AS (SELECT {_x}, CAST(CASE {_arms} ELSE {_n - 1} END AS INTEGER) AS bin
      FROM lines, cuts)""", "bin + 1"))

# --- pivots over awkward values --------------------------------------------------------

_counts = ", ".join(
    f"count({P}) FILTER (substr(engine, 1, 1) = '{i}') AS \"1.{i} `x`\"" for i in range(1, 6))
oracle("pivoted_dotted", f"SELECT make, {_counts} FROM adverts GROUP BY make")
_tops = ", ".join(
    f"coalesce(max({P}) FILTER (round(discount) = {i}), 0) AS \"{i}.0\"" for i in range(11))
oracle("pivoted_float", f"SELECT year, {_tops} FROM adverts GROUP BY year")
oracle("pivot_series_tall", f"""
SELECT years.year, label, CAST(coalesce(min({P}), 0) AS DOUBLE) AS value
FROM (SELECT DISTINCT year FROM adverts WHERE make = 'Brand#3') years
CROSS JOIN (SELECT DISTINCT concat('1.', substr(engine, 1, 1), ' `x`') AS label
            FROM adverts WHERE make = 'Brand#3') labels
LEFT JOIN adverts ON adverts.year = years.year AND make = 'Brand#3'
  AND concat('1.', substr(engine, 1, 1), ' `x`') = label
GROUP BY years.year, label
""")

# --- bins out of the data, delimited text ----------------------------------------------

oracle("bins_of_years", """
SELECT 'year' AS "column", year AS start, year + 1 AS "end", concat('in ', year) AS category,
  CAST(row_number() OVER (ORDER BY year) AS INTEGER) AS "index", count(*) AS adverts
FROM adverts GROUP BY year
UNION ALL SELECT 'year', 1900, min(year), 'before', 0, 0 FROM adverts
""")
oracle("source_parsed", f"""
SELECT make, model, year, engine, gearbox, power, mileage, cc,
  CAST(NULL AS VARCHAR) AS mileage_breakdown, CAST(NULL AS VARCHAR) AS power_breakdown,
  {P}, estimated_price_in_eur, save_diff_in_eur, CAST(NULL AS INTEGER) AS extra_charge_in_eur,
  CAST(round(discount) AS DOUBLE) AS discount, CAST(round(increase) AS DOUBLE) AS increase
FROM adverts
""")
oracle("source_bad_rows", """
SELECT count(*) AS row_count, count(*) FILTER (gearbox IS NULL) AS bad_row_count FROM adverts
""")
oracle("source_quotes", "SELECT doc_id, replace(text, '\"', '') AS text, n_chars FROM documents")
oracle("estimate_batch_ranges", f"""
SELECT request_id, {ANSWER.replace('n AS "count"', 'coalesce(n, 0) AS "count"')}
FROM requests LEFT JOIN (SELECT request_id AS id, {MEASURED} FROM chosen GROUP BY request_id)
  ON id = request_id
""", f"""
requests AS (
  SELECT concat_ws('-', make, m) AS request_id, make AS w_make, m, m % 4 AS k
  FROM (SELECT DISTINCT make, month(created_on) AS m FROM adverts)
),
met AS (
  SELECT request_id, {P}, k <> 1 OR cc = 1250 AS strict
  FROM requests JOIN adverts ON make = w_make
    AND CASE k WHEN 0 THEN year = 1997
               WHEN 1 THEN year >= 1996 + m % 3 AND year <= 1998 AND (cc = 1250 OR cc >= 2000)
               WHEN 2 THEN {P} >= 30000 ELSE year <= 1998 AND discount <= 4.5 END
    AND (k = 3 OR mileage <= m * 12000)
),
chosen AS (
  SELECT * FROM (SELECT *, max(strict) OVER (PARTITION BY request_id) AS any_strict FROM met)
  WHERE strict = any_strict
)
""")

# --- many bins, limits per request, indexes and mergeable states -------------------------

PRICE_BINS = f"""
bins AS (
  SELECT '{P}' AS "column", start, "end", CAST("index" AS VARCHAR) AS category, "index" FROM (
    SELECT {P} AS start, lead({P}) OVER (ORDER BY {P}) AS "end",
      CAST(row_number() OVER (ORDER BY {P}) - 1 AS INTEGER) AS "index"
    FROM (SELECT DISTINCT {P} FROM adverts WHERE make < 'Brand#19')
  ) WHERE "end" IS NOT NULL
)
"""
oracle("bins_table_stats", f"""
SELECT "column", category, "index", {bin_measures()}
FROM adverts ASOF JOIN bins ON {P} >= start WHERE {P} < "end" GROUP BY ALL
""", PRICE_BINS)
oracle("bins_table_overlaps", """
SELECT * FROM (
  SELECT *, lead(start) OVER (ORDER BY start, "end") AS next_start
  FROM (SELECT * REPLACE ("end" + CASE WHEN start % 2 = 0 THEN 3 ELSE 0 END AS "end") FROM bins)
) WHERE next_start < "end"
""", PRICE_BINS)
oracle("dist_index_quantile", f"""
SELECT '{P}' AS "column", CAST(bin AS VARCHAR) AS category,
  CAST(dense_rank() OVER (ORDER BY bin) - 1 AS INTEGER) AS "index", {bin_measures()}
FROM trimmed ASOF JOIN wide ON {P} >= lo_cut WHERE {P} < hi_cut GROUP BY bin
""", f"""{range_steps(True, "make <> 'x'")},
  sorted AS (SELECT {P}, row_number() OVER (ORDER BY {P}) - 1 AS spot, count(*) OVER () AS n FROM trimmed),
  cuts AS (SELECT i, {P} AS cut FROM range(0, 101) r(i)
    JOIN sorted ON spot = CAST(floor((n - 1) * (i / 100::DOUBLE) + 0.5) AS BIGINT)),
  wide AS (SELECT * FROM (
    SELECT i + 1 AS bin, cut AS lo_cut, lead(cut) OVER (ORDER BY i) AS hi_cut FROM cuts)
    WHERE lo_cut < hi_cut)""")
S = "save_diff_in_eur"
oracle("dist_index_interval", f"""
SELECT '{S}' AS "column", CAST(bin AS VARCHAR) AS category, bin AS "index", {bin_measures(S)}
FROM (SELECT {S}, CAST(least(59, ({S} - lo) // ((hi - lo) // 60)) AS INTEGER) AS bin
      FROM adverts, bounds WHERE make <> 'x' AND {S} BETWEEN lo AND hi)
GROUP BY bin
""", f"""bounds AS (SELECT CAST({nearest(0.0005, S)} AS INTEGER) AS lo,
    CAST({nearest(0.995, S)} AS INTEGER) AS hi FROM adverts WHERE make <> 'x')""")
oracle("estimate_batch_limits", f"""
SELECT request_id, {ANSWER}
FROM requests JOIN (SELECT request_id AS id, {MEASURED} FROM met GROUP BY request_id) ON id = request_id
""", f"""
hot AS (SELECT mileage, power, created_on, {P} FROM adverts WHERE make = 'Brand#1'),
requests AS (
  SELECT concat_ws('-', mileage, power) AS request_id, mileage AS m, power AS w,
    min(created_on) AS first_day
  FROM hot GROUP BY mileage, power
),
met AS (
  SELECT request_id, {P} FROM requests JOIN hot ON mileage >= m - 24000
    AND (w % 3 = 0 OR mileage <= m + 16000) AND (w % 3 <> 1 OR power <= w)
    AND (m % 3 <> 0 OR created_on >= first_day) AND (m % 5 <> 0 OR {P} <= 60000)
)
""")
_title, _equipment = "lower(title)", "lower(equipment)"
oracle("search_indexed", f"""
SELECT advert_id, title, equipment, {P}, 'RED.*get' AS search FROM adverts
WHERE regexp_matches({_title}, 'red.*get') OR regexp_matches({_equipment}, 'red.*get')
UNION ALL SELECT advert_id, title, equipment, {P}, '*bolt' FROM adverts
WHERE {_title} LIKE '%bolt' OR {_equipment} LIKE '%bolt'
UNION ALL SELECT advert_id, title, equipment, {P}, 'urgent' FROM adverts
WHERE contains({_title}, 'urgent') OR contains({_equipment}, 'urgent')
""")
oracle("quantile_sketch", f"""
SELECT make, fraction, "rows", true AS "within" FROM (
  SELECT make, count({P}) AS "rows" FROM adverts GROUP BY make),
  (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) f(fraction)
""")
oracle("facet_overlap_sketch", f"""
SELECT make, count(DISTINCT {P}) AS distinct_prices, count(DISTINCT {P}) FILTER ({P} IN (
    SELECT {P} FROM adverts WHERE engine = '2-HIGH')) AS shared_prices, true AS "within"
FROM adverts GROUP BY make
""")
oracle("stat_merged", f"SELECT make, {aliased(['count', 'mean', 'std', 'rsd'])} FROM adverts GROUP BY make")
oracle("pivoted_variant", f"""
SELECT make, year, concat('{{', string_agg(concat('"', label, '":', total), ',' ORDER BY label), '}}')
  AS cells
FROM (SELECT make, year, coalesce(gearbox, 'null') AS label, sum({P}) AS total
      FROM adverts GROUP BY ALL)
GROUP BY make, year
""")
oracle("spellings_collated", """
SELECT min(title) AS value, count(DISTINCT title) AS spellings, count(*) AS listings
FROM (SELECT CASE WHEN year % 3 = 0 THEN upper(title) WHEN year % 3 = 1 THEN array_to_string(
    list_transform(string_split(title, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') ELSE title END
    AS title FROM adverts)
GROUP BY lower(title)
""")
oracle("result_pages", f"""
SELECT spot // 150 AS page, spot // 150 * 150 AS first, CAST(count(*) AS INTEGER) AS items,
  concat('[', string_agg(concat('{{"advert_id":"', advert_id, '","make":"', make, '","gearbox":',
    CASE WHEN gearbox IS NULL THEN 'null' ELSE concat('"', gearbox, '"') END,
    ',"{P}":', {P}, '}}'), ',' ORDER BY spot), ']') AS json
FROM (SELECT *, row_number() OVER (ORDER BY {P} DESC, advert_id) - 1 AS spot
      FROM adverts WHERE make = 'Brand#2')
GROUP BY spot // 150
""")
