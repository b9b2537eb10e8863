"""Price estimates from comparable listings, singly or in batch."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import chain
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from forecourt.functions.bands import MILEAGE_BANDS, POWER_BANDS, band_number, band_of
from forecourt.functions.measures import is_whole, measures
from forecourt.functions.text import any_like
from forecourt.operators.filters import (
    AT_LEAST,
    AT_MOST,
    EXACT_OR_RANGE,
    SEARCHED,
    ListingFilter,
    require_columns,
)
from forecourt.operators.grouping import group_measures
from forecourt.operators.ranks import COUNT, ROWS, VALUE, measures_of_counts, value_counts
from forecourt.plans.statistics import DEFAULT_STAT_COLUMN

# The measures an estimate rests on and their weights. Up to a relative
# deviation r of LOW the weights shrink by 1 - r and the maximum enters with r. Up to
# MIDDLE they shrink likewise, next to fixed ones, and all are scaled to a sum of 1
# when that differs from 1 by more than TOLERANCE. Beyond, all are fixed.
ESTIMATE_MEASURES = (
    "count", "min", "mean", "median", "quantile_66", "quantile_75", "quantile_80",
    "quantile_85", "max", "std", "rsd",
)
ROUNDED = (
    "mean", "median", "quantile_66", "quantile_75", "quantile_80", "quantile_85", "max",
)
LOW = 0.1
LOW_SHRINKING = {"mean": 0.4, "median": 0.4, "quantile_66": 0.12, "quantile_80": 0.1}
MIDDLE = 0.3
MIDDLE_SHRINKING = {"mean": 0.2, "median": 0.2, "quantile_66": 0.3, "quantile_80": 0.3}
MIDDLE_FIXED = {"quantile_75": 0.15}
TOLERANCE = 0.0001
HIGH_FIXED = {
    "mean": 0.2, "median": 0.2, "quantile_66": 0.25, "quantile_75": 0.15,
    "quantile_80": 0.1, "max": 0.1,
}

# Weights and corrections of the alternative estimate.
ALTERNATIVE_MEASURES = (
    "count", "mean", "median", "std", "rsd", "quantile_60", "quantile_66",
    "quantile_75", "quantile_80", "quantile_90",
)
ALTERNATIVE_WEIGHTS = {
    "mean": 0.25, "median": 0.25, "quantile_60": 0.1, "quantile_66": 0.1,
    "quantile_75": 0.1, "quantile_80": 0.1, "quantile_90": 0.1,
}
HIGH_RSD, HIGH_RSD_FACTOR = 0.3, 1.1
LOW_RSD, LOW_RSD_FACTOR = 0.1, 0.95
HIGH_STD, HIGH_STD_FACTOR = 10_000, 1.05
LOW_STD, LOW_STD_FACTOR = 5_000, 0.95


def _weighted(weights: dict[str, float]) -> Column:
    return reduce(add, [F.col(name) * weight for name, weight in weights.items()])


def estimate_of() -> Column:
    """The estimate over columns named like ``ESTIMATE_MEASURES``; null without a
    relative deviation, that is with fewer than two prices."""
    r = F.col("rsd")
    shrink = F.lit(1.0) - r
    low = shrink * _weighted(LOW_SHRINKING) + r * F.col("max")
    total = shrink * sum(MIDDLE_SHRINKING.values()) + sum(MIDDLE_FIXED.values())
    blended = shrink * _weighted(MIDDLE_SHRINKING) + _weighted(MIDDLE_FIXED)
    middle = F.when(F.abs(total - 1) > TOLERANCE, blended / total).otherwise(blended)
    high = _weighted(HIGH_FIXED)
    return F.when(
        r.isNotNull(),
        F.when(r <= LOW, low).when(r <= MIDDLE, middle).otherwise(high),
    )


def alternative_estimate_of() -> Column:
    """The alternative estimate over columns named like ``ALTERNATIVE_MEASURES``."""
    r, std = F.col("rsd"), F.col("std")
    by_rsd = (
        F.when(r > HIGH_RSD, HIGH_RSD_FACTOR)
        .when(r < LOW_RSD, LOW_RSD_FACTOR)
        .when(r.isNotNull(), 1.0)
    )
    by_std = (
        F.when(std > HIGH_STD, HIGH_STD_FACTOR)
        .when(std < LOW_STD, LOW_STD_FACTOR)
        .when(std.isNotNull(), 1.0)
    )
    return _weighted(ALTERNATIVE_WEIGHTS) * by_rsd * by_std


def snapped(request: ListingFilter) -> ListingFilter:
    """Replace an exact mileage and power by the fixed band around it."""
    for name, bands in (("mileage", MILEAGE_BANDS), ("power", POWER_BANDS)):
        band = band_of(getattr(request, name), bands)
        if band is not None:
            request = request.replace(
                **{f"{name}_from": band.start, f"{name}_to": band.end}
            )
        request = request.replace(**{name: None})
    return request


def comparables(
    adverts: DataFrame, request: ListingFilter, as_of: dt.date | None = None
) -> DataFrame:
    """Adverts comparable to a request, each with the ``level`` it belongs to.

    Level 0 meets the whole request, level 1 the request without ``search`` and
    ``cc``. An advert of both levels appears once for each.
    """
    strict = snapped(request)
    relaxed = strict.replace(search=None, cc=None)
    if strict == relaxed:
        return strict.apply(adverts, as_of).withColumn("level", F.lit(0))
    require_columns(adverts, [c for cs, _ in strict.conditions(as_of) for c in cs])
    meets = [f.to_column(as_of) for f in (strict, relaxed)]
    levels = F.array(*[F.when(m, F.lit(level)) for level, m in enumerate(meets)])
    return (
        adverts.filter(meets[0] | meets[1])
        .select("*", F.explode(F.array_compact(levels)).alias("level"))
    )


def comparable_count(
    adverts: DataFrame, request: ListingFilter, as_of: dt.date | None = None
) -> DataFrame:
    """The level used and how many adverts it has; no row if there are none."""
    return (
        comparables(adverts, request, as_of)
        .groupBy("level")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy("level")
        .limit(1)
    )


def comparable_statistics(
    adverts: DataFrame,
    request: ListingFilter,
    column: str = DEFAULT_STAT_COLUMN,
    as_of: dt.date | None = None,
) -> DataFrame:
    """Measures of the comparables, relaxing the request once if none meets it.

    Both levels are measured in one scan and the stricter one with adverts is taken.
    """
    require_columns(adverts, [column])
    measured = group_measures(
        comparables(adverts, request, as_of), ["level"], column, ESTIMATE_MEASURES
    )
    return measured.orderBy("level").limit(1).drop("level")


def _answer(measured: DataFrame, *kept: str) -> DataFrame:
    def whole(c: Column) -> Column:
        return F.round(c, 0).cast("int")

    return measured.select(
        *kept,
        "count",
        *[whole(F.col(name)).alias(name) for name in ROUNDED],
        whole(F.col("rsd") * 100).alias("rsd"),
        whole(estimate_of()).alias("estimation"),
    )


def estimate_price(
    adverts: DataFrame,
    request: ListingFilter,
    column: str = DEFAULT_STAT_COLUMN,
    as_of: dt.date | None = None,
) -> DataFrame:
    """Estimate, and the measures behind it, as whole numbers (rsd in percent).

    No row when there are no comparables; a null estimate when there is only one.
    """
    return _answer(comparable_statistics(adverts, request, column, as_of))


def alternative_estimates(
    df: DataFrame, keys: Sequence[str], column: str = DEFAULT_STAT_COLUMN
) -> DataFrame:
    """The alternative estimate of every group, with its measures."""
    measured = group_measures(df, keys, column, ALTERNATIVE_MEASURES)
    return measured.withColumn("estimation", alternative_estimate_of())


# --- batch ---------------------------------------------------------------------

NUMBERS = ("year", "cc")
BANDED = {"mileage": MILEAGE_BANDS, "power": POWER_BANDS}
FOUND = "found"
# Fields that must be met exactly. Those dropped when a wish is relaxed come last.
FIELDS = ("year", *BANDED, "make", "model", "gearbox", "engine", "cc", FOUND)
RELAXED = ("cc", FOUND)
# Limits a request may give: its column, the advert's, the comparison, and the exact field
# that replaces it. Those of ``created_on`` are days back from a date.
LIMITS = (
    *((f"{name}_{side}", name, op, name) for name in EXACT_OR_RANGE
      for side, op in (("from", ">="), ("to", "<="))),
    *((name, column, ">=", None) for name, column in AT_LEAST.items()),
    *((name, column, "<=", None) for name, column in AT_MOST.items()),
    ("created_on_from", "created_on", ">=", None),
    ("created_on_to", "created_on", "<=", None),
)
# A range becomes nodes of a tree in this many columns of a wish.
TREES = 2


def _fields(df: DataFrame, search: Column | None) -> dict[str, Column]:
    """The comparable fields a table has, as they are compared; engines may be a list."""
    found: dict[str, Column] = {}
    for name in FIELDS:
        if name == FOUND:
            if search is not None:
                found[name] = search
        elif name in df.columns:
            if name in BANDED:
                found[name] = band_number(name, BANDED[name])
            elif name in NUMBERS:
                whole = is_whole(df.schema[name].dataType)
                found[name] = F.col(name).cast("bigint" if whole else "double")
            elif isinstance(df.schema[name].dataType, ArrayType):
                listed = F.array_sort(F.array_distinct(F.array_compact(name)))
                found[name] = F.when(F.size(listed) > 0, listed)
            else:
                found[name] = F.col(name).cast("string")
    return found


def _print(names: Sequence[str], label: str) -> list[str]:
    """Two 64-bit hashes of some columns and of which of them are null, as two columns in SQL.

    They stay apart: a struct of them is compared field by field where rows are sorted by it.
    """
    present = " + ".join(f"if({name} IS NULL, 0L, {1 << i}L)" for i, name in enumerate(names))
    values = ", ".join((present, *names))
    return [f"xxhash64({values}) AS {label}_a", f"xxhash64(7919, {values}) AS {label}_b"]


def _pair(label: str) -> list[str]:
    return [f"{label}_a", f"{label}_b"]


def tree_node(position: str, level: str) -> str:
    """The node of a level above a position of a tree of four branches, as SQL.

    Nodes are longs: their place among those of their level, and the level in the last six bits.
    """
    return f"shiftright(cast({position} AS bigint), 2 * {level}) * 64 + {level}"


def tree_cover(first: str, last: str, levels: str) -> str:
    """The fewest nodes that cover positions from first to last (both in), as SQL.

    On each level, whole nodes lie between two places; those that fill no whole node of the
    next level are taken. That is at most six a level.
    """
    def places(level: str) -> tuple[str, str]:
        return (f"shiftright({first} + shiftleft(1L, 2 * ({level})) - 1, 2 * ({level}))",
                f"shiftright({last} + 1, 2 * ({level}))")

    def nodes(start: str, end: str) -> str:
        # The sequence would run backwards.
        return (f"if({start} < {end}, transform(sequence({start}, {end} - 1), n -> n * 64 + l),"
                " cast(array() AS array<bigint>))")

    (left, right), (above, below) = places("l"), places("l + 1")
    return (f"flatten(transform(sequence(0, {levels}), l -> if({above} < {below}, concat("
            f"{nodes(left, f'4 * {above}')}, {nodes(f'4 * {below}', right)}),"
            f" {nodes(left, right)})))")


def _met(search: str | None) -> Column | None:
    return None if search is None else F.coalesce(any_like(SEARCHED, search), F.lit(False))


def _answered(
    wanted: DataFrame, tries: DataFrame, measured: DataFrame, id_column: str
) -> DataFrame:
    """Every request with the answer of the strictest of its tries that is met."""
    answers = (
        tries.select(*_pair("strict"), "level", *_pair("wish"))
        .join(measured, _pair("wish"))
        .groupBy(*_pair("strict"))
        .agg(F.min_by(F.struct(*ESTIMATE_MEASURES), "level").alias("best"))
    )
    best = wanted.join(answers, _pair("strict"), "left")
    best = best.select(id_column, "best.*")
    return _answer(best.withColumn("count", F.coalesce("count", F.lit(0))), id_column)


def _estimates_by_fields(
    requests: DataFrame,
    adverts: DataFrame,
    id_column: str,
    column: str,
    search: str | None,
    asked: dict[str, Column],
) -> DataFrame:
    """``estimate_prices`` for requests that give at most one value per field, and no limits.

    The fields that no try drops are the *base* of a wish; beyond it a wish has ``fc_extra``
    (which of ``RELAXED`` it gives) and ``fc_cc``. A wish is one cell then, so adverts are
    measured without a list of wishes: price counts per base and relaxed fields are moved once,
    by base, and ordered there for every wish of the base. Requests are moved once, by wish,
    with no more than what tells their tries, and wishes are found where requests arrive.
    """
    kept = [k for k in asked if k not in RELAXED]
    relaxed = [f"fc_{k}" for k in asked if k in RELAXED]
    own = [c for c in relaxed if c != f"fc_{FOUND}"]
    cc, found = 1, 2
    given = " + ".join(f"if(fc_{k} IS NULL, 0L, {1 << i}L)" for i, k in enumerate(kept))
    extra = " + ".join(["0L", *(f"if({c} IS NULL, 0L, {cc}L)" for c in own),
                        *([f"{found}L"] if search is not None else [])])

    def base() -> list[str]:
        """Hashes of 64 and 32 bits, and the fields given in the last eight bits, as two columns.

        All requests are moved with them, so they are no longer than they need to be.
        """
        parts = ", ".join(("fc_given", *(f"fc_{k}" for k in kept)))
        return [f"xxhash64({parts}) AS base_a",
                f"shiftleft(cast(hash(7919, {parts}) AS bigint), 8) + fc_given AS base_b"]

    def beyond(label: str, *parts: str) -> list[str]:
        """The base and more, as two columns in SQL."""
        return [f"xxhash64({', '.join((f'base_{x}', *parts))}) AS {label}_{x}" for x in "ab"]

    # Wishes and requests are both read from here. The hash of an id keeps the ids in where
    # wishes are found, so that Spark moves requests once.
    strict = beyond("strict", extra, *own)
    wanted = (
        requests.select(id_column, *[c.alias(f"fc_{k}") for k, c in asked.items() if k != FOUND])
        .selectExpr("*", f"{given} AS fc_given")
        .selectExpr(id_column, *base(), *own)
        .repartition(*[F.expr(part.rsplit(" AS ", 1)[0]) for part in strict])
        .selectExpr("*", *strict)
    )
    wishes = (
        wanted.groupBy(*_pair("strict"), *_pair("base"), *own)
        .agg(F.max(F.xxhash64(id_column)).alias("an_id")).where("an_id IS NOT NULL")
        .selectExpr("*", "base_b & 255 AS fc_given", f"{extra} AS fc_extra")
    )
    types = requests.select(*[c.alias(k) for k, c in asked.items()]).schema
    nothing = [f"cast(NULL AS {types['cc'].dataType.simpleString()})"] if own else []
    first, last = (
        f"struct({level} AS level, {', '.join(beyond('wish', *parts))})"
        for level, parts in ((0, ("fc_extra", *own)), (1, ("0L", *nothing))))
    tries = wishes.selectExpr(
        *_pair("strict"), f"inline(if(fc_extra > 0, array({first}, {last}), array({first})))")

    # One set of cells per combination of given fields, at most one per subset; in it, one per
    # combination of relaxed fields, at most three.
    combinations = wishes.agg(F.struct(
        F.collect_set("fc_given").alias("given"),
        F.array_union(F.collect_set("fc_extra"), F.array(F.lit(0).cast("bigint"))).alias("extra"),
    )).scalar()
    described = _fields(adverts, _met(search))
    cells = adverts.select(
        *[described[k].cast(types[k].dataType).alias(f"fc_{k}")
          if k in NUMBERS else described[k].alias(f"fc_{k}") for k in asked],
        F.col(column).alias(VALUE))
    cells = value_counts(cells, [f"fc_{k}" for k in asked], VALUE).drop(ROWS)
    # Not ``explode``: Spark would look for empty lists below the joins that adverts come from.
    cells = cells.withColumn("fc_given", F.explode_outer(combinations["given"]))
    there = [f"(fc_given & {1 << i} = 0 OR fc_{k} IS NOT NULL)" for i, k in enumerate(kept)]
    within = [f"if(fc_given & {1 << i} = 0, NULL, fc_{k}) AS fc_{k}" for i, k in enumerate(kept)]
    cells = (
        cells.where(" AND ".join(("fc_given IS NOT NULL", *there)))
        .selectExpr("fc_given", *within, *relaxed, VALUE, COUNT)
        .selectExpr("fc_given", *base(), *relaxed, VALUE, COUNT)
    )
    # Prices come once per base; where a base leaves fields open, they are added up.
    # (Of an equality Spark would make further conditions, and move adverts once for them.)
    all_given, priced = (1 << len(kept)) - 1, [*_pair("base"), *relaxed, VALUE]
    cells = cells.where(f"fc_given >= {all_given}").select(*priced, COUNT).union(
        cells.where(f"fc_given < {all_given}").groupBy(*priced).agg(F.sum(COUNT).alias(COUNT)))
    cells = cells.join(wishes.select(*_pair("base")).distinct(), _pair("base"), "left_semi")
    keys = _pair("base")
    if relaxed:
        met = [*(f"(fc_extra & {cc} = 0 OR {c} IS NOT NULL)" for c in own),
               *([f"(fc_extra & {found} = 0 OR fc_{FOUND})"] if search is not None else [])]
        cells = (
            cells.withColumn("fc_extra", F.explode(combinations["extra"]))
            .where(" AND ".join(met))
            .selectExpr(*keys, "fc_extra",
                        *[f"if(fc_extra & {cc} = 0, NULL, {c}) AS {c}" for c in own], VALUE, COUNT)
        )
        keys = [*keys, "fc_extra", *own]
    measured = measures_of_counts(
        cells, keys, adverts.schema[column].dataType, measures(ESTIMATE_MEASURES), small_keys=True,
    ).selectExpr(*beyond("wish", "fc_extra" if relaxed else "0L", *own), *ESTIMATE_MEASURES)
    return _answered(wanted, tries, measured, id_column)


def estimate_prices(
    requests: DataFrame,
    adverts: DataFrame,
    id_column: str = "request_id",
    column: str = DEFAULT_STAT_COLUMN,
    search: str | None = None,
    as_of: dt.date | None = None,
) -> DataFrame:
    """Estimate every request of a table.

    A request may give ``make, model, year, engine`` (a value or a list), ``gearbox,
    mileage, power`` and ``cc``, and limits: ``year, power, mileage`` and ``cc`` with
    ``_from`` and ``_to``, ``price, price_from, price_to, estimated_price``,
    ``discount`` and ``save_diff`` with ``_from`` and ``_to``, and ``created_on_from`` and
    ``created_on_to`` (days back from ``as_of``, today if not given). A null leaves a field open; any
    other column is an error. ``search`` holds for the whole batch. As for a single request,
    mileage and power mean their bands, an exact value replaces its limits, and a request
    nothing meets is tried again without ``cc`` and ``search``. Requests without comparables
    keep a row with count 0.

    Requests and adverts are never paired. Equal wishes are answered once (they go by two
    hashes of all they ask for), and adverts
    are reduced to price counts per *cell* (the fields wishes give), one set of cells
    for every combination of given fields that occurs, so a model holding most of
    adverts and requests costs its distinct prices. Those of one wish are ordered in one task;
    without lists of engines and limits, those of all wishes that agree but for ``cc`` are,
    which costs the distinct pairs of price and ``cc``.

    A range of whole numbers or days is a few nodes of a tree over the column's values, and every
    value lies in one node of each level; so ranges, too, are met by equality, and a wish
    reads the distinct prices of its nodes, however many adverts there are. That holds for two
    limited columns of a wish, and for limits of the price itself; limits on fractions, and on a
    third column at once, are compared row by row among the counts of those nodes.
    """
    require_columns(requests, [id_column])
    require_columns(adverts, [column])
    limits = [limit for limit in LIMITS if limit[0] in requests.columns]
    known = {id_column, *FIELDS, *(name for name, *_ in limits)} - {FOUND}
    unknown = sorted(set(requests.columns) - known)
    if unknown:
        raise ValueError(f"unknown request columns: {', '.join(unknown)}")
    asked = _fields(requests, None if search is None else F.lit(True))
    if not asked and not limits:
        raise ValueError("requests name no field to compare by")
    require_columns(adverts, [of for _, of, *_ in limits])
    require_columns(adverts, [k for k in asked if k != FOUND])
    names = list(asked)
    if "engine" in names and isinstance(adverts.schema["engine"].dataType, ArrayType):
        raise ValueError("adverts must have one engine each")  # hashes of lists meet no text's
    for k in set(names) & set(NUMBERS):  # compared in one type
        if not (is_whole(requests.schema[k].dataType) and is_whole(adverts.schema[k].dataType)):
            asked[k] = asked[k].cast("double")
    listed = "engine" in names and isinstance(requests.schema["engine"].dataType, ArrayType)
    if not limits and not listed and set(names) - set(RELAXED):
        return _estimates_by_fields(requests, adverts, id_column, column, search, asked)
    bits = {k: 1 << i for i, k in enumerate(names)}
    today = as_of or dt.datetime.now(dt.timezone.utc).date()

    # Both tries of every wish: the fields that are not given are null.
    def limit_value(name: str, of: str) -> Column:
        if of == "created_on":
            return F.unix_date(F.date_sub(F.lit(today), F.col(name).cast("int")))
        return F.col(name)

    wanted = requests.select(
        id_column, *[c.alias(f"fc_{k}") for k, c in asked.items()],
        *[limit_value(name, of).alias(f"fl_{name}") for name, of, *_ in limits])
    limited = list(dict.fromkeys(of for _, of, *_ in limits))
    relaxable = [k for k in names if k in RELAXED]

    def bounds(level: int) -> list[str]:
        """Per limited column its limits, as SQL: none where an exact value is given and kept."""
        found = []
        for of in limited:
            for op, best in ((">=", "greatest"), ("<=", "least")):
                held = []
                for name, its, its_op, exact in limits:
                    if (its, its_op) == (of, op):
                        replaced = exact in names and not (level and exact in RELAXED)
                        held.append(
                            f"if(fc_{exact} IS NULL, fl_{name}, NULL)" if replaced else f"fl_{name}")
                side = f"{best}({', '.join(held)})" if len(held) > 1 else (
                    held[0] if held else "cast(NULL AS int)")
                found.append(f"{side} AS {'lo' if op == '>=' else 'hi'}_{of}")
        return found

    def one_try(level: int) -> str:
        kept = [f"{'NULL' if level and k in RELAXED else f'fc_{k}'} AS fc_{k}" for k in names]
        given = " + ".join(
            ["0", *(f"if(fc_{k} IS NULL, 0, {bits[k]})" for k in names
                    if not (level and k in RELAXED))])
        return f"struct({level} AS level, {', '.join((*kept, f'{given} AS given', *bounds(level)))})"

    everything = [f"fc_{k}" for k in names] + [f"fl_{name}" for name, *_ in limits]
    # Without an aggregate of texts, equal wishes are found by hashing, not by sorting requests.
    strict = wanted.select(*everything).distinct().selectExpr("*", *_print(everything, "strict"))
    wanted = wanted.selectExpr(id_column, *_print(everything, "strict"))
    dropped = " OR ".join(f"fc_{k} IS NOT NULL" for k in relaxable) or "false"
    tries = strict.selectExpr(
        *_pair("strict"),
        f"inline(if({dropped}, array({one_try(0)}, {one_try(1)}), array({one_try(0)})))"
    ) if relaxable else strict.selectExpr(*_pair("strict"), f"inline(array({one_try(0)}))")
    ends = [f"{side}_{of}" for of in limited for side in ("lo", "hi")]
    tries = tries.selectExpr("*", *_print([*[f"fc_{k}" for k in names], *ends], "wish"))

    attempts = tries.drop(*_pair("strict"), "level").distinct()
    if listed:
        attempts = attempts.withColumn("fc_engine", F.explode_outer("fc_engine"))

    described = _fields(adverts, _met(search))
    treed = [of for of in limited if of != column]

    def plain(of: str) -> Column:
        return F.unix_date(of) if of == "created_on" else F.col(of)

    rows = adverts.select(
        *[described[k].cast(strict.schema[f"fc_{k}"].dataType).alias(f"fc_{k}")
          if k in NUMBERS else described[k].alias(f"fc_{k}") for k in names], column,
        *[plain(of).alias(f"fr_{of}") for of in treed])
    fine = value_counts(rows, [*(f"fc_{k}" for k in names), *(f"fr_{of}" for of in treed)], column)

    # Whole numbers and days have trees over the range of the adverts' values.
    whole = [of for of in treed if of == "created_on" or is_whole(adverts.schema[of].dataType)]
    spans = {of: 1 << i for i, of in enumerate(whole)}
    def span(of: str) -> Column:
        base, top = (f(f"fr_{of}").cast("bigint") for f in (F.min, F.max))
        levels = F.floor((F.length(F.bin(top - base)) + 1) / 2).cast("int")
        return F.struct(base.alias("base"), top.alias("top"), levels.alias("levels")).alias(of)

    extent = rows.agg(F.struct(
        *[span(of) for of in whole] or [F.lit(0).alias("none")]).alias("extent")).scalar()
    mask = " + ".join(["0", *(
        f"if(lo_{of} IS NULL AND hi_{of} IS NULL, 0, {bit})" for of, bit in spans.items())])
    attempts = attempts.selectExpr("*", f"{mask} AS mask").withColumn("extent", extent)

    def nth(n: int, expression: Callable[[str], str]) -> str:
        """An expression for the nth limited column of ``mask``, as SQL; null if there is none."""
        arms = " ".join(
            f"WHEN mask & {bit} > 0 AND bit_count(mask & {bit - 1}) = {n} THEN {expression(of)}"
            for of, bit in spans.items())
        return f"CASE {arms} END"

    def covered(of: str) -> str:
        base, top = f"extent.{of}.base", f"extent.{of}.top"
        low = f"greatest(ceil(coalesce(lo_{of}, {base})) - {base}, 0L)"
        high = f"least(floor(coalesce(hi_{of}, {top})), {top}) - {base}"
        return (f"if({high} < {low}, cast(array() AS array<bigint>),"
                f" {tree_cover(f'cast({low} AS bigint)', f'cast({high} AS bigint)', f'extent.{of}.levels')})")

    trees = range(min(TREES, len(whole)))

    def node(df: DataFrame, n: int, expression: Callable[[str], str]) -> DataFrame:
        return df.withColumn(f"node_{n}", F.explode(F.expr(
            f"if(bit_count(mask) <= {n}, array(-1L), {nth(n, expression)})")))

    # Limits that no tree meets: of fractions, and of a third column.
    rest = [of for of in treed if of not in spans or len(spans) > TREES]
    within = [f"if(given & {bit} = 0, NULL, fc_{k}) AS fc_{k}" for k, bit in bits.items()]

    # A cell goes by two 64-bit hashes, too: what is given, of which columns, and the nodes so far.
    def cell(to: int) -> list[str]:
        if to:
            return [f"xxhash64(cell_{to - 1}_{x}, node_{to - 1}) AS cell_{to}_{x}" for x in "ab"]
        parts = ", ".join(("given", "mask", *(f"fc_{k}" for k in names)))
        return [f"xxhash64({parts}) AS cell_0_a", f"xxhash64(7919, {parts}) AS cell_0_b"]

    looked_up = attempts.selectExpr("*", *cell(0))
    for n in trees:
        looked_up = node(looked_up, n, covered).selectExpr("*", *cell(n + 1))
    limit_of_value = [f"{side}_{column} AS {name}" if column in limited else f"cast(NULL AS int) AS {name}"
                      for side, name in (("lo", "low"), ("hi", "high"))]
    looked_up = looked_up.selectExpr(
        *_pair("wish"), "mask", *chain.from_iterable(_pair(f"cell_{to}") for to in range(len(trees) + 1)),
        *limit_of_value,
        *[f"{end}_{of}" for of in rest for end in ("lo", "hi")])

    # One set of cells per combination of given fields and limited columns, at most one per subset.
    combinations = attempts.agg(F.collect_set(F.struct("given", "mask"))).scalar()
    cells = fine.withColumn("fc_all", combinations).withColumn(
        "fc_one", F.explode("fc_all")).selectExpr("*", "fc_one.given", "fc_one.mask")
    # What a wish gives must be there.
    there = [f"(given & {bit} = 0 OR fc_{k} IS NOT NULL)" for k, bit in bits.items()]
    there += [f"(mask & {bit} = 0 OR fr_{of} IS NOT NULL)" for of, bit in spans.items()]
    cells = cells.where(" AND ".join(there) or "true")
    compared = [
        f"if(mask & {spans[of]} > 0 AND bit_count(mask & {spans[of] - 1}) < {TREES}, NULL, fr_{of})"
        f" AS fr_{of}" if of in spans else f"fr_{of}" for of in rest]
    cells = cells.selectExpr(
        "given", "mask", *within, *[f"fr_{of} AS at_{of}" for of in whole], *compared, VALUE, COUNT)
    if whole:
        cells = cells.withColumn("extent", extent)
    for to in range(len(trees) + 1):
        if to:
            n = to - 1
            # One row a level; functions of arrays' elements would be called row by row.
            at_level = nth(n, lambda of: tree_node(f"(at_{of} - extent.{of}.base)", "at_level"))
            cells = cells.withColumn("at_level", F.explode(F.expr(
                f"if(bit_count(mask) <= {n}, array(-1),"
                f" {nth(n, lambda of: f'sequence(0, extent.{of}.levels)')})"))).withColumn(
                f"node_{n}", F.expr(f"if(at_level < 0, -1L, {at_level})"))
        cells = cells.selectExpr("*", *cell(to))
        if limits:
            # Only what some wish asks for goes on.
            asked_for = looked_up.select(*_pair(f"cell_{to}")).distinct()
            cells = cells.join(asked_for, _pair(f"cell_{to}"), "left_semi")
    key = _pair(f"cell_{len(trees)}")
    cells = cells.groupBy(*key, *[f"fr_{of}" for of in rest], VALUE).agg(F.sum(COUNT).alias(COUNT))

    matched = looked_up.join(cells, key)
    matched = matched.where(f"(low IS NULL OR {VALUE} >= low) AND (high IS NULL OR {VALUE} <= high)")
    for of in rest:
        # Null where a tree has met the limit.
        met_by_tree = f"(fr_{of} IS NULL AND mask & {spans[of]} > 0)" if of in spans else "false"
        matched = matched.where(
            f"{met_by_tree} OR ((lo_{of} IS NULL OR fr_{of} >= lo_{of})"
            f" AND (hi_{of} IS NULL OR fr_{of} <= hi_{of}))")
    matched = matched.select(*_pair("wish"), VALUE, COUNT)
    if limits:
        # A wish meets a price in many nodes; where its prices are ordered, each comes once.
        matched = matched.repartition(*_pair("wish")).groupBy(*_pair("wish"), VALUE).agg(
            F.sum(COUNT).alias(COUNT))
    measured = measures_of_counts(
        matched, _pair("wish"), adverts.schema[column].dataType, measures(ESTIMATE_MEASURES),
        small_keys=True,
    )
    return _answered(wanted, tries, measured, id_column)
