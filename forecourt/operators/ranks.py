"""Exact order statistics over tables of value counts.

The quantile of fraction q over n sorted non-null values is the one at 0-based rank
``floor((n - 1) * q + 0.5)``. Rows are first reduced to one row per (keys, value) with
its count, which combines before the shuffle, so a key holding most rows arrives as its
distinct values. Ranks are then found in steps:

1. values fall into order-preserving *slices*, 128 to an octave; a running count over
   the slices of a key tells which slice holds which rank;
2. only the slices that hold a wanted rank are looked into. 32-bit integers are ordered
   there. Of wider types a slice may hold any number of values: it is cut again between
   its own extremes, into one *part* per thousand distinct values, and only the parts
   that hold a wanted rank are ordered.

A slice of 32-bit integers has at most 8,192 values, and a key at most 528,000 such slices (of
64-bit integers 16,384).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from forecourt.functions.measures import (
    Measure,
    anchor_of,
    is_small,
    is_whole,
    moments,
    of_moments,
    quoted,
    sums_needed,
)

VALUE = "fc_value"
COUNT = "fc_count"
ROWS = "fc_rows"

STEP_BITS = 7
WIDTH_BITS = 13
FRACTION_BITS = 20
PART_VALUES = 1024


def value_counts(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One row per (keys, value): ``fc_count`` non-null values and ``fc_rows`` rows."""
    return df.groupBy(*keys, F.col(column).alias(VALUE)).agg(
        F.count(column).alias(COUNT), F.count(F.lit(1)).alias(ROWS)
    )


def slice_of(value: str, dtype: DataType) -> str:
    """An order-preserving coarse number of the value, as SQL.

    It keeps the place of the leading bit and the seven bits after it (of 32-bit integers all
    but the last 13 bits at least), all in exact
    arithmetic: the same value gets the same slice on every machine. Of fractions the
    binary places beyond the twentieth do not count; numbers beyond 2^42 are scaled down.
    """
    if is_whole(dtype):
        size = f"if({value} < 0, ~cast({value} AS bigint), cast({value} AS bigint))"
    else:
        number = f"cast({value} AS double)"
        # Beyond 2^42 places below 2^-20 are no longer told apart: the same bits, fewer
        # of them, with as many octaves added as the scale takes away.
        steps = [(42, FRACTION_BITS), (104, FRACTION_BITS - 62), (166, FRACTION_BITS - 124)]
        arms = " ".join(
            f"WHEN abs({number}) < {2.0**top!r}D THEN"
            f" {62 * i * 2**STEP_BITS} + {_octaves(f'cast(abs({number}) * {2.0**scale!r}D AS bigint)')}"
            for i, (top, scale) in enumerate(steps))
        most = 62 * len(steps) * 2**STEP_BITS
        number = f"(CASE WHEN isnan({number}) THEN {most + 2} {arms} ELSE {most + 1} END)"
        return f"if({value} < 0, -1 - {number}, {number})"
    number = _octaves(size, WIDTH_BITS if is_small(dtype) else 64)
    return f"if({value} < 0, -1 - {number}, {number})"


def _octaves(size: str, most: int = 64) -> str:
    """The place of the leading bit of a whole number, and the bits after it, as one number.

    At most ``most`` bits at its end do not count.
    """
    shift = f"greatest(length(bin({size})) - {STEP_BITS + 1}, 0)"
    if most < 64:
        shift = f"least({shift}, {most})"
    return f"({shift} * {2**STEP_BITS} + shiftright({size}, {shift}))"


def _ranks_of(m: Measure) -> list[str]:
    """The 0-based ranks a measure needs among ``fc_n`` sorted values."""
    if m.kind == "median":
        # Mean of the two middle ranks, which coincide for an odd count.
        return ["shiftright(fc_n - 1, 1)", "shiftright(fc_n, 1)"]
    return [f"cast(floor((fc_n - 1) * {float(m.fraction)!r}D + 0.5D) AS bigint)"]


def measures_of_counts(
    counts: DataFrame,
    keys: Sequence[str],
    dtype: DataType,
    wanted: Sequence[Measure],
    keep_empty: bool = True,
    few_keys: bool = False,
    small_keys: bool = False,
) -> DataFrame:
    """Measures per key of a value-count table; without keys always one row.

    Sums of 64-bit integers come as decimals, which the caller narrows. A key whose values are
    all null keeps its row, with count 0, if ``keep_empty``.
    The table is read twice, in the same shape, so that Spark reuses its exchange.
    ``few_keys`` says that the keys are a short list fixed by the caller: the slices to
    look into, at most one per key and rank, are then broadcast. ``small_keys`` says that the
    keys are many and that no key has more values than a task can sort; of 32-bit integers, a key's
    values are then ordered as a whole, with one shuffle for all measures.
    """
    sums = sums_needed(wanted, VALUE, COUNT, dtype)
    ranks: dict[str, list[str]] = {}
    # One struct as the key: null is a value like any other in it, and joins, windows and
    # groupings all find rows where the one before has put them.
    keyed = "fc_key, " if keys else ""
    source = "{sliced}"
    steps = ""
    if not is_small(dtype) and "fc_squares" in sums:
        anchor = anchor_of(VALUE, COUNT, dtype)
        if keys:
            steps = f"""
        centres AS (SELECT fc_key, {anchor} AS fc_anchor FROM {{sliced}} GROUP BY fc_key),
        anchored AS (SELECT l.*, r.fc_anchor FROM {{sliced}} l JOIN centres r USING (fc_key)),"""
        else:
            steps = f"""
        anchored AS (SELECT *, (SELECT {anchor} FROM {{sliced}}) AS fc_anchor FROM {{sliced}}),"""
        source = "anchored"
    if any(m.ranked for m in wanted) and small_keys and keys and is_small(dtype):
        more, ranks = _ordering_steps(len(keys), source, wanted, sums)
    elif any(m.ranked for m in wanted):
        more, ranks = _locating_steps(
            keyed, source, wanted, sums, keep_empty, few_keys or not keys, dtype
        )
    else:
        more = f"""
        found AS (
          SELECT {keyed}{_aliased(sums)} FROM {source} {_grouped_by(keyed)}
        )"""
    def result(m: Measure) -> str:
        if not m.ranked:
            return of_moments(m, dtype)
        if m.own:
            return ranks[m.name][0]
        picks = " + ".join(f"cast({r} AS double)" for r in ranks[m.name])
        return f"({picks}) / {len(ranks[m.name])}"

    results = ", ".join(f"{result(m)} AS {quoted(m.name)}" for m in wanted)
    restored = "".join(f"fc_key.c{i} AS {quoted(k)}, " for i, k in enumerate(keys))
    key = ", ".join(f"{quoted(k)} AS c{i}" for i, k in enumerate(keys))
    # The statement's view of a table is dropped after use, and with it what is cached
    # under the very same plan; with one more column it is another plan.
    sliced = counts.selectExpr(
        *([f"struct({key}) AS fc_key"] if keys else []), VALUE, COUNT,
        f"{slice_of(VALUE, dtype)} AS fc_slice",
    )
    return counts.sparkSession.sql(
        f"""
        WITH {steps}{more},
        moments AS (SELECT *{_more(moments(sums, dtype))} FROM found)
        SELECT {restored}{results} FROM moments
        """,
        sliced=sliced,
    )


def _aliased(expressions: Mapping[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in expressions.items())


def _more(expressions: Mapping[str, str]) -> str:
    return f", {_aliased(expressions)}" if expressions else ""


def _grouped_by(keyed: str) -> str:
    return f"GROUP BY {keyed[:-2]}" if keyed else ""


def _rank_columns(wanted: Sequence[Measure]) -> tuple[dict[str, list[str]], dict[str, str]]:
    """The columns that hold the values a measure needs, and the ranks of those values, as SQL."""
    names: dict[str, list[str]] = {}
    ranks: dict[str, str] = {}
    for i, m in enumerate(m for m in wanted if m.ranked):
        expressions = _ranks_of(m)
        names[m.name] = [f"fc_rank_{i}_{j}" for j in range(len(expressions))]
        ranks.update(zip(names[m.name], expressions))
    return names, ranks


def _ordering_steps(
    keys: int, source: str, wanted: Sequence[Measure], sums: Mapping[str, str]
) -> tuple[str, dict[str, list[str]]]:
    """The steps to the sums and the values at the wanted ranks per key, all values in order.

    The key's columns are taken apart: a struct has no prefix that a sort could go by.
    """
    names, ranks = _rank_columns(wanted)
    picked = {
        name: f"max({VALUE}) FILTER (WHERE {r} < fc_upto AND {r} >= fc_upto - {COUNT})"
        for name, r in ranks.items()
    }
    flat = ", ".join(f"fc_key_{i}" for i in range(keys))
    apart = ", ".join(f"fc_key.c{i} AS fc_key_{i}" for i in range(keys))
    together = ", ".join(f"fc_key_{i} AS c{i}" for i in range(keys))
    return f"""
        keyed AS (SELECT {apart}, {VALUE}, {COUNT} FROM {source}),
        ordered AS (
          SELECT {flat}, {VALUE}, {COUNT}, sum({COUNT}) OVER (PARTITION BY {flat}) AS fc_n,
                 sum({COUNT}) OVER (
                   PARTITION BY {flat} ORDER BY {VALUE} ROWS UNBOUNDED PRECEDING) AS fc_upto
          FROM keyed
        ),
        found AS (
          SELECT struct({together}) AS fc_key, {_aliased(sums)}, {_aliased(picked)}
          FROM ordered GROUP BY {flat}
        )""", names


def _locating_steps(
    keyed: str,
    source: str,
    wanted: Sequence[Measure],
    sums: Mapping[str, str],
    keep_empty: bool,
    small: bool,
    dtype: DataType,
) -> tuple[str, dict[str, list[str]]]:
    """The steps to the sums and the values at the wanted ranks per key, and the
    columns the latter are in."""
    ranks, rank_columns = _rank_columns(wanted)

    here = {f"{c}_here": e for c, e in sums.items()}
    over_key = {
        c: f"{ {'fc_min': 'min', 'fc_max': 'max'}.get(c, 'sum') }({c}_here) OVER whole"
        for c in sums
    }
    partition = f"PARTITION BY {keyed[:-2]}" if keyed else ""

    def holding(n: str) -> str:
        return " OR ".join(
            f"({r} >= fc_before AND {r} < fc_before + {n})" for r in rank_columns
        )

    held = holding("fc_n_here")
    if keyed and keep_empty:
        held += " OR fc_n = 0"
    # Only a key without values needs the slice of its nulls.
    slice_key = "coalesce(fc_slice, 0) AS fc_slice, fc_slice IS NULL AS fc_none"
    picked = {
        r: f"max({VALUE}) FILTER (WHERE {r} < fc_upto AND {r} >= fc_upto - {COUNT})"
        for r in rank_columns
    }
    repeated = {c: f"max({c})" for c in sums if c != "fc_n"}
    carried = ", ".join((*sums, *rank_columns))
    at = f"{keyed}fc_slice, fc_none"
    hint = "/*+ BROADCAST(r) */" if small else ""
    steps = f"""
        slices AS (
          SELECT {keyed}{slice_key}, {_aliased(here)}, min({VALUE}) AS fc_low,
                 max({VALUE}) AS fc_high, count({VALUE}) AS fc_values
          FROM {source} GROUP BY {keyed}fc_slice
        ),
        placed AS (
          SELECT {at}, fc_n_here, fc_low, fc_high, fc_values, {_aliased(over_key)},
                 coalesce(sum(fc_n_here) OVER earlier, 0) AS fc_before
          FROM slices
          WINDOW
            whole AS ({partition} ORDER BY fc_none, fc_slice
                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
            earlier AS ({partition} ORDER BY fc_none, fc_slice
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ),
        ranked AS (SELECT *, {_aliased(rank_columns)} FROM placed),
        looked_into AS (SELECT * FROM ranked WHERE {held}),
        plain AS (SELECT {keyed}{slice_key}, {VALUE}, {COUNT} FROM {{sliced}}),
        entered AS (
          SELECT {hint} l.*, {carried}, fc_before, fc_low, fc_high, fc_values
          FROM plain l JOIN looked_into r USING ({at})
        ),"""
    inside, within = "entered", at
    if not is_small(dtype):
        share = (f"(cast({VALUE} AS double) - cast(fc_low AS double))"
                 " / (cast(fc_high AS double) - cast(fc_low AS double))")
        parts = f"ceil(fc_values / {PART_VALUES})"
        within = f"{at}, fc_part"
        steps += f"""
        cut AS (
          SELECT *, CASE WHEN {parts} > 1
            THEN least(cast(floor(nanvl(try_divide({share}, 1), 0) * {parts}) AS bigint), {parts} - 1)
            ELSE 0 END AS fc_part
          FROM entered
        ),
        parts AS (
          SELECT {within}, sum({COUNT}) AS fc_n_part, max(fc_before) AS fc_before_slice
          FROM cut GROUP BY {within}
        ),
        parts_placed AS (
          SELECT {within}, fc_n_part, fc_before_slice + coalesce(sum(fc_n_part) OVER (
            PARTITION BY {at} ORDER BY fc_part
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fc_before
          FROM parts
        ),
        entered_parts AS (
          SELECT l.*, r.fc_before FROM (SELECT {within}, {VALUE}, {COUNT}, {carried} FROM cut) l
          JOIN parts_placed r USING ({within})
          WHERE {holding("fc_n_part")} OR fc_n_part = 0
        ),"""
        inside = "entered_parts"
    steps += f"""
        located AS (
          SELECT *, fc_before + sum({COUNT}) OVER (
            PARTITION BY {within} ORDER BY {VALUE} ROWS UNBOUNDED PRECEDING) AS fc_upto
          FROM {inside}
        ),
        found AS (
          SELECT {keyed}coalesce(max(fc_n), 0) AS fc_n{_more(repeated)},
                 {_aliased(picked)}
          FROM located {_grouped_by(keyed)}
        )"""
    return steps, ranks
