"""Grouped and global measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DecimalType,
    DoubleType,
    FractionalType,
    IntegralType,
    LongType,
)

from forecourt.functions.measures import Measure, is_exact, measures, of_rows, quantile
from forecourt.operators.filters import require_columns
from forecourt.operators.ranks import measures_of_counts, value_counts

DEFAULT_ACCURACY = 10_000
SPREAD = ("std", "rsd", "rsd_percent", "rsd_whole")


def group_measures(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    wanted: Sequence[str | Measure],
    approx: bool = False,
    accuracy: int = DEFAULT_ACCURACY,
) -> DataFrame:
    """Measures of one column per group; without keys one row over the whole table.

    Simple measures are one partial and one final aggregation. With an order statistic
    among them, everything is taken from exact value counts in the same single scan; so
    are deviations of 64-bit and decimal numbers, which doubles cannot hold.
    ``approx`` answers order statistics from a sketch instead (one aggregation).
    """
    require_columns(df, [*keys, column])
    found = measures(wanted)
    dtype = df.schema[column].dataType
    spread = is_exact(dtype) and any(m.kind in SPREAD for m in found)
    if approx or not (spread or any(m.ranked for m in found)):
        return df.groupBy(*keys).agg(
            *[_over_rows(m, column, dtype, accuracy) for m in found]
        )
    measured = measures_of_counts(value_counts(df, keys, column), keys, dtype, found)
    # A total beyond 64 bits is an error where it is asked for, as in Spark's own sum.
    totals = [m.name for m in found if m.kind == "sum" and isinstance(dtype, LongType)]
    return measured.withColumns({t: F.col(t).cast("bigint") for t in totals})


def _over_rows(m: Measure, column: str, dtype: DataType, accuracy: int) -> Column:
    if not m.ranked:
        return of_rows(m, column, dtype)
    fraction = 0.5 if m.kind == "median" else m.fraction
    return F.percentile_approx(column, fraction, accuracy).cast("double").alias(m.name)


def map_measure(column: str, function: str | tuple[str, float]) -> Measure:
    """One entry of an aggregate map, named ``<column>_<function>``.

    A quantile is ``("quantile", p)`` and is named ``<column>_Q_<p>``, the decimal
    point written as an underscore.
    """
    if isinstance(function, tuple):
        kind, fraction = function
        if kind != "quantile":
            raise ValueError(f"unknown function {kind!r}")
        return quantile(fraction, f"{column}_Q_{str(fraction).replace('.', '_')}")
    if function not in ("min", "max", "sum", "median", "mean", "count"):
        raise ValueError(f"unknown function {function!r}")
    return Measure(f"{column}_{function}", function)


def aggregate_map(
    df: DataFrame,
    keys: Sequence[str],
    functions: Mapping[str, Sequence[str | tuple[str, float]]],
) -> DataFrame:
    """Several functions over several columns per group, in one scan."""
    require_columns(df, [*keys, *functions])
    wanted = [
        (column, map_measure(column, f)) for column, fs in functions.items() for f in fs
    ]
    types = {c: df.schema[c].dataType for c in functions}
    if not any(m.ranked for _, m in wanted):
        return df.groupBy(*keys).agg(
            *[of_rows(m, c, types[c]) for c, m in wanted]
        )

    # With order statistics the columns are stacked, so that one value count serves
    # all of them; the column's name is one more key. Whole numbers and decimals are never
    # stacked with doubles, which cannot hold them all.
    inexact = [c for c in functions if types[c].typeName() in ("float", "double")]
    stacks = [[c for c in functions if c not in inexact], inexact]
    # Keys are renamed so that a key may itself be measured.
    held = [f"fc_key_{i}" for i in range(len(keys))]
    tables = [
        _stacked(df, keys, held, columns, types, [(c, m) for c, m in wanted if c in columns])
        for columns in stacks if columns
    ]
    wide = tables[0]
    for other in tables[1:]:
        renamed = other.withColumnsRenamed({h: f"{h}_too" for h in held})
        same = [F.col(h).eqNullSafe(F.col(f"{h}_too")) for h in held]
        wide = wide.join(renamed, same) if held else wide.crossJoin(renamed)
    return wide.select(
        *[F.col(h).alias(k) for k, h in zip(keys, held)], *[m.name for _, m in wanted]
    )


def _common(types: Sequence[DataType]) -> DataType:
    """A type that holds all of them: whole numbers and decimals, or floats and doubles."""
    if all(t == types[0] for t in types):
        return types[0]
    if all(isinstance(t, IntegralType) for t in types):
        return LongType()
    if any(isinstance(t, FractionalType) and not isinstance(t, DecimalType) for t in types):
        return DoubleType()
    scale = max(t.scale for t in types if isinstance(t, DecimalType))
    whole = max(t.precision - t.scale if isinstance(t, DecimalType) else 19 for t in types)
    return DecimalType(min(38, whole + scale), scale)


def _stacked(
    df: DataFrame,
    keys: Sequence[str],
    held: Sequence[str],
    columns: Sequence[str],
    types: Mapping[str, DataType],
    wanted: Sequence[tuple[str, Measure]],
) -> DataFrame:
    """The measures of some columns of one kind, one row per group."""
    common = _common([types[c] for c in columns])
    stacked = df.select(
        *[F.col(k).alias(h) for k, h in zip(keys, held)],
        *[F.col(c).cast(common).alias(c) for c in columns],
    ).unpivot(list(held), list(columns), "fc_column", "fc_number")
    every = list({(m.kind, m.fraction): m for _, m in wanted}.values())
    plain = {
        (m.kind, m.fraction): Measure(f"fc_m{i}", m.kind, m.fraction)
        for i, m in enumerate(every)
    }
    counts = value_counts(stacked, [*held, "fc_column"], "fc_number")
    tall = measures_of_counts(counts, [*held, "fc_column"], common, list(plain.values()))

    def cell(column: str, m: Measure) -> Column:
        found = F.max(
            F.when(F.col("fc_column") == column, F.col(plain[m.kind, m.fraction].name))
        )
        kind = types[column]
        if m.kind in ("min", "max"):
            return found.cast(kind)
        if m.kind == "sum" and isinstance(kind, IntegralType):
            return found.cast("bigint")
        if m.kind == "sum" and isinstance(kind, DecimalType):
            return found.cast(DecimalType(min(38, kind.precision + 10), kind.scale))
        if m.kind == "count":
            return F.coalesce(found, F.lit(0))
        return found

    return tall.groupBy(*held).agg(*[cell(c, m).alias(m.name) for c, m in wanted])


def row_count(df: DataFrame) -> DataFrame:
    """One row with the number of rows."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))
