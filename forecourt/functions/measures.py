"""The measures a grouped query can ask for.

A simple measure is built from count, extremes, sum, mean and deviation. Those come
either from aggregating rows, or from a table of value counts, where sums of counts and
of weighted values stand in for the rows. Order statistics (median and quantiles) always
come from value counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegralType, LongType

# Measure names and what they are. ``avg`` is the truncated integer
# average, the three rsd are std/mean, 100 std / whole mean, and the whole part of
# 100 std / mean.
SIMPLE = {
    "count": "{count}",
    "min": "{low}",
    "max": "{high}",
    "sum": "coalesce({total}, 0)",
    "mean": "{mean}",
    "avg": "{total} div nullif({count}, 0)",
    "std": "{std}",
    "rsd": "try_divide({std}, {mean})",
    "rsd_percent": "try_divide({std} * 100, try_cast({mean} AS bigint))",
    "rsd_whole": "cast(try_divide({std} * 100, {mean}) AS int)",
}
FRACTIONAL_AVG = "try_divide({total}, {count})"
QUANTILE_NAME = re.compile(r"quantile_(\d{1,2})")

# Columns a table of value counts is summed up to.
MOMENTS = {
    "count": "fc_n", "low": "fc_min", "high": "fc_max", "total": "fc_total",
    "mean": "fc_mean", "std": "fc_std",
}


@dataclass(frozen=True)
class Measure:
    """A measure and the name its result goes by; ``fraction`` only for quantiles.

    ``own`` asks for a quantile in the type of the column instead of a double.
    """

    name: str
    kind: str
    fraction: float | None = None
    own: bool = False

    @property
    def ranked(self) -> bool:
        return self.kind in ("median", "quantile")


def measure(name: str) -> Measure:
    """Look a measure up by name; ``quantile_NN`` is the NN percent quantile."""
    if name in SIMPLE or name == "median":
        return Measure(name, name)
    match = QUANTILE_NAME.fullmatch(name)
    if match:
        return Measure(name, "quantile", int(match[1]) / 100)
    raise ValueError(
        f"unknown measure {name!r}; known: {', '.join(SIMPLE)}, median, quantile_NN"
    )


def quantile(fraction: float, name: str, own: bool = False) -> Measure:
    if not 0 <= fraction <= 1:
        raise ValueError(f"quantile fraction {fraction} is outside 0..1")
    return Measure(name, "quantile", fraction, own)


def measures(names: Iterable[str | Measure]) -> list[Measure]:
    return [n if isinstance(n, Measure) else measure(n) for n in names]


def quoted(name: str) -> str:
    """A column name as it is written in SQL."""
    return "`" + name.replace("`", "``") + "`"


def is_whole(dtype: DataType) -> bool:
    return isinstance(dtype, IntegralType)


def _sql(kind: str, parts: dict[str, str], dtype: DataType) -> str:
    template = SIMPLE[kind]
    if kind == "avg" and not is_whole(dtype):
        template = FRACTIONAL_AVG
    return template.format(**parts)


def of_rows(m: Measure, column: str, dtype: DataType) -> Column:
    """A simple measure as an aggregate over rows."""
    c = quoted(column)
    parts = {
        "count": f"count({c})",
        "low": f"min({c})",
        "high": f"max({c})",
        "total": f"sum({c})",
        "mean": f"avg({c})",
        "std": f"stddev_samp({c})",
    }
    return F.expr(_sql(m.kind, parts, dtype)).alias(m.name)


def of_moments(m: Measure, dtype: DataType) -> str:
    """A simple measure over the columns named in ``MOMENTS``, as SQL."""
    return _sql(m.kind, MOMENTS, dtype)


def is_small(dtype: DataType) -> bool:
    """Whole numbers whose squares can be summed as decimals, however many there are."""
    return is_whole(dtype) and not isinstance(dtype, LongType)


def is_exact(dtype: DataType) -> bool:
    """Types that a double cannot hold without loss."""
    return isinstance(dtype, (LongType, DecimalType))


def wide(value: str, dtype: DataType) -> str:
    """The value in a type whose sums and differences lose nothing, as SQL."""
    if is_whole(dtype):
        return f"cast({value} AS decimal(20,0))"
    if isinstance(dtype, DecimalType):
        return f"cast({value} AS decimal(38,{dtype.scale}))"
    return f"cast({value} AS double)"


def anchor_of(value: str, count: str, dtype: DataType) -> str:
    """A value near the mean, from which deviations are measured, as SQL."""
    return centre_of(
        f"try_divide(sum(cast({value} AS double) * {count}), sum(if({value} IS NULL, 0, {count})))",
        dtype)


def centre_of(mean: str, dtype: DataType) -> str:
    """A double in the type deviations are measured in, as SQL."""
    if is_whole(dtype):
        return f"cast(greatest(least(round({mean}), 9.2E18D), -9.2E18D) AS decimal(20,0))"
    return wide(mean, dtype)


def moment_sums(value: str, count: str, dtype: DataType) -> tuple[str, str]:
    """Sum and sum of squares of a value that occurs ``count`` times.

    Small whole numbers are summed as decimals, so nothing is lost before the deviation
    is taken. Squares of other numbers are those of their distance from ``fc_anchor``.
    """
    if is_small(dtype):
        v, n = f"cast({value} AS decimal(19,0))", f"cast({count} AS decimal(19,0))"
        return f"sum({v} * {n})", f"sum({v} * {n} * {v})"
    away = _away(value, dtype)
    return f"sum({wide(value, dtype)} * {count})", f"sum({away} * {away} * {count})"


def _away(value: str, dtype: DataType) -> str:
    return f"cast({wide(value, dtype)} - fc_anchor AS double)"


def sums_needed(wanted: Iterable[Measure], value: str, count: str, dtype: DataType) -> dict[str, str]:
    """What a value-count table is summed up to for these measures, as SQL."""
    total, squares = moment_sums(value, count, dtype)
    kinds = {m.kind for m in wanted}
    spread = any("{std}" in SIMPLE.get(k, "") for k in kinds)
    totals = spread or any(
        part in SIMPLE.get(k, "") for k in kinds for part in ("{total}", "{mean}")
    )
    sums = {"fc_n": f"coalesce(sum({count}), 0)"}
    if "min" in kinds:
        sums["fc_min"] = f"min({value})"
    if "max" in kinds:
        sums["fc_max"] = f"max({value})"
    if totals:
        sums["fc_sum"] = total
    if spread:
        sums["fc_squares"] = squares
        if not is_small(dtype):
            sums["fc_shift"] = f"sum({_away(value, dtype)} * {count})"
    return sums


def moments(sums: Iterable[str], dtype: DataType) -> dict[str, str]:
    """Further columns from ``fc_n``, ``fc_sum``, ``fc_squares`` and ``fc_shift``, as SQL.

    For small whole numbers the squares are taken around the truncated mean, exactly; what
    the mean has beyond that is below 1. For others they are those around the anchor, which
    is near the mean.
    """
    if "fc_sum" not in sums:
        return {}
    if is_small(dtype):
        n = "cast(fc_n AS decimal(19,0))"
        centre = f"cast(fc_sum div nullif({n}, 0) AS decimal(19,0))"
        rest = f"(fc_sum - {centre} * {n})"
        found = {
            "fc_total": "cast(fc_sum AS bigint)",
            "fc_mean": "cast(fc_sum AS double) / nullif(fc_n, 0)",
        }
        spread = (
            f"cast(fc_squares - fc_sum * {centre} - {rest} * {centre} AS double)"
            f" - power(cast({rest} AS double), 2) / nullif(fc_n, 0)"
        )
    else:
        found = {"fc_total": "fc_sum", "fc_mean": "cast(fc_sum AS double) / nullif(fc_n, 0)"}
        spread = "fc_squares - fc_shift * fc_shift / nullif(fc_n, 0)"
    if "fc_squares" in sums:
        found["fc_std"] = (
            f"CASE WHEN fc_n > 1 THEN sqrt(greatest({spread}, 0D) / (fc_n - 1)) END"
        )
    return found
