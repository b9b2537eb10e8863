"""Mergeable summaries: states kept per part of the data and combined without rereading it.

Extracts arrive in parts. A state table has one row per group and part; groups, or any
coarser groups, are answered from it. Quantiles and distinct counts are approximate, with a
stated bound; counts, means and deviations are those of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.functions.measures import is_whole
from forecourt.operators.filters import require_columns

#: Size of a quantile sketch; its ranks are within 3.3 / KLL_SIZE ** 0.9 of n with 99 percent.
KLL_SIZE = 800
#: A distinct-count sketch keeps 2 ** THETA_BITS hashes and is exact below as many values.
THETA_BITS = 14


def quantile_states(df: DataFrame, keys: Sequence[str], column: str, size: int = KLL_SIZE) -> DataFrame:
    """Per group a KLL sketch of a column (``sketch``) and its number of values (``n``)."""
    require_columns(df, [*keys, column])
    value = F.col(column)
    kind = "bigint" if is_whole(df.schema[column].dataType) else "double"
    sketch = F.call_function(f"kll_sketch_agg_{kind}", value.cast(kind), F.lit(size))
    return df.groupBy(*keys).agg(sketch.alias("sketch"), F.count(value).alias("n"))


def merged_quantiles(
    states: DataFrame, keys: Sequence[str], fractions: Sequence[float], kind: str = "bigint"
) -> DataFrame:
    """Per group one row for each fraction: ``fraction``, ``value``, ``rows``, from states of its parts.

    ``kind`` is that of the column, bigint (whole numbers) or double. Groups without a value have
    no row.
    """
    require_columns(states, [*keys, "sketch", "n"])
    merged = states.where("n > 0").groupBy(*keys).agg(
        F.call_function(f"kll_merge_agg_{kind}", F.col("sketch")).alias("sketch"),
        F.sum("n").alias("rows"))
    values = F.array(*[F.struct(
        F.lit(float(q)).alias("fraction"),
        F.call_function(f"kll_sketch_get_quantile_{kind}", F.col("sketch"), F.lit(float(q)))
        .alias("value")) for q in fractions])
    return merged.select(*keys, "rows", F.inline(values))


def distinct_states(df: DataFrame, keys: Sequence[str], column: str, bits: int = THETA_BITS) -> DataFrame:
    """Per group a theta sketch of the distinct values of a column (``sketch``)."""
    require_columns(df, [*keys, column])
    return df.groupBy(*keys).agg(
        F.call_function("theta_sketch_agg", F.col(column), F.lit(bits)).alias("sketch"))


def distinct_error(bits: int = THETA_BITS, deviations: float = 4.0) -> float:
    """The relative error a distinct count keeps within, that many standard deviations out."""
    return deviations / 2 ** (bits / 2)


def _estimate(sketch: Column) -> Column:
    return F.call_function("theta_sketch_estimate", sketch).cast("bigint")


def facet_overlap(
    df: DataFrame, facet: str, column: str, among: Column, bits: int = THETA_BITS
) -> DataFrame:
    """Per value of a facet, how many distinct values of a column it shares with a selection of rows.

    ``among`` selects the rows; the columns are the facet, ``distinct_count``, ``shared`` (also among
    the selection), ``only_here`` and ``either`` (values of the facet or the selection). One scan
    makes sketches of fixed size; intersections, differences and unions are taken of these.
    """
    require_columns(df, [facet, column])
    parts = df.select(F.col(facet), F.col(column), F.coalesce(among, F.lit(False)).alias("fc_among"))
    states = distinct_states(parts, [facet, "fc_among"], column, bits)
    union = lambda c: F.call_function("theta_union_agg", c, F.lit(bits))
    chosen = states.where("fc_among").agg(union(F.col("sketch")).alias("fc_chosen"))
    empty = F.call_function("theta_difference", F.col("sketch"), F.col("sketch"))
    own = states.groupBy(facet).agg(union(F.col("sketch")).alias("sketch"))
    beside = own.withColumn("fc_other", F.coalesce(chosen.scalar(), empty))
    return beside.select(
        facet, _estimate(F.col("sketch")).alias("distinct_count"),
        _estimate(F.call_function("theta_intersection", "sketch", "fc_other")).alias("shared"),
        _estimate(F.call_function("theta_difference", "sketch", "fc_other")).alias("only_here"),
        _estimate(F.call_function("theta_union", "sketch", "fc_other", F.lit(bits))).alias("either"))


def moment_states(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Per group ``n``, ``mean`` and ``squares``, the sum of squared distances from that mean."""
    require_columns(df, [*keys, column])
    value = F.col(column).cast("double")
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("squares"))


def merged_moments(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group ``count, mean, std`` and ``rsd`` from the states of its parts.

    The squares of parts are put together around the mean of the whole group, so that large
    values with small deviations lose nothing. Without keys one row.
    """
    require_columns(states, [*keys, "n", "mean", "squares"])
    group = Window.partitionBy(*[F.col(k) for k in keys])
    whole = F.sum(F.col("n") * F.col("mean")).over(group) / F.sum("n").over(group)
    beside = states.where("n > 0").withColumn("fc_mean", whole)
    apart = F.col("mean") - F.col("fc_mean")
    total = F.sum("n")
    found = beside.groupBy(*keys).agg(
        total.alias("count"), F.max("fc_mean").alias("mean"),
        F.sum(F.col("squares") + F.col("n") * apart * apart).alias("fc_squares"))
    std = F.when(F.col("count") > 1, F.sqrt(F.col("fc_squares") / (F.col("count") - 1)))
    return found.select(*keys, "count", "mean", std.alias("std"),
                        F.try_divide(std, F.col("mean")).alias("rsd"))
