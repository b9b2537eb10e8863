"""A running-count index over the values of one column, and lookups in it.

The index has one row per distinct value, with the number of rows up to it. Ranks, the values
between two bounds and the number of rows before any value are then lookups: one aggregation
over the index each, joined to it by a single row, whatever they are asked for.

Values are ordered in the order-preserving slices of ``ranks``; large slices of wide types
are cut into parts of about a thousand values. The window over slices sees one row for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from forecourt.functions.measures import (
    Measure,
    centre_of,
    is_small,
    moments,
    of_moments,
    sums_needed,
)
from forecourt.operators.ranks import COUNT, PART_VALUES, VALUE, slice_of

UPTO = "fc_upto"
TOTAL = "fc_total_rows"


def running_counts(counts: DataFrame, dtype: DataType) -> DataFrame:
    """``fc_value, fc_count``, ``fc_upto`` (rows up to the value) and ``fc_total_rows``.

    ``counts`` are value counts; null values are left out. One row per distinct value, in slices
    that are ordered by themselves; what is before a slice is added to all its rows.
    """
    sliced = counts.where(F.col(VALUE).isNotNull()).selectExpr(
        VALUE, COUNT, f"{slice_of(VALUE, dtype)} AS fc_slice")
    # The join below says as much of one of its sides; said of both, they stay one exchange.
    sliced = sliced.where("fc_slice IS NOT NULL")
    hint = ""
    if is_small(dtype):
        within, steps, source = "fc_slice", "", "{sliced}"
        hint = "/*+ BROADCAST(places) */"  # so many slices there can be, and no more
    else:
        share = (f"(cast({VALUE} AS double) - cast(fc_low AS double))"
                 " / (cast(fc_high AS double) - cast(fc_low AS double))")
        parts = f"ceil(fc_values / {PART_VALUES})"
        steps = f"""
        extremes AS (
          SELECT fc_slice, min({VALUE}) AS fc_low, max({VALUE}) AS fc_high, count(*) AS fc_values
          FROM {{sliced}} GROUP BY fc_slice
        ),
        parted AS (
          SELECT /*+ BROADCAST(r) */ l.*, CASE WHEN {parts} > 1
            THEN least(cast(floor(nanvl(try_divide({share}, 1), 0) * {parts}) AS bigint), {parts} - 1)
            ELSE 0 END AS fc_part
          FROM {{sliced}} l JOIN extremes r USING (fc_slice)
        ),"""
        within, source = "fc_slice, fc_part", "parted"
    return counts.sparkSession.sql(
        f"""
        WITH {steps}
        ordered AS (
          SELECT *, sum({COUNT}) OVER (
            PARTITION BY {within} ORDER BY {VALUE} ROWS UNBOUNDED PRECEDING) AS fc_here
          FROM {source}
        ),
        totals AS (SELECT {within}, sum({COUNT}) AS fc_n FROM {source} GROUP BY {within}),
        places AS (
          SELECT {within}, sum(fc_n) OVER () AS {TOTAL}, sum(fc_n) OVER (
            ORDER BY {within} ROWS UNBOUNDED PRECEDING) - fc_n AS fc_earlier
          FROM totals
        )
        SELECT {hint} {VALUE}, {COUNT}, fc_here + fc_earlier AS {UPTO}, {TOTAL}
        FROM ordered JOIN places USING ({within})
        """,
        sliced=sliced,
    )


def rank_of(fraction: str, n: str) -> str:
    """The 0-based nearest rank of a fraction among n values, as SQL."""
    return f"cast(floor(({n} - 1) * {fraction} + 0.5D) AS bigint)"


def holds(rank: str) -> str:
    """Whether the value of a row is the one at a rank, as SQL."""
    return f"({rank} < {UPTO} AND {rank} >= {UPTO} - {COUNT})"


def entry_at(rank: str) -> str:
    """The index entry at a rank (value, rows up to it, its rows), as an aggregate in SQL."""
    return f"max(struct({VALUE}, {UPTO}, {COUNT})) FILTER (WHERE {holds(rank)})"


def with_row(index: DataFrame, row: DataFrame) -> DataFrame:
    """Every entry of an index beside the one row of ``row``, which has the index's total, too."""
    return index.join(F.broadcast(row), TOTAL)


def even_values(within: DataFrame, n: int, before: str, rows: str) -> DataFrame:
    """One row: ``fc_total_rows`` and ``fc_cuts``, the values at the ranks of 0, 1/n, ..., 1.

    The ranks are among the ``rows`` rows after the first ``before`` ones (columns of ``within``).
    A value looks only at the few fractions whose ranks can lie in it.
    """
    scale = f"{n}D / greatest({rows} - 1, 1)"
    low = f"greatest(0, cast(floor(({UPTO} - {COUNT} - {before} - 0.5D) * {scale}) AS int) - 1)"
    high = f"least({n}, cast(ceil(({UPTO} - {before} + 0.5D) * {scale}) AS int) + 1)"
    wanted = f"{before} + {rank_of(f'(i / {n}D)', rows)}"
    # Few values hold a rank: only those make a list. One that does is at most half a rank off.
    some = (f"floor(({UPTO} - {before} + 0.5D) / (greatest({rows} - 1, 1) / {n}D)) >= "
            f"ceil(({UPTO} - {COUNT} - {before} - 1.5D) / (greatest({rows} - 1, 1) / {n}D))")
    hits = within.where(some).selectExpr(
        TOTAL, VALUE,
        f"explode(filter(sequence({low}, greatest({low}, {high})), i -> {holds(wanted)})) AS i")
    return hits.groupBy(TOTAL).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", VALUE))), lambda e: e[VALUE]).alias("fc_cuts"))


def middle(before: str, rows: str) -> tuple[str, str]:
    """The two middle ranks of ``rows`` rows after ``before``, as SQL."""
    return f"{before} + shiftright({rows} - 1, 1)", f"{before} + shiftright({rows}, 1)"


def measured_runs(
    placed: DataFrame, keys: list[str], dtype: DataType, few: bool = True
) -> DataFrame:
    """Measures per key of index entries that lie in successive rows for each key.

    The first pass sums up, and knows the rows before each key; so the second one, beside
    the rows of the first, finds the middle ranks and measures deviations from the mean. ``few``
    says that the keys are a short list fixed by the caller, which is then broadcast.
    """
    spread = sums_needed([Measure("rsd", "rsd_percent")], VALUE, COUNT, dtype)
    sums = {k: v for k, v in spread.items() if k in ("fc_n", "fc_sum")}
    first = placed.groupBy(*keys).agg(
        F.min(VALUE).alias("min"), F.max(VALUE).alias("max"),
        F.min(F.col(UPTO) - F.col(COUNT)).alias("fc_first"),
        *[F.expr(sql).alias(name) for name, sql in sums.items()])
    centre = "cast(fc_sum AS double) / fc_n"
    first = first.selectExpr("*", f"{centre_of(centre, dtype)} AS fc_anchor")
    second = {k: v for k, v in spread.items() if k not in sums}
    low, high = middle("fc_first", "fc_n")
    again = placed.join(F.broadcast(first) if few else first, keys)
    found = again.groupBy(*keys, "min", "max", "fc_n", "fc_sum").agg(
        F.expr(f"max({VALUE}) FILTER (WHERE {holds(low)})").alias("fc_low"),
        F.expr(f"max({VALUE}) FILTER (WHERE {holds(high)})").alias("fc_high"),
        *[F.expr(sql).alias(name) for name, sql in second.items()])
    more = moments([*sums, *second], dtype)
    found = found.selectExpr("*", *[f"{sql} AS {name}" for name, sql in more.items()])
    return found.selectExpr(
        *keys, "min", "max", "(cast(fc_low AS double) + cast(fc_high AS double)) / 2 AS median",
        "fc_n AS count", f"{of_moments(Measure('mean', 'mean'), dtype)} AS mean",
        f"{of_moments(Measure('rsd', 'rsd_percent'), dtype)} AS rsd")


def last_before(entries: DataFrame, starts: DataFrame, dtype: DataType) -> DataFrame:
    """Every entry (``fc_value`` and more) with ``fc_start``, the last row of ``starts`` at or before it.

    ``starts`` has ``fc_value`` and ``fc_start``, a struct; of equal starts the one with the
    largest struct counts. Starts and entries are sorted together in slices of values, the last
    start so far is carried along, and from slice to slice by one window that sees one row a slice.
    """
    columns = [c for c in entries.columns if c != VALUE]
    kind = starts.schema["fc_start"].dataType.simpleString()
    both = entries.selectExpr(
        VALUE, *columns, f"cast(NULL AS {kind}) AS fc_given", "true AS fc_entry").unionByName(
        starts.selectExpr(VALUE, "fc_start AS fc_given", "false AS fc_entry"),
        allowMissingColumns=True)
    sliced = both.selectExpr("*", f"{slice_of(VALUE, dtype)} AS fc_slice")
    return entries.sparkSession.sql(
        f"""
        WITH carried AS (
          SELECT *, last(fc_given) IGNORE NULLS OVER (
            PARTITION BY fc_slice ORDER BY {VALUE}, fc_entry, fc_given
            ROWS UNBOUNDED PRECEDING) AS fc_here
          FROM {{sliced}}
        ),
        slices AS (
          SELECT fc_slice, max_by(fc_given, struct({VALUE}, fc_given))
            FILTER (WHERE fc_given IS NOT NULL) AS fc_last
          FROM carried GROUP BY fc_slice
        ),
        places AS (
          SELECT fc_slice, last(fc_last) IGNORE NULLS OVER (
            ORDER BY fc_slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fc_earlier
          FROM slices
        )
        SELECT {VALUE}, {"".join(f"`{c}`, " for c in columns)} coalesce(fc_here, fc_earlier) AS fc_start
        FROM carried JOIN places USING (fc_slice)
        WHERE fc_entry
        """,
        sliced=sliced,
    )
