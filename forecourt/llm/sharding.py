"""A uniform random shuffle into shards of exact size, by a drawn communication matrix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt.llm.common import free_name, ship, written


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` balls are good, drawn without replacement from ``good + bad``.

    By inversion around the mode, for counts of any size (numpy's own ends at 10^9). The
    range looked at is 40 standard deviations to both sides, more than a double can tell.
    """
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max(int((drawn + 1) * (good + 1) / (total + 2)), low), high)
    spread = math.sqrt(drawn * (good / total) * (bad / total) + 1)
    first, last = max(low, mode - int(40 * spread) - 20), min(high, mode + int(40 * spread) + 20)
    k = np.arange(first, last, dtype=np.float64)
    # log of p(k + 1) / p(k), summed up from the first value looked at
    steps = (np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1))
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.exp(logs - logs.max())
    sums = np.cumsum(weights)
    return first + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def communication_matrix(
    rows: list[int], shards: list[int], seed: int | list[int]
) -> np.ndarray:
    """How many rows of each partition go to each shard, drawn as a uniform shuffle would.

    Row sums are ``rows``, column sums ``shards``; the law is multivariate hypergeometric.
    """
    rng = np.random.default_rng(seed)
    left = [int(x) for x in shards]
    matrix = np.zeros((len(rows), len(shards)), dtype=np.int64)
    for i, size in enumerate(rows):
        open_, rest = int(size), sum(left)
        for j, room in enumerate(left):
            if open_ == 0:
                break
            taken = hypergeometric(rng, room, rest - room, open_)
            matrix[i, j] = taken
            open_ -= taken
            rest -= room
        left = [room - int(x) for room, x in zip(left, matrix[i])]
    return matrix


def _cuts(df: DataFrame, part: F.Column, parts: int, sizes: list[int], seed: int) -> DataFrame:
    """``p, cuts``: per partition, how many of its permuted rows go to the first 1, 2, ... shards.

    The matrix is drawn in two levels, about sqrt(parts) groups of as many partitions: the
    driver draws what each group sends to each shard; given that, groups do not depend on each
    other, and tasks draw the rows of their partitions. The law is that of one draw.
    """
    groups = math.ceil(math.sqrt(parts))
    counts = written(df.select(part.alias("p")).groupBy("p").agg(F.count("*").alias("n")).select(
        "p", "n", F.pmod("p", F.lit(groups)).alias("g")), "counts")
    sums = sorted((row.g, row.n) for row in counts.groupBy("g").agg(F.sum("n").alias("n")).collect())
    drawn = communication_matrix([n for _, n in sums], sizes, seed)
    totals = {g: line.tolist() for (g, _), line in zip(sums, drawn)}

    def draw(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("p")
        group = int(found["g"].iloc[0])
        matrix = communication_matrix(found["n"].tolist(), totals[group], [seed, group])
        return pd.DataFrame({"p": found["p"], "cuts": list(np.cumsum(matrix, axis=1))})

    ship(df.sparkSession)
    return written(counts.groupBy("g").applyInPandas(draw, "p long, cuts array<long>"), "cuts")


def shuffle_into_shards(
    df: DataFrame, shards: int = 16, seed: int = 1, key: list[str] | None = None,
    rows_per_partition: int = 25_000,
) -> DataFrame:
    """All rows with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in its shard).

    Shard sizes are at most one apart, and each assignment of rows to places is as likely as
    any other. Rows are dealt into partitions by a hash of ``key`` (default: all columns but
    maps), the communication matrix is drawn for the partitions' exact counts, each
    partition is permuted by a keyed hash and cut as its matrix row says, and each shard is
    permuted again by another hash. The same rows, key and seed give the same result however
    often a task runs, as nothing depends on the order in which rows arrive. Rows with equal
    keys (nulls included) stay in one partition; which of them gets which place is decided by
    a hash of all columns, and rows equal in everything are exchangeable. An empty table
    gives no rows.

    Partitions have about ``rows_per_partition`` rows; the driver sees counts of groups of
    them, about as many as the square root of their number. A shard is ranked in ranges of about ``rows_per_partition`` rows,
    never in one task.
    """
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    quoted = [F.col(f"`{c}`") for c in (key or plain)]
    row = [F.col(f"`{c}`") for c in plain]
    shard, slot = free_name(df, "shard"), free_name(df, "slot")

    def hashed(salt: int) -> F.Column:
        return F.xxhash64(F.lit(seed * 8 + salt), *quoted)

    total = df.count()
    parts = max(1, math.ceil(total / rows_per_partition))
    ranges = max(1, math.ceil(total / shards / rows_per_partition))
    # Part, order in the part, range in the shard, order in the shard.
    p, o, r, s, tie = (free_name(df, c) for c in ("part", "order", "range", "again", "tie"))
    laid = {p: F.pmod(hashed(0), F.lit(parts)), o: hashed(1),
            r: F.pmod(hashed(2), F.lit(ranges)), s: hashed(3)}
    sizes = [total // shards + (i < total % shards) for i in range(shards)]
    cut = free_name(df, "cuts")
    cuts = _cuts(df, laid[p], parts, sizes, seed).select(
        F.col("p").alias(p), F.col("cuts").alias(cut))
    place = free_name(df, "place")

    def cut_up(rows: DataFrame, ties: list[str]) -> DataFrame:
        local = Window.partitionBy(p).orderBy(o, r, *ties)
        ranked = rows.withColumn(place, F.row_number().over(local) - 1)
        joined = ranked.join(cuts, p)
        before = F.filter(F.col(cut), lambda end: end <= F.col(place))
        return joined.withColumn(shard, F.size(before)).drop(p, o, cut, place)

    per_range = cut_up(df.select(*[c.alias(n) for n, c in laid.items() if n != s]), []).groupBy(
        shard, r).count()
    offset = free_name(df, "offset")
    ahead = Window.partitionBy(shard).orderBy(r).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        shard, r, F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias(offset))
    full = df.withColumns(laid | {tie: F.xxhash64(F.lit(seed * 8 + 4), *row)})
    dealt = cut_up(full, [tie])
    inside = Window.partitionBy(shard, r).orderBy(s, tie)
    return dealt.withColumn(slot, F.row_number().over(inside) - 1).join(
        offsets, [shard, r]).select(
        *[F.col(f"`{c}`") for c in df.columns], shard,
        (F.col(slot) + F.col(offset)).cast("long").alias(slot))
