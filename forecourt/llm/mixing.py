"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forecourt.llm.common import written

_DEC = "decimal(38,0)"


def word_count(text: str) -> F.Column:
    """The number of words of a text: runs of anything but blanks and \\x09-\\x0D; 0 for null."""
    return F.coalesce(
        F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2),
            most: int = 2) -> DataFrame:
    """``sizes`` (``source``, ``source_size``), one row per source, with ``weight`` and ``target``.

    Sources in the order of their code points, null last, take the weights in turn. They share
    ``share`` (a fraction) of all sizes by weight; no target passes ``most`` times its source's
    size, and what is cut off there is shared by weight among the others until none is above:
    in the order of size by weight, a source is full if its limit is not above what the sources
    not yet full would get by their weights. All sums are exact. The windows see one row per
    source, which is what weights are given to.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    listed = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.get(
        listed, (F.row_number().over(by_name) - 1) % len(weights)).cast("long"))
    exact = ranked.withColumn("cap", (F.col("source_size") * most).cast(_DEC))
    whole = Window.partitionBy()
    exact = exact.withColumn("budget", F.sum("source_size").over(whole).cast(_DEC) * share[0])
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(
        F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    filled = exact.withColumn("before", before.cast(_DEC)).withColumn("after", after.cast("long"))
    # budget is share[1] times what is to be given out.
    full = F.col("cap") * F.col("after") * share[1] <= (
        F.col("budget") - F.col("before") * share[1]) * F.col("weight")
    filled = filled.withColumn("full", full)
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    rest = (F.col("budget") - spent * share[1]) * F.col("weight")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        F.try_divide(rest.cast("double"), (open_weight * share[1]).cast("double")))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2,
    seed: int = 0, rows_per_range: int = 5_000,
) -> DataFrame:
    """The queue of a mix: every document ``most`` times, with what the mix takes of it.

    Columns: the key, ``source``, ``size`` (words), ``source_size``, ``target``, ``pass`` (from 0),
    ``finish`` (virtual finish time), ``start`` (words of the mix before it) and ``taken`` (0 where
    the mix ends before the document).

    The documents of a source are shuffled (by a hash of seed, key and text) and stand behind each
    other ``most`` times. A document's virtual finish time is the words of its source up to its
    end over its source's target; all documents are sorted by it and the mix ends where it has
    ``share`` of all words, so that every source has its target but for parts of one document.
    The last document is cut.

    Null texts and those without words have size 0, and nothing is taken of them. Null keys are
    keys. Rows that are equal in key, source and text each have a place in the queue. An empty
    table makes an empty mix. Other columns are not read.

    Both running sums are made of sums of short ranges: of hashes within a source, then of finish
    times, which are even, as documents are shuffled. So a source that holds most rows is worked
    on by many tasks. Equal rows are counted before they are moved, once per input partition.
    """
    named = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("-")),
                       F.lit(":"), F.coalesce(F.col(text), F.lit("")))).alias("h"),
        F.spark_partition_id().alias("part"))
    slim = written(
        named.groupBy("key", "source", "size", "h", "part").agg(F.count("*").alias("copies")),
        "queue")
    goals = written(
        targets(slim.groupBy("source").agg(
            F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, share, most),
        "targets")
    total = goals.agg(F.count("*"), F.sum("source_size")).first()
    rows = slim.agg(F.sum("copies")).first()[0] or 0
    ranges = max(1, -(-rows // rows_per_range))

    # Words of the source before each row: of earlier ranges of hashes, then within the range.
    place = F.floor(F.conv(F.substring("h", 1, 7), 16, 10).cast("long") * ranges / (1 << 28))
    words = F.col("size") * F.col("copies")
    slim = slim.withColumn("range", place)
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = slim.groupBy("source", "range").agg(F.sum(words).alias("here")).select(
        F.col("source").alias("its_source"), F.col("range").alias("its_range"),
        F.coalesce(F.sum("here").over(upto), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "range").orderBy("h", "key", "part").rowsBetween(
        Window.unboundedPreceding, -1)
    queued = slim.withColumn("before", F.coalesce(F.sum(words).over(within), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("its_source"))
        & (F.col("range") == F.col("its_range")))
    queued = queued.withColumn("before", F.col("before") + F.col("offset"))
    queued = queued.join(goals.withColumnRenamed("source", "goal_source"),
                         F.col("source").eqNullSafe(F.col("goal_source")))
    entries = queued.select(
        "key", "source", "size", "h", "part", "source_size", "target", "before",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    entries = entries.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass"))
    ended = F.col("pass") * F.col("source_size") + F.col("before") \
        + (F.col("copy") + 1) * F.col("size")
    entries = entries.withColumn("finish", F.coalesce(F.try_divide(
        ended.cast("double"), F.col("target")), F.lit(0.0)))

    # The same over all: words before a range of finish times, then within it.
    entries = entries.withColumn("range", F.floor(
        F.least(F.col("finish"), F.lit(float(4 * most))) * ranges))
    sums = entries.groupBy("range").agg(F.sum("size").alias("here"))
    spans = sums.select(
        F.col("range").alias("its_range"),
        F.coalesce(F.sum("here").over(Window.orderBy("range").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    order = Window.partitionBy("range").orderBy(
        "finish", F.col("source").isNull(), "source", "h", "key", "part", "copy", "pass")
    placed = entries.withColumn("inside", F.coalesce(F.sum("size").over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(
        spans, F.col("range") == F.col("its_range"))
    start = F.col("offset") + F.col("inside")
    budget = (total[1] or 0) * share[0] // share[1]
    taken = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - start))
    return placed.select(
        F.col("key").alias(key), "source", "size", "source_size", "target", "pass", "finish",
        start.alias("start"), taken.cast("long").alias("taken"), "h", "part", "copy")


def mixed_documents(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Per document what a mix takes: key, ``size``, ``source_size``, ``target``, ``taken``.

    One row per row of ``docs``; see ``mix`` for the options and for odd rows.
    """
    queue = mix(docs, key, **options)
    return queue.groupBy("h", key, "source", "part", "copy").agg(
        *[F.first(c).alias(c) for c in ("size", "source_size", "target")],
        F.sum("taken").alias("taken")).select(key, "size", "source_size", "target", "taken")
