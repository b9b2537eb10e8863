"""Exact duplicates by an extendible-hash index on shared files, with Spark functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import free_name, written

#: What texts are compared without: blank, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"


def slot(hashed: F.Column, depth: int) -> F.Column:
    """The first ``depth`` bits of a 64-bit hash."""
    return F.shiftrightunsigned(hashed, 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int, doublings: int = 6) -> tuple[DataFrame, int]:
    """The directory of an extendible-hash index over entries with hashes ``h``, and its depth.

    It doubles while a slot holds more than ``capacity`` entries of more than one hash, up to
    ``doublings`` times beyond what even hashes need. Neighbouring slots that fit into one bucket
    share it: per slot, the bucket's first bits (``bucket``) and local depth. Copies of one hash
    cannot be split by doubling; a bucket that stays overfull has several ``pages``, between which
    entries are dealt by their keys. The rows are counts, one per slot, and stay a table.
    """
    n = entries.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / capacity)))
    last = min(60, depth + doublings)
    while True:
        slots = written(
            entries.groupBy(slot(F.col("h"), depth).alias("slot")).agg(
                F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")),
            "slots")
        overfull = slots.where((F.col("n") > capacity) & (F.col("low") < F.col("high")))
        if depth >= last or overfull.isEmpty():
            break
        depth += 1
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    levels = levels.withColumn(
        "bucket",
        F.call_function("shiftrightunsigned", "slot", (F.lit(depth) - F.col("d")).cast("int")))
    sums = levels.groupBy("d", "bucket").agg(F.sum("n").alias("held"))
    fits = sums.where((F.col("held") <= capacity) | (F.col("d") == depth))
    joined = levels.select("slot", "d", "bucket").join(fits, ["d", "bucket"])
    best = joined.groupBy("slot").agg(F.min(F.struct("d", "bucket", "held")).alias("at"))
    return best.select(
        "slot", F.col("at.d").alias("local_depth"), F.col("at.bucket").alias("bucket"),
        F.ceil(F.col("at.held") / capacity).alias("pages")), depth


def build_index(entries: DataFrame, capacity: int) -> DataFrame:
    """The entries with ``bucket`` and ``local_depth``, written by bucket.

    Every entry looks its bucket up in the directory. A file holds the entries of some buckets
    (or pages of one) in the order of their hashes; a bucket is a range of hashes.
    """
    slots, depth = directory(entries, capacity)
    found = entries.withColumn("slot", slot(F.col("h"), depth)).join(slots, "slot").drop("slot")
    page = F.pmod(F.xxhash64("id", "points"), F.col("pages")).alias("page")
    files = max(1, -(-entries.count() // capacity))
    return written(
        found.select("*", page).repartition(files, "local_depth", "bucket", "page")
        .sortWithinPartitions("local_depth", "bucket", "h").drop("pages", "page"), "index")


def exact_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = 65_536
) -> DataFrame:
    """Every row's key with the group of texts that equal its own without white space.

    Columns: the key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (of the text
    without white space), ``bucket`` and ``local_depth`` (the place in the index). The row
    with the most code points stays, then the smallest key; null keys come last. A null
    text counts as empty, and all empty texts are equal. Rows that repeat the key that stays
    are marked kept, too. Other columns are not read.

    Entries (hash, digest, length, key) look up their bucket and go to index files by bucket in
    the shared folder. Buckets are counted hash by hash; an entry alone under its hash is
    answered from the index. Where a bucket has several entries of a hash, their texts are chained in
    that bucket, one link per distinct byte string, so hashes that collide are told apart by
    comparing bytes. Only those texts are moved, and copies are counted before they are, so that a
    text that fills a third of the rows costs one row per task; the join that hands results
    back is one that Spark splits at hot keys.
    """
    bare = F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, "")
    base = docs.select(
        F.col(key).alias("id"), bare.alias("bare"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("points"))
    base = base.withColumn("h", F.xxhash64("bare"))
    rank = F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("z"),
                    F.col("id").alias("id"))
    entries = written(
        base.select("h", F.sha2(F.encode("bare", "UTF-8"), 256).alias("sha"), "points", "id"),
        "entries")
    index = build_index(entries, capacity)
    at = ["local_depth", "bucket", "h"]
    counted = written(index.groupBy(*at).agg(
        F.count("*").alias("n"), F.min(F.struct("sha", "id")).alias("only")), "counted")
    single = counted.where("n = 1").select(
        F.col("only.id").alias("id"), F.col("only.id").alias("keep_id"), F.col("n").alias("group_size"),
        F.lit(True).alias("kept"), F.col("only.sha").alias("sha"), "bucket", "local_depth")
    # Chains: the distinct texts under a hash that occurs more than once.
    several = counted.where("n > 1").select(*at)
    texts = written(base.join(several, "h"), "chained")
    chains = texts.groupBy(*at, "bare").agg(
        F.count("*").alias("group_size"), F.min(rank).alias("best"))
    same = texts.select(*at, "bare", "id").join(chains, [*at, "bare"]).select(
        "id", F.col("best.id").alias("keep_id"), "group_size",
        F.col("id").eqNullSafe(F.col("best.id")).alias("kept"),
        F.sha2(F.encode("bare", "UTF-8"), 256).alias("sha"), "bucket", "local_depth")
    name = free_name(docs.select(key), "keep_id")
    return single.union(same).select(
        F.col("id").alias(key), F.col("keep_id").alias(name), "group_size", "kept",
        F.col("sha").alias("text_sha256"), "bucket", "local_depth")
