"""What the operators share: tables, written intermediates, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder of this process on a single machine (tests), and an
    error on a cluster, whose executors would not see it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="forecourt-"))
    return _own_folder[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """The same rows, as a table in the shared folder: lineage ends here, work is not repeated.

    With ``rows``, Python functions on the way get at most so many rows at a time: a batch of
    long texts is held by the JVM and by the Python worker at once.
    """
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(_BATCH)
    if rows and not 0 < int(before) <= rows:
        spark.conf.set(_BATCH, rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the application, which may not have it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="forecourt-"), "forecourt_workers.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in (home / "__init__.py", home / "session.py", *sorted(home.glob("llm/*.py"))):
            archive.write(file, Path(home.name) / file.relative_to(home))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def _local_forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links of one partition: each node with its smallest known node."""
    above: dict[int, int] = {}

    def root(node: int) -> int:
        top = node
        while above.setdefault(top, top) != top:
            top = above[top]
        while above[node] != top:
            above[node], node = top, above[node]
        return top

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    pairs = [(node, root(node)) for node in above]
    pairs = [pair for pair in pairs if pair[0] != pair[1]]
    yield pd.DataFrame({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}, dtype="int64")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (both long) of an undirected graph given as links ``a, b``.

    The component is the smallest node that can be reached. Nodes without links have no row.
    Each partition first reduces its links to a forest by union-find. Large-star and
    small-star steps then hang every node under the smallest one it knows, until nothing
    changes; a step is one minimum per node and one join, so a node with very many
    neighbours is never gathered, and Spark may split it in the join.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    ship(links.sparkSession)
    stars = written(links.mapInPandas(_local_forests, "a long, b long").distinct(), "forest")
    before = None
    for _ in range(rounds):
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        # Large star: the larger neighbours of a node go to the smallest node around it.
        large = both.where("b > a").join(lowest, "a").select(
            F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # Small star: a node's smaller neighbours, and itself, go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        step = small.union(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        done = written(step, "stars")
        forget(stars)
        stars = done
        after = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
