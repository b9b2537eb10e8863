"""From raw documents to packed training windows, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm.common import table, written
from forecourt.llm.decontaminate import clean_documents
from forecourt.llm.line_dedup import drop_repeated_passages
from forecourt.llm.packing import pack
from forecourt.llm.quality import drop_low_quality
from forecourt.llm.super_minhash import drop_near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return drop_low_quality(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of over 50 words that occur before.

    ``n_chars`` follows the text; documents of which nothing is left go, those whose text was
    null from the start stay.
    """
    clean = drop_repeated_passages(docs.select(COLUMNS))
    n_chars = F.when(F.col("units_removed") > 0, F.char_length("text").cast("long")).otherwise(
        F.col("n_chars"))
    return clean.where("units_removed = 0 OR text IS NOT NULL").withColumn(
        "n_chars", n_chars).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id."""
    return drop_near_duplicates(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return clean_documents(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of the documents in windows of at most 2048, one row per piece."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: The stages learn, draw hashes and tokenize; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each writes its rows, the next one rereads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return docs
