"""A trigram index for text searches, which prunes listings before the exact match.

The index is a table of postings: which distinct texts of a column hold which three
letters in a row. A search looks up the trigrams its pattern cannot do without; listings
whose texts lack one are ruled out by a join, and the rest is matched as ever.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.text import any_like, like
from forecourt.operators.filters import SEARCHED, require_columns

GRAM = 3
# What has a meaning of its own in a pattern.
_SPECIAL = re.compile(r"[\\^$.|?*+()\[\]{}]")


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text; none of a shorter one."""
    places = F.sequence(F.lit(1), F.char_length(text) - (GRAM - 1))
    return F.when(F.char_length(text) >= GRAM, F.array_distinct(F.transform(
        places, lambda i: F.substring(text, i, GRAM)))).otherwise(F.array().cast("array<string>"))


def needed_trigrams(value: str) -> list[str] | None:
    """Trigrams that every text matched by a search (see ``like``) holds, in order; None if unknown.

    A search for the end or the start of a text, or for plain text, needs all its own. A regular
    expression needs those of its plain stretches if all it has besides are ``.``, ``.*`` and
    ``.+``; nothing is known of others.
    """
    wanted = value.lower()
    if wanted.startswith("*") or wanted.endswith("*"):
        stretches = [wanted.replace("*", "")]
    else:
        stretches = re.split(r"\.[*+]?", wanted)
        if any(_SPECIAL.search(part) for part in stretches):
            return None
    found = dict.fromkeys(
        part[i:i + GRAM] for part in stretches for i in range(len(part) - GRAM + 1))
    return list(found) or None


def trigram_index(df: DataFrame, columns: Sequence[str] = SEARCHED) -> DataFrame:
    """Postings ``column, gram, value``: the distinct lower-case texts of the columns that hold a gram.

    Distinct texts are found first, so a text that many listings share is cut up once.
    Written partitioned or clustered by ``gram``, a search reads a few of them.
    """
    require_columns(df, columns)
    texts = reduce(DataFrame.union, [
        df.select(F.lit(c).alias("column"), F.lower(F.col(c)).alias("value")) for c in columns])
    texts = texts.where(F.col("value").isNotNull()).distinct()
    return texts.select("column", F.explode(trigrams(F.col("value"))).alias("gram"), "value")


def texts_found(index: DataFrame, value: str, columns: Sequence[str] = SEARCHED) -> DataFrame:
    """The texts ``column, value`` of an index that a search matches: postings first, then the match."""
    grams = needed_trigrams(value)
    if grams is None:
        raise ValueError(f"the index cannot tell what {value!r} needs")
    held = index.where(F.col("gram").isin(grams) & F.col("column").isin(list(columns)))
    candidates = held.groupBy("column", "value").agg(F.count("*").alias("grams")).where(
        F.col("grams") == len(grams))
    return candidates.where(like(F.col("value"), value.lower())).select("column", "value")


def indexed_search(
    df: DataFrame, index: DataFrame, value: str, columns: Sequence[str] = SEARCHED
) -> DataFrame:
    """The listings a search finds in any of the columns, by way of an index of these columns.

    The same rows as ``any_like``. The pattern is matched once per distinct text that has all
    trigrams it needs, and listings are kept by equality with those texts. Patterns the index
    cannot help with are matched against all listings.
    """
    require_columns(df, columns)
    if needed_trigrams(value) is None:
        return df.where(any_like(columns, value))
    found = texts_found(index, value, columns)
    marks = []
    for i, c in enumerate(columns):
        own = found.where(F.col("column") == c).select(
            F.col("value").alias(f"fc_text_{i}"), F.lit(True).alias(f"fc_found_{i}"))
        df = df.join(own, F.lower(F.col(c)) == F.col(f"fc_text_{i}"), "left")
        marks.append(F.col(f"fc_found_{i}"))
    kept = df.where(F.coalesce(*marks, F.lit(False)))
    return kept.drop(*[f"fc_{n}_{i}" for i in range(len(columns)) for n in ("text", "found")])
