"""A view of adverts over the star-schema test tables.

A line item is an advert; its part gives make and model, its order the engine. Only the
tables a query's columns come from are read and joined: every line item has exactly one
part and one order, so a lookup left out neither drops nor repeats an advert.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.date(2001, 12, 31)
# An advert's id as text is longer than the keys it is made of, which are its key.
ID_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
IDS = ("advert_id", "advert_key")


def _columns() -> dict[str, tuple[frozenset[str], Column]]:
    line, part, order = (frozenset({t}) for t in ("lineitem", "part", "orders"))

    def whole(c: Column) -> Column:
        return c.cast("int")

    price = whole(F.col("l_extendedprice"))
    estimated = F.when(
        F.col("l_discount") != 0, whole(F.col("p_retailprice") * F.col("l_quantity"))
    )
    return {
        "advert_id": (line, F.concat_ws("-", *ID_KEYS)),
        "advert_key": (line, F.struct(*ID_KEYS)),
        "source": (line, F.col("l_linestatus")),
        "title": (part, F.col("p_name")),
        "equipment": (order, F.lower("o_orderpriority")),
        "make": (part, F.col("p_brand")),
        "model": (part, F.col("p_type")),
        "year": (line, F.year("l_shipdate")),
        "engine": (order, F.col("o_orderpriority")),
        "gearbox": (line, F.nullif(F.col("l_returnflag"), F.lit("R"))),
        "cc": (part, F.col("p_size") * 100),
        "power": (part, F.lit(40) + F.col("p_size") * 10),
        "mileage": (line, whole(F.col("l_quantity")) * 4000),
        "price_in_eur": (line, price),
        "estimated_price_in_eur": (part, estimated),
        "save_diff_in_eur": (part, estimated - price),
        "discount": (line, F.abs("l_discount") * 100),
        "increase": (line, F.abs("l_tax") * 100),
        "created_on": (line, F.to_date("l_shipdate")),
    }


# Column names in order.
ADVERT_COLUMNS = (
    "advert_id", "source", "title", "equipment", "make", "model", "year", "engine",
    "gearbox", "cc", "power", "mileage", "price_in_eur", "estimated_price_in_eur",
    "save_diff_in_eur", "discount", "increase", "created_on",
)

JOINS = {"part": ("l_partkey", "p_partkey"), "orders": ("l_orderkey", "o_orderkey")}


def adverts(
    spark: SparkSession,
    sf_dir: str,
    columns: Sequence[str] = ADVERT_COLUMNS,
    together: Sequence[str] = (),
) -> DataFrame:
    """The view with the given columns.

    What a line item alone gives is taken before the joins, as it is narrower than what it
    comes from. Views that name the same columns ``together`` move line items to their parts
    and orders once for all of them, each with all these columns; Spark would else move them
    once per view, each time with the columns of that view.
    """
    described = _columns()
    needed = frozenset().union(*[described[c][0] for c in (*columns, *together)])
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if len(needed) > 1:
        early = [c for c, (tables, _) in described.items() if tables == {"lineitem"} and c not in IDS]
        rows = rows.select("*", *[described[c][1].alias(c) for c in early])
        described |= {c: (described[c][0], F.col(c)) for c in early}
    for table, (left, right) in JOINS.items():
        if table in needed:
            other = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            rows = rows.join(other, rows[left] == other[right])
    if together:
        # Every hash is in its range, so all rows stay; but no column can be left out below the joins.
        moved = [c for name in together
                 for c in (ID_KEYS if name in IDS else (described[name][1],))]
        rows = rows.where(F.xxhash64(*moved) >= -(2**63))
    return rows.select(*[described[c][1].alias(c) for c in columns])


def id_of_key(key: str) -> Column:
    """The ``advert_id`` of an ``advert_key``."""
    return F.concat_ws("-", *[F.col(key)[k] for k in ID_KEYS])


ADVERTS_SQL = """
adverts AS (
  SELECT
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS advert_id,
    l_linestatus AS source,
    p_name AS title,
    lower(o_orderpriority) AS equipment,
    p_brand AS make,
    p_type AS model,
    CAST(year(l_shipdate) AS INTEGER) AS year,
    o_orderpriority AS engine,
    nullif(l_returnflag, 'R') AS gearbox,
    p_size * 100 AS cc,
    40 + p_size * 10 AS power,
    CAST(trunc(l_quantity) AS INTEGER) * 4000 AS mileage,
    CAST(trunc(l_extendedprice) AS INTEGER) AS price_in_eur,
    CASE WHEN l_discount = 0 THEN NULL
         ELSE CAST(trunc(p_retailprice * l_quantity) AS INTEGER)
    END AS estimated_price_in_eur,
    CASE WHEN l_discount = 0 THEN NULL
         ELSE CAST(trunc(p_retailprice * l_quantity) AS INTEGER)
    END - CAST(trunc(l_extendedprice) AS INTEGER) AS save_diff_in_eur,
    abs(l_discount) * 100 AS discount,
    abs(l_tax) * 100 AS increase,
    CAST(l_shipdate AS DATE) AS created_on
  FROM lineitem
  JOIN part ON p_partkey = l_partkey
  JOIN orders ON o_orderkey = l_orderkey
)
"""
