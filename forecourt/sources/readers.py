"""Reading listing tables from delimited files, Parquet and databases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from forecourt.sources.schemas import DATASETS

SEPARATOR = ";"
DATE_FORMAT = "yyyy-MM-dd"
CORRUPT = "_corrupt_record"


def _schema_of(dataset: str | StructType) -> StructType:
    if isinstance(dataset, StructType):
        return dataset
    if dataset not in DATASETS:
        raise ValueError(f"unknown dataset {dataset!r}; known: {sorted(DATASETS)}")
    return DATASETS[dataset]


def _options(mode: str = "PERMISSIVE") -> dict[str, str]:
    """How a delimited line is parsed, from a file or a column."""
    return {"sep": SEPARATOR, "dateFormat": DATE_FORMAT, "mode": mode,
            "columnNameOfCorruptRecord": CORRUPT}


def read_csv(
    spark: SparkSession,
    dataset: str | StructType,
    paths: str | Sequence[str],
    mode: str = "PERMISSIVE",
    keep_corrupt: bool = False,
) -> DataFrame:
    """Scan one or several ``;``-separated files with a fixed schema.

    ``mode`` is Spark's: PERMISSIVE turns bad fields into nulls, DROPMALFORMED skips
    the row, FAILFAST raises. ``keep_corrupt`` adds the raw text of bad rows.
    """
    schema = _schema_of(dataset)
    if keep_corrupt:
        schema = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    return spark.read.csv(
        [paths] if isinstance(paths, str) else list(paths),
        schema=schema,
        header=True,
        **_options(mode),
    )


def parse_lines(
    df: DataFrame,
    column: str,
    dataset: str | StructType,
    mode: str = "PERMISSIVE",
    keep_corrupt: bool = False,
) -> DataFrame:
    """Parse a column of ``;``-separated lines as ``read_csv`` parses files.

    ``mode`` is PERMISSIVE or FAILFAST. ``keep_corrupt`` adds the raw text of bad lines.
    """
    schema = _schema_of(dataset)
    if keep_corrupt:
        schema = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return df.select(F.from_csv(column, ddl, _options(mode)).alias("fields")).select("fields.*")


def count_bad_rows(
    spark: SparkSession, dataset: str | StructType, paths: str | Sequence[str]
) -> DataFrame:
    """One row: how many rows the files hold, how many do not fit the schema, and a
    check sum of all fields."""
    return bad_lines(read_csv(spark, dataset, paths, keep_corrupt=True))


def bad_lines(rows: DataFrame) -> DataFrame:
    """The same for rows that have been parsed with ``keep_corrupt``."""
    # Whether a row fits is only known once every field is parsed, so no field may be
    # left out of the scan: a check sum over all of them stays in the result.
    fields = [F.col(c) for c in rows.columns if c != CORRUPT]
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(CORRUPT).isNotNull()).alias("bad_row_count"),
        F.bit_xor(F.xxhash64(*fields)).alias("checksum"),
    )


def strip_quotes(df: DataFrame) -> DataFrame:
    """Delete every double quote from the string columns."""
    return df.select(
        *[
            F.regexp_replace(f.name, '"', "").alias(f.name)
            if isinstance(f.dataType, StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_quoted_csv(
    spark: SparkSession, dataset: str | StructType, paths: str | Sequence[str]
) -> DataFrame:
    """Scan files that still carry quotes, deleting the quotes before parsing.

    Quoting is switched off, so the split is the one the cleaned text would give;
    fields that do not parse become null.
    """
    schema = _schema_of(dataset)
    text = StructType()
    for field in schema.fields:
        text = text.add(field.name, StringType())
    raw = spark.read.csv(
        [paths] if isinstance(paths, str) else list(paths),
        schema=text,
        sep=SEPARATOR,
        header=True,
        quote="",
        enforceSchema=True,
    )
    clean = strip_quotes(raw)
    return clean.select(
        *[
            F.nullif(F.col(f.name), F.lit("")).try_cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Scan listings kept as Parquet; filters and column choice reach the files."""
    return spark.read.parquet(*paths)


def read_view(
    spark: SparkSession,
    url: str,
    view: str,
    properties: Mapping[str, str],
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    num_partitions: int = 1,
) -> DataFrame:
    """Read a database view, in parallel ranges when a partition column is given."""
    if partition_column is None:
        return spark.read.jdbc(url, view, properties=dict(properties))
    if bounds is None:
        raise ValueError("bounds are required with a partition column")
    lower, upper = bounds
    return spark.read.jdbc(
        url,
        view,
        column=partition_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=num_partitions,
        properties=dict(properties),
    )


def select_dataset(
    tables: Mapping[str, DataFrame], source: str | None = None, default: str = "vehicles"
) -> DataFrame:
    """Pick the table a request names; an absent or empty name means the default."""
    name = source or default
    if name not in tables:
        raise ValueError(f"unknown source {name!r}; known: {sorted(tables)}")
    return tables[name]
