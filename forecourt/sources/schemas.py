"""The four listing datasets: field names, types and visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def _schema(fields: str) -> StructType:
    schema = StructType()
    for field in fields.split(","):
        name, kind = field.split()
        schema = schema.add(name, kind)
    return schema


# The field names, order and types of the incoming files, and the
# columns a client is told not to show.
VEHICLES = _schema("""
    advert_id string, source string, title string, make string, model string,
    year integer, engine string, gearbox string, cc integer, power integer,
    power_kw integer, mileage integer, currency string, price integer,
    estimated_price integer, save_diff integer, extra_charge integer, discount float,
    increase float, price_in_eur integer, estimated_price_in_eur integer,
    save_diff_in_eur integer, extra_charge_in_eur integer, equipment string, url string,
    created_on date, updated_on date
""")

PRICES = _schema("""
    make string, model string, year integer, engine string, gearbox string,
    power integer, mileage integer, cc integer, mileage_breakdown string,
    power_breakdown string, price_in_eur integer, estimated_price_in_eur integer,
    save_diff_in_eur integer, extra_charge_in_eur integer, discount float, increase float
""")

ESTIMATED_PRICES = _schema("""
    make string, model string, year integer, engine string, gearbox string,
    power integer, mileage integer, cc integer, mileage_breakdown string,
    power_breakdown string, price_in_eur integer
""")

VEHICLE_STATISTIC = _schema("""
    advert_id string, make string, model string, year integer, engine string,
    gearbox string, mileage integer, power integer, price_in_eur integer,
    mileage_breakdown string, cc_breakdown string, power_breakdown string,
    price__breakdown string, mileage_breakdown_order integer,
    cc_breakdown_order integer, power_breakdown_order string,
    price__breakdown_order integer, year_created_on integer, year_changed_on integer,
    month_created_on integer, month_changed_on integer, week_created_on integer,
    week_changed_on integer, days_in_sale integer, created_on date, sold_date date
""")

DATASETS = {
    "vehicles": VEHICLES,
    "prices": PRICES,
    "estimated_prices": ESTIMATED_PRICES,
    "vehicle_statistic": VEHICLE_STATISTIC,
}

HIDDEN_COLUMNS = frozenset({"id", "advert_id", "published_on", "dealer"})


def with_visibility(df: DataFrame) -> DataFrame:
    """Mark every column visible or hidden in its metadata."""
    for field in df.schema.fields:
        metadata = {**field.metadata, "visible": field.name not in HIDDEN_COLUMNS}
        df = df.withMetadata(field.name, metadata)
    return df


def visible_columns(df: DataFrame) -> list[str]:
    """Names of the columns not marked hidden."""
    return [
        f.name
        for f in df.schema.fields
        if f.metadata.get("visible", f.name not in HIDDEN_COLUMNS)
    ]
