"""Fixed bands for price, mileage and power."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from forecourt.functions.measures import quoted


class Band(NamedTuple):
    """Closed integer band."""

    start: int
    end: int
    label: str


# Price band labels, exclusive upper limits and ordering codes (there is
# no code 4), and the inclusive mileage and power bands comparables are drawn from.
PRICE_BANDS = (
    ("5K", 5_000, 1),
    ("10K", 10_000, 2),
    ("15K", 15_000, 3),
    ("20K", 20_000, 5),
    ("25K", 25_000, 6),
    ("30K", 30_000, 7),
    ("40K", 40_000, 8),
    ("50K", 50_000, 9),
    ("60K", 60_000, 10),
    ("70K", 70_000, 11),
    ("80K", 80_000, 12),
    ("90K", 90_000, 13),
    ("100K", 100_000, 14),
)
TOP_PRICE_BAND = ("100K+", 15)

MILEAGE_BANDS = (
    Band(0, 20_000, "Less than 20 000 km"),
    Band(20_001, 40_000, "Between 20 000 km. and 40 000 km."),
    Band(40_001, 60_000, "Between 40 000 km. and 60 000 km."),
    Band(60_001, 80_000, "Between 60 000 km. and 80 000 km."),
    Band(80_001, 100_000, "Between 80 000 km. and 100 000 km."),
    Band(100_001, 120_000, "Between 100 000 km. and 120 000 km."),
    Band(120_001, 150_000, "Between 120 000 km. and 150 000 km."),
    Band(150_001, 999_999, "Over 150 000 km."),
)

POWER_BANDS = (
    Band(0, 90, "0-90"),
    Band(91, 130, "91-130"),
    Band(131, 150, "131-150"),
    Band(151, 200, "151-200"),
    Band(201, 252, "201-252"),
    Band(253, 303, "253-303"),
    Band(304, 358, "304-358"),
    Band(359, 404, "359-404"),
    Band(405, 454, "405-454"),
    Band(455, 9_999, "455-9999"),
)


def _ladder(steps: Sequence[tuple[str, str]], otherwise: str = "NULL") -> str:
    return f"CASE {' '.join(f'WHEN {c} THEN {v}' for c, v in steps)} ELSE {otherwise} END"


def price_band(column: str) -> Column:
    """Label of the fixed price band; a null price falls in the top band."""
    c = quoted(column)
    steps = [(f"{c} < {limit}", f"'{label}'") for label, limit, _ in PRICE_BANDS]
    return F.expr(_ladder(steps, f"'{TOP_PRICE_BAND[0]}'"))


def price_band_order(column: str) -> Column:
    """Ordering code of the fixed price band."""
    c = quoted(column)
    steps = [(f"{c} < {limit}", str(code)) for _, limit, code in PRICE_BANDS]
    return F.expr(_ladder(steps, str(TOP_PRICE_BAND[1])))


def band_number(column: str, bands: Sequence[Band]) -> Column:
    """1-based number of the closed band holding the value, null outside all."""
    c = quoted(column)
    steps = [
        (f"{c} BETWEEN {b.start} AND {b.end}", str(i)) for i, b in enumerate(bands, 1)
    ]
    return F.expr(_ladder(steps))


def band_label(column: str, bands: Sequence[Band]) -> Column:
    """Label of the closed band holding the value, null outside all."""
    c = quoted(column)
    steps = [(f"{c} BETWEEN {b.start} AND {b.end}", f"'{b.label}'") for b in bands]
    return F.expr(_ladder(steps))


def band_of(value: int | None, bands: Sequence[Band]) -> Band | None:
    """The band of a single request value."""
    if value is None:
        return None
    return next((b for b in bands if b.start <= value <= b.end), None)
