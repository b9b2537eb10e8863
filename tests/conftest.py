import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from forecourt import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions=8,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__maxMetadataStringLength=10_000,
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def listings(spark):
    """A handful of listings with nulls and ties."""
    rows = [
        ("a1", "Audi", "A4", 2018, "Petrol", "Automatic", 2000, 150, 55_000, 10_000),
        ("a2", "Audi", "A4", 2018, "Diesel", "Manual", 2000, 190, 42_000, 20_000),
        ("a3", "Audi", "A4", 2017, "Diesel", None, 1600, 150, 61_000, 20_000),
        ("a4", "Audi", "A6", 2016, "Petrol", "Automatic", 3000, 250, 90_000, None),
        ("b1", "BMW", "320", 2018, "Petrol", "Automatic", 2000, 184, 61_234, 28_000),
        ("b2", "BMW", "320", 2018, "Petrol", "Manual", 2000, 184, 70_000, 30_000),
        ("n1", None, "320", 2015, "Petrol", "Manual", 1800, 140, 10_000, 5_000),
    ]
    return spark.createDataFrame(
        rows,
        "advert_id string, make string, model string, year int, engine string,"
        " gearbox string, cc int, power int, mileage int, price_in_eur int",
    )


@pytest.fixture(scope="session")
def prices(spark):
    """Make a one-column table of prices."""

    def make(values, kind="int"):
        return spark.createDataFrame([("m", v) for v in values], f"make string, price_in_eur {kind}")

    return make
