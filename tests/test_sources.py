"""Files in and out."""

import datetime as dt
import json

import pytest
from pyspark.sql.types import IntegerType, StringType

from forecourt.sources.readers import (
    count_bad_rows,
    read_csv,
    read_parquet,
    read_quoted_csv,
    read_view,
    select_dataset,
    strip_quotes,
)
from forecourt.sources.schemas import (
    DATASETS,
    ESTIMATED_PRICES,
    PRICES,
    VEHICLE_STATISTIC,
    VEHICLES,
    visible_columns,
    with_visibility,
)
from forecourt.sources.writers import write_csv, write_extract, write_json, write_parquet

HEADER = ";".join(ESTIMATED_PRICES.names)


def test_schemas():
    assert [len(s) for s in (VEHICLES, PRICES, ESTIMATED_PRICES, VEHICLE_STATISTIC)] == [27, 16, 11, 26]
    assert VEHICLE_STATISTIC["power_breakdown_order"].dataType == StringType()
    assert VEHICLES["price_in_eur"].dataType == IntegerType()
    assert "price__breakdown" in VEHICLE_STATISTIC.names
    assert set(DATASETS) == {"vehicles", "prices", "estimated_prices", "vehicle_statistic"}


@pytest.fixture
def file(tmp_path):
    def write(name, *lines):
        path = tmp_path / name
        path.write_text("\n".join([HEADER, *lines]) + "\n")
        return str(path)

    return write


def test_several_files_are_one_table(spark, file):
    a = file("a.csv", "Audi;A4;2018;Petrol;Manual;150;1000;1600;1;2;9000")
    b = file("b.csv", "BMW;320;;;;;;;;;")
    df = read_csv(spark, "estimated_prices", [a, b])
    assert df.schema.names == ESTIMATED_PRICES.names
    found = {r["make"]: r for r in df.collect()}
    assert found["Audi"]["price_in_eur"] == 9000 and found["BMW"]["gearbox"] is None
    assert read_csv(spark, ESTIMATED_PRICES, a).count() == 1


def test_bad_rows_become_nulls_are_counted_or_refused(spark, file):
    path = file(
        "bad.csv", "Audi;A4;2018;Petrol;Manual;150;1000;1600;1;2;9000", "bad;y;2024-02-30",
        "Audi;A4;x;Petrol;Manual;150;1000;1600;1;2;100",
    )
    rows = {r["price_in_eur"]: r for r in read_csv(spark, "estimated_prices", path).collect()}
    assert rows[100]["year"] is None and rows[None]["make"] == "bad"
    assert tuple(count_bad_rows(spark, "estimated_prices", path).first())[:2] == (3, 2)
    assert len(read_csv(spark, "estimated_prices", path, mode="DROPMALFORMED").collect()) == 1
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        read_csv(spark, "estimated_prices", path, mode="FAILFAST").collect()
    kept = read_csv(spark, "estimated_prices", path, keep_corrupt=True).collect()
    assert sum(r["_corrupt_record"] is not None for r in kept) == 2


def test_quotes_are_deleted_before_parsing(spark, file):
    path = file("q.csv", '"Audi";"A""4";"2018";Petrol;"";150;1000;1600;1;2;"9000"')
    row = read_quoted_csv(spark, "estimated_prices", path).first()
    assert (row["make"], row["model"], row["year"], row["gearbox"], row["price_in_eur"]) == ("Audi", "A4", 2018, None, 9000)


def test_unknown_names(spark):
    with pytest.raises(ValueError, match="unknown dataset"):
        read_csv(spark, "nothing", "x")
    with pytest.raises(ValueError, match="unknown source"):
        select_dataset({"vehicles": None}, "other")
    assert select_dataset({"vehicles": 1, "prices": 2}, "prices") == 2
    assert select_dataset({"vehicles": 1}) == select_dataset({"vehicles": 1}, "") == 1


def test_parallel_database_reads_need_bounds(spark):
    with pytest.raises(ValueError, match="bounds"):
        read_view(spark, "jdbc:none", "v", {}, partition_column="year")


def test_csv_round_trip(spark, tmp_path):
    row = ["id-1", "src", 'The "best"', "Audi", "A4", 2018, None, "x", 1600, 150, 110, 5, "EUR",
           1, 2, 3, 4, 1.5, None, 10, 20, 30, 40, "abs", "http://x", dt.date(2024, 2, 3), None]
    df = spark.createDataFrame([row], VEHICLES)
    write_csv(df, str(tmp_path / "plain"))
    assert read_csv(spark, "vehicles", str(tmp_path / "plain")).collect() == df.collect()
    write_extract(df, str(tmp_path / "clean"))
    text = "".join(p.read_text() for p in (tmp_path / "clean").glob("part-*"))
    assert '"' not in text and ";The best;" in text and "2024-02-03" in text
    assert read_csv(spark, "vehicles", str(tmp_path / "clean")).collect() == strip_quotes(df).collect()


def test_parquet_is_partitioned_and_pruned(spark, listings, tmp_path):
    path = str(tmp_path / "adverts")
    write_parquet(listings, path, ["year"])
    assert {p.name for p in (tmp_path / "adverts").glob("year=*")} == {f"year={y}" for y in (2015, 2016, 2017, 2018)}
    df = read_parquet(spark, path)
    assert df.count() == listings.count()
    plan = df.filter("year = 2018 AND cc > 1000").select("make")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "GreaterThan(cc,1000)" in plan


def test_json_lines(spark, listings, tmp_path):
    write_json(listings.select("advert_id", "gearbox").orderBy("advert_id"), str(tmp_path / "out"))
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert len(lines) == 7 and {"advert_id": "a3", "gearbox": None} in lines


def test_visibility(listings):
    df = with_visibility(listings)
    assert visible_columns(df) == [c for c in listings.columns if c != "advert_id"]
    assert "advert_id" not in visible_columns(listings)
