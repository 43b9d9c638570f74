"""File sources and sinks on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from wattloom import constants as K
from wattloom.sources import sinks, tables
from wattloom.streaming.stock_ingest import ingest_stock


def test_survey_scan(spark, tmp_path):
    p = tmp_path / "survey.csv"
    p.write_bytes(b"DOEID , TOTSQFT_EN,TOTALBTU,BA_climate,YEARMADERANGE,WALLTYPE,name\n"
                  b"1,1000,50000,Very-Cold,3,-2,caf\xe9\n2,500,10000,Hot-Dry,-2,1,x\n")
    df = tables.load_survey(spark, str(p))
    assert tables.load_survey(spark, str(p), rows=1).collect() == df.limit(1).collect()
    a, b = df.orderBy("DOEID").collect()
    assert a.EUI == 50.0 and a.YEAR_BUILT == 1955 and a.WALLTYPE is None and a.name == "café"
    assert b.YEAR_BUILT is None and b.BA_climate_SIMPLE == "Hot"


def test_weather_scans(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Station number,Dry-bulb (C),GHI (W/m^2),other\n7,10.5,3,zz\n")
    (tmp_path / "m.csv").write_text("USAF,STATE,Class,Lat\n7,tx,I,30.5\n")
    h = tables.load_hourly(spark, str(tmp_path / "w.csv"))
    assert h.columns == ["station_number", "dry_bulb", "radiation"] and h.first().dry_bulb == 10.5
    assert tables.load_stations(spark, str(tmp_path / "m.csv")).first().state == "tx"
    assert tables.load_stations(spark, str(tmp_path / "absent.csv")) is None


def write_stock(folder):
    for u in (0, 10):
        with gzip.open(folder / f"upgrade{u}.csv.gz", "wt") as f:
            f.write("bldg_id,in.sqft..ft2,in.heating_fuel,in.infiltration,out.site_energy.total.energy_consumption..kwh,unused\n")
            f.write(f"1,1200,Electricity,10 ACH50,{9000 - u},q\n2,800,Propane,7 ACH50,5000,q\n")


def test_stock_scan_and_store(spark, tmp_path):
    write_stock(tmp_path)
    files = {u: str(tmp_path / f"upgrade{u}.csv.gz") for u in (0, 3, 10)}
    assert tables.load_stock(spark, files, rows=1).groupBy("upgrade").count().filter("count <> 1").count() == 0
    df = tables.load_stock(spark, files, partitions=4)
    assert df.rdd.getNumPartitions() == 4 and "unused" not in df.columns
    assert {(r.upgrade, r.bldg_id): r[K.STOCK_ENERGY_COL] for r in df.collect()}[(10, 1)] == 8990.0
    stored = tables.store_stock(df, str(tmp_path / "stock"))
    assert stored.filter("upgrade = 10").count() == 2


def test_incremental_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_stock(tmp_path / "in")
    schema = spark.read.option("header", True).csv(str(tmp_path / "in")).schema
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for _ in range(2):                      # a second run finds nothing new
        ingest_stock(spark, str(tmp_path / "in"), schema, out, progress).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 4 and {r.upgrade for r in got.select("upgrade").collect()} == {0, 10}


def test_registry(spark, tmp_path):
    reg = sinks.ResultRegistry(spark, "s1")
    reg.set("r2", 0.5)
    reg.add_row("t", {"a": 1})
    reg.add_row("t", {"a": 2, "b": "x"})
    reg.save(str(tmp_path / "reg"))
    values = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "reg/values")).collect()]
    assert {v["key"] for v in values} == {"run_stamp", "r2"}
    assert spark.read.option("header", True).csv(str(tmp_path / "reg/tables/t")).count() == 2


def test_alias_order():
    assert tables.find_column(["GHI", "ghi (w/m^2) "], K.WEATHER_ALIASES["radiation"]) == "ghi (w/m^2) "
    assert tables.find_column(["x"], ["y"]) is None
