"""Nearest-neighbour information, the station stream, observed counts and positional pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom import constants as K
from wattloom.operators import clean, neighbours, savings, weather
from wattloom.streaming import station_stream


def psi(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, n))


def brute(x, y, k=3):
    """Every pair of points, in the plane and along both axes."""
    x, y = np.array(x, float), np.array(y, float)
    sx, sy, n = x.std(), y.std(), len(x)
    if not sx or not sy or n <= k:
        return 0.0
    dx, dy = np.abs(x[:, None] - x) / sx, np.abs(y[:, None] - y) / sy
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.nextafter(np.sort(d, axis=1)[:, k - 1], 0)[:, None]
    return max(0.0, psi(n) + psi(k) - np.mean([psi(int(a)) + psi(int(b)) for a, b in zip((dx <= r).sum(1), (dy <= r).sum(1))]))


def columns_of(seed, n):
    r = random.Random(seed)
    y = [r.gauss(0, 1) for _ in range(n)]
    return y, {
        "line": [v * 2 + 1 for v in y], "noisy": [v + r.gauss(0, 1) for v in y], "free": [r.uniform(0, 1) for _ in y],
        "flag": [float(v > 0) for v in y], "steps": [float(round(v * 3)) for v in y], "hot": [0.0 if r.random() < .6 else r.gauss(0, 1) for _ in y],
        "far": [v if i % 50 else 1000.0 * i for i, v in enumerate(y)], "const": [4.0] * n}


@pytest.mark.parametrize("strip,slab", [(1024, 1 << 18), (4, 1 << 18), (4, 20)])
def test_information_equals_brute_force(spark, strip, slab):
    y, cols = columns_of(1, 400)
    y = [round(v, 2) for v in y[:100]] + y[100:]
    df = spark.createDataFrame([(i, *[c[i] for c in cols.values()], y[i]) for i in range(400)], ["id", *cols, "y"])
    # repeated rows, nulls and odd numbers
    df = df.unionByName(df.filter("id < 60")).unionByName(df.filter("id < 5").withColumn("noisy", F.lit(None).cast("double")).withColumn("free", F.lit(float("nan"))))
    rows = df.collect()
    got = {r.column: r for r in neighbours.neighbour_information(df, list(cols), "y", strip=strip, slab=slab).collect()}
    for c in cols:
        own = [(r[c], r["y"]) for r in rows if r[c] is not None and not math.isnan(r[c])]
        assert got[c].n == len(own)
        assert got[c].mi == pytest.approx(brute(*zip(*own)), abs=1e-9), c
    assert got["line"].mi > got["noisy"].mi > got["free"].mi and got["const"].mi == 0


def test_information_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "a double, y double")
    assert neighbours.neighbour_information(df, ["a"], "y").collect()[0].mi == 0
    assert neighbours.neighbour_information(df.filter("a > 5"), ["a"], "y").collect()[0].mi == 0


def test_digamma(spark):
    n = [1, 2, 3, 19, 20, 21, 100, 12345]
    got = [r.p for r in spark.createDataFrame([(v,) for v in n], "n long").select(neighbours.digamma(F.col("n")).alias("p")).collect()]
    assert got == pytest.approx([psi(v) for v in n], abs=1e-12)


def test_no_table_grows_with_the_square(spark):
    """The points asked of other slabs stay a small multiple of the points."""
    y, cols = columns_of(2, 3000)
    df = spark.createDataFrame([(cols["noisy"][i], y[i]) for i in range(3000)], "x double, y double").withColumn("column", F.lit("x")).withColumn("m", F.lit(1).cast("long"))
    edges = {"x": np.quantile(cols["noisy"], np.arange(1, 10) / 10)}
    plane = neighbours.Plane({"x": (np.std(cols["noisy"]), np.std(y))}, edges, {"x": np.quantile(y, np.arange(1, 10) / 10)}, {})
    found = neighbours.nearest_distances(df, plane, 3).filter("r is not null")
    asked = sum(len(plane.asked("x", np.array([r.x]), np.array([r.y]), np.array([r.r]))[0]) for r in found.collect())
    assert asked < 2 * 3000


# ---- station stream --------------------------------------------------------------

def hours(spark, seed, n, stations=5):
    r = random.Random(seed)
    rows = [(r.randrange(stations), r.choice([None, r.gauss(10, 9)]), r.uniform(0, 900), r.uniform(5, 100), r.choice([None, r.uniform(0, 9)])) for _ in range(n)]
    return spark.createDataFrame(rows, "station_number int, dry_bulb double, radiation double, humidity double, wind double")


def same(a, b):
    a, b = ({r.station_number: r.asDict() for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].keys() == b[k].keys()
        for c, v in a[k].items():
            assert v == b[k][c] if v is None or b[k][c] is None else v == pytest.approx(b[k][c], rel=1e-9, abs=1e-9), (k, c)


def test_late_files_change_the_features_as_a_recomputation_would(spark, tmp_path):
    folder, parts, progress = (str(tmp_path / x) for x in ("in", "parts", "progress"))
    frames = [hours(spark, i, 40 + i) for i in range(5)]
    schema = frames[0].schema

    def run():
        q = station_stream.keep_station_sums(spark, folder, schema, parts, progress)
        q.awaitTermination()
        assert q.exception() is None
    for f in frames[:2]:
        f.coalesce(1).write.mode("append").parquet(folder)
    run()
    same(station_stream.features(station_stream.read_parts(spark, parts)), weather.station_climate(spark.read.parquet(folder)))
    for f in frames[2:]:
        f.coalesce(1).write.mode("append").parquet(folder)
    run()
    run()                                               # nothing new: nothing is counted twice
    whole = weather.station_climate(spark.read.parquet(folder))
    same(station_stream.features(station_stream.read_parts(spark, parts)), whole)
    # a batch that is written again replaces itself
    station_stream.station_sums(frames[0]).write.mode("overwrite").parquet(str(tmp_path / "parts2" / "batch=0"))
    station_stream.station_sums(frames[0]).write.mode("overwrite").parquet(str(tmp_path / "parts2" / "batch=0"))
    same(station_stream.features(station_stream.read_parts(spark, str(tmp_path / "parts2"))), weather.station_climate(frames[0]))


def test_compacted_parts_stand_for_their_batches(spark, tmp_path):
    parts = str(tmp_path / "parts")
    frames = [hours(spark, 10 + i, 30) for i in range(4)]
    for i, f in enumerate(frames[:3]):
        station_stream.station_sums(f).write.parquet(f"{parts}/batch={i}")
    assert station_stream.compacted(spark, parts) is None
    assert station_stream.compact(spark, parts) == 2 and station_stream.compacted(spark, parts) == 2
    station_stream.station_sums(frames[3]).write.parquet(f"{parts}/batch=3")
    all_hours = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])
    same(station_stream.features(station_stream.read_parts(spark, parts)), weather.station_climate(all_hours))
    (tmp_path / "parts" / "upto=3").mkdir()             # a compaction that was stopped
    same(station_stream.features(station_stream.read_parts(spark, parts)), weather.station_climate(all_hours))


# ---- observed counts -------------------------------------------------------------

def test_counts_come_from_the_pass_that_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, -2.0, 3.0), (2, 4.0, -2.0), (3, -2.0, None)], "id int, a double, b double")
    out, seen = clean.observed_sentinels(df, ["a", "b"], codes=(-2,))
    out.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"a": 2, "b": 1}
    assert sorted((r.id, r.a, r.b) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, None, 3.0), (2, 4.0, None), (3, None, None)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CollectMetrics" in plan and "Exchange" not in plan


# ---- positional pairs ------------------------------------------------------------

def test_rows_pair_by_their_place(spark, tmp_path):
    base = spark.range(0, 1000, 1, 4).select((F.col("id") * 10.0 + 5000).alias(K.STOCK_ENERGY_COL), "id")
    up = spark.range(0, 1000, 1, 7).select((F.col("id") * 9.0 + 4000).alias(K.STOCK_ENERGY_COL))
    for name, df in (("base", base), ("up", up)):
        df.write.parquet(str(tmp_path / name))
    a, b = (spark.read.parquet(str(tmp_path / x)) for x in ("base", "up"))
    out = savings.positional_pairs(a, b)
    assert out.count() == 1000 and out.select("position").distinct().count() == 1000
    assert out.filter((F.col("position") != F.col("id")) | (F.col("e_base") != F.col("id") * 10.0 + 5000) | (F.col("e_up") != F.col("id") * 9.0 + 4000)).count() == 0
    spark.range(0, 999).select((F.col("id") * 1.0).alias(K.STOCK_ENERGY_COL)).write.parquet(str(tmp_path / "short"))
    with pytest.raises(ValueError, match="equal row counts"):
        savings.positional_pairs(a, spark.read.parquet(str(tmp_path / "short")))
