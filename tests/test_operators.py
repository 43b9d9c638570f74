"""Hand-computed and metamorphic checks on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom import constants as K
from wattloom.functions import as_number, clip, first_number, safe_ratio
from wattloom.models.stacking import moments, non_negative_ridge
from wattloom.operators import (
    audit, clean, conservation, features, harmonise, metrics, physics, quantiles, savings, scenarios, selection, split,
    weather,
)


def one(df):
    return df.first()


# ---- missing values ------------------------------------------------------------

def test_clip_and_ratio_keep_null(spark):
    df = spark.createDataFrame([(None, 1.0), (-5.0, 0.0), (5.0, 2.0)], "a double, b double")
    got = [(r[0], r[1]) for r in df.select(clip("a", 0, 3), safe_ratio("a", "b")).collect()]
    assert got == [(None, None), (0.0, None), (3.0, 2.5)]


def test_number_coercion(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "a string")
    assert [r[0] for r in df.select(as_number("a")).collect()] == [1.5, None, None, None]


def test_sentinels_only_in_numbers(spark):
    df = spark.createDataFrame([(-2.0, -1.5, "-2"), (999999999.0, 3.0, "x")], "a double, b double, t string")
    assert [tuple(r) for r in clean.sentinels_to_null(df).collect()] == [(None, -1.5, "-2"), (None, 3.0, "x")]
    counts = {r[0]: r[1] for r in clean.sentinel_counts(df).collect()}
    assert counts == {"a": 2, "b": 0}


def test_intensity_of_zero_total_and_tiny_area(spark):
    df = spark.createDataFrame([(0.0, 100.0, 5.0), (50.0, 0.5, 5.0), (50.0, None, 5.0)],
                               "TOTALBTU double, TOTSQFT_EN double, TOTALBTUSPH double")
    rows = clean.energy_intensity(df).collect()
    assert rows[0].SHARE_HEATING is None and rows[1].EUI == 50.0 and rows[2].EUI is None
    assert rows[0].EUI_COOLING is None


@pytest.mark.parametrize("zone,want", [("Very-Cold", "Cold"), ("Subarctic", "Cold"), ("Hot-Dry", "Hot"),
                                       ("Marine", "Mixed"), (None, "Mixed")])
def test_zones(spark, zone, want):
    df = spark.createDataFrame([(zone,)], "BA_climate string")
    assert one(clean.add_coarse_zone(df)).BA_climate_SIMPLE == want


def test_guard_drops_replicate_weights_and_energy():
    cols = ["DOEID", "NWEIGHT", "NWEIGHT7", "KWH", "PH_eui_estimate", "STORIES", "doltotal"]
    assert set(clean.guarded_names(cols)) == set(cols) - {"STORIES"}


# ---- text ------------------------------------------------------------------------

def test_stock_text(spark):
    df = spark.createDataFrame([("10 ACH50", "R-38", "Triple, Low-E", "<1940"), ("", "Uninsulated", None, "1970s"),
                                ("14 ACH50", "R-13", "Single, Clear", "new")], "i string, r string, w string, v string")
    got = [tuple(x) for x in df.select(harmonise.draftiness_code("i"), harmonise.insulation_code("r"),
                                       harmonise.glazing_code("w"), harmonise.vintage_text_year("v")).collect()]
    assert got == [(2.0, 4.0, 3.0, 1935.0), (None, None, 2.0, 1975.0), (1.0, 1.0, 1.0, None)]
    assert one(df.select(first_number("i"))).asDict().popitem()[1] == 10.0


def test_equipment_precedence(spark):
    df = spark.createDataFrame([("Electricity ASHP",), ("Electric Furnace",), ("Fuel Boiler",), ("Fuel Furnace",), (None,)], "e string")
    assert [r[0] for r in df.select(harmonise.equipment_code("e")).collect()] == [3.0, 12.0, 7.0, 2.0, None]


# ---- exact ranks -------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["uniform", "ties", "two", "heavy"])
def test_ranks_without_gathering(spark, kind):
    r = random.Random(kind)
    n = 3001
    data = {"uniform": [r.random() for _ in range(n)], "ties": [float(r.randint(0, 3)) for _ in range(n)],
            "two": [1.0] * 1000 + [2.0] * 2001, "heavy": [5.0] * 1000 + [math.exp(9 * r.random()) for _ in range(2001)]}[kind]
    df = spark.createDataFrame([(v,) for v in data] + [(None,), (float("nan"),)], "v double").repartition(5)
    got = quantiles.exact_percentiles(df, {"v": "v"}, [0, 0.001, 0.25, 0.5, 0.9, 1], accuracy=50, direct_rows=3)["v"]
    assert got == pytest.approx(list(np.quantile(data, [0, 0.001, 0.25, 0.5, 0.9, 1])), rel=1e-12)


def test_empty_column_has_no_quantile(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles.exact_percentiles(df, {"v": "v"}, [0.5]) == {"v": [None]}


# ---- splits --------------------------------------------------------------------------

def test_split_is_exact_and_stable(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, "a").otherwise("b"))
    first = split.stratified_split(df, ["id"], "g")
    counts = {(r[0], r[1]): r[2] for r in split.split_balance(first, "g").collect()}
    assert counts[("a", "train")] == 490 and counts[("b", "test")] == 45
    again = split.stratified_split(df.repartition(7), ["id"], "g")
    assert first.join(again, "id").filter(first.split != again.split).count() == 0


def test_small_stratum_falls_back(spark):
    df = spark.range(109).withColumn("g", F.when(F.col("id") < 9, "small").otherwise("big"))
    counts = split.stratified_split(df, ["id"], "g").groupBy("split").count().collect()
    assert {r[0] for r in counts} == set(K.SPLIT_SIZES) and sum(r[1] for r in counts) == 109


# ---- weather ---------------------------------------------------------------------------

def test_station_with_one_hour_and_mixed_case_states(spark):
    hours = spark.createDataFrame([(1, 8.3), (2, 28.3), (2, 28.3), (3, None)], "station_number long, dry_bulb double")
    st = {r.station_number: r for r in weather.station_climate(hours).collect()}
    assert st[1].TMY3_TDB_std is None and st[1].TMY3_HDD65 == pytest.approx(10 / 24)
    assert st[3].TMY3_HDD65 == 0.0 and st[3].TMY3_TDB_mean is None
    meta = spark.createDataFrame([(1, "tx", "II"), (2, " TX", "I"), (2, " TX", "I"), (3, "ny", "?")],
                                 "station_number long, state string, class string")
    states = weather.state_climate(meta, weather.station_climate(hours))
    rows = {r.state_postal: r for r in states.collect()}
    assert set(rows) == {"TX", "NY"} and rows["TX"].TMY3ST_n_stations == 2
    assert rows["TX"].TMY3_TDB_mean == pytest.approx((8.3 * 0.7 + 28.3 * 2) / 2.7)
    homes = spark.createDataFrame([(1, "Tx"), (2, "zz")], "DOEID long, state_postal string")
    assert weather.attach_state_climate(homes, states).count() == 2


# ---- physics -------------------------------------------------------------------------------

def test_physics_defaults_and_idempotence(spark):
    df = spark.createDataFrame([(1, 5.0, None, 0.0), (2, 1.0, 4.0, 1.0)], "id long, FUELHEAT double, EQUIPM double, AIRCOND double")
    once = physics.add_physics(df)
    twice = physics.add_physics(once)
    assert len(physics.physics_columns(once)) == 47 and once.columns == twice.columns
    assert [tuple(r) for r in once.orderBy("id").collect()] == [tuple(r) for r in twice.orderBy("id").collect()]
    a, b = once.orderBy("id").collect()
    assert a.PH_heating_eff == 2.3 and b.PH_heating_eff == pytest.approx(0.8 * 0.85)
    assert a.PH_cooling_share_est == 0.0 and one(physics.add_physics(df, strict=True).orderBy("id")).PH_cooling_share_est > 0
    assert one(physics.default_equipment_heat_pumps(df))[0] == 1


# ---- savings ----------------------------------------------------------------------------------

def make_stock(spark, n=4000, effect=0.1, leaky_only=True):
    base = spark.range(n).select(
        F.col("id").alias("bldg_id"), (F.col("id") % 3).cast("string").alias("BA_climate"), (F.col("id") % 5).cast("int").alias("TYPEHUQ"),
        (F.col("id") % 4).cast("int").alias("FUELHEAT"), F.when(F.col("id") % 7 < 3, "leaky").otherwise("tight").alias("infiltration"))
    energy = 10000 + 500 * F.col("TYPEHUQ") + F.when(F.col("infiltration") == "leaky", 6000).otherwise(0)
    base = base.withColumn(K.STOCK_ENERGY_COL, energy.cast("double"))
    up = base.filter("infiltration = 'leaky'") if leaky_only else base
    up = up.withColumn(K.STOCK_ENERGY_COL, F.col(K.STOCK_ENERGY_COL) * (1 - effect))
    return base.withColumn("upgrade", F.lit(0)).unionByName(up.withColumn("upgrade", F.lit(10)))


def test_planted_effect_is_recovered(spark):
    stock = make_stock(spark)
    assert one(savings.naive_delta(stock, [10])).naive_pct < 0
    assert one(savings.paired_delta(stock, [10])).paired_pct == pytest.approx(10.0)
    got = one(savings.measured_deltas(stock.drop("bldg_id"), [10], building=None, min_cells=20))
    assert got.drivers == "infiltration" and got.reported_pct == pytest.approx(10.0)
    assert got.estimator == "shared_support" and got.sign_flip


def test_full_coverage_without_ids_uses_cells(spark):
    stock = make_stock(spark, leaky_only=False).drop("bldg_id")
    got = one(savings.measured_deltas(stock, [10], building=None, min_cells=20))
    assert got.estimator == "matched" and got.matched_pct == pytest.approx(10.0) and got.n_cells == 60


def test_pairs_of_repeated_ids_equal_the_join(spark):
    r = random.Random(1)
    rows = [(r.choice([7, r.randint(1, 60)]), u, r.uniform(-5, 100)) for u in (0, 10) for _ in range(300)]
    stock = spark.createDataFrame(rows, "bldg_id long, upgrade int, TOTAL_ENERGY_KWH double")
    pairs = [(b[2] - u[2]) / b[2] * 100 for b in rows for u in rows
             if b[1] == 0 and u[1] == 10 and b[0] == u[0] and b[2] > 0 and u[2] >= 0]
    got = one(savings.paired_delta(stock, [10]))
    assert got.n_pairs == len(pairs) and got.paired_pct == pytest.approx(np.mean(pairs))


def test_pinned_number_is_a_driver(spark):
    rows = [(0, float(i % 4), "x") for i in range(40)] + [(10, 2.0, "x")] * 5
    stock = spark.createDataFrame(rows, "upgrade int, a double, b string").withColumn(K.STOCK_ENERGY_COL, F.lit(1.0))
    assert savings.driver_columns(stock, [10]) == {10: ["a"]}


def test_too_few_diagnosed_rows(spark):
    stock = make_stock(spark, n=300)
    assert one(savings.shared_support_delta(stock, [10])).shared_support_pct is None


def test_positional_pairs_need_an_order(spark):
    a = spark.createDataFrame([(1, 100.0), (2, 100.0)], "k long, TOTAL_ENERGY_KWH double")
    b = spark.createDataFrame([(1, 90.0), (2, 50.0)], "k long, TOTAL_ENERGY_KWH double")
    assert sorted(r.saving_pct for r in savings.ordered_pairs(a, b, "k").collect()) == [10.0, 50.0]
    with pytest.raises(ValueError):
        savings.ordered_pairs(a, b.limit(1), "k")


# ---- scenarios -------------------------------------------------------------------------------------

def test_identity_edit_saves_nothing(spark):
    df = spark.createDataFrame([(1, 3.0, 2.0), (2, 1.0, 4.0)], "id long, TYPEGLASS double, DRAFTY double")
    out = scenarios.scenario_predictions(df, lambda d: d.withColumn("prediction", F.col("PH_UA_total")),
                                         edits={"same": {"DRAFTY": F.col("DRAFTY")}, "seal": {"DRAFTY": F.lit(4.0)}})
    got = {(r.id, r.scenario): r for r in out.collect()}
    assert got[(1, "same")].savings_pct == 0 and got[(1, "seal")].savings_pct > 0
    assert got[(1, "seal")].DRAFTY == 2.0            # raw attribute restored


# ---- metrics ------------------------------------------------------------------------------------------

def test_conformal_needs_fifty_rows_and_handles_ties(spark):
    df = spark.createDataFrame([(float(i // 2),) for i in range(50)], "r double")
    assert metrics.conformal_quantiles(df.limit(49), "r")[0] == {0.10: None}
    k = math.ceil(51 * 0.9)
    assert metrics.conformal_quantiles(df, "r")[0][0.10] == float((k - 1) // 2)


def test_metrics_null_below_ten_rows(spark):
    df = spark.range(9).select(F.col("id").cast("double").alias("y"), F.col("id").cast("double").alias("p"))
    assert one(metrics.regression_metrics(df, "y", "p")).r2 is None


@pytest.mark.parametrize("df,want", [(1, 12.7062), (2, 4.3027), (9, 2.2622), (30, 2.0423)])
def test_t_quantile(df, want):
    assert metrics.t_quantile(0.975, df) == pytest.approx(want, abs=1e-4)


def test_shares_are_conserved(spark):
    df = spark.createDataFrame([(0.9, 0.5), (0.1, 0.2), (-0.3, 0.4)], "share_a double, share_b double")
    rows = conservation.conserve_shares(df, ["a", "b"]).collect()
    assert all(r.share_a + r.share_b + r.share_other == pytest.approx(1.0) for r in rows)
    assert rows[0].share_a == pytest.approx(0.9 / 1.4) and rows[2].share_a == 0.0


# ---- features and audit ---------------------------------------------------------------------------------

def frame(spark, n=600):
    r = random.Random(3)
    rows = [(i, float(r.random()), float(r.random()), float(r.random()), float(r.random()), r.choice(["x", "y", None]),
             "train" if i % 4 else "test") for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, t string, split string")
    return df.withColumn("y", F.col("a") + F.col("b") + F.col("c") + F.col("d"))


def test_encoder_ignores_other_splits_and_round_trips(spark, tmp_path):
    df = frame(spark)
    model = features.FeatureEncoder(["a", "t"], keep=["id"]).fit(df.filter("split = 'train'"))
    changed = df.withColumn("a", F.when(F.col("split") == "test", 1e9).otherwise(F.col("a")))
    again = features.FeatureEncoder(["a", "t"], keep=["id"]).fit(changed.filter("split = 'train'"))
    assert model.bounds == again.bounds and model.levels == {"t": ["MISSING", "x", "y"]}
    unseen = spark.createDataFrame([(1, None, "z")], "id long, a double, t string")
    row = one(model.transform(unseen))
    assert row.t == -1.0 and row.a == model.medians["a"]
    model.save(spark, str(tmp_path / "m"))
    assert features.FeatureEncoderModel.load(spark, str(tmp_path / "m")).medians == model.medians


def test_long_category_lists_use_a_dictionary(spark):
    df = spark.range(400).select("id", F.format_string("v%05d", F.col("id") % 150).alias("t"))
    model = features.FeatureEncoder(["t"], keep=["id"]).fit(df)
    assert list(model.dictionaries) == ["t"]
    assert {r.id: r.t for r in model.transform(df).collect()} == {i: float(i % 150) for i in range(400)}


def test_planted_sum_is_caught(spark):
    df = frame(spark)
    found = audit.greedy_linear_r2(df, ["a", "b", "c", "d"], "y")
    assert found["max_r2"] > 0.999 and set(found["group"]) == {"a", "b", "c", "d"}
    checks = {(r["check"]): r.passed for r in audit.run_audit(df, ["a", "b", "c", "d"], "y").collect()}
    assert not checks["G"] and checks["B"]


def test_planted_copy_is_caught(spark):
    df = spark.createDataFrame([("train", 1.00001, None, "q"), ("test", 1.00002, None, "q"), ("test", 1.1, None, "q"),
                                ("test", 1.00001, "z", "q")], "split string, a double, b string, c string")
    got = one(audit.duplicate_count(df, ["a", "b", "c"]))
    assert (got.duplicate_rows, got.duplicate_contents) == (1, 1)


def test_tied_rank_shares(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0)], "column string, v double")
    got = {r.column: r.p for r in df.withColumn("p", selection.percent_rank_average("v")).collect()}
    assert got == {"a": 0.5, "b": 0.5, "c": 1.0}


def test_non_negative_ridge_matches_least_squares(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 3))
    y = x @ [0.5, 0.3, 0.0] - 0.2 * x[:, 2] + 1.0
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    coef, intercept, r2 = non_negative_ridge(*moments(df, ["a", "b", "c"], "y", F.lit(1.0)), 1e-8)
    assert coef[2] == 0.0 and coef[0] == pytest.approx(0.5, abs=0.05) and 0.8 < r2 <= 1


def test_mutual_information_orders_signal(spark):
    df = frame(spark).withColumn("z", F.col("a") * 2)
    mi = {r.column: r.mi for r in selection.binned_mutual_information(df, ["a", "b", "z"], "a").collect()}
    assert mi["a"] == pytest.approx(math.log(10), rel=0.01) and mi["z"] == pytest.approx(mi["a"]) and mi["b"] < 0.3


def test_the_scans_do_not_follow_the_number_of_ranks(spark, monkeypatch):
    r = random.Random(3)
    data = {"a": [r.gauss(0, 1) for _ in range(4000)], "b": [float(r.randint(-3, 3)) for _ in range(3998)] + [-math.inf, math.inf]}
    df = spark.createDataFrame(list(zip(data["a"], data["b"])) + [(None, None)], "a double, b double").repartition(4)
    searches, real = [], quantiles._search
    monkeypatch.setattr(quantiles, "_search", lambda *a: searches.append(1) or real(*a))
    probs = [i / 100 for i in range(101)]
    ranks = lambda _, n: [round((n - 1) * p) for p in probs]
    found, sizes = quantiles.order_statistics(df, {"a": "a", "b": "b"}, ranks, accuracy=500, direct_rows=200)
    assert sizes == {"a": 4000, "b": 4000} and len(searches) == 1
    for c, values in data.items():
        assert found[c] == {k: sorted(values)[k] for k in ranks(c, 4000)}
