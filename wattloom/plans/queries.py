"""Registered queries: one per operator, over whole tables in their roles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom import constants as K
from wattloom.operators import (
    audit, clean, features, harmonise, metrics, neighbours, physics, report, savings, scenarios, selection, split, weather,
)
from wattloom.plans import roles
from wattloom.plans.roles import ROW_KEY
from wattloom.session import run_folder
from wattloom.streaming import station_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    """Round floating columns so that engines agree on the last digits."""
    return df.select(*[
        F.round(c, special.get(c, places)).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in df.dtypes])


# ---- weather -------------------------------------------------------------------

@query
def station_climate(spark, sf):
    return rounded(weather.station_climate(roles.hourly(spark, sf)), 4)


@query
def station_climate_events(spark, sf):
    df = weather.station_climate(roles.event_hours(spark, sf))
    return rounded(df, 10)


@query
def station_climate_stream(spark, sf):
    """The same features from a stream of the hourly rows in files, reduced batch by batch."""
    folder = run_folder(spark, "station-stream")
    hourly = roles.hourly(spark, sf)
    hourly.repartition(6).write.parquet(f"{folder}/hours")
    stream = station_stream.keep_station_sums(spark, f"{folder}/hours", hourly.schema, f"{folder}/parts", f"{folder}/progress", 2)
    stream.awaitTermination()
    station_stream.compact(spark, f"{folder}/parts")
    return rounded(station_stream.features(station_stream.read_parts(spark, f"{folder}/parts")), 6)


def _states(spark, sf, **kw):
    meta = roles.stations(spark, sf)
    return meta, weather.state_climate(meta, weather.station_climate(roles.hourly(spark, sf)), **kw)


@query
def state_climate(spark, sf):
    return rounded(_states(spark, sf)[1], 4)


@query
def state_climate_first_letter(spark, sf):
    return rounded(_states(spark, sf, first_letter_only=True)[1], 4)


@query
def household_climate(spark, sf):
    meta, states = _states(spark, sf)
    return rounded(weather.attach_state_climate(roles.geo_households(spark, sf), states), 4)


@query
def climate_match_rate(spark, sf):
    meta, states = _states(spark, sf)
    df = weather.attach_state_climate(roles.geo_households(spark, sf), states, ["TMY3_HDD65"])
    return rounded(weather.match_rate(df, "TMY3_HDD65"), 6)


@query
def climate_crosscheck(spark, sf):
    meta, states = _states(spark, sf)
    df = weather.attach_state_climate(roles.geo_households(spark, sf), states, ["TMY3_HDD65"])
    return rounded(physics.paired_correlation(df, "TMY3_HDD65", K.HDD_COL), 6)


# ---- cleaning ------------------------------------------------------------------

@query
def sentinel_clean(spark, sf):
    df = clean.sentinels_to_null(roles.raw_households(spark, sf), ["WALLTYPE", "TYPEGLASS", "ADQINSUL", "DRAFTY"])
    return df.select(*ROW_KEY, "WALLTYPE", "TYPEGLASS", "ADQINSUL", "DRAFTY")


@query
def sentinel_counts(spark, sf):
    return clean.sentinel_counts(roles.raw_households(spark, sf))


@query
def observed_counts(spark, sf):
    """Replaced codes, homes with climate and homes without area, from the passes that write the frames."""
    folder = run_folder(spark, "observed")
    cleaned, codes = clean.observed_sentinels(roles.raw_households(spark, sf))
    cleaned.write.parquet(f"{folder}/households")
    _, states = _states(spark, sf)
    geo = weather.attach_state_climate(roles.geo_households(spark, sf), states, ["TMY3_HDD65"])
    geo, match = clean.observed(geo, {"homes": F.count(F.lit(1)), "homes_with_climate": F.count("TMY3_HDD65")}, "match")
    geo.write.parquet(f"{folder}/climate")
    eui, missing = clean.observed(clean.energy_intensity(spark.read.parquet(f"{folder}/households")),
                                  {"eui_missing": F.count_if(F.col("EUI").isNull())}, "eui")
    eui.write.parquet(f"{folder}/eui")
    rows = [(f"code:{c}", n) for c, n in codes.get.items()] + list(match.get.items()) + list(missing.get.items())
    return spark.createDataFrame(rows, "measure string, n long")


@query
def vintage_year(spark, sf):
    return (clean.vintage_year(roles.raw_households(spark, sf))
            .groupBy(K.YEAR_BUILT_COL).agg(F.count(F.lit(1)).alias("n")))


@query
def energy_intensity(spark, sf):
    df = clean.energy_intensity(roles.raw_households(spark, sf))
    return df.select(*ROW_KEY, "EUI", *[f"EUI_{t.upper()}" for t in K.ENDUSE_BTU],
                     *[f"SHARE_{t.upper()}" for t in K.ENDUSE_BTU])


@query
def zone_coarsen(spark, sf):
    df = clean.add_coarse_zone(roles.raw_households(spark, sf))
    return df.groupBy(K.CLIMATE_COL, K.CLIMATE_SIMPLE_COL).agg(F.count(F.lit(1)).alias("n"))


@query
def eui_report(spark, sf):
    return rounded(clean.eui_report(roles.households(spark, sf)), 4)


@query
def normalised_weights(spark, sf):
    df = split.hash_split(roles.households(spark, sf), ROW_KEY)
    df = clean.normalised_weights(df)
    return rounded(df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean_w"),
                                           F.sum("w").alias("sum_w"), F.max("w").alias("max_w")), 4)


@query
def guarded_features(spark, sf):
    df = clean.guard(roles.households(spark, sf))
    return rounded(df.agg(F.lit(",".join(df.columns)).alias("kept"), F.count(F.lit(1)).alias("n"),
                          F.avg("NHSLDMEM").alias("mean_people")), 4)


@query
def aligned_schema(spark, sf):
    df = clean.align_schema(roles.households(spark, sf), ["NHSLDMEM", "NOT_THERE", K.SQFT_COL])
    return rounded(df.agg(F.lit(",".join(df.columns)).alias("columns"), F.count("NHSLDMEM").alias("n_people"),
                          F.count("NOT_THERE").alias("n_absent"), F.avg(K.SQFT_COL).alias("mean_area")), 4)


@query
def target_columns(spark, sf):
    df = clean.target_columns(roles.households(spark, sf))
    df = df.withColumn("y_log", clean.log_target(K.TOTAL_COL))
    names = [K.TOTAL_COL, "EUI", "EUI_HEATING", "SHARE_COOLING", "_w", "y_log"]
    return rounded(df.groupBy(K.CLIMATE_COL).agg(*[F.avg(c).alias(f"mean_{c}") for c in names]), 4)


# ---- physics -------------------------------------------------------------------

GROUPS = {
    "geometry": ["building_height", "footprint_area", "building_perimeter", "wall_area", "roof_area",
                 "building_volume", "surface_area", "surface_volume_ratio", "surface_factor", "log_sqft", "age"],
    "envelope": ["U_wall", "U_roof", "U_window", "window_area", "window_wall_ratio", "ceiling_insul"],
    "conductance": ["UA_wall", "UA_window", "UA_roof", "UA_floor", "UA_infiltration", "UA_total",
                    "ACH_natural", "duct_leakage"],
    "equipment": ["heating_eff", "cooling_eff", "dhw_eff", "has_cooling"],
    "loads": ["heating_load", "cooling_load", "dhw_load", "solar_gain", "base_load"],
    "interactions": ["HDD_x_UA", "CDD_x_UA", "HDD_x_sqft", "CDD_x_sqft", "HDD_x_CDD", "vintage_x_HDD",
                     "occ_x_sqft"],
    "scores": ["envelope_quality", "eui_estimate", "heating_share_est", "cooling_share_est", "dhw_share_est",
               "efficiency_score"],
}


def _physics_group(group: str, strict: bool = False) -> Query:
    def run(spark, sf):
        df = physics.add_physics(roles.households(spark, sf), strict=strict)
        return rounded(df.select(*ROW_KEY, *[f"PH_{c}" for c in GROUPS[group]]))
    return run


for _g in GROUPS:
    QUERIES[f"physics_{_g}"] = _physics_group(_g)
QUERIES["physics_scores_strict"] = _physics_group("scores", strict=True)


@query
def physics_summary(spark, sf):
    df = physics.add_physics(roles.households(spark, sf))
    return rounded(physics.feature_summary(df, physics.physics_columns(df)), 3)


@query
def physics_corr(spark, sf):
    df = physics.add_physics(roles.households(spark, sf))
    return rounded(physics.paired_correlation(df, "PH_eui_estimate", "EUI"), 6)


@query
def defaulted_heat_pumps(spark, sf):
    return physics.default_equipment_heat_pumps(roles.households(spark, sf))


# ---- harmonisation --------------------------------------------------------------

@query
def harmonise_codes(spark, sf):
    df = roles.stock_text(spark, sf)
    return df.select(
        "p_partkey", harmonise.building_type_code("TYPEHUQ").alias("type_code"),
        harmonise.fuel_code("FUELHEAT").alias("fuel_code"), harmonise.equipment_code("EQUIPM").alias("equip_code"),
        harmonise.draftiness_code("infiltration").alias("drafty"), harmonise.insulation_code("insul_roof").alias("insul"),
        harmonise.glazing_code("windows").alias("glass"), harmonise.stories_number("STORIES").alias("stories"))


@query
def first_number(spark, sf):
    from wattloom.functions import first_number as number
    o = roles.table(spark, sf, "orders")
    return (o.select(number("o_orderpriority").alias("level"), "o_totalprice").groupBy("level")
            .agg(F.count(F.lit(1)).alias("n")))


@query
def text_numbers(spark, sf):
    from wattloom.functions import first_number as number
    df = roles.stock_text(spark, sf)
    return df.select("p_partkey", number("p_brand").alias("brand_no"), number("infiltration").alias("ach50"),
                     number("insul_roof").alias("r_value"))


@query
def vintage_text(spark, sf):
    return roles.stock_text(spark, sf).select("p_partkey", harmonise.vintage_text_year("vintage").alias("year_built"))


@query
def zone_degree_days(spark, sf):
    hdd, cdd = harmonise.zone_degree_days(K.CLIMATE_COL, ["p_partkey"])
    return rounded(roles.stock_text(spark, sf).select("p_partkey", hdd.alias("hdd"), cdd.alias("cdd")), 6)


@query
def harmonised_physics(spark, sf):
    df = harmonise.harmonise_stock(roles.stock_text(spark, sf), ["p_partkey"])
    return rounded(df.select("p_partkey", "DRAFTY", "ADQINSUL", "TYPEGLASS", "YEAR_BUILT", "PH_UA_total",
                             "PH_heating_eff", "PH_heating_load"), 4)


@query
def site_energy(spark, sf):
    df = roles.stock(spark, sf).filter("upgrade = 0")
    df = df.withColumn("kbtu", harmonise.site_energy_kbtu(df))
    return rounded(df.groupBy(K.CLIMATE_COL).agg(F.avg("kbtu").alias("mean_kbtu"), F.count("kbtu").alias("n")), 3)


# ---- measured savings -----------------------------------------------------------

@query
def naive_delta(spark, sf):
    return rounded(savings.naive_delta(roles.stock(spark, sf)), 6)


@query
def paired_delta(spark, sf):
    return rounded(savings.paired_delta(roles.stock(spark, sf)), 6)


@query
def matched_cell_delta(spark, sf):
    return rounded(savings.matched_cell_delta(roles.stock(spark, sf), min_cells=30), 6)


DRIVER_COLUMNS = [K.CLIMATE_COL, "TYPEHUQ", "FUELHEAT", "infiltration", K.SQFT_COL, "vintage"]


@query
def driver_columns(spark, sf):
    found = savings.driver_columns(roles.stock(spark, sf), columns=DRIVER_COLUMNS)
    return spark.createDataFrame([(u, ",".join(c)) for u, c in found.items()], "upgrade int, drivers string")


@query
def driver_values(spark, sf):
    return savings.driver_table(roles.stock(spark, sf), K.UPGRADES, [K.CLIMATE_COL, "infiltration", "vintage"])


@query
def shared_support_delta(spark, sf):
    return rounded(savings.shared_support_delta(roles.stock(spark, sf), columns=DRIVER_COLUMNS), 6)


@query
def measured_deltas(spark, sf):
    return rounded(savings.measured_deltas(roles.stock(spark, sf), columns=DRIVER_COLUMNS), 6)


@query
def measured_deltas_without_ids(spark, sf):
    df = roles.stock(spark, sf).drop("bldg_id")
    return rounded(savings.measured_deltas(df, building=None, columns=DRIVER_COLUMNS, min_cells=100), 6)


@query
def duplicate_buildings(spark, sf):
    return savings.duplicate_buildings(roles.stock(spark, sf))


@query
def cell_pairs(spark, sf):
    stock = roles.stock(spark, sf)
    parts = [savings.cell_pairs(stock, u, features=[K.SQFT_COL]).withColumn("upgrade", F.lit(u)) for u in K.UPGRADES]
    # sums of short decimals end where rounding does, so engines agree on them; means need not
    sums = {"sum_base": F.col("e_base") * F.col("n_base"), "sum_up": F.col("e_up") * F.col("n_up"), "sum_area": F.col(K.SQFT_COL) * F.col("n_base")}
    return rounded(report.union_all(parts).withColumns(sums).drop("e_base", "e_up", K.SQFT_COL), 6, saving_pct=8)


@query
def positional_pairs(spark, sf):
    """Baseline and upgraded rows of two tables without ids, paired by their place."""
    rows = roles.table(spark, sf, "lineitem")
    base = rows.withColumn("_e", F.col("l_extendedprice"))
    up = rows.withColumn("_e", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    pairs = savings.positional_pairs(base, up, "_e")
    return rounded(pairs.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.avg("saving_pct").alias("mean_saving_pct"), F.max("saving_pct").alias("max_saving_pct"),
        F.sum(F.col("e_base") - F.col("e_up")).alias("saved")), 4)


# ---- splits ---------------------------------------------------------------------

@query
def stratified_split(spark, sf):
    df = split.stratified_split(roles.table(spark, sf, "orders"), ["o_orderkey"], "o_orderpriority")
    return df.select("o_orderkey", "o_orderpriority", "split")


@query
def split_balance(spark, sf):
    df = split.hash_split(roles.table(spark, sf, "orders"), ["o_orderkey"])
    return split.split_balance(df, "o_orderpriority")


@query
def kfold_counts(spark, sf):
    df = split.add_fold(roles.table(spark, sf, "orders"), ["o_orderkey"])
    return df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query
def row_sample(spark, sf):
    return split.sample_rows(roles.table(spark, sf, "orders"), ["o_orderkey"], 500).select("o_orderkey")


# ---- metrics and intervals --------------------------------------------------------

@query
def regression_metrics(spark, sf):
    return rounded(metrics.regression_metrics(roles.predictions(spark, sf), "y", "p", "w", ["split"]), 4)


@query
def weighted_r2(spark, sf):
    df = metrics.regression_metrics(roles.predictions(spark, sf), "y", "p", "w")
    return rounded(df.select("n", "r2", "r2_weighted"), 6)


@query
def population_calibration(spark, sf):
    return rounded(metrics.population_calibration(roles.predictions(spark, sf), "y", "p", "w", ["o_orderpriority"]), 4,
                   weighted_total_true=2, weighted_total_pred=2)


def _widths(df, alphas):
    calib = df.filter("split = 'calib'")
    return metrics.conformal_quantiles(calib, F.col("ly") - F.col("lp"), alphas)


@query
def conformal_q(spark, sf):
    df = roles.predictions(spark, sf)
    q, n = _widths(df, K.CURVE_ALPHAS)
    return rounded(spark.createDataFrame([(float(a), n, q[a]) for a in q], "alpha double, n long, q double"), 8)


@query
def conformal_curve(spark, sf):
    df = roles.predictions(spark, sf)
    q, _ = _widths(df, K.CURVE_ALPHAS)
    return rounded(metrics.coverage_curve(df.filter("split = 'test'"), "ly", "lp", q), 6)


@query
def conformal_interval(spark, sf):
    df = roles.predictions(spark, sf)
    q, _ = _widths(df, [K.ALPHA])
    out = metrics.conformal_bounds(df.filter("split = 'test'"), "lp", q[K.ALPHA])
    return rounded(out.select("o_orderkey", "lo", "hi"), 2)


@query
def interval_coverage(spark, sf):
    df = roles.predictions(spark, sf)
    q, _ = _widths(df, [K.ALPHA])
    out = metrics.conformal_bounds(df.filter("split = 'test'"), "lp", q[K.ALPHA])
    return rounded(metrics.interval_coverage(out, "y", "lo", "hi"), 4, mean_width=2)


def _scores(spark, sf):
    """Scores of two models over ten seeds: hashed tenths of the orders."""
    df = split.add_fold(roles.predictions(spark, sf), ["o_orderkey"], 10, seed=7)
    df = df.withColumn("p2", F.col("y") * 0.2 + F.col("p") * 0.8)
    a = metrics.regression_metrics(df, "y", "p", by=["fold"]).select("fold", F.col("r2").alias("noTL"))
    b = metrics.regression_metrics(df, "y", "p2", by=["fold"]).select("fold", F.col("r2").alias("TL"))
    return a.join(b, "fold")


@query
def seed_summary(spark, sf):
    s = _scores(spark, sf).select("fold", F.inline(F.array(
        F.struct(F.lit("noTL").alias("model"), F.col("noTL").alias("score")),
        F.struct(F.lit("TL").alias("model"), F.col("TL").alias("score")))))
    return rounded(metrics.summarise_scores(s), 6)


@query
def paired_verdict(spark, sf):
    return rounded(metrics.paired_verdict(_scores(spark, sf), "TL", "noTL"), 6)


@query
def best_baseline(spark, sf):
    return rounded(metrics.best_of(_scores(spark, sf), ["TL", "noTL"]).select("fold", "best"), 6)


# ---- features -------------------------------------------------------------------

MATRIX = [f"e{i}" for i in range(64)]


@query
def winsor_impute(spark, sf):
    train = roles.matrix(spark, sf).filter("split = 'train'")
    model = features.FeatureEncoder(MATRIX, clip_q=0.01).fit(train)
    return rounded(model.statistics(spark), 6)


@query
def winsor_transform(spark, sf):
    df = roles.matrix(spark, sf)
    model = features.FeatureEncoder(MATRIX, clip_q=0.01, keep=["vec_id"]).fit(df.filter("split = 'train'"))
    return rounded(model.transform(df), 6)


ENCODED = ["o_orderstatus", "o_orderpriority", "month"]


def _order_features(spark, sf):
    o = roles.table(spark, sf, "orders").withColumn("month", F.month("o_orderdate"))
    o = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")))
    return split.hash_split(o, ["o_orderkey"])


@query
def ordinal_encode(spark, sf):
    df = _order_features(spark, sf)
    model = features.FeatureEncoder(ENCODED, keep=["o_orderkey"]).fit(df.filter("split = 'train'"))
    return model.transform(df)


@query
def column_kinds(spark, sf):
    cats, nums = features.column_kinds(roles.table(spark, sf, "lineitem"), [
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_suppkey"])
    return spark.createDataFrame([(c, "categorical") for c in cats] + [(c, "numeric") for c in nums],
                                 "column string, kind string")


@query
def column_quality(spark, sf):
    return rounded(selection.column_quality(roles.matrix(spark, sf), MATRIX), 6)


@query
def binned_mi(spark, sf):
    return rounded(selection.binned_mutual_information(roles.matrix(spark, sf), MATRIX, "target"), 6)


@query
def knn_mi(spark, sf):
    """Mutual information by three nearest neighbours, all rows and columns."""
    return rounded(neighbours.neighbour_information(roles.matrix(spark, sf), MATRIX, "target"), 6)


@query
def abs_corr(spark, sf):
    return rounded(selection.absolute_correlation(roles.matrix(spark, sf), MATRIX, "target"), 6)


def _ranked(spark, sf):
    df = roles.matrix(spark, sf)
    mi = rounded(selection.binned_mutual_information(df, MATRIX, "target"), 6)
    r = rounded(selection.absolute_correlation(df, MATRIX, "target"), 6).withColumnRenamed("abs_r", "importance")
    return selection.hybrid_rank(mi.join(r, "column"))


@query
def hybrid_rank(spark, sf):
    return rounded(_ranked(spark, sf).select("column", "score"), 6)


@query
def top_features(spark, sf):
    return rounded(selection.physics_first(_ranked(spark, sf), 20).select("column", "score", "position"), 6)


@query
def importance_top(spark, sf):
    r = rounded(selection.absolute_correlation(roles.matrix(spark, sf), MATRIX, "target"), 6)
    return selection.top_features(r, 12, "abs_r")


@query
def median_imputation(spark, sf):
    from wattloom.operators.quantiles import exact_medians
    df = roles.households(spark, sf)
    names = ["WALLTYPE", "ADQINSUL", "DRAFTY", K.YEAR_BUILT_COL]
    med = exact_medians(df, names)
    return rounded(df.groupBy(K.CLIMATE_COL).agg(*[
        F.avg(F.coalesce(F.col(c), F.lit(med[c]))).alias(f"mean_{c}") for c in names]), 6)


# ---- audit ----------------------------------------------------------------------

@query
def audit_names(spark, sf):
    df = roles.households(spark, sf)
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    bad = ",".join(sorted(audit.forbidden_names(df.columns)))
    return n.select("n_rows", F.lit(bad).alias("forbidden"),
                    F.lit(",".join(sorted(audit.lineage_names(df.columns)))).alias("lineage"))


@query
def audit_removed(spark, sf):
    df = roles.households(spark, sf)
    removed = audit.removed_ledger(spark, df.columns, clean.guard(df).columns)
    return removed.join(selection.column_quality(df, clean.guarded_names(df.columns)).select("column", "n", "n_valid"), "column")


@query
def audit_tripwire(spark, sf):
    return rounded(audit.tripwire(roles.matrix(spark, sf).withColumn("leak", F.col("target") * 2 + 1),
                                  [*MATRIX, "leak"], "target"), 6)


@query
def audit_duplicates(spark, sf):
    d = split.hash_split(roles.table(spark, sf, "documents"), ["doc_id"])
    return audit.duplicate_count(d, ["lang", "source", "n_chars", "text"])


@query
def audit_refit(spark, sf):
    train = roles.matrix(spark, sf).filter("split = 'train'")
    model = features.FeatureEncoder(MATRIX).fit(train)
    return rounded(audit.refit_medians(model, train), 6)


@query
def audit_categories(spark, sf):
    df = _order_features(spark, sf)
    model = features.FeatureEncoder(ENCODED).fit(df)
    return audit.categories_outside_train(model, df.filter("o_orderpriority <> '1-URGENT'"))


@query
def audit_linear_combo(spark, sf):
    df = roles.matrix(spark, sf).filter("split = 'train'")
    df = df.withColumn("target_log", F.log1p(F.col("target") - F.lit(-20.0)))
    return rounded(audit.linear_combo_table(df, MATRIX, {"raw_target": "target", "log1p_target": "target_log"}), 6)


@query
def audit_verdict(spark, sf):
    df = roles.matrix(spark, sf)
    train = df.filter("split = 'train'")
    model = features.FeatureEncoder(MATRIX).fit(train)
    scores = {r.split: r.r2 for r in metrics.regression_metrics(roles.predictions(spark, sf), "ly", "lp", by=["split"]).collect()}
    checks = audit.run_audit(df, MATRIX, "target", encoder=model, raw_train=train, scores=scores)
    overall = audit.verdict(checks).select(F.lit("overall").alias("check"), F.lit("all").alias("split"), "passed", F.lit(False).alias("counted"),
                                           F.format_string("counted=%d;failed=%d", "n_counted", "n_failed").alias("detail"))
    return checks.unionByName(overall)


# ---- scenarios -------------------------------------------------------------------

def load_scorer(df: DataFrame) -> DataFrame:
    """Closed-form prediction: estimated energy use from the physics loads."""
    use = (F.col("PH_heating_load") / F.col("PH_heating_eff")
           + F.when(F.col("PH_has_cooling") == 1, F.col("PH_cooling_load") / F.greatest(F.col("PH_cooling_eff"), F.lit(0.1)))
           .otherwise(0.0)
           + F.col("PH_dhw_load") / F.col("PH_dhw_eff") + F.col("PH_base_load"))
    return df.withColumn("prediction", use)


@query
def scenario_predictions(spark, sf):
    df = scenarios.scenario_predictions(roles.households(spark, sf), load_scorer)
    return rounded(df.groupBy("scenario", K.CLIMATE_COL).agg(
        F.count(F.lit(1)).alias("n"), F.avg("base_pred").alias("mean_base"), F.avg("new_pred").alias("mean_new"),
        F.avg("savings_pct").alias("mean_savings_pct")), 4)


@query
def scenario_savings(spark, sf):
    return rounded(scenarios.run_scenarios(roles.households(spark, sf), load_scorer), 4)


@query
def scenario_report(spark, sf):
    deltas = savings.measured_deltas(roles.stock(spark, sf), columns=DRIVER_COLUMNS)
    table = scenarios.run_scenarios(roles.households(spark, sf), load_scorer, deltas)
    return rounded(table, 4)


# ---- reports -----------------------------------------------------------------------

@query
def target_summary(spark, sf):
    return rounded(report.target_summary(roles.households(spark, sf)), 4)


@query
def eui_histogram(spark, sf):
    return report.clipped_histogram(roles.households(spark, sf), K.EUI_COL)


@query
def residual_histogram(spark, sf):
    return report.residual_histogram(roles.predictions(spark, sf), "ly", "lp")


@query
def benchmark_table(spark, sf):
    m = metrics.regression_metrics(roles.predictions(spark, sf), "y", "p", by=["split"])
    m = m.select(F.concat(F.lit("total_btu_"), "split").alias("metric"), "r2", "rmse")
    return rounded(report.benchmark_table(m), 6)


@query
def zone_summary(spark, sf):
    m = metrics.regression_metrics(roles.predictions(spark, sf), "ly", "lp", by=["o_orderpriority"])
    return rounded(report.zone_summary(m.select(F.col("r2").alias("r2_log_total"), F.col("n").alias("n_test"))), 6)
