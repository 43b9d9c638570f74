"""The star-schema tables in the roles of the energy data.

Orders, line items, suppliers and customers stand in for survey households,
hourly weather, stations and before/after building stock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom import constants as K
from wattloom.functions import hash_uniform
from wattloom.session import spread, stored, tune

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf}/{name}.parquet")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("station_number"), F.col("l_quantity").alias("dry_bulb"),
        F.col("l_extendedprice").alias("radiation"), F.col("l_discount").alias("humidity"),
        F.col("l_tax").alias("wind"))


def event_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Second weather series: hourly mean event value per user."""
    e = table(spark, sf, "events")
    hours = e.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("dry_bulb"))
    return hours.select(F.col("user_id").alias("station_number"), "dry_bulb")


def stations(spark: SparkSession, sf: str) -> DataFrame:
    classes = F.element_at(F.array(F.lit("I"), F.lit("II"), F.lit("III")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("station_number"),
        F.concat(F.lit(" st"), F.col("s_nationkey").cast("string")).alias("state"), classes.alias("class"),
        (F.col("s_acctbal") / 100).alias("latitude"), F.col("s_acctbal").alias("elevation"))


def geo_households(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias(K.ID_COL), F.concat(F.lit("St"), F.col("c_nationkey").cast("string")).alias(K.STATE_COL),
        F.col("c_acctbal").alias(K.HDD_COL))


def raw_households(spark: SparkSession, sf: str) -> DataFrame:
    """Survey-shaped rows; zero codes are written as the sentinel -2."""
    c = F.col

    def code(x):
        return F.when(x == 0, -2).otherwise(x).cast("double")

    zone = F.when(c("l_returnflag") == "A", "Very-Cold").when(c("l_returnflag") == "N", "Mixed-Humid").otherwise("Hot-Dry")
    return table(spark, sf, "lineitem").select(
        *ROW_KEY, zone.alias(K.CLIMATE_COL),
        c("l_extendedprice").alias(K.TOTAL_COL), (c("l_quantity") * 100).alias(K.SQFT_COL),
        (c("l_extendedprice") * c("l_discount")).alias("TOTALBTUSPH"),
        (c("l_extendedprice") * c("l_tax")).alias("BTUELCOL"),
        (c("l_extendedprice") * c("l_discount") * 0.5).alias("TOTALBTUWTH"),
        (c("l_extendedprice") * c("l_tax") * 0.25).alias("BTUELLGT"),
        c("l_quantity").alias(K.WEIGHT_COL),
        code(c("l_partkey") % 12).alias(K.YEAR_RANGE_COL),
        (1000 + (c("l_suppkey") % 50) * 150).cast("double").alias(K.HDD_COL),
        (3500 - (c("l_suppkey") % 50) * 60).cast("double").alias(K.CDD_COL),
        c("l_linenumber").cast("double").alias("NHSLDMEM"),
        (1 + c("l_linenumber") % 3).cast("double").alias("STORIES"),
        code(c("l_suppkey") % 8).alias("WALLTYPE"), code(c("l_linenumber") % 4).alias("TYPEGLASS"),
        c("l_quantity").alias("WINDOWS"), code(c("l_partkey") % 5).alias("ADQINSUL"),
        code(c("l_orderkey") % 5).alias("DRAFTY"), code(c("l_linenumber") % 8).alias("FUELHEAT"),
        code(c("l_suppkey") % 13).alias("EQUIPM"),
        F.when(c("l_linestatus") == "O", 1.0).otherwise(0.0).alias("AIRCOND"),
        code(c("l_partkey") % 4).alias("TYPEAC"), (c("l_orderkey") % 2).cast("double").alias("HEATPUMP"))


def households(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned households: what the survey loader returns."""
    from wattloom.operators import clean
    df = clean.vintage_year(raw_households(spark, sf))
    coded = ["WALLTYPE", "TYPEGLASS", "ADQINSUL", "DRAFTY", "FUELHEAT", "EQUIPM", "TYPEAC", K.YEAR_RANGE_COL]
    df = clean.sentinels_to_null(df, coded)
    return clean.add_coarse_zone(clean.energy_intensity(df))


def stock(spark: SparkSession, sf: str) -> DataFrame:
    """Baseline and five upgrades from one scan of the line items.

    Upgrades 3 and 4 cover everything, 10 only one line status and large homes,
    11 and 15 parts of the stock.
    """
    c = F.col
    e, nothing = c("l_extendedprice"), F.lit(None).cast("double")
    energy = {
        0: e,
        3: e * (1 - c("l_tax")),
        4: e * (1 - c("l_discount") * 0.5 - c("l_tax")),
        10: F.when((c("l_linestatus") == "F") & (c("l_quantity") > 20), e * (1 - c("l_discount"))).otherwise(nothing),
        11: F.when(c("l_linenumber") == 3, e * (1 + c("l_tax"))).otherwise(nothing),
        15: F.when(c("l_quantity") > 4, e * (1 - c("l_discount") * c("l_tax"))).otherwise(nothing),
    }
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("bldg_id"),
        c("l_returnflag").alias(K.CLIMATE_COL), c("l_linenumber").alias("TYPEHUQ"),
        (c("l_suppkey") % 5).cast("int").alias("FUELHEAT"), c("l_linestatus").alias("infiltration"),
        (c("l_quantity") * 100).alias(K.SQFT_COL), (c("l_partkey") % 6).cast("string").alias("vintage"),
        F.inline(F.array(*[F.struct(F.lit(u).alias("upgrade"), x.alias(K.STOCK_ENERGY_COL))
                           for u, x in energy.items()])),
    ).filter(c(K.STOCK_ENERGY_COL).isNotNull())


# features of the model queries: raw codes and the physics columns that pass the guard
MODEL_FEATURES = [K.SQFT_COL, "STORIES", "WALLTYPE", "TYPEGLASS", "ADQINSUL", "DRAFTY", "FUELHEAT", "EQUIPM",
                  "NHSLDMEM", K.HDD_COL, "PH_UA_total", "PH_heating_load", "PH_cooling_load", "PH_dhw_load",
                  "PH_heating_eff", "PH_occ_x_sqft"]
MODEL_TARGETS = [K.TOTAL_COL, K.EUI_COL, *[f"EUI_{t.upper()}" for t in K.ENDUSE_BTU],
                 *[f"SHARE_{t.upper()}" for t in K.ENDUSE_BTU]]


def model_households(spark: SparkSession, sf: str) -> DataFrame:
    """Households whose energy follows from their physics, with a spread taken from
    the price column; split, normalised weight and log target attached."""
    from wattloom.operators import clean, split
    from wattloom.operators.physics import add_physics
    c = F.col
    # the formulas and every fit take all cores
    raw = roles_without_targets(spread(households(spark, sf)).withColumn("_spread", 0.6 + c(K.TOTAL_COL) / 130_000))
    df = add_physics(raw)
    heat = c("PH_heating_load") / c("PH_heating_eff")
    cool = F.when(c("AIRCOND") == 1, c("PH_cooling_load") / F.greatest(c("PH_cooling_eff"), F.lit(0.1))).otherwise(0.0)
    dhw, base = c("PH_dhw_load") / c("PH_dhw_eff"), c("PH_base_load")
    df = df.withColumns({K.ENDUSE_BTU["heating"]: heat * c("_spread"), K.ENDUSE_BTU["cooling"]: cool * c("_spread"),
                         K.ENDUSE_BTU["dhw"]: dhw * c("_spread"), K.ENDUSE_BTU["lighting"]: base * 0.3 * c("_spread"),
                         K.TOTAL_COL: (heat + cool + dhw + base) * c("_spread")}).drop("_spread")
    df = clean.normalised_weights(split.hash_split(clean.energy_intensity(df), ROW_KEY))
    df = df.withColumn("y_log", clean.log_target(K.TOTAL_COL))
    # written once: later filters on derived columns must not unfold the formulas again
    return stored(df.select(*ROW_KEY, "split", "w", "y_log", K.CLIMATE_SIMPLE_COL, "AIRCOND", "TYPEAC", "WINDOWS",
                             K.CDD_COL, K.YEAR_BUILT_COL, "HEATPUMP", *MODEL_FEATURES, *MODEL_TARGETS))


def roles_without_targets(df: DataFrame) -> DataFrame:
    return df.drop(*MODEL_TARGETS, *K.ENDUSE_BTU.values())


def encoded_households(spark: SparkSession, sf: str):
    """(encoder fitted on train, encoded frame with keys, split, weight and targets)."""
    return encoded(model_households(spark, sf))


def encoded(df: DataFrame):
    """The same from the households of the model queries."""
    from wattloom.operators.features import FeatureEncoder
    encoder = FeatureEncoder(MODEL_FEATURES, keep=[*ROW_KEY, "split", "w", "y_log", *MODEL_TARGETS]).fit(
        df.filter("split = 'train'"))
    # a projection of the stored frame: coding again costs less than a second copy
    return encoder, encoder.transform(df)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Truth and a noisy prediction per order, with weight, split and log scale."""
    from wattloom.operators.split import hash_split
    o = table(spark, sf, "orders")
    u = hash_uniform(["o_orderkey"], "pred")
    df = o.select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("y"),
                  (F.col("o_totalprice") * (0.8 + 0.4 * u)).alias("p"),
                  (1.0 + F.col("o_custkey") % 7).alias("w"))
    df = df.withColumns({"ly": F.log1p("y"), "lp": F.log1p("p")})
    return hash_split(df, ["o_orderkey"])


def matrix(spark: SparkSession, sf: str, target_noise: float = 0.05) -> DataFrame:
    """64 numeric columns, a planted three-column target and a hash split."""
    from wattloom.operators.split import hash_split
    v = table(spark, sf, "embeddings")
    cols = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)]
    df = v.select("vec_id", "label", *cols)
    noise = hash_uniform(["vec_id"], "noise") * target_noise
    df = df.withColumn("target", F.col("e0") + F.col("e1") * 2 + F.col("e2") * 3 + noise)
    return hash_split(df, ["vec_id"])


def stock_text(spark: SparkSession, sf: str) -> DataFrame:
    """Coded text in the shapes the stock files use, derived from part and order rows."""
    p = table(spark, sf, "part")
    kinds = F.element_at(F.array(*[F.lit(s) for s in (
        "Electricity ASHP", "Electric Baseboard", "Natural Gas Fuel Boiler", "Propane Fuel Furnace",
        "Electric Furnace", "None")]), (F.col("p_size") % 6 + 1).cast("int"))
    fuels = F.element_at(F.array(*[F.lit(s) for s in (
        "Electricity", " natural gas", "Propane", "FUEL OIL", "Wood", "Steam")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    types = F.element_at(F.array(*[F.lit(s) for s in (
        "Single-Family Detached", "Single-Family Attached", "Mobile Home", "Multi-Family with 2 - 4 Units",
        "Multi-Family with 5+ Units", "Houseboat")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    panes = F.element_at(F.array(*[F.lit(s) for s in (
        "Single, Clear", "Double, Clear", "Double, Low-E", "Triple, Clear")]), (F.col("p_size") % 4 + 1).cast("int"))
    floors = F.element_at(F.array(*[F.lit(s) for s in ("One", "two ", "Three", "4", "many")]), (F.col("p_size") % 5 + 1).cast("int"))
    zones = F.element_at(F.array(*[F.lit(s) for s in (
        "Very-Cold", "Cold", "Marine", "Mixed-Humid", "Mixed-Dry", "Hot-Humid", "Hot-Dry", "Subarctic", "Tundra")]),
        (F.col("p_partkey") % 9 + 1).cast("int"))
    vintage = F.when(F.col("p_size") < 10, "<1940").when(F.col("p_size") > 45, "n/a").otherwise(
        F.concat((F.floor(F.col("p_size") / 10) * 10 + 1940).cast("string"), F.lit("s")))
    return p.select(
        "p_partkey", types.alias("TYPEHUQ"), fuels.alias("FUELHEAT"), kinds.alias("EQUIPM"),
        F.concat(F.round(F.col("p_retailprice") / 80, 1).cast("string"), F.lit(" ACH50")).alias("infiltration"),
        F.when(F.col("p_size") % 7 == 0, "Uninsulated").otherwise(F.concat(F.lit("R-"), F.col("p_size").cast("string"))).alias("insul_roof"),
        panes.alias("windows"), vintage.alias("vintage"), floors.alias("STORIES"), zones.alias(K.CLIMATE_COL),
        (F.col("p_size") * 60).cast("double").alias(K.SQFT_COL), "p_brand")
