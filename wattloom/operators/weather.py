"""Hourly weather to station climate, state climate and household climate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom import constants as K
from wattloom.functions import as_number, clip, code_map

SERIES = {"dry_bulb": "TDB", "radiation": "GHI", "humidity": "RH", "wind": "WSPD"}


def station_climate(hourly: DataFrame, base_c: float = K.DEGREE_DAY_BASE_C,
                    station: str = "station_number") -> DataFrame:
    """Up to 19 annual features per station from its hourly rows.

    One grouped aggregate of mergeable sums: a station that holds much of the
    data is combined on the map side before the shuffle.
    """
    series = {c: s for c, s in SERIES.items() if c in hourly.columns}
    rows = hourly.select(F.col(station).alias("station_number"),
                         *[as_number(c).alias(c) for c in series])
    t = F.col("dry_bulb")
    aggs = [
        F.coalesce(F.sum(clip(base_c - t, lo=0.0) / 24.0), F.lit(0.0)).alias("TMY3_HDD65"),
        F.coalesce(F.sum(clip(t - base_c, lo=0.0) / 24.0), F.lit(0.0)).alias("TMY3_CDD65")]
    for c, s in series.items():
        aggs += [F.avg(c).alias(f"TMY3_{s}_mean"), F.stddev_samp(c).alias(f"TMY3_{s}_std"),
                 F.max(c).alias(f"TMY3_{s}_max")]
    aggs.append(F.count(F.lit(1)).alias("TMY3_n_hours"))
    return derived_features(rows.filter(F.col("station_number").isNotNull()).groupBy("station_number").agg(*aggs))


def derived_features(out: DataFrame) -> DataFrame:
    """Add the features that follow from the others."""
    hdd, cdd = F.col("TMY3_HDD65"), F.col("TMY3_CDD65")
    derived = {
        "TMY3_HDD_CDD_ratio": hdd / F.greatest(cdd, F.lit(1.0)),
        "TMY3_heating_months": clip(hdd / 30.0, 0.0, 12.0),
        "TMY3_cooling_months": clip(cdd / 30.0, 0.0, 12.0)}
    if "TMY3_GHI_mean" in out.columns:
        derived["TMY3_solar_gain_index"] = (
            F.col("TMY3_GHI_mean") * clip("TMY3_GHI_max", lo=1.0) / 1000.0)
    return out.withColumns(derived)


def station_weight(meta: DataFrame, first_letter_only: bool = False):
    """Class weight of a station; unknown classes weigh 0.5.

    ``first_letter_only`` looks at the first letter of the class, which gives
    I, II and III the same weight.
    """
    if "class" not in meta.columns:
        return F.lit(K.UNKNOWN_CLASS_WEIGHT)
    label = F.trim(F.col("class").cast("string"))
    if first_letter_only:
        label = F.substring(label, 1, 1)
    return code_map(label, K.STATION_CLASS_WEIGHT, K.UNKNOWN_CLASS_WEIGHT)


def state_key(c: str):
    return F.upper(F.trim(F.col(c).cast("string")))


def state_climate(meta: DataFrame, stations: DataFrame, first_letter_only: bool = False) -> DataFrame:
    """State means of the station features, weighted by class weight x hours.

    ``meta`` is one row per station (of repeats the least row stays); Spark picks the join by its size.
    """
    geo = {"latitude": "TMY3ST_Lat", "longitude": "TMY3ST_Lon", "elevation": "TMY3ST_Elev"}
    side = meta.select(
        "station_number", state_key("state").alias(K.STATE_COL),
        station_weight(meta, first_letter_only).alias("_cw"),
        *[as_number(c).alias(v) for c, v in geo.items() if c in meta.columns],
    )
    # of repeated rows the least one stays, so that a rerun gives the same state
    others = [c for c in side.columns if c != "station_number"]
    side = side.groupBy("station_number").agg(F.min(F.struct(*others)).alias("_m")).select("station_number", "_m.*")
    joined = stations.join(side, "station_number")
    joined = (joined.withColumn("_w", F.col("_cw") * F.greatest(F.col("TMY3_n_hours"), F.lit(1)))
              .filter(F.col(K.STATE_COL).isNotNull()))
    features = [c for c in joined.columns
                if c.startswith(("TMY3_", "TMY3ST_")) and c != "TMY3_n_hours"]
    w = F.col("_w")

    def mean(c: str):
        use = F.col(c).isNotNull() & (w > 0)
        return F.try_divide(F.sum(F.when(use, F.col(c) * w)), F.sum(F.when(use, w))).alias(c)

    return joined.groupBy(K.STATE_COL).agg(
        *[mean(c) for c in features], F.count(F.lit(1)).alias("TMY3ST_n_stations"))


def attach_state_climate(households: DataFrame, states: DataFrame,
                         columns: Sequence[str] | None = None) -> DataFrame:
    """Left join of the state features; every household row is kept exactly once."""
    if columns is not None:
        states = states.select(K.STATE_COL, *columns)
    keyed = households.withColumn(K.STATE_COL, state_key(K.STATE_COL))
    return keyed.join(states, K.STATE_COL, "left")


def match_rate(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("n_matched"),
                  (F.avg(F.col(column).isNotNull().cast("double")) * 100).alias("matched_pct"))
