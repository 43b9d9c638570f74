"""Building heat-balance features: 47 row-local ``PH_*`` columns.

Each group of formulas is one ``withColumns`` stage, so a later stage refers to
columns instead of repeating their expression trees. No Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom import constants as K
from wattloom.functions import as_number, clip, code_map, default_number

_INPUT = "_ph_"


_RAW = (K.SQFT_COL, "STORIES", K.HDD_COL, K.CDD_COL, "NHSLDMEM", K.YEAR_BUILT_COL, "WINDOWS", "WALLTYPE",
        "TYPEGLASS", "ADQINSUL", "DRAFTY", "FUELHEAT", "EQUIPM", "HEATPUMP", "AIRCOND", "TYPEAC")


def _inputs(df: DataFrame) -> DataFrame:
    """Numbers first, codes and bounds second: short stages keep the generated
    methods within what the JIT compiler accepts."""
    present = [c for c in _RAW if c in df.columns]
    df = df.withColumns({f"{_INPUT}raw_{c}": as_number(c) for c in present})

    def raw(name: str):
        return F.col(f"{_INPUT}raw_{name}")

    def number(name: str, default: float):
        return F.coalesce(raw(name), F.lit(default)) if name in present else F.lit(default)

    def coded(name: str, table: dict, default: float):
        return code_map(raw(name), table, default) if name in present else F.lit(default)

    df = df.withColumns({_INPUT + k: v for k, v in {
        "area": F.greatest(number(K.SQFT_COL, 2000.0), F.lit(50.0)),
        "stories": F.least(F.greatest(number("STORIES", 1.5), F.lit(1.0)), F.lit(6.0)),
        "hdd": F.greatest(number(K.HDD_COL, 4500.0), F.lit(0.0)),
        "cdd": F.greatest(number(K.CDD_COL, 1200.0), F.lit(0.0)),
        "people": F.greatest(number("NHSLDMEM", 2.5), F.lit(1.0)),
        "year": number(K.YEAR_BUILT_COL, 1980.0),
        "windows": F.least(F.greatest(number("WINDOWS", 5.0), F.lit(1.0)), F.lit(12.0)),
        "fuel": number("FUELHEAT", 1.0),
        "equip": number("EQUIPM", 3.0),
        "hp_flag": number("HEATPUMP", 0.0) == 1,
        "ac": number("AIRCOND", 1.0),
        "ac_type": number("TYPEAC", 2.0),
    }.items()})
    return df.withColumns({_INPUT + k: v for k, v in {
        "wall_u": coded("WALLTYPE", K.WALL_U, 0.22),
        "glass_u": coded("TYPEGLASS", K.GLASS_U, 0.65),
        "insul": coded("ADQINSUL", K.INSULATION_FACTOR, 1.0),
        "ach50": coded("DRAFTY", K.ACH50_BY_DRAFTINESS, 9.0),
    }.items()})


def add_physics(df: DataFrame, ceiling_ft: float = 9.0, strict: bool = False) -> DataFrame:
    """Append the 47 features; existing ``PH_*`` columns are replaced.

    ``strict=True`` divides the cooling load of homes without air conditioning
    by the 0.1 efficiency floor; the default gives such homes no cooling energy.
    """
    df = df.drop(*[c for c in df.columns if c.startswith(K.PHYSICS_PREFIX)])
    df = _inputs(df)
    i = {c: F.col(c) for c in df.columns if c.startswith(_INPUT)}

    def x(name: str):
        return i[_INPUT + name]

    def ph(name: str):
        return F.col(K.PHYSICS_PREFIX + name)

    def stage(frame: DataFrame, **features) -> DataFrame:
        return frame.withColumns({K.PHYSICS_PREFIX + k: v for k, v in features.items()})

    # geometry
    df = stage(df,
               building_height=x("stories") * ceiling_ft,
               footprint_area=x("area") / x("stories"))
    df = stage(df, building_perimeter=4.0 * F.sqrt(F.greatest(ph("footprint_area"), F.lit(25.0))))
    df = stage(df,
               wall_area=ph("building_perimeter") * ph("building_height"),
               roof_area=ph("footprint_area"),
               building_volume=x("area") * ceiling_ft)
    df = stage(df, surface_area=ph("wall_area") + ph("roof_area") + ph("footprint_area"))
    df = stage(df,
               surface_volume_ratio=ph("surface_area") / F.greatest(ph("building_volume"), F.lit(1.0)),
               surface_factor=ph("surface_area") / x("area"),
               log_sqft=F.log1p(x("area")),
               age=F.greatest(2020.0 - x("year"), F.lit(0.0)),
               # envelope
               U_wall=x("wall_u") * x("insul"),
               U_roof=0.08 * x("insul"),
               U_window=x("glass_u"),
               window_wall_ratio=clip(0.06 + 0.02 * x("windows"), 0.08, 0.30),
               ceiling_insul=x("insul"),
               ACH_natural=x("ach50") / 20.0)
    df = stage(df, window_area=ph("wall_area") * ph("window_wall_ratio"))
    # conductance
    df = stage(df,
               UA_wall=ph("U_wall") * F.greatest(ph("wall_area") - ph("window_area"), F.lit(0.0)),
               UA_window=ph("U_window") * ph("window_area"),
               UA_roof=ph("U_roof") * ph("roof_area"),
               UA_floor=0.10 * ph("footprint_area"),
               UA_infiltration=0.018 * ph("building_volume") * ph("ACH_natural"))
    old_duct = F.when(x("year") < 1990, 0.25).otherwise(0.10)
    df = stage(df,
               UA_total=ph("UA_wall") + ph("UA_window") + ph("UA_roof") + ph("UA_floor")
               + ph("UA_infiltration"),
               duct_leakage=old_duct * (ph("UA_wall") + ph("UA_roof")))
    # equipment
    electric = x("fuel") == 5
    heat_pump = electric & (x("equip").isin(3.0, 10.0) | x("hp_flag"))
    combustion = (code_map(x("fuel"), K.FUEL_EFFICIENCY, 0.80)
                  * code_map(x("equip"), K.EQUIPMENT_FACTOR, 0.95))
    cooled = x("ac") == 1
    df = stage(df,
               heating_eff=F.greatest(F.when(heat_pump, 2.30).when(electric, 0.98)
                                      .otherwise(combustion), F.lit(0.3)),
               cooling_eff=F.when(cooled, code_map(x("ac_type"), K.COOLING_EFFICIENCY, 2.8))
               .otherwise(0.0),
               dhw_eff=F.when(electric, 0.92).otherwise(0.62),
               has_cooling=cooled.cast("double"),
               # steady-state loads, kBtu
               heating_load=ph("UA_total") * x("hdd") * 24.0 / 1000.0,
               cooling_load=(ph("UA_total") * 0.8 + ph("UA_infiltration") * 0.5)
               * x("cdd") * 24.0 / 1000.0,
               dhw_load=x("people") * 22.0 * 8.34 * 70.0 * 365.0 / 1000.0,
               solar_gain=ph("window_area") * x("cdd") * 0.30 / 1000.0,
               base_load=(x("area") * 3.5 + x("people") * 800.0) / 1000.0,
               # interactions
               HDD_x_UA=x("hdd") * ph("UA_total") / 1000.0,
               CDD_x_UA=x("cdd") * ph("UA_total") / 1000.0,
               HDD_x_sqft=x("hdd") * x("area") / 1000.0,
               CDD_x_sqft=x("cdd") * x("area") / 1000.0,
               HDD_x_CDD=x("hdd") * x("cdd") / 1000.0,
               vintage_x_HDD=ph("age") * x("hdd") / 1000.0,
               occ_x_sqft=x("people") * x("area") / 1000.0,
               envelope_quality=1.0 / (1.0 + ph("UA_total") / x("area") * 100.0))
    # scores: estimated energy by use
    cooling_energy = ph("cooling_load") / F.greatest(ph("cooling_eff"), F.lit(0.1))
    if not strict:
        cooling_energy = F.when(ph("has_cooling") == 1, cooling_energy).otherwise(0.0)
    df = df.withColumns({
        "_ph_heat_use": ph("heating_load") / ph("heating_eff"),
        "_ph_cool_use": cooling_energy,
        "_ph_dhw_use": ph("dhw_load") / ph("dhw_eff")})
    df = df.withColumn("_ph_use", F.col("_ph_heat_use") + F.col("_ph_cool_use")
                       + F.col("_ph_dhw_use") + ph("base_load"))
    floor_use = F.greatest(F.col("_ph_use"), F.lit(1.0))
    insulation_grade = code_map(x("insul"), {v: k for k, v in K.INSULATION_FACTOR.items()}, 2.0)
    df = stage(df,
               eui_estimate=F.col("_ph_use") / x("area"),
               heating_share_est=F.col("_ph_heat_use") / floor_use,
               cooling_share_est=F.col("_ph_cool_use") / floor_use,
               dhw_share_est=F.col("_ph_dhw_use") / floor_use,
               efficiency_score=ph("envelope_quality") * F.least(ph("heating_eff"), F.lit(1.0))
               * insulation_grade / 4.0)
    return df.drop(*[c for c in df.columns if c.startswith(_INPUT)])


def physics_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(K.PHYSICS_PREFIX)]


def default_equipment_heat_pumps(df: DataFrame) -> DataFrame:
    """Electric homes counted as heat pumps only because their equipment is unknown."""
    unknown = as_number("EQUIPM").isNull() if "EQUIPM" in df.columns else F.lit(True)
    return df.agg(F.count_if((default_number(df, "FUELHEAT", 1.0) == 5) & unknown)
                  .alias("n_defaulted_heat_pumps"))


def paired_correlation(df: DataFrame, a: str, b: str, min_pairs: int = 30) -> DataFrame:
    """Pearson correlation over complete pairs; NULL unless more than ``min_pairs``."""
    x, y = as_number(a), as_number(b)
    both = x.isNotNull() & y.isNotNull()
    return (df.agg(F.count_if(both).alias("n_pairs"), F.corr(x, y).alias("r"))
            .select("n_pairs", F.when(F.col("n_pairs") > min_pairs, F.col("r")).alias("r")))


def feature_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and valid count per feature, one scan: ``(feature, mean, n_valid)``."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                 *[F.count(c).alias(f"n_{c}") for c in columns])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"),
                 F.col(f"n_{c}").alias("n_valid")) for c in columns])))
