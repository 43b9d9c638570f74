"""SQL statements equivalent to the registered queries, for the check engine."""

from __future__ import annotations

ORACLES: dict[str, str] = {}
# The physics columns that each query of a group publishes.
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
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def uniform(key: str, seed: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {key}, '{seed}')), 1, 13))::bigint::double / 4503599627370496::double)"


def bucket(key: str, seed: str, n: int) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {key}, '{seed}')), 1, 13))::bigint % {n})::int"


def split_of(key: str, seed: str = "42") -> str:
    u = uniform(key, seed)
    return (f"case when {u} < 0.7 then 'train' when {u} < 0.8 then 'val' "
            f"when {u} < 0.85 then 'calib' else 'test' end")


def mapped(column: str, table: dict, default: str = "null") -> str:
    return f"case {column} " + " ".join(f"when {k} then {v}::double" for k, v in table.items()) + f" else {default} end"


# ---- weather ------------------------------------------------------------------

STATION = """
hourly as (select l_suppkey station_number, l_quantity t, l_extendedprice g, l_discount h, l_tax w from lineitem),
st as (select station_number,
  sum(greatest(18.3::double - t, 0) / 24) "TMY3_HDD65", sum(greatest(t - 18.3::double, 0) / 24) "TMY3_CDD65",
  avg(t) "TMY3_TDB_mean", stddev_samp(t) "TMY3_TDB_std", max(t) "TMY3_TDB_max",
  avg(g) "TMY3_GHI_mean", stddev_samp(g) "TMY3_GHI_std", max(g) "TMY3_GHI_max",
  avg(h) "TMY3_RH_mean", stddev_samp(h) "TMY3_RH_std", max(h) "TMY3_RH_max",
  avg(w) "TMY3_WSPD_mean", stddev_samp(w) "TMY3_WSPD_std", max(w) "TMY3_WSPD_max",
  count(*) "TMY3_n_hours" from hourly group by 1),
station as (select *, "TMY3_HDD65" / greatest("TMY3_CDD65", 1) "TMY3_HDD_CDD_ratio",
  least(greatest("TMY3_HDD65" / 30, 0), 12) "TMY3_heating_months",
  least(greatest("TMY3_CDD65" / 30, 0), 12) "TMY3_cooling_months",
  "TMY3_GHI_mean" * greatest("TMY3_GHI_max", 1) / 1000 "TMY3_solar_gain_index" from st)"""
SERIES = [f"TMY3_{s}_{f}" for s in ("TDB", "GHI", "RH", "WSPD") for f in ("mean", "std", "max")]
FEATURES = ["TMY3_HDD65", "TMY3_CDD65", *SERIES, "TMY3_HDD_CDD_ratio", "TMY3_heating_months",
            "TMY3_cooling_months", "TMY3_solar_gain_index"]


def r(names, d=4, q='"'):
    return ", ".join(f"round({q}{n}{q}, {d}) {q}{n}{q}" for n in names)


ORACLES["station_climate"] = f"""with {STATION}
select station_number, {r(FEATURES)}, "TMY3_n_hours" from station"""
ORACLES["station_climate_stream"] = f"""with {STATION}
select station_number, {r(FEATURES, 6)}, "TMY3_n_hours" from station"""
ORACLES["station_climate_events"] = f"""with h as (select user_id station_number, avg(value) t from events group by user_id, date_trunc('hour', ts)),
st as (select station_number, sum(greatest(18.3::double - t, 0) / 24) "TMY3_HDD65", sum(greatest(t - 18.3::double, 0) / 24) "TMY3_CDD65",
  avg(t) "TMY3_TDB_mean", stddev_samp(t) "TMY3_TDB_std", max(t) "TMY3_TDB_max", count(*) "TMY3_n_hours" from h group by 1),
s2 as (select *, "TMY3_HDD65" / greatest("TMY3_CDD65", 1) "TMY3_HDD_CDD_ratio",
  least(greatest("TMY3_HDD65" / 30, 0), 12) "TMY3_heating_months", least(greatest("TMY3_CDD65" / 30, 0), 12) "TMY3_cooling_months" from st)
select station_number, {', '.join(f'round("{c}", 10) "{c}"' for c in [*FEATURES[:2], *SERIES[:3], *FEATURES[14:17]])}, "TMY3_n_hours" from s2"""


def state_sql(class_weight: str) -> str:
    means = ", ".join(f'sum("{c}" * wt) filter ("{c}" is not null) / sum(wt) filter ("{c}" is not null) "{c}"'
                      for c in [*FEATURES, "TMY3ST_Lat", "TMY3ST_Elev"])
    return f"""{STATION},
meta as (select s_suppkey station_number, upper(trim(' st' || s_nationkey)) state_postal, {class_weight} cw,
  s_acctbal / 100 "TMY3ST_Lat", s_acctbal "TMY3ST_Elev" from supplier),
j as (select station.*, state_postal, "TMY3ST_Lat", "TMY3ST_Elev", cw * greatest("TMY3_n_hours", 1) wt
  from station join meta using (station_number)),
state as (select state_postal, {means}, count(*) "TMY3ST_n_stations" from j group by 1)"""


BY_CLASS = "case s_suppkey % 3 when 0 then 1.0::double when 1 then 0.7::double else 0.4::double end"
STATE_COLS = [*FEATURES, "TMY3ST_Lat", "TMY3ST_Elev"]
ORACLES["state_climate"] = f"""with {state_sql(BY_CLASS)}
select state_postal, {r(STATE_COLS)}, "TMY3ST_n_stations" from state"""
ORACLES["state_climate_first_letter"] = f"""with {state_sql('1.0::double')}
select state_postal, {r(STATE_COLS)}, "TMY3ST_n_stations" from state"""
GEO = f"""with {state_sql(BY_CLASS)},
hh as (select c_custkey "DOEID", upper('St' || c_nationkey) state_postal, c_acctbal "HDD65" from customer)"""
ORACLES["household_climate"] = f"""{GEO}
select state_postal, "DOEID", round("HDD65", 4) "HDD65", {r(STATE_COLS)}, "TMY3ST_n_stations"
from hh left join state using (state_postal)"""
ORACLES["climate_match_rate"] = f"""{GEO}
select count(*) n, count("TMY3_HDD65") n_matched, round(count("TMY3_HDD65")::double / count(*) * 100, 6) matched_pct
from hh left join state using (state_postal)"""
ORACLES["climate_crosscheck"] = f"""{GEO}
select count(*) n_pairs, round(case when count(*) > 30 then corr("TMY3_HDD65", "HDD65") end, 6) r
from hh join state using (state_postal) where "TMY3_HDD65" is not null and "HDD65" is not null"""

# ---- cleaning -----------------------------------------------------------------


def coded(x: str) -> str:
    return f"(case when {x} = 0 then -2 else {x} end)::double"


RAW = f"""raw as (select {KEY},
  case l_returnflag when 'A' then 'Very-Cold' when 'N' then 'Mixed-Humid' else 'Hot-Dry' end "BA_climate",
  l_extendedprice "TOTALBTU", l_quantity * 100 "TOTSQFT_EN", l_extendedprice * l_discount "TOTALBTUSPH",
  l_extendedprice * l_tax "BTUELCOL", l_extendedprice * l_discount * 0.5::double "TOTALBTUWTH",
  l_extendedprice * l_tax * 0.25::double "BTUELLGT", l_quantity "NWEIGHT",
  {coded('l_partkey % 12')} "YEARMADERANGE",
  (1000 + (l_suppkey % 50) * 150)::double "HDD65", (3500 - (l_suppkey % 50) * 60)::double "CDD65",
  l_linenumber::double "NHSLDMEM", (1 + l_linenumber % 3)::double "STORIES",
  {coded('l_suppkey % 8')} "WALLTYPE", {coded('l_linenumber % 4')} "TYPEGLASS", l_quantity "WINDOWS",
  {coded('l_partkey % 5')} "ADQINSUL", {coded('l_orderkey % 5')} "DRAFTY", {coded('l_linenumber % 8')} "FUELHEAT",
  {coded('l_suppkey % 13')} "EQUIPM", case when l_linestatus = 'O' then 1.0::double else 0.0::double end "AIRCOND",
  {coded('l_partkey % 4')} "TYPEAC", (l_orderkey % 2)::double "HEATPUMP" from lineitem)"""
CODED = ["WALLTYPE", "TYPEGLASS", "ADQINSUL", "DRAFTY", "FUELHEAT", "EQUIPM", "TYPEAC", "YEARMADERANGE"]
YEARS = {1: 1935, 2: 1945, 3: 1955, 4: 1965, 5: 1975, 6: 1985, 7: 1995, 8: 2005, 9: 2012, 10: 2017, 11: 2020}
USES = {"HEATING": "TOTALBTUSPH", "COOLING": "BTUELCOL", "DHW": "TOTALBTUWTH", "LIGHTING": "BTUELLGT"}
INTENSITY = ", ".join(f'"{b}" / greatest("TOTSQFT_EN", 1) "EUI_{u}", case when "TOTALBTU" > 0 then "{b}" / "TOTALBTU" end "SHARE_{u}"'
                      for u, b in USES.items())
HH = f"""{RAW},
hh as (select * replace ({', '.join(f'case when "{c}" = -2 then null else "{c}" end as "{c}"' for c in CODED)}),
  {mapped('"YEARMADERANGE"::int', YEARS)} "YEAR_BUILT", "TOTALBTU" / greatest("TOTSQFT_EN", 1) "EUI", {INTENSITY},
  case "BA_climate" when 'Very-Cold' then 'Cold' when 'Hot-Dry' then 'Hot' else 'Mixed' end "BA_climate_SIMPLE" from raw)"""
EUI_COLS = ["EUI", *[f"EUI_{u}" for u in USES], *[f"SHARE_{u}" for u in USES]]
ORACLES["sentinel_clean"] = f"""with {RAW} select {KEY},
nullif("WALLTYPE", -2) "WALLTYPE", nullif("TYPEGLASS", -2) "TYPEGLASS", nullif("ADQINSUL", -2) "ADQINSUL", nullif("DRAFTY", -2) "DRAFTY" from raw"""
_NUMERIC = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "TOTALBTU", "TOTSQFT_EN", "TOTALBTUSPH", "BTUELCOL", "TOTALBTUWTH",
            "BTUELLGT", "NWEIGHT", "YEARMADERANGE", "HDD65", "CDD65", "NHSLDMEM", "STORIES", "WALLTYPE", "TYPEGLASS",
            "WINDOWS", "ADQINSUL", "DRAFTY", "FUELHEAT", "EQUIPM", "AIRCOND", "TYPEAC", "HEATPUMP"]
ORACLES["sentinel_counts"] = f"with {RAW} " + " union all ".join(
    f"""select '{c}' "column", count(*) filter ("{c}" in (-2,-3,-4,-5,-6,-7,-8,-9,-99,-999,999999999)) n_missing_codes from raw"""
    for c in _NUMERIC)
ORACLES["observed_counts"] = (f"{GEO}, {RAW} " + " union all ".join(
    f"""select 'code:{c}' measure, count(*) filter ("{c}" in (-2,-3,-4,-5,-6,-7,-8,-9,-99,-999,999999999)) n from raw""" for c in _NUMERIC)
    + """ union all select 'homes', count(*) from hh union all select 'homes_with_climate', count("TMY3_HDD65") from hh left join state using (state_postal)
union all select 'eui_missing', count(*) filter ("TOTALBTU" is null or "TOTSQFT_EN" is null) from raw""")
ORACLES["vintage_year"] = f"""with {HH} select "YEAR_BUILT", count(*) n from hh group by 1"""
ORACLES["energy_intensity"] = f"with {HH} select {KEY}, {', '.join(f'"{c}"' for c in EUI_COLS)} from hh"
ORACLES["zone_coarsen"] = f"""with {HH} select "BA_climate", "BA_climate_SIMPLE", count(*) n from hh group by 1, 2"""
ORACLES["eui_report"] = f"""with {HH} select count("EUI") n, round(avg("EUI"), 4) mean_eui,
round(median("EUI"), 4) median_eui, round(quantile_cont("EUI", 0.01), 4) p01_eui, round(quantile_cont("EUI", 0.99), 4) p99_eui,
median("EUI") between 20 and 80 in_range from hh"""
ORACLES["normalised_weights"] = f"""with s as (select l_quantity w, {split_of(KEY)} split from lineitem),
n as (select split, w / avg(w) over (partition by split) w from s)
select split, count(*) n, round(avg(w), 4) mean_w, round(sum(w), 4) sum_w, round(max(w), 4) max_w from n group by 1"""
_KEPT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "BA_climate", "TOTSQFT_EN", "YEARMADERANGE", "HDD65", "CDD65", "NHSLDMEM",
         "STORIES", "WALLTYPE", "TYPEGLASS", "WINDOWS", "ADQINSUL", "DRAFTY", "FUELHEAT", "EQUIPM", "AIRCOND", "TYPEAC",
         "HEATPUMP", "YEAR_BUILT", "BA_climate_SIMPLE"]
ORACLES["guarded_features"] = f"""with {HH} select '{','.join(_KEPT)}' kept, count(*) n, round(avg("NHSLDMEM"), 4) mean_people from hh"""
ORACLES["aligned_schema"] = f"""with {HH} select 'NHSLDMEM,NOT_THERE,TOTSQFT_EN' "columns", count("NHSLDMEM") n_people, 0 n_absent,
round(avg("TOTSQFT_EN"), 4) mean_area from hh"""
ORACLES["target_columns"] = f"""with {HH} select "BA_climate", {', '.join(
    f'round(avg("{c}"), 4) "mean_{c}"' for c in ("TOTALBTU", "EUI", "EUI_HEATING", "SHARE_COOLING"))},
round(avg("NWEIGHT"), 4) "mean__w", round(avg(ln(1 + "TOTALBTU")), 4) "mean_y_log" from hh group by 1"""

# ---- physics ------------------------------------------------------------------

PHYSICS = f"""{HH},
i as (select *, greatest("TOTSQFT_EN", 50) a, least(greatest("STORIES", 1), 6) s, greatest("HDD65", 0) h, greatest("CDD65", 0) c,
  greatest("NHSLDMEM", 1) n, coalesce("YEAR_BUILT", 1980) y, least(greatest("WINDOWS", 1), 12) win,
  coalesce({mapped('"WALLTYPE"::int', {1: .30, 2: .18, 3: .25, 4: .20, 5: .22, 6: .35, 7: .28, 99: .22})}, 0.22::double) wu,
  coalesce({mapped('"TYPEGLASS"::int', {1: 1.0, 2: .55, 3: .35})}, 0.65::double) gu,
  coalesce({mapped('"ADQINSUL"::int', {1: 1.25, 2: 1.0, 3: .8, 4: .65})}, 1.0::double) ins,
  coalesce({mapped('"ADQINSUL"::int', {1: 1, 2: 2, 3: 3, 4: 4})}, 2.0::double) grade,
  coalesce({mapped('"DRAFTY"::int', {1: 14, 2: 10, 3: 6.5, 4: 4})}, 9.0::double) ach,
  coalesce("FUELHEAT", 1) fuel, coalesce("EQUIPM", 3) eq, "TYPEAC" act from hh),
g as (select *, s * 9::double "PH_building_height", a / s "PH_footprint_area", 4::double * sqrt(greatest(a / s, 25)) "PH_building_perimeter",
  a / s "PH_roof_area", a * 9::double "PH_building_volume", ln(1 + a) "PH_log_sqft", greatest(2020 - y, 0)::double "PH_age",
  wu * ins "PH_U_wall", 0.08::double * ins "PH_U_roof", gu "PH_U_window",
  least(greatest(0.06::double + 0.02::double * win, 0.08::double), 0.30::double) "PH_window_wall_ratio", ins "PH_ceiling_insul",
  ach / 20 "PH_ACH_natural" from i),
g2 as (select *, "PH_building_perimeter" * "PH_building_height" "PH_wall_area" from g),
g3 as (select *, "PH_wall_area" + "PH_roof_area" + "PH_footprint_area" "PH_surface_area", "PH_wall_area" * "PH_window_wall_ratio" "PH_window_area" from g2),
u as (select *, "PH_surface_area" / greatest("PH_building_volume", 1) "PH_surface_volume_ratio", "PH_surface_area" / a "PH_surface_factor",
  "PH_U_wall" * greatest("PH_wall_area" - "PH_window_area", 0) "PH_UA_wall", "PH_U_window" * "PH_window_area" "PH_UA_window",
  "PH_U_roof" * "PH_roof_area" "PH_UA_roof", 0.10::double * "PH_footprint_area" "PH_UA_floor",
  0.018::double * "PH_building_volume" * "PH_ACH_natural" "PH_UA_infiltration" from g3),
t as (select *, "PH_UA_wall" + "PH_UA_window" + "PH_UA_roof" + "PH_UA_floor" + "PH_UA_infiltration" "PH_UA_total",
  (case when y < 1990 then 0.25::double else 0.10::double end) * ("PH_UA_wall" + "PH_UA_roof") "PH_duct_leakage",
  greatest(case when fuel = 5 and (eq in (3, 10) or "HEATPUMP" = 1) then 2.30::double when fuel = 5 then 0.98::double
    else coalesce({mapped('fuel::int', {1: .80, 2: .78, 3: .78, 7: .55})}, 0.80::double)
       * coalesce({mapped('eq::int', {3: 1.0, 4: .85, 5: .92, 7: .88, 10: 1.0, 12: 1.0})}, 0.95::double) end, 0.3::double) "PH_heating_eff",
  case when "AIRCOND" = 1 then coalesce({mapped('coalesce(act, 2)::int', {1: 3.2, 2: 3.0, 3: 2.6})}, 2.8::double) else 0::double end "PH_cooling_eff",
  case when fuel = 5 then 0.92::double else 0.62::double end "PH_dhw_eff", "AIRCOND" "PH_has_cooling" from u),
l as (select *, "PH_UA_total" * h * 24 / 1000 "PH_heating_load",
  ("PH_UA_total" * 0.8::double + "PH_UA_infiltration" * 0.5::double) * c * 24 / 1000 "PH_cooling_load",
  n * 22 * 8.34::double * 70 * 365 / 1000 "PH_dhw_load", "PH_window_area" * c * 0.30::double / 1000 "PH_solar_gain",
  (a * 3.5::double + n * 800) / 1000 "PH_base_load", h * "PH_UA_total" / 1000 "PH_HDD_x_UA", c * "PH_UA_total" / 1000 "PH_CDD_x_UA",
  h * a / 1000 "PH_HDD_x_sqft", c * a / 1000 "PH_CDD_x_sqft", h * c / 1000 "PH_HDD_x_CDD", "PH_age" * h / 1000 "PH_vintage_x_HDD",
  n * a / 1000 "PH_occ_x_sqft", 1 / (1 + "PH_UA_total" / a * 100) "PH_envelope_quality" from t)"""


def scores_sql(strict: bool) -> str:
    cool = '"PH_cooling_load" / greatest("PH_cooling_eff", 0.1::double)'
    if not strict:
        cool = f'case when "PH_has_cooling" = 1 then {cool} else 0 end'
    return f"""{PHYSICS},
e as (select *, "PH_heating_load" / "PH_heating_eff" eh, {cool} ec, "PH_dhw_load" / "PH_dhw_eff" ed from l),
e2 as (select *, eh + ec + ed + "PH_base_load" et from e),
ph as (select *, et / a "PH_eui_estimate", eh / greatest(et, 1) "PH_heating_share_est", ec / greatest(et, 1) "PH_cooling_share_est",
  ed / greatest(et, 1) "PH_dhw_share_est", "PH_envelope_quality" * least("PH_heating_eff", 1) * grade / 4 "PH_efficiency_score" from e2)"""


PH = scores_sql(False)
for _group, _names in GROUPS.items():
    ORACLES[f"physics_{_group}"] = f"with {PH} select {KEY}, {r([f'PH_{c}' for c in _names], 6)} from ph"
ORACLES["physics_scores_strict"] = (f"with {scores_sql(True)} select {KEY}, "
                                    f"{r([f'PH_{c}' for c in GROUPS['scores']], 6)} from ph")
_ALL_PH = [f"PH_{c}" for g in GROUPS.values() for c in g]
ORACLES["physics_summary"] = f"with {PH} " + " union all ".join(
    f"""select '{c}' feature, round(avg("{c}"), 3) mean, count("{c}") n_valid from ph""" for c in _ALL_PH)
ORACLES["physics_corr"] = f"""with {PH} select count(*) n_pairs, round(corr("PH_eui_estimate", "EUI"), 6) r from ph"""
ORACLES["defaulted_heat_pumps"] = f"""with {HH} select count(*) filter ("FUELHEAT" = 5 and "EQUIPM" is null) n_defaulted_heat_pumps from hh"""

# ---- harmonisation --------------------------------------------------------------


def pick(index: str, words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][({index})::int]"


TEXT = f"""txt as (select p_partkey,
  {pick('p_partkey % 6 + 1', ['Single-Family Detached', 'Single-Family Attached', 'Mobile Home', 'Multi-Family with 2 - 4 Units', 'Multi-Family with 5+ Units', 'Houseboat'])} "TYPEHUQ",
  {pick('p_partkey % 6 + 1', ['Electricity', ' natural gas', 'Propane', 'FUEL OIL', 'Wood', 'Steam'])} "FUELHEAT",
  {pick('p_size % 6 + 1', ['Electricity ASHP', 'Electric Baseboard', 'Natural Gas Fuel Boiler', 'Propane Fuel Furnace', 'Electric Furnace', 'None'])} "EQUIPM",
  round(p_retailprice / 80, 1) ach, case when p_size % 7 = 0 then null else p_size::double end rv,
  {pick('p_size % 4 + 1', ['Single, Clear', 'Double, Clear', 'Double, Low-E', 'Triple, Clear'])} windows,
  {pick('p_size % 5 + 1', ['One', 'two ', 'Three', '4', 'many'])} "STORIES",
  {pick('p_partkey % 9 + 1', ['Very-Cold', 'Cold', 'Marine', 'Mixed-Humid', 'Mixed-Dry', 'Hot-Humid', 'Hot-Dry', 'Subarctic', 'Tundra'])} zone,
  p_size, p_brand from part)"""
CODES = f"""{TEXT},
k as (select p_partkey,
  {mapped('lower(trim("TYPEHUQ"))', {"'single-family detached'": 2, "'single-family attached'": 3, "'mobile home'": 1, "'multi-family with 2 - 4 units'": 4, "'multi-family with 5+ units'": 5})} type_code,
  {mapped('lower(trim("FUELHEAT"))', {"'electricity'": 5, "'natural gas'": 1, "'propane'": 3, "'fuel oil'": 2, "'wood'": 7})} fuel_code,
  case "EQUIPM" when 'Electricity ASHP' then 3.0 when 'Electric Baseboard' then 12.0 when 'Natural Gas Fuel Boiler' then 7.0
    when 'Propane Fuel Furnace' then 2.0 when 'Electric Furnace' then 12.0 end::double equip_code,
  (case when ach >= 13 then 1 when ach >= 8.5 then 2 when ach >= 5.5 then 3 else 4 end)::double drafty,
  (case when rv is null then null when rv < 19 then 1 when rv < 30 then 2 when rv < 38 then 3 else 4 end)::double insul,
  (case when windows like '%Low-E%' then 3 when windows like 'Single%' then 1 when windows like 'Triple%' then 3 else 2 end)::double glass,
  (case trim("STORIES") when 'One' then 1 when 'two' then 2 when 'Three' then 3 when '4' then 4 end)::double stories,
  (case when p_size < 10 then 1935 when p_size > 45 then null else p_size // 10 * 10 + 1940 + 5 end)::double year_built,
  {mapped('zone', {"'Very-Cold'": 9000, "'Cold'": 6500, "'Marine'": 4200, "'Mixed-Humid'": 4300, "'Mixed-Dry'": 4500, "'Hot-Humid'": 1600, "'Hot-Dry'": 1800, "'Subarctic'": 12000})}
    * (0.85::double + 0.30::double * {uniform('p_partkey', '42-hdd')}) hdd,
  {mapped('zone', {"'Very-Cold'": 350, "'Cold'": 700, "'Marine'": 450, "'Mixed-Humid'": 1500, "'Mixed-Dry'": 1200, "'Hot-Humid'": 3200, "'Hot-Dry'": 3000, "'Subarctic'": 200})}
    * (0.85::double + 0.30::double * {uniform('p_partkey', '42-cdd')}) cdd, p_size * 60::double a from txt)"""
ORACLES["harmonise_codes"] = f"with {CODES} select p_partkey, type_code, fuel_code, equip_code, drafty, insul, glass, stories from k"
ORACLES["first_number"] = "select substr(o_orderpriority, 1, 1)::double level, count(*) n from orders group by 1"
ORACLES["text_numbers"] = f"""with {TEXT} select p_partkey, regexp_extract(p_brand, '[0-9]+')::double brand_no, ach ach50, rv r_value from txt"""
ORACLES["vintage_text"] = f"with {CODES} select p_partkey, year_built from k"
ORACLES["zone_degree_days"] = f"with {CODES} select p_partkey, round(hdd, 6) hdd, round(cdd, 6) cdd from k"
ORACLES["harmonised_physics"] = f"""with {CODES},
f as (select *, greatest(a, 50) a2, coalesce(stories, 1.5) s, greatest(coalesce(hdd, 4500), 0) h, coalesce({mapped('insul::int', {1: 1.25, 2: 1.0, 3: .8, 4: .65})}, 1.0::double) ins,
  {mapped('glass::int', {1: 1.0, 2: .55, 3: .35})} gu, {mapped('drafty::int', {1: 14, 2: 10, 3: 6.5, 4: 4})} ac, coalesce(fuel_code, 1) fuel, coalesce(equip_code, 3) eq from k),
g as (select *, a2 / least(greatest(s, 1), 6) fp, 4 * sqrt(greatest(a2 / least(greatest(s, 1), 6), 25)) * least(greatest(s, 1), 6) * 9 wall from f),
w as (select *, wall * least(greatest(0.06::double + 0.02::double * 5, 0.08::double), 0.30::double) win from g),
u as (select *, 0.22::double * ins * greatest(wall - win, 0) + gu * win + 0.08::double * ins * fp + 0.10::double * fp + 0.018::double * (a2 * 9) * (ac / 20) ua from w)
select p_partkey, drafty "DRAFTY", insul "ADQINSUL", glass "TYPEGLASS", year_built "YEAR_BUILT", round(ua, 4) "PH_UA_total",
  round(greatest(case when fuel = 5 and eq in (3, 10) then 2.30 when fuel = 5 then 0.98 else
    coalesce({mapped('fuel::int', {1: .80, 2: .78, 3: .78, 7: .55})}, 0.80::double) * coalesce({mapped('eq::int', {3: 1.0, 4: .85, 5: .92, 7: .88, 10: 1.0, 12: 1.0})}, 0.95::double) end, 0.3), 4)::double "PH_heating_eff",
  round(ua * h * 24 / 1000, 4) "PH_heating_load" from u"""

# ---- measured savings -------------------------------------------------------------

_BASE = """l_orderkey || '-' || l_linenumber bldg_id, l_returnflag "BA_climate", l_linenumber "TYPEHUQ", (l_suppkey % 5)::int "FUELHEAT",
l_linestatus infiltration, l_quantity * 100 "TOTSQFT_EN", (l_partkey % 6)::varchar vintage"""
_ENERGY = {0: "l_extendedprice", 3: "l_extendedprice * (1 - l_tax)", 4: "l_extendedprice * (1 - l_discount * 0.5::double - l_tax)",
           10: "case when l_linestatus = 'F' and l_quantity > 20 then l_extendedprice * (1 - l_discount) end",
           11: "case when l_linenumber = 3 then l_extendedprice * (1 + l_tax) end",
           15: "case when l_quantity > 4 then l_extendedprice * (1 - l_discount * l_tax) end"}
STOCK = "stock as (select * from (" + " union all ".join(
    f"select {_BASE}, {u} upgrade, {e} e from lineitem" for u, e in _ENERGY.items()) + ") where e is not null)"
UPS = "ups as (select unnest([3, 4, 10, 11, 15])::int upgrade)"
NAIVE = f"""{STOCK}, {UPS},
naive as (select upgrade, (1 - avg(e) / (select avg(e) from stock where upgrade = 0)) * 100 naive_pct,
  count(*)::double / (select count(*) from stock where upgrade = 0) * 100 coverage_pct from stock where upgrade > 0 group by 1)"""
PAIRED = """paired as (select u.upgrade, count(*) n_pairs, case when count(*) > 100 then avg((b.e - u.e) / b.e) * 100 end paired_pct
  from stock b join stock u using (bldg_id) where b.upgrade = 0 and u.upgrade > 0 and b.e > 0 and u.e >= 0 group by 1)"""


def cells_sql(name: str, base_filter: str, up_filter: str = "true") -> str:
    return f"""{name}_c as (select u.upgrade, nb, mb, mu from
  (select "BA_climate", "TYPEHUQ", "FUELHEAT", count(*) nb, avg(e) mb from stock where upgrade = 0 and {base_filter} group by 1, 2, 3) b
  join (select upgrade, "BA_climate", "TYPEHUQ", "FUELHEAT", avg(e) mu from stock where upgrade > 0 and {up_filter} group by 1, 2, 3, 4) u
  using ("BA_climate", "TYPEHUQ", "FUELHEAT")),
{name} as (select upgrade, count(*) n_cells, (1 - sum(nb * mu) / sum(nb * mb)) * 100 pct, sum(nb) n_base from {name}_c group by 1)"""


MATCHED = cells_sql("matched", "true")
S10 = cells_sql("s10", "infiltration in (select distinct infiltration from stock where upgrade = 10)", "upgrade = 10")
S11 = cells_sql("s11", '"TYPEHUQ" in (select distinct "TYPEHUQ" from stock where upgrade = 11)', "upgrade = 11")
_PLAIN = """case when n_cells >= 20 then pct else (1 - (select avg(e) from stock where upgrade = {u}) /
  (select avg(e) from stock where upgrade = 0 and {f})) * 100 end"""
_P10 = _PLAIN.format(u=10, f="infiltration = 'F'")
_P11 = _PLAIN.format(u=11, f='"TYPEHUQ" = 3')
SHARED = f"""{S10}, {S11},
shared as (select upgrade, case upgrade when 10 then 'infiltration' when 11 then 'TYPEHUQ' else '' end drivers,
  case upgrade when 10 then (select count(*) from stock where upgrade = 0 and infiltration = 'F')
    when 11 then (select count(*) from stock where upgrade = 0 and "TYPEHUQ" = 3) else (select count(*) from stock where upgrade = 0) end n_base_restricted,
  case upgrade when 10 then (select n_cells from s10) when 11 then (select n_cells from s11) end n_cells,
  case upgrade when 10 then (select {_P10} from s10) when 11 then (select {_P11} from s11) end shared_support_pct from ups)"""
ORACLES["naive_delta"] = f"with {NAIVE} select upgrade, round(naive_pct, 6) naive_pct, round(coverage_pct, 6) coverage_pct from naive"
ORACLES["paired_delta"] = f"with {STOCK}, {PAIRED} select upgrade, n_pairs, round(paired_pct, 6) paired_pct from paired"
ORACLES["matched_cell_delta"] = f"""with {STOCK}, {MATCHED} select upgrade, n_cells,
round(case when n_cells >= 30 then pct end, 6) matched_pct from matched"""
_DRIVERS = [("BA_climate", True), ("TYPEHUQ", False), ("FUELHEAT", False), ("infiltration", True), ("TOTSQFT_EN", False), ("vintage", True)]
_LONG = "long as (" + " union all ".join(
    f"""select upgrade, {i} pos, {str(t).lower()} is_text, '{c}' "column", "{c}"::varchar v from stock""" for i, (c, t) in enumerate(_DRIVERS)) + ")"
_DC = f"""{STOCK}, {UPS}, {_LONG},
vals as (select distinct upgrade, pos, is_text, "column", v from long where v is not null),
base as (select pos, count(*) n_base from vals where upgrade = 0 group by 1),
dc as (select u.upgrade, u.pos, u.is_text, u."column", count(*) n_up, any_value(n_base) n_base,
  count(*) filter (not exists (select 1 from vals b where b.upgrade = 0 and b.pos = u.pos and b.v = u.v)) n_new
  from vals u join base using (pos) where u.upgrade > 0 group by 1, 2, 3, 4)"""
ORACLES["driver_columns"] = f"""with {_DC},
hit as (select upgrade, "column", row_number() over (partition by upgrade order by pos) rn from dc
  where n_new = 0 and ((is_text and n_up < n_base) or (not is_text and n_up = 1 and n_base > 1)))
select ups.upgrade, coalesce((select string_agg("column", ',' order by rn) from hit where hit.upgrade = ups.upgrade and rn <= 3), '') drivers from ups"""
ORACLES["driver_values"] = f"""with {_DC} select upgrade, "column", n_up, n_base, n_new from dc where is_text"""
ORACLES["shared_support_delta"] = f"""with {STOCK}, {UPS}, {SHARED}
select upgrade, drivers, n_base_restricted, n_cells, round(shared_support_pct, 6) shared_support_pct from shared"""


def measured_sql(ids: bool) -> str:
    paired = ("paired_pct, coalesce(n_pairs, 0) n_pairs" if ids else "null::double paired_pct, 0 n_pairs")
    return f"""{NAIVE}, {PAIRED}, {MATCHED}, {SHARED},
m0 as (select n.upgrade, naive_pct, coverage_pct, {paired}, m.n_cells, case when m.n_cells >= 100 then m.pct end matched_pct,
  drivers, n_base_restricted, case when coverage_pct < 95 then shared_support_pct end shared_support_pct
  from naive n left join paired using (upgrade) left join matched m using (upgrade) left join shared using (upgrade)),
measured as (select *, coalesce(paired_pct, shared_support_pct, matched_pct, naive_pct) reported_pct,
  case when paired_pct is not null then 'paired' when shared_support_pct is not null then 'shared_support'
    when matched_pct is not null then 'matched' else 'naive' end estimator,
  coalesce(sign(coalesce(paired_pct, shared_support_pct, matched_pct)) <> sign(naive_pct), false) sign_flip from m0)"""


_MEASURED = """select upgrade, round(naive_pct, 6) naive_pct, round(coverage_pct, 6) coverage_pct, n_pairs, round(paired_pct, 6) paired_pct,
n_cells, round(matched_pct, 6) matched_pct, drivers, n_base_restricted, round(shared_support_pct, 6) shared_support_pct,
round(reported_pct, 6) reported_pct, estimator, sign_flip from measured"""
ORACLES["measured_deltas"] = f"with {measured_sql(True)} {_MEASURED}"
ORACLES["measured_deltas_without_ids"] = f"with {measured_sql(False)} {_MEASURED}"
ORACLES["duplicate_buildings"] = f"""with {STOCK}, d as (select upgrade, bldg_id from stock group by 1, 2 having count(*) > 1)
select upgrade, count(*) n_duplicate_ids from d group by 1"""
ORACLES["cell_pairs"] = f"""with {STOCK},
k as (select *, coalesce(round("TOTSQFT_EN" / 500)::bigint::varchar, 'NA') k0 from stock),
c as (select u.upgrade, k0, vintage, "TYPEHUQ", "BA_climate", "FUELHEAT", count(*) filter (k.upgrade = 0) n_base, count(*) filter (k.upgrade = u.upgrade) n_up,
  avg(e) filter (k.upgrade = 0) e_base, avg(e) filter (k.upgrade = u.upgrade) e_up, avg("TOTSQFT_EN") filter (k.upgrade = 0) a
  from k join (select unnest([3, 4, 10, 11, 15]) upgrade) u on k.upgrade in (0, u.upgrade) group by 1, 2, 3, 4, 5, 6)
select upgrade, k0 "k_TOTSQFT_EN", vintage k_vintage, "TYPEHUQ"::varchar "k_TYPEHUQ", "BA_climate" "k_BA_climate", "FUELHEAT"::varchar "k_FUELHEAT",
n_base, n_up, round(e_base * n_base, 6) sum_base, round(e_up * n_up, 6) sum_up, round(a * n_base, 6) sum_area,
round(least(greatest((e_base - e_up) / e_base * 100, -50), 90), 8) saving_pct from c where e_base is not null and e_up is not null"""
ORACLES["site_energy"] = f"""with {STOCK} select "BA_climate", round(avg(e * 3.412::double), 3) mean_kbtu, count(e) n from stock where upgrade = 0 group by 1"""

# ---- splits -------------------------------------------------------------------------

ORACLES["stratified_split"] = """with k as (select o_orderkey, o_orderpriority,
  (row_number() over (partition by o_orderpriority order by md5(concat_ws('|', o_orderkey, '42'))) - 1)::double
    / count(*) over (partition by o_orderpriority) f from orders)
select o_orderkey, o_orderpriority, case when f < 0.7 then 'train' when f < 0.8 then 'val' when f < 0.85 then 'calib' else 'test' end split from k"""
ORACLES["split_balance"] = f"select o_orderpriority, {split_of('o_orderkey')} split, count(*) n from orders group by 1, 2"
ORACLES["kfold_counts"] = f"""select {bucket('o_orderkey', '42', 5)} fold, count(*) n, sum(o_orderkey)::bigint key_sum from orders group by 1"""
ORACLES["row_sample"] = f"select o_orderkey from orders order by {uniform('o_orderkey', '42')}, o_orderkey limit 500"

# ---- metrics --------------------------------------------------------------------------

PRED = f"""pr as (select o_orderkey, o_orderpriority, o_totalprice y, o_totalprice * (0.8::double + 0.4::double * {uniform('o_orderkey', 'pred')}) p,
  1.0::double + o_custkey % 7 w, {split_of('o_orderkey')} split from orders),
pred as (select *, ln(1 + y) ly, ln(1 + p) lp from pr)"""


def metric_cols(y="y", p="p", d=4):
    return f"""count(*) n, round(1 - avg(({y} - {p}) * ({y} - {p})) / var_pop({y}), {d}) r2, round(sqrt(avg(({y} - {p}) * ({y} - {p}))), {d}) rmse,
round(avg(abs({y} - {p})), {d}) mae, round(100 * (avg({p}) - avg({y})) / greatest(abs(avg({y})), 1e-9), {d}) nmbe_pct,
round(100 * sqrt(avg(({y} - {p}) * ({y} - {p}))) / greatest(abs(avg({y})), 1e-9), {d}) cvrmse_pct"""


_WR2 = "1 - sum(w * (y - p) * (y - p)) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w))"
ORACLES["regression_metrics"] = f"with {PRED} select split, {metric_cols()}, round({_WR2}, 4) r2_weighted from pred group by 1"
ORACLES["weighted_r2"] = f"""with {PRED} select count(*) n, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) r2, round({_WR2}, 6) r2_weighted from pred"""
ORACLES["population_calibration"] = f"""with {PRED} select o_orderpriority, count(*) n, round(sum(y * w), 2) weighted_total_true,
round(sum(p * w), 2) weighted_total_pred, round(100 * (sum(p * w) - sum(y * w)) / greatest(sum(y * w), 1e-9), 4) calibration_error_pct from pred group by 1"""
CONF = f"""{PRED}, al as (select unnest([0.2::double, 0.1::double, 0.05::double]) alpha),
res as (select row_number() over (order by abs(ly - lp)) k, abs(ly - lp) r, count(*) over () n from pred where split = 'calib'),
q as (select alpha, n, r q from al join res on k = least(ceil((n + 1) * (1 - alpha)), n))"""
ORACLES["conformal_q"] = f"with {CONF} select alpha, n, round(q, 8) q from q"
ORACLES["conformal_curve"] = f"""with {CONF},
c as (select alpha, any_value(q) q, count(*) n, avg((ly between lp - q and lp + q)::int) observed from q cross join pred where split = 'test' group by 1)
select n, round(1 - alpha, 3) nominal, round(q, 6) q, round(observed, 6) observed, abs(observed - round(1 - alpha, 3)) * 100 > 3 warn from c"""
_BOUNDS = f"""{CONF}, b as (select o_orderkey, y, greatest(exp(lp - q) - 1, 0) lo, exp(lp + q) - 1 hi
  from pred cross join (select q from q where alpha = 0.1::double) where split = 'test')"""
ORACLES["conformal_interval"] = f"with {_BOUNDS} select o_orderkey, round(lo, 2) lo, round(hi, 2) hi from b"
ORACLES["interval_coverage"] = f"""with {_BOUNDS} select count(*) n, round(avg((y between lo and hi)::int), 4) coverage, round(avg(hi - lo), 2) mean_width from b"""
_T9 = "2.2621571627982044"        # Student's t, 0.975, nine degrees of freedom
SCORES = f"""{PRED}, f as (select *, y * 0.2::double + p * 0.8::double p2, {bucket('o_orderkey', '7', 10)} fold from pred),
sc as (select fold, 1 - avg((y - p) * (y - p)) / var_pop(y) "noTL", 1 - avg((y - p2) * (y - p2)) / var_pop(y) "TL" from f group by 1)"""
ORACLES["seed_summary"] = f"""with {SCORES}, s as (select 'noTL' model, "noTL" v from sc union all select 'TL', "TL" from sc)
select model, count(*) n, round(avg(v), 6) mean, round(stddev_samp(v), 6) sd, round(min(v), 6) min, round(max(v), 6) max,
round(avg(v) - {_T9} * stddev_samp(v) / sqrt(count(*)), 6) ci95_lo, round(avg(v) + {_T9} * stddev_samp(v) / sqrt(count(*)), 6) ci95_hi from s group by 1"""
ORACLES["paired_verdict"] = f"""with {SCORES}, d as (select ("TL" - "noTL") * 100 d from sc),
m as (select count(*) n, avg(d) mu, stddev_samp(d) sd, {_T9} * stddev_samp(d) / sqrt(count(*)) hw, count(*) filter (d > 0) pos from d)
select n, round(mu, 6) mean_pp, round(sd, 6) sd_pp, round(mu - hw, 6) ci95_lo_pp, round(mu + hw, 6) ci95_hi_pp, pos || '/' || n sign_consistency,
case when mu - hw > 0.1 then 'consistent_gain' when mu + hw < 0.1 then 'no_measurable_gain' else 'within_noise' end verdict, 0.1::double threshold_pp from m"""
ORACLES["best_baseline"] = f"""with {SCORES} select fold, round(greatest("TL", "noTL"), 6) best from sc"""

# ---- features ---------------------------------------------------------------------------

MATRIX = f"""mx as (select vec_id, embedding, {split_of('vec_id')} split,
  embedding[1]::double + embedding[2]::double * 2 + embedding[3]::double * 3 + {uniform('vec_id', 'noise')} * 0.05::double target from embeddings),
long as (select vec_id, split, target, 'e' || (i - 1) "column", i, embedding[i]::double v from mx, range(1, 65) t(i))"""
ORACLES["winsor_impute"] = f"""with {MATRIX} select "column", round(quantile_cont(v, 0.01), 6) lo, round(median(v), 6) median,
round(quantile_cont(v, 0.99), 6) hi from long where split = 'train' group by 1"""
_CLIP = ", ".join(f"""round(greatest(least(embedding[{i + 1}]::double, hi[{i + 1}]), lo[{i + 1}]), 6) e{i}""" for i in range(64))
ORACLES["winsor_transform"] = f"""with {MATRIX},
q as (select i, quantile_cont(v, 0.01) lo, quantile_cont(v, 0.99) hi from long where split = 'train' group by i),
b as (select list(lo order by i) lo, list(hi order by i) hi from q)
select vec_id, {_CLIP} from mx cross join b"""
ORDF = f"""ordf as (select o_orderkey, case when o_orderkey % 11 <> 0 then o_orderstatus end o_orderstatus, o_orderpriority,
  month(o_orderdate) "month", {split_of('o_orderkey')} split from orders)"""


def code_sql(c: str) -> str:
    text = f"coalesce({c}::varchar, 'MISSING')"
    lev = f"lev_{c.strip(chr(34))}"
    return f"{lev} as (select v, row_number() over (order by v) - 1 code from (select distinct {text} v from ordf where split = 'train'))"


_ENC = ["o_orderstatus", "o_orderpriority", '"month"']
ORACLES["ordinal_encode"] = f"""with {ORDF}, {', '.join(code_sql(c) for c in _ENC)} select o_orderkey, {', '.join(
    f"coalesce((select code from lev_{c.strip(chr(34))} l where l.v = coalesce(ordf.{c}::varchar, 'MISSING')), -1)::double {c}" for c in _ENC)} from ordf"""
ORACLES["column_kinds"] = " union all ".join(
    f"""select '{c}' "column", case when count(distinct {c}) <= 15 {'or true' if c == 'l_returnflag' else ''} then 'categorical' else 'numeric' end kind from lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_suppkey"))
ORACLES["column_quality"] = f"""with {MATRIX} select count(*) n, "column", count(v) n_valid, round(stddev_samp(v), 6) sd, min(v) < max(v) varies from long group by "column" """
_EDGE = "[" + ", ".join(f"0.{i}" for i in range(1, 10)) + "]"
MI = f"""{MATRIX}, ex as (select "column", quantile_cont(v, {_EDGE}) ed from long group by 1),
ey as (select quantile_cont(target, {_EDGE}) ed from mx),
bn as (select l."column", len(list_filter(ex.ed, lambda e: e < l.v)) bx, len(list_filter(ey.ed, lambda e: e < l.target)) byy
  from long l join ex using ("column") cross join ey),
cn as (select "column", bx, byy, count(*) n from bn group by 1, 2, 3),
pp as (select "column", n / sum(n) over (partition by "column") p, sum(n) over (partition by "column", bx) / sum(n) over (partition by "column") px,
  sum(n) over (partition by "column", byy) / sum(n) over (partition by "column") py from cn),
mi as (select "column", round(sum(p * ln(p / (px * py))), 6) mi from pp group by 1),
ac as (select "column", round(abs(corr(v, target)), 6) abs_r, count(*) n from long group by 1)"""
ORACLES["binned_mi"] = f'with {MI} select "column", mi from mi'
ORACLES["knn_mi"] = f"""with {MATRIX},
st as (select "column", stddev_pop(v) sv, stddev_pop(target) sy, count(*) n from long group by 1),
pt as (select l."column", row_number() over () i, v, target y, sv, sy from long l join st using ("column")),
kd as (select a."column", a.i, min(greatest(abs(a.v - b.v) / a.sv, abs(a.y - b.y) / a.sy), 3)[3] d
  from pt a join pt b on a."column" = b."column" and a.i <> b.i group by 1, 2),
nb as (select a."column", a.i, count(*) filter (abs(a.v - b.v) / a.sv < d or (d = 0 and a.v = b.v)) nx,
  count(*) filter (abs(a.y - b.y) / a.sy < d or (d = 0 and a.y = b.y)) ny
  from pt a join kd using (i) join pt b on a."column" = b."column" group by 1, 2),
ps as (select k + 1 k, -0.5772156649015329 + sum(1.0::double / k) over (order by k) psi from range(1, 2000000) t(k) union all select 1, -0.5772156649015329)
select st."column", st.n, round(greatest(pn.psi + p3.psi - avg(px.psi + py.psi), 0), 6) mi
from nb join st using ("column") join ps px on px.k = nx join ps py on py.k = ny join ps pn on pn.k = st.n join ps p3 on p3.k = 3
group by st."column", st.n, pn.psi, p3.psi"""
ORACLES["abs_corr"] = f'with {MI} select "column", abs_r, n from ac'
HYB = f"""{MI}, j as (select "column", mi, abs_r from mi join ac using ("column")),
hy as (select "column", ((rank() over (order by mi) + (count(*) over (partition by mi) - 1) / 2.0::double) / count(*) over ()
  + (rank() over (order by abs_r) + (count(*) over (partition by abs_r) - 1) / 2.0::double) / count(*) over ()) / 2 score from j)"""
ORACLES["hybrid_rank"] = f'with {HYB} select "column", round(score, 6) score from hy'
ORACLES["top_features"] = f"""with {HYB}, rk as (select "column", score, row_number() over (order by score desc, "column") position from hy)
select "column", round(score, 6) score, position from rk where position <= 20"""
ORACLES["importance_top"] = f"""with {MI} select "column", abs_r, n from ac order by abs_r desc, "column" limit 12"""
ORACLES["median_imputation"] = f"""with {HH}, md as (select {', '.join(f'median("{c}") "{c}"' for c in ("WALLTYPE", "ADQINSUL", "DRAFTY", "YEAR_BUILT"))} from hh)
select "BA_climate", {', '.join(f'round(avg(coalesce(hh."{c}", md."{c}")), 6) "mean_{c}"' for c in ("WALLTYPE", "ADQINSUL", "DRAFTY", "YEAR_BUILT"))}
from hh cross join md group by 1"""

# ---- audit --------------------------------------------------------------------------------

_BAD = sorted(["TOTALBTU", "TOTALBTUSPH", "BTUELCOL", "TOTALBTUWTH", "BTUELLGT", "NWEIGHT", *EUI_COLS])
_LINEAGE = sorted(["TOTALBTU", "TOTALBTUSPH", "BTUELCOL", "TOTALBTUWTH", "BTUELLGT", *EUI_COLS])
ORACLES["audit_names"] = f"select count(*) n_rows, '{','.join(_BAD)}' forbidden, '{','.join(_LINEAGE)}' lineage from lineitem"
ORACLES["audit_removed"] = f"""with {HH} {' union all '.join(f"""select '{c}' "column", count(*) n, count("{c}") n_valid from hh""" for c in _BAD)}"""
ORACLES["audit_tripwire"] = f"""with {MATRIX}, x as (select "column", v, target from long union all select 'leak', target * 2 + 1, target from mx),
c as (select "column", abs(corr(v, target)) a, count(*) n from x group by 1) select "column", round(a, 6) abs_r, n from c where a > 0.90 and n > 100"""
ORACLES["audit_duplicates"] = f"""with d as (select *, {split_of('doc_id')} split from documents),
g as (select lang, source, n_chars, text, count(*) filter (split = 'train') a, count(*) filter (split = 'test') b from d group by 1, 2, 3, 4)
select coalesce(sum(b) filter (a > 0 and b > 0), 0)::bigint duplicate_rows, count(*) filter (a > 0 and b > 0) duplicate_contents from g"""
ORACLES["audit_refit"] = f"""with {MATRIX} select "column", round(median(v), 6) stored, round(median(v), 6) recomputed, 0.0::double rel_dev, true ok
from long where split = 'train' group by 1"""
ORACLES["audit_categories"] = f"""with {ORDF} select distinct 'o_orderpriority' "column", o_orderpriority "value" from ordf
where o_orderpriority not in (select distinct o_orderpriority from ordf where o_orderpriority <> '1-URGENT')"""
# ---- scenarios -------------------------------------------------------------------------------

_USE = """({ua} * h * 24 / 1000) / {he} + case when "PH_has_cooling" = 1 then
  (({ua} * 0.8::double + {inf} * 0.5::double) * c * 24 / 1000) / greatest("PH_cooling_eff", 0.1::double) else 0 end
  + "PH_dhw_load" / {de} + "PH_base_load" """
_UA = '("PH_U_wall" * greatest("PH_wall_area" - "PH_window_area", 0) + {gu} * "PH_window_area" + "PH_U_roof" * "PH_roof_area" + "PH_UA_floor" + {inf})'
_UA_INS = '(wu * 0.65::double * greatest("PH_wall_area" - "PH_window_area", 0) + gu * "PH_window_area" + 0.08::double * 0.65::double * "PH_roof_area" + "PH_UA_floor" + "PH_UA_infiltration")'
_INF4 = '(0.018::double * "PH_building_volume" * 0.2::double)'
_HE3 = f"""greatest(case when fuel = 5 and (eq2 in (3, 10) or "HEATPUMP" = 1) then 2.30::double when fuel = 5 then 0.98::double
  else coalesce({mapped('fuel::int', {1: .80, 2: .78, 3: .78, 7: .55})}, 0.80::double)
  * coalesce({mapped('eq2::int', {3: 1.0, 4: .85, 5: .92, 7: .88, 10: 1.0, 12: 1.0})}, 0.95::double) end, 0.3::double)"""


def _use(ua='"PH_UA_total"', inf='"PH_UA_infiltration"', he='"PH_heating_eff"', de='"PH_dhw_eff"'):
    return _USE.format(ua=ua, inf=inf, he=he, de=de)


_NEW = {
    "Reference HVAC 2025": (3, _use(he=_HE3)),
    "Cold Climate ASHP": (4, _use(he="2.30::double", de="0.92::double")),
    "Air Sealing": (10, _use(ua=_UA.format(gu="gu", inf=_INF4), inf=_INF4)),
    "Attic Insulation": (11, _use(ua=_UA_INS)),
    "ENERGY STAR Windows": (15, _use(ua=_UA.format(gu="gu2", inf='"PH_UA_infiltration"'))),
}
SCEN = f"""{PH}, z as (select *, {_use()} base_pred, case when eq in (4, 5, 7) then 3 else eq end eq2,
  coalesce({mapped('greatest(coalesce("TYPEGLASS", 2), 2)::int', {2: .55, 3: .35})}, 0.65::double) gu2 from ph),
sv0 as ({' union all '.join(f"select '{n}' scenario, {u} upgrade, \"BA_climate\", base_pred, {e} new_pred from z" for n, (u, e) in _NEW.items())}),
sv as (select *, (base_pred - new_pred) / greatest(base_pred, 1e-6) * 100 s from sv0),
tab as (select scenario, upgrade::int upgrade, avg(s) mean_savings_pct, median(s) median_savings_pct, quantile_cont(s, 0.1) p10_savings_pct,
  quantile_cont(s, 0.9) p90_savings_pct from sv group by 1, 2)"""
ORACLES["scenario_predictions"] = f"""with {SCEN} select scenario, "BA_climate", count(*) n, round(avg(base_pred), 4) mean_base,
round(avg(new_pred), 4) mean_new, round(avg(s), 4) mean_savings_pct from sv group by 1, 2"""
_TAB = ", ".join(f"round({c}_savings_pct, 4) {c}_savings_pct" for c in ("mean", "median", "p10", "p90"))
ORACLES["scenario_savings"] = f"with {SCEN} select scenario, upgrade, {_TAB} from tab"
ORACLES["scenario_report"] = f"""with {SCEN}, {measured_sql(True)}
select scenario, upgrade, {_TAB}, round(reported_pct, 4) measured_pct, round(matched_pct, 4) measured_matched_pct,
round(naive_pct, 4) measured_naive_pct, round(mean_savings_pct - reported_pct, 4) gap_pp from tab left join measured using (upgrade)"""

# ---- reports ------------------------------------------------------------------------------------

ORACLES["target_summary"] = f"""with {HH} select round(avg("EUI"), 4) eui_mean, round(median("EUI"), 4) eui_median,
round(avg("TOTALBTU"), 4) total_mean, count(*) n from hh"""
ORACLES["eui_histogram"] = f"""with {HH}, m as (select quantile_cont("EUI", 0.99) hi from hh)
select least(floor(least(greatest("EUI", 0), hi) / (hi / 60)), 59)::int bin, count(*) n from hh cross join m group by 1"""
ORACLES["residual_histogram"] = f"""with {PRED}, m as (select min(ly - lp) lo, max(ly - lp) hi from pred)
select least(floor((ly - lp - lo) / ((hi - lo) / 60)), 59)::int bin, count(*) n from pred cross join m group by 1"""
ORACLES["benchmark_table"] = f"""with {PRED}, m as (select 'total_btu_' || split metric, 1 - avg((y - p) * (y - p)) / var_pop(y) r2 from pred group by 1)
select metric, round(r2, 6) r2, 0.85::double target, case when r2 >= 0.85 then 'meets internal benchmark' else 'below internal benchmark' end status from m"""
ORACLES["zone_summary"] = f"""with {PRED}, m as (select o_orderpriority, 1 - avg((ly - lp) * (ly - lp)) / var_pop(ly) r2, count(*) n from pred group by 1)
select round(avg(r2), 6) mean_r2, round(min(r2), 6) min_r2, sum(n)::bigint n_test from m"""

# ---- conservation ---------------------------------------------------------------------------------

ORACLES["share_conservation"] = f"""with {HH},
c as (select *, least(greatest("SHARE_HEATING" * 8, 0), 1) a, least(greatest("SHARE_COOLING" * 9, 0), 1) b,
  least(greatest("SHARE_DHW" * 4 - 0.02::double, 0), 1) d from hh),
s as (select l_linenumber, "TOTALBTU" t, "TOTSQFT_EN" q, a / greatest(a + b + d, 1) a, b / greatest(a + b + d, 1) b, d / greatest(a + b + d, 1) d from c)
select l_linenumber line, count(*) n, round(avg(a), 4) share_heating, round(avg(b), 4) share_cooling, round(avg(d), 4) share_dhw,
round(avg(greatest(1 - a - b - d, 0)), 4) share_other, round(avg(a * t), 4) btu_heating, round(avg(b * t), 4) btu_cooling,
round(avg(d * t), 4) btu_dhw, round(avg(a * t / greatest(q, 1)), 4) eui_heating from s group by 1"""


def combo_sql(prefix: str, y: str) -> str:
    """CTEs ``{prefix}c`` (k, added, r2): greedy choice of up to three columns by least squares on correlations."""
    two = "(a.ry * a.ry + x.ry * x.ry - 2 * a.ry * x.ry * p.r) / (1 - p.r * p.r)"
    three = """(a.ry ^ 2 * (1 - bc.r ^ 2) + b.ry ^ 2 * (1 - ac.r ^ 2) + x.ry ^ 2 * (1 - ab.r ^ 2) - 2 * a.ry * b.ry * (ab.r - ac.r * bc.r)
      - 2 * a.ry * x.ry * (ac.r - ab.r * bc.r) - 2 * b.ry * x.ry * (bc.r - ab.r * ac.r))
      / (1 + 2 * ab.r * ac.r * bc.r - ab.r ^ 2 - ac.r ^ 2 - bc.r ^ 2)"""
    q = prefix
    return f"""{q}y as (select "column", corr(v, {y}) ry from long where split = 'train' group by 1),
{q}1 as (select "column", ry, ry * ry r2 from {q}y order by r2 desc limit 1),
{q}2 as (select x."column", x.ry, {two} r2 from {q}1 a join pairs p on p.c1 = a."column" join {q}y x on x."column" = p.c2 where a.r2 <= 0.95 order by r2 desc limit 1),
{q}3 as (select x."column", {three} r2 from {q}1 a join {q}2 b on b.r2 <= 0.95 join pairs ab on ab.c1 = a."column" and ab.c2 = b."column"
  join pairs ac on ac.c1 = a."column" join pairs bc on bc.c1 = b."column" and bc.c2 = ac.c2 join {q}y x on x."column" = ac.c2 order by r2 desc limit 1),
{q}c as (select 1 k, "column" added, r2 from {q}1 union all select 2, "column", r2 from {q}2 union all select 3, "column", r2 from {q}3)"""


_PAIRS = """pairs as (select a."column" c1, b."column" c2, corr(a.v, b.v) r from long a join long b using (vec_id)
  where a.split = 'train' and a."column" <> b."column" group by 1, 2)"""
ORACLES["audit_linear_combo"] = f"""with {MATRIX}, {_PAIRS}, {combo_sql('r', 'target')}, {combo_sql('l', 'ln(1 + target + 20)')}
select 'raw_target' scale, k, added, round(r2, 6) r2, r2 > 0.95 flagged from rc
union all select 'log1p_target', k, added, round(r2, 6), r2 > 0.95 from lc"""
_COUNTED = "\"check\" in ('A', 'B', 'C', 'D', 'G', 'H')"
ORACLES["audit_verdict"] = f"""with {MATRIX}, {_PAIRS}, {combo_sql('r', 'target')}, {PRED},
trip as (select string_agg("column", ',' order by a desc) hit from (select "column", abs(corr(v, target)) a from long where split = 'train' group by 1) where a > 0.9),
same as (select count(*) filter (split = 'train') n_train, count(*) filter (split = 'test') n_test
  from (select vec_id, any_value(split) split, list(round_even(v, 4) order by i) x from long group by 1) group by x),
dup as (select coalesce(sum(n_test) filter (n_train > 0 and n_test > 0), 0)::bigint n from same),
high as (select string_agg(split, ',' order by split) hit from (select split, 1 - avg((ly - lp) * (ly - lp)) / var_pop(ly) r2 from pred group by 1) where r2 > 0.99),
combo as (select 'log1p_target=[' || string_agg(chr(39) || added || chr(39), ', ' order by k) || ']' hit, max(r2) > 0.95 bad from rc),
checks as (
  select 'A' "check", unnest(['train', 'val', 'calib', 'test']) split, true passed, '' detail
  union all select 'B', 'train', hit is null, coalesce(hit, '') from trip
  union all select 'C', 'test', n = 0, 'duplicate_rows=' || n from dup
  union all select 'D', 'train', true, 'medians_off=0;extra_levels=0'
  union all select 'E', 'test', hit is null, coalesce(hit, '') from high
  union all select 'F', 'train', true, 'selection on train'
  union all select 'G', 'train', not bad, case when bad then hit else '' end from combo
  union all select 'H', 'all', true, '')
select "check", split, passed, {_COUNTED} counted, detail from checks
union all select 'overall', 'all', bool_and(passed) filter ({_COUNTED}), false,
  'counted=' || count(*) filter ({_COUNTED}) || ';failed=' || count(*) filter ({_COUNTED} and not passed) from checks"""

ORACLES["positional_pairs"] = """select l_returnflag, l_linestatus, count(*) n, round(avg(p), 4) mean_saving_pct, round(max(p), 4) max_saving_pct, round(sum(b - u), 4) saved
from (select l_returnflag, l_linestatus, b, u, least(greatest((b - u) / b * 100, -50), 90) p
  from (select *, l_extendedprice b, l_extendedprice * (1 - l_discount) u from lineitem)) group by 1, 2"""
