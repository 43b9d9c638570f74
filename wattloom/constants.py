"""Published survey, weather and building-stock conventions.

Everything in this module is a constant that results depend on. Logic lives in
the operator modules.
"""

# ---- fixed values: survey columns -------------------------------------------
ID_COL = "DOEID"
WEIGHT_COL = "NWEIGHT"
SQFT_COL = "TOTSQFT_EN"
STATE_COL = "state_postal"
CLIMATE_COL = "BA_climate"
CLIMATE_SIMPLE_COL = "BA_climate_SIMPLE"
HDD_COL = "HDD65"
CDD_COL = "CDD65"
YEAR_RANGE_COL = "YEARMADERANGE"
YEAR_BUILT_COL = "YEAR_BUILT"
TOTAL_COL = "TOTALBTU"
EUI_COL = "EUI"
STOCK_ENERGY_COL = "TOTAL_ENERGY_KWH"

ENDUSE_BTU = {
    "heating": "TOTALBTUSPH",
    "cooling": "BTUELCOL",
    "dhw": "TOTALBTUWTH",
    "lighting": "BTUELLGT",
}

# ---- fixed values: missing codes and guarded name tokens ---------------------
MISSING_CODES = (-2, -3, -4, -5, -6, -7, -8, -9, -99, -999, 999999999)
GUARD_TOKENS = ("BTU", "KWH", "THERMS", "GALLON", "CUFEET", "DOL", "WOODAMT",
                "PELLETS", "EUI", "INTENSITY", "SHARE")
LINEAGE_TOKENS = ("TOTALBTU", "BTUSPH", "BTUELCOL", "BTUWTH", "BTUELLGT", "EUI",
                  "SHARE_", "KWH", "THERMS", "DOL")
TEACHER_PREFIX = "TL_pred"
PHYSICS_PREFIX = "PH_"

# ---- fixed values: vintage band -> midpoint year -----------------------------
VINTAGE_MIDPOINT = {1: 1935, 2: 1945, 3: 1955, 4: 1965, 5: 1975, 6: 1985,
                    7: 1995, 8: 2005, 9: 2012, 10: 2017, 11: 2020}

# ---- fixed values: envelope, infiltration and equipment tables ---------------
WALL_U = {1: 0.30, 2: 0.18, 3: 0.25, 4: 0.20, 5: 0.22, 6: 0.35, 7: 0.28, 99: 0.22}
GLASS_U = {1: 1.00, 2: 0.55, 3: 0.35}
INSULATION_FACTOR = {1: 1.25, 2: 1.00, 3: 0.80, 4: 0.65}
ACH50_BY_DRAFTINESS = {1: 14.0, 2: 10.0, 3: 6.5, 4: 4.0}
COOLING_EFFICIENCY = {1: 3.2, 2: 3.0, 3: 2.6}
FUEL_EFFICIENCY = {1: 0.80, 2: 0.78, 3: 0.78, 7: 0.55}
EQUIPMENT_FACTOR = {3: 1.00, 4: 0.85, 5: 0.92, 7: 0.88, 10: 1.00, 12: 1.00}

# ---- fixed values: weather ---------------------------------------------------
DEGREE_DAY_BASE_C = 18.3
STATION_CLASS_WEIGHT = {"I": 1.0, "II": 0.7, "III": 0.4}
UNKNOWN_CLASS_WEIGHT = 0.5

# ---- fixed values: zone -> (heating, cooling) degree days --------------------
ZONE_DEGREE_DAYS = {
    "Very-Cold": (9000, 350), "Cold": (6500, 700), "Marine": (4200, 450),
    "Mixed-Humid": (4300, 1500), "Mixed-Dry": (4500, 1200),
    "Hot-Humid": (1600, 3200), "Hot-Dry": (1800, 3000), "Subarctic": (12000, 200),
}

# ---- fixed values: building-stock text -> survey code ------------------------
BUILDING_TYPE_CODE = {
    "single-family detached": 2, "single-family attached": 3, "mobile home": 1,
    "multi-family with 2 - 4 units": 4, "multi-family with 5+ units": 5,
}
FUEL_CODE = {"electricity": 5, "natural gas": 1, "propane": 3, "fuel oil": 2,
             "wood": 7, "other fuel": 9, "none": 0}
STORY_WORDS = {"one": 1.0, "two": 2.0, "three": 3.0}
KBTU_PER_KWH = 3.412

# ---- fixed values: source column aliases, first match wins -------------------
WEATHER_ALIASES = {
    "station_number": ["station_number", "Station number", "USAF", "station"],
    "dry_bulb": ["Dry-bulb (C)", "Dry-bulb(C)", "dry_bulb", "DryBulb", "Tdry"],
    "radiation": ["GHI (W/m^2)", "GHI(W/m^2)", "GHI", "ghi"],
    "humidity": ["RHum (%)", "RHum(%)", "RH", "rhum"],
    "wind": ["Wspd (m/s)", "Wspd(m/s)", "Wind Speed", "wspd"],
}
STATION_ALIASES = {
    "station_number": ["station_number", "Station number", "USAF", "station"],
    "state": ["State", "state", "STATE"],
    "class": ["Class", "class", "Station Class", "CLASS"],
    "latitude": ["Latitude", "Lat", "latitude", "LATITUDE"],
    "longitude": ["Longitude", "Lon", "longitude", "LONGITUDE"],
    "elevation": ["Elevation", "Elev", "elevation", "ELEVATION"],
}
STOCK_ALIASES = {
    "sqft": ["in.sqft..ft2", "in.sqft"],
    "typehuq": ["in.geometry_building_type_recs", "in.geometry_building_type"],
    "vintage": ["in.vintage"],
    "stories": ["in.geometry_stories"],
    "bedrooms": ["in.bedrooms"],
    "occupants": ["in.occupants"],
    "fuelheat": ["in.heating_fuel"],
    "hvac_heat_type": ["in.hvac_heating_type"],
    "hvac_heat_eff": ["in.hvac_heating_efficiency"],
    "hvac_cool_type": ["in.hvac_cooling_type"],
    "hvac_cool_eff": ["in.hvac_cooling_efficiency"],
    "insul_wall": ["in.insulation_wall"],
    "insul_roof": ["in.insulation_roof"],
    "insul_ceiling": ["in.insulation_ceiling"],
    "infiltration": ["in.infiltration"],
    "windows": ["in.windows"],
    "ba_climate": ["in.building_america_climate_zone"],
    "ashrae_zone": ["in.ashrae_iecc_climate_zone_2004"],
    "census_region": ["in.census_region"],
    "census_division": ["in.census_division"],
    "bldg_id": ["bldg_id", "in.bldg_id", "id", "building_id", "bldgid",
                "in.building_id", "sample_id"],
    "state": ["in.state"],
    "county": ["in.county"],
    "puma": ["in.puma"],
    "weather_city": ["in.weather_file_city"],
    "wh_fuel": ["in.water_heater_fuel"],
    "wh_eff": ["in.water_heater_efficiency"],
    "has_pv": ["in.has_pv"],
    "ev": ["in.electric_vehicle_ownership"],
    "lighting": ["in.lighting"],
    "ceiling_fan": ["in.ceiling_fan"],
    "mech_vent": ["in.mechanical_ventilation"],
    "total_energy_kwh": ["out.site_energy.total.energy_consumption..kwh",
                         "out.site_energy.total.energy_consumption.kwh"],
    "elec_kwh": ["out.electricity.total.energy_consumption..kwh",
                 "out.electricity.total.energy_consumption.kwh"],
    "gas_kwh": ["out.natural_gas.total.energy_consumption..kwh",
                "out.natural_gas.total.energy_consumption.kwh"],
    "eui_total": ["out.site_energy.total.energy_consumption_intensity..kwh_per_ft2",
                  "out.site_energy.total.energy_consumption_intensity.kwh_per_ft2"],
    "bill_usd": ["out.utility_bills.total_bill..usd"],
    "co2e_kg": ["out.emissions.total.lrmer_mid_case_25..co2e_kg"],
    "upgrade": ["upgrade"],
    "upgrade_name": ["in.upgrade_name"],
    "weight": ["weight"],
}
STOCK_TO_SURVEY = {
    "sqft": "TOTSQFT_EN", "typehuq": "TYPEHUQ", "stories": "STORIES",
    "bedrooms": "BEDROOMS", "occupants": "NHSLDMEM", "fuelheat": "FUELHEAT",
    "hvac_heat_type": "EQUIPM", "ba_climate": "BA_climate", "state": "state_postal",
    "weight": "NWEIGHT", "eui_total": "EUI_TOTAL", "total_energy_kwh": "TOTAL_ENERGY_KWH",
}

# ---- fixed values: retrofit scenario -> measured upgrade id ------------------
SCENARIO_UPGRADE = {
    "Reference HVAC 2025": 3,
    "Cold Climate ASHP": 4,
    "Air Sealing": 10,
    "Attic Insulation": 11,
    "ENERGY STAR Windows": 15,
}
UPGRADES = (3, 4, 10, 11, 15)
MATCH_KEYS = ("BA_climate", "TYPEHUQ", "FUELHEAT")
PAIR_KEYS = ("TOTSQFT_EN", "vintage", "TYPEHUQ", "BA_climate", "FUELHEAT", "NHSLDMEM")

# ---- fixed values: thresholds, split sizes, seeds ----------------------------
SPLIT_SIZES = {"train": 0.70, "val": 0.10, "calib": 0.05, "test": 0.15}
SEEDS = (42, 101, 202, 303, 404, 505, 606, 707, 808, 909)
ALPHA = 0.10
CURVE_ALPHAS = (0.20, 0.10, 0.05)
COVERAGE_TOLERANCE_PP = 3.0
EFFECT_THRESHOLD_PP = 0.10
MIN_MATCHED_CELLS = 100
MIN_DIAGNOSED_ROWS = 200
MIN_PAIRS = 100
FULL_COVERAGE_PCT = 95.0
MAX_CATEGORY_LEVELS = 15
TRIPWIRE_R = 0.90
LINEAR_COMBO_SIZE = 4
LINEAR_COMBO_R2 = 0.95
LINEAR_COMBO_MIN_ROWS = 200
BENCHMARK_R2_TOTAL = 0.85
BENCHMARK_R2_EUI = 0.70

# ---- fixed values: expected direction of total energy ------------------------
MONOTONE_SIGN = {
    "TOTSQFT_EN": 1, "PH_log_sqft": 1, "PH_footprint_area": 1, "PH_wall_area": 1,
    "PH_roof_area": 1, "PH_building_volume": 1, "PH_surface_area": 1,
    "PH_building_height": 1, "PH_building_perimeter": 1, "PH_window_area": 1,
    "PH_UA_total": 1, "PH_UA_wall": 1, "PH_UA_roof": 1, "PH_UA_window": 1,
    "PH_UA_floor": 1, "PH_UA_infiltration": 1, "PH_U_wall": 1, "PH_U_roof": 1,
    "PH_U_window": 1, "PH_ACH_natural": 1, "PH_duct_leakage": 1,
    "HDD65": 1, "CDD65": 1, "TMY3_HDD65": 1, "TMY3_CDD65": 1,
    "PH_HDD_x_sqft": 1, "PH_CDD_x_sqft": 1, "PH_HDD_x_UA": 1, "PH_CDD_x_UA": 1,
    "PH_HDD_x_CDD": 1, "PH_heating_load": 1, "PH_cooling_load": 1,
    "PH_dhw_load": 1, "PH_base_load": 1, "PH_occ_x_sqft": 1, "PH_eui_estimate": 1,
    "NHSLDMEM": 1, "NUMADULTS": 1, "NUMCHILD": 1,
    "PH_heating_eff": -1, "PH_cooling_eff": -1, "PH_dhw_eff": -1,
    # larger insulation factor means a worse envelope, hence +1
    "PH_ceiling_insul": 1, "PH_envelope_quality": -1, "PH_efficiency_score": -1,
}
