"""Names, thresholds, lookup tables and texts that results depend on.

Everything here is a domain constant.  Changing an entry changes results, so the tables are kept
in one place, in natural order, and the operators only refer to them by name.
"""

# --- columns -------------------------------------------------------------------------------------
CATEGORICAL = ["crop", "state", "season"]
WEATHER = ["mean_temperature", "total_precipitation", "mean_relative_humidity", "mean_solar_radiation"]
IRRIGATION = "irrigation_coverage_pct"
FERTILIZER = "npk_consumption_kg_per_ha"
NUMERICAL = ["crop_year", "area", *WEATHER, IRRIGATION, FERTILIZER]
FEATURES = [*CATEGORICAL, *NUMERICAL]
TARGET = "yield"
EXCLUDED = ["production", "district"]
FEATURE_TYPES = {**{c: "string" for c in CATEGORICAL}, **{c: "double" for c in NUMERICAL}, "crop_year": "int"}

# --- state dimensions ----------------------------------------------------------------------------
DEFAULT_IRRIGATION = 40.0
DEFAULT_FERTILIZER = 120.0

STATE_ALIASES = {
    "odisha": "Odisha",
    "orissa": "Odisha",
    "tamilnadu": "Tamil Nadu",
    "tamil nadu": "Tamil Nadu",
    "jammu & kashmir": "Jammu and Kashmir",
    "jammu and kashmir": "Jammu and Kashmir",
    "uttaranchal": "Uttarakhand",
}

FALLBACK_CENTROID = (20.5937, 78.9629)
CENTROIDS = [
    ("Andhra Pradesh", 15.9129, 79.7400),
    ("Arunachal Pradesh", 28.2180, 94.7278),
    ("Assam", 26.2006, 92.9376),
    ("Bihar", 25.0961, 85.3131),
    ("Chhattisgarh", 21.2787, 81.8661),
    ("Goa", 15.2993, 74.1240),
    ("Gujarat", 22.2587, 71.1924),
    ("Haryana", 29.0588, 76.0856),
    ("Himachal Pradesh", 31.1048, 77.1734),
    ("Jammu and Kashmir", 33.7782, 76.5762),
    ("Jharkhand", 23.6102, 85.2799),
    ("Karnataka", 15.3173, 75.7139),
    ("Kerala", 10.8505, 76.2711),
    ("Madhya Pradesh", 22.9734, 78.6569),
    ("Maharashtra", 19.7515, 75.7139),
    ("Manipur", 24.6637, 93.9063),
    ("Meghalaya", 25.4670, 91.3662),
    ("Mizoram", 23.1645, 92.9376),
    ("Nagaland", 26.1584, 94.5624),
    ("Odisha", 20.9517, 85.0985),
    ("Orissa", 20.9517, 85.0985),
    ("Punjab", 31.1471, 75.3412),
    ("Rajasthan", 27.0238, 74.2179),
    ("Sikkim", 27.5330, 88.5122),
    ("Tamil Nadu", 11.1271, 78.6569),
    ("Telangana", 18.1124, 79.0193),
    ("Tripura", 23.9408, 91.9882),
    ("Uttar Pradesh", 26.8467, 80.9462),
    ("Uttarakhand", 30.0668, 79.0193),
    ("West Bengal", 22.9868, 87.8550),
]

# Bands run from the highest lower bound down; the last entry has no lower bound.
IRRIGATION_BANDS = [
    (80, "Very High", "Predominantly irrigated."),
    (60, "High", "Significant irrigation."),
    (40, "Moderate", "Partial irrigation."),
    (20, "Low", "Mostly rain-fed."),
    (None, "Very Low", "Predominantly rain-fed."),
]
FERTILIZER_BANDS = [
    (200, "Very High", "Intensive chemical inputs."),
    (150, "High", "Above-average use."),
    (100, "Moderate", "Average consumption."),
    (50, "Low", "Below-average use."),
    (None, "Very Low", "Minimal inputs."),
]

# --- historical weather --------------------------------------------------------------------------
DAILY_PARAMETERS = {
    "T2M": "mean_temperature",
    "PRECTOTCORR": "total_precipitation",
    "RH2M": "mean_relative_humidity",
    "ALLSKY_SFC_SW_DWN": "mean_solar_radiation",
}
FILL_LIMIT = -990.0
DAYS_PER_YEAR = 365.25
TRAILING_DAYS = 365

# --- seasonal forecast ---------------------------------------------------------------------------
SEASON_MONTHS = {
    "KHARIF": [6, 7, 8, 9, 10],
    "RABI": [11, 12, 1, 2, 3],
    "SUMMER": [3, 4, 5],
    "AUTUMN": [10, 11],
    "WINTER": [12, 1, 2],
    "WHOLE YEAR": list(range(1, 13)),
}
SEASON_ALIASES = {"WHOLE_YEAR": "WHOLE YEAR", "WHOLEYEAR": "WHOLE YEAR", "ANNUAL": "WHOLE YEAR"}
FORECAST_VARIABLES = ["temperature_2m", "precipitation", "relative_humidity_2m", "shortwave_radiation"]
FORECAST_DAYS = 180
READINGS_PER_DAY = 4.0
WATTS_TO_MJ_PER_DAY = 0.0864
FORECAST_TTL_SECONDS = 30 * 24 * 3600
HORIZON_HIGH_DAYS = 45
HORIZON_MEDIUM_DAYS = 120
LOW_COVERAGE_PCT = 30
# How far a forecast must move from history before the report shows the difference.
DELTA_CUTOFFS = {
    "mean_temperature": 0.3,
    "total_precipitation": 50.0,
    "mean_relative_humidity": 2.0,
    "mean_solar_radiation": 0.5,
}
YIELD_DELTA_CUTOFF = 1.0
DIRECTION_CUTOFF = 0.5

# --- risk rules: metric, comparison, threshold, level, category -----------------------------------
RISK_RULES = [
    ("total_precipitation", "<", 400.0, "CRITICAL", "DROUGHT"),
    ("total_precipitation", "<", 600.0, "HIGH", "DROUGHT"),
    ("total_precipitation", "<", 800.0, "MODERATE", "DROUGHT"),
    ("mean_relative_humidity", "<", 35.0, "HIGH", "DROUGHT"),
    ("mean_relative_humidity", "<", 45.0, "MODERATE", "DROUGHT"),
    ("total_precipitation", ">", 2500.0, "CRITICAL", "EXCESS_RAIN"),
    ("total_precipitation", ">", 2000.0, "HIGH", "EXCESS_RAIN"),
    ("total_precipitation", ">", 1600.0, "MODERATE", "EXCESS_RAIN"),
    ("mean_temperature", ">", 30.0, "CRITICAL", "HEAT_STRESS"),
    ("mean_temperature", ">", 28.0, "HIGH", "HEAT_STRESS"),
    ("mean_temperature", ">", 26.5, "MODERATE", "HEAT_STRESS"),
    ("mean_temperature", "<", 16.0, "CRITICAL", "COLD_STRESS"),
    ("mean_temperature", "<", 19.0, "HIGH", "COLD_STRESS"),
    ("mean_temperature", "<", 21.0, "MODERATE", "COLD_STRESS"),
    ("mean_solar_radiation", "<", 13.0, "HIGH", "SOLAR_DEFICIENCY"),
    ("mean_solar_radiation", "<", 15.0, "MODERATE", "SOLAR_DEFICIENCY"),
]
LEVEL_SEVERITY = {"OPTIMAL": 0, "LOW": 1, "MODERATE": 2, "HIGH": 3, "CRITICAL": 4}
LEVEL_ICONS = {
    "OPTIMAL": "\U0001f7e2",
    "LOW": "\U0001f7e1",
    "MODERATE": "\U0001f7e0",
    "HIGH": "\U0001f534",
    "CRITICAL": "\U0001f534",
}
UNKNOWN_ICON = "\u26a0\ufe0f"
CATEGORY_TITLES = {
    "DROUGHT": "DROUGHT RISK",
    "EXCESS_RAIN": "EXCESS RAINFALL",
    "HEAT_STRESS": "HEAT STRESS",
    "COLD_STRESS": "COLD STRESS",
    "SOLAR_DEFICIENCY": "LOW SOLAR RADIATION",
}
# label, unit, digits shown
METRIC_TEXT = {
    "total_precipitation": ("Rainfall", "mm/yr", 0),
    "mean_temperature": ("Temperature", "°C", 1),
    "mean_relative_humidity": ("Humidity", "%", 0),
    "mean_solar_radiation": ("Solar Radiation", "MJ/m²/day", 1),
}
DEFAULT_NORMS = {
    "mean_temperature": 25.5,
    "total_precipitation": 1100.0,
    "mean_relative_humidity": 62.0,
    "mean_solar_radiation": 17.5,
}

# --- report texts --------------------------------------------------------------------------------
DISPLAY_NAMES = {
    "crop": "Crop",
    "state": "State",
    "season": "Season",
    "crop_year": "Year",
    "area": "Area (Ha)",
    "yield": "Yield (q/ha)",
    "mean_temperature": "Avg Temp (°C)",
    "total_precipitation": "Rainfall (mm/yr)",
    "mean_relative_humidity": "Humidity (%)",
    "mean_solar_radiation": "Solar Rad (MJ/m²/day)",
    "irrigation_coverage_pct": "Irrigation (%)",
    "npk_consumption_kg_per_ha": "NPK (kg/ha)",
}
GAUGE_MAX = {
    "SUGARCANE": 1000.0,
    "POTATO": 400.0,
    "ONION": 500.0,
    "BANANA": 400.0,
    "RICE": 60.0,
    "WHEAT": 60.0,
    "MAIZE": 60.0,
    "COTTON": 50.0,
    "JOWAR": 50.0,
    "BAJRA": 50.0,
    "GRAM": 30.0,
    "GROUNDNUT": 50.0,
    "SESAMUM": 20.0,
    "URAD": 20.0,
    "MOONG(GREEN GRAM)": 20.0,
    "RAPESEED &MUSTARD": 30.0,
    "ARHAR/TUR": 30.0,
    "DRY CHILLIES": 80.0,
    "SUNFLOWER": 40.0,
}
GAUGE_DEFAULT = 100.0

# --- request limits ------------------------------------------------------------------------------
YEAR_RANGE = (1997, 2015)
AREA_RANGE = (0.1, 10000.0)
DEFAULT_AREA = 1.0
IRRIGATION_RANGE = (0.0, 100.0)
FERTILIZER_RANGE = (0.0, 500.0)
YIELD_UNIT = "Quintal/Hectare"
MODEL_VERSION = "3.2.0"
TRAINED_VERSION = "1.0.0"

# --- model ---------------------------------------------------------------------------------------
SEED = 42
TEST_FRACTION = 0.2
MIN_R2 = 0.1
MAPE_FLOOR = 0.01
FOLDS = 3
GRID = {
    "maxIter": [50, 100],
    "stepSize": [0.1, 0.05],
    "maxDepth": [3, 5],
    "subsamplingRate": [0.8, 1.0],
}
