"""Fixed values that must equal the reference's for the same results.

Fixed values (kept in the reference's order):
"""

# -- fixed values ---------------------------------------------------------
# Weighted quality index: column -> weight (sum 0.90, not re-normalised).
WQI_WEIGHTS = {
    "pH Level": 0.15,
    "Dissolved Oxygen (mg/L)": 0.25,
    "Nitrate-N/Nitrite-N (mg/L)": 0.10,
    "Ammonia (mg/L)": 0.15,
    "Phosphate (mg/L)": 0.10,
    "Surface Water Temp (°C)": 0.05,
    "Middle Water Temp (°C)": 0.05,
    "Bottom Water Temp (°C)": 0.05,
}
# Index classes: upper bounds (exclusive) and the label above the last bound.
WQI_CLASS_LIMITS = [(50.0, "Excellent"), (75.0, "Good"), (90.0, "Fair")]
WQI_CLASS_ELSE = "Poor"
# Candidate location / time column names, in priority order.
LOCATION_CANDIDATES = ["Location", "location", "LOCATION", "Site", "site", "SITE"]
TIME_CANDIDATES = ["Date", "date", "datetime", "time"]
# Advice text per index class.
WQI_ADVICE = {
    "Excellent": "Water is suitable for all uses. Maintain current practices.",
    "Good": "Water is suitable for most uses. Minor treatment might be needed in sensitive applications. Some monitoring is recommended.",
    "Fair": "Water is suitable for limited uses. Aquatic life might be stressed. Further treatment may be needed.",
    "Poor": "Water is not suitable for any uses without treatment.",
}
# Named feature sets (inner blanks of names normalised to one).
WATER_COLUMNS = [
    "Surface Water Temp (°C)", "Middle Water Temp (°C)", "Bottom Water Temp (°C)",
    "pH Level", "Dissolved Oxygen (mg/L)",
]
CLIMATE_COLUMNS = ["RAINFALL", "TMAX", "TMIN", "RH", "WIND_SPEED", "WIND_DIRECTION"]
POLLUTANT_COLUMNS = ["Ammonia (mg/L)", "Nitrate-N/Nitrite-N (mg/L)", "Phosphate (mg/L)"]
MODEL_FEATURE_COLUMNS = [
    "Surface Water Temp (°C)", "Middle Water Temp (°C)", "Bottom Water Temp (°C)",
    "pH Level", "Dissolved Oxygen (mg/L)",
    "RAINFALL", "TMAX", "TMIN", "RH", "WIND_SPEED", "WIND_DIRECTION",
    "Ammonia (mg/L)", "Nitrate-N/Nitrite-N (mg/L)", "Phosphate (mg/L)",
]
FEATURE_SETS = {
    "WQI + Pollutant Level": WATER_COLUMNS + CLIMATE_COLUMNS + POLLUTANT_COLUMNS,
    "WQI Only": WATER_COLUMNS,
    "WQI + Climate": WATER_COLUMNS + CLIMATE_COLUMNS,
}
# Pipeline parameters.
LOOK_BACK = 12
WINDOW_SIZE_RECOMMENDED = 30
TEST_FRACTION = 0.2
VALIDATION_FRACTION = 0.2
Z_LIMIT = 3.0
HIST_BINS = 30
TOP_PAIRS = 10
FALLBACK_INDEX = 60.0
# Metric direction for "best model": higher is better for these names ...
HIGHER_IS_BETTER = ["accuracy", "precision", "recall", "f1_score", "f1", "r2_score", "r2", "r²"]
# -- end of fixed values --------------------------------------------------

__all__ = [n for n in dir() if n.isupper()]
