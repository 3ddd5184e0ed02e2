"""Rule tables used by the decision operators.

They are small inputs known on the driver (their size is fixed by the list
literals below), so operators either inline them as literal arrays / maps or
broadcast them explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# fixed values (must equal the service's defaults for identical results)
# ---------------------------------------------------------------------------

# zone -> crops allowed in that zone (serving default map)
ZONE_CROPS = {
    "arid": ["cotton", "millet", "lentil", "chickpea", "pigeonpeas", "mothbeans", "mungbean",
             "blackgram", "pomegranate"],
    "temperate": ["maize", "rice", "lentil", "chickpea", "pigeonpeas", "kidneybeans", "blackgram",
                  "mungbean", "mothbeans", "cotton", "grapes", "apple", "muskmelon", "watermelon",
                  "orange", "papaya"],
    "tropical": ["rice", "jute", "coconut", "banana", "papaya", "mango", "coffee", "orange",
                 "watermelon", "muskmelon", "grapes", "kidneybeans", "maize"],
}

# crop -> (tmin, tmax, rmin, rmax): temperature band (C) and rainfall band (mm)
CROP_BANDS = {
    "wheat": (10, 30, 200, 800),
    "rice": (20, 35, 800, 2000),
    "cotton": (20, 40, 300, 900),
    "maize": (15, 35, 300, 1200),
    "sugarcane": (20, 35, 600, 1500),
    "coffee": (18, 25, 1200, 2500),
}

# scenario -> (add to temperature, factor on rainfall, factor on humidity, humidity floor)
SCENARIOS = [
    ("baseline", 0.0, 1.0, 1.0, None),
    ("plus_2c_temp", 2.0, 1.0, 1.0, None),
    ("minus_20pct_rainfall", 0.0, 0.8, 1.0, None),
    ("drought_risk", 0.0, 0.6, 0.75, 10.0),
    ("heatwave_risk", 4.0, 1.0, 0.85, 10.0),
]

# country box (lat_lo, lat_hi, lon_lo, lon_hi) and province boxes in priority order
BOX_COUNTRY = "Pakistan"
COUNTRY_BOX = (23.0, 37.5, 60.0, 78.5)
PROVINCE_BOXES = [
    ("Punjab", 27.0, 33.5, 69.0, 75.8),
    ("Sindh", 23.5, 28.8, 66.0, 71.5),
    ("Khyber Pakhtunkhwa", 31.0, 37.3, 67.0, 74.8),
    ("Balochistan", 24.0, 32.5, 60.0, 69.5),
]

# substring of lower("country region") -> default soil pH; otherwise 6.5
PH_BY_SUBSTRING = [("punjab", 7.1), ("sindh", 7.6), ("khyber", 6.8), ("kp", 6.8), ("baloch", 7.3)]
PH_DEFAULT = 6.5

# address keys tried in order for the region name
ADDRESS_KEYS = ["state", "state_district", "province", "county", "region"]

# request defaults of the service
SERVE_DEFAULTS = {"temperature": 25.0, "rainfall": 500.0, "humidity": 60.0, "N": 70.0, "P": 40.0, "K": 40.0,
                  "ph": 6.5}

# ---------------------------------------------------------------------------


def zone_rules(spark: SparkSession, zone_crops: dict | None = None) -> DataFrame:
    """(zone, crop) rule table."""
    zc = zone_crops or ZONE_CROPS
    return spark.createDataFrame([(z, c) for z, cs in zc.items() for c in cs], "zone string, crop string")


def band_rules(spark: SparkSession, bands: dict | None = None) -> DataFrame:
    """(crop, tmin, tmax, rmin, rmax) rule table."""
    b = bands or CROP_BANDS
    return spark.createDataFrame([(c, float(a), float(b_), float(c_), float(d)) for c, (a, b_, c_, d) in b.items()],
                                 "crop string, tmin double, tmax double, rmin double, rmax double")


def zone_rules_sql(zone_crops: dict | None = None) -> str:
    zc = zone_crops or ZONE_CROPS
    vals = ", ".join(f"('{z}', '{c}')" for z, cs in zc.items() for c in cs)
    return f"(SELECT * FROM (VALUES {vals}) t(zone, crop))"


def band_rules_sql(bands: dict | None = None) -> str:
    b = bands or CROP_BANDS
    vals = ", ".join(f"('{c}', {float(a)}, {float(x)}, {float(y)}, {float(z)})" for c, (a, x, y, z) in b.items())
    return f"(SELECT * FROM (VALUES {vals}) t(crop, tmin, tmax, rmin, rmax))"
