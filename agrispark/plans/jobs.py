"""Composed jobs: the master table (ML16) and the integrated timeline (ML17).

Plan shape (ML16): scan climate -> project/coerce/filter (pushed to the scan
where possible) -> left join to per-crop priors, which are aggregated
**before** the join (one row per crop) -> scalar-subquery median fill ->
final projection. At scale the only large shuffle is on the fact side of the
priors join; AQE broadcasts the priors after measuring them.

Plan shape (ML17): yearly weather means (partial + final aggregate) -> left
join -> one window spec on (country, crop_type) ordered by time serves both
the lag and the rolling mean -> centroid join -> cache lookup join -> derived
columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import (coerce_double_in, coerce_int_in, delta, norm_key, safe_ratio, year_start_ts_int)
from ..operators.aggregates import quantiles, geo_centroid, group_mean, group_median
from ..operators.filters import drop_null_rows
from ..operators.joins import join_centroid, join_priors, join_yearly, lookup_cached, with_geo_key, written
from ..operators.schema import normalise_headers, rename_present, require_columns
from ..operators.windows import SEGMENT_ROWS, calendar_parts, lag_column, look_back, rolling_mean_column

# fixed values: source header spellings -> canonical names
CLIMATE_RENAMES = {
    "Country": "country", "Region": "region", "Year": "year", "Crop_Type": "crop_type",
    "Average_Temperature_C": "temperature_c", "Total_Precipitation_mm": "rainfall_mm",
    "Crop_Yield_MT_per_HA": "crop_yield",
}
CLIMATE_REQUIRED = ["country", "region", "year", "crop_type", "temperature_c", "rainfall_mm", "crop_yield"]
SOIL_REQUIRED = ["n", "p", "k", "temperature", "humidity", "rainfall", "crop_type"]
MASTER_COLUMNS = ["country", "region", "year", "timestamp", "crop_type", "temperature", "rainfall",
                  "humidity", "N", "P", "K", "ph", "crop_yield"]


def _nonblank(c: str):
    return F.col(c).isNotNull() & (F.col(c) != "")


def load_climate(raw: DataFrame) -> DataFrame:
    """Climate table: rename, require, trim, coerce, year-start timestamp, clean."""
    d = rename_present(raw, CLIMATE_RENAMES)
    require_columns(d, CLIMATE_REQUIRED, "climate dataset")
    d = d.select(
        F.trim(F.col("country").cast("string")).alias("country"),
        F.trim(F.col("region").cast("string")).alias("region"),
        coerce_int_in(d, "year").alias("year"),
        F.trim(F.col("crop_type").cast("string")).alias("crop_type"),
        coerce_double_in(d, "temperature_c").alias("temperature_c"),
        coerce_double_in(d, "rainfall_mm").alias("rainfall_mm"),
        coerce_double_in(d, "crop_yield").alias("crop_yield"),
    ).withColumn("timestamp", year_start_ts_int("year"))
    d = d.where(F.col("country").isNotNull() & F.col("region").isNotNull()
                & F.col("timestamp").isNotNull() & F.col("crop_type").isNotNull())
    return d.where(_nonblank("country") & _nonblank("crop_type"))


def load_soil(raw: DataFrame) -> DataFrame:
    """Soil/crop table: lower-case headers, label -> crop_type, normalised key, coerce."""
    d = normalise_headers(raw)
    require_columns(d, SOIL_REQUIRED, "recommendation dataset")
    num = [c for c in ("n", "p", "k", "temperature", "humidity", "rainfall", "ph") if c in d.columns]
    d = d.select(norm_key("crop_type").alias("crop_type"), *[coerce_double_in(d, c).alias(c) for c in num])
    return d.where(_nonblank("crop_type"))


def build_master(climate_raw: DataFrame, soil_raw: DataFrame, default_humidity: float = 60.0) -> DataFrame:
    """ML16: climate rows enriched with per-crop soil medians; fixed 13 columns."""
    climate = load_climate(climate_raw)
    soil = load_soil(soil_raw)
    stat_cols = [c for c in ("n", "p", "k", "ph", "humidity") if c in soil.columns]
    priors = group_median(soil, "crop_type", stat_cols, normalise=False)
    priors = priors.withColumnsRenamed({"n": "N", "p": "P", "k": "K"}).withColumnRenamed("crop_type", "prior_key")
    out = join_priors(climate, priors, "crop_type", "prior_key")
    if "humidity" in soil.columns:
        gh = quantiles(soil, [], "humidity", [0.5], ["gh"]).scalar()
        hum = F.coalesce(F.col("humidity"), gh, F.lit(default_humidity)) if "humidity" in out.columns \
            else F.coalesce(gh, F.lit(default_humidity))
    else:
        hum = F.coalesce(F.col("humidity"), F.lit(default_humidity)) if "humidity" in out.columns \
            else F.lit(default_humidity)
    out = out.withColumn("humidity", hum).withColumnsRenamed(
        {"temperature_c": "temperature", "rainfall_mm": "rainfall"})
    for c in MASTER_COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    out = out.select(*MASTER_COLUMNS)
    out = drop_null_rows(out, ["country", "region", "timestamp", "crop_type", "temperature", "rainfall", "crop_yield"])
    return out.where(_nonblank("country") & _nonblank("crop_type"))


def normalise_weather(raw: DataFrame) -> DataFrame:
    """Weather snapshots: canonical names, parsed timestamp."""
    d = rename_present(raw, {"last_updated": "timestamp_raw", "temperature_celsius": "temperature_c",
                             "precip_mm": "precipitation_mm"})
    ts = F.col("timestamp_raw")
    if dict(d.dtypes).get("timestamp_raw") == "string":
        ts = F.try_to_timestamp(ts)
    return d.select("country", "location_name", "latitude", "longitude", ts.alias("timestamp"),
                    "temperature_c", "precipitation_mm", "humidity")


def build_timeline(climate: DataFrame, weather_raw: DataFrame, cache: DataFrame | None = None,
                   tiebreak: tuple = (), segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """ML17: climate timeline + yearly weather, lag, rolling mean, centroids, cache, deltas.

    ``climate`` columns: country, year, crop_type, temperature_c,
    precipitation_mm, crop_yield (+ optional tiebreak columns). ``cache``
    (optional) has lat_key, lon_key, day_key, nasa_temp_c, nasa_precip_mm,
    nasa_rh2m.
    """
    weather = normalise_weather(weather_raw)
    c = written(climate).withColumn("timestamp", year_start_ts_int(coerce_int_in(climate, "year")))
    wd = weather.where(F.col("country").isNotNull() & F.col("timestamp").isNotNull()).withColumn(
        "year", F.year("timestamp"))
    yearly = group_mean(wd, ["country", "year"], ["temperature_c", "precipitation_mm", "humidity"])
    yearly = yearly.withColumnsRenamed({"temperature_c": "weather_temp_c", "precipitation_mm": "weather_precip_mm",
                                        "humidity": "weather_humidity"})
    t = join_yearly(c, yearly, ["country", "year"])
    t = calendar_parts(t, "timestamp").drop("year_of")
    order = ["timestamp", *tiebreak]
    t = look_back(t, ["country", "crop_type"], order, 2, {"crop_yield_lag1": lag_column("crop_yield"), "crop_yield_trend3": rolling_mean_column("crop_yield", 3)}, segment_rows, counted=c)
    cents = geo_centroid(weather, "country", "latitude", "longitude")
    t = join_centroid(t, cents, "country")
    if cache is not None:
        t = with_geo_key(t, "latitude", "longitude", "timestamp")
        t = lookup_cached(t, cache).drop("lat_key", "lon_key", "day_key")
    else:
        t = t.withColumns({"nasa_temp_c": F.lit(None).cast("double"),
                           "nasa_precip_mm": F.lit(None).cast("double"),
                           "nasa_rh2m": F.lit(None).cast("double")})
    return t.withColumns({
        "temp_delta": delta("temperature_c", "weather_temp_c"),
        "precip_delta": delta("precipitation_mm", "weather_precip_mm"),
        "yield_per_precip": safe_ratio("crop_yield", "precipitation_mm"),
    })


def map_points(timeline: DataFrame) -> DataFrame:
    """The narrow 6-column extract for map use."""
    return timeline.select("country", "crop_type", "timestamp", "latitude", "longitude", "crop_yield")
