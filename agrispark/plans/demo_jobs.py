"""Registered queries for the composed jobs ML16 (flagship) and ML17."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views as V
from .jobs import build_master, build_timeline, map_points
from .registry import register
from ..operators.aggregates import group_mean
from ..operators.joins import with_geo_key
from .util import round_doubles


def master_inputs(spark, sf):
    o = V.obs(spark, sf)
    climate = o.select(
        F.col("country").alias("Country"), F.col("region").alias("Region"), F.col("year").alias("Year"),
        F.col("crop_type").alias("Crop_Type"), F.col("temperature").alias("Average_Temperature_C"),
        F.col("rainfall").alias("Total_Precipitation_mm"), F.col("crop_yield").alias("Crop_Yield_MT_per_HA"))
    return climate, V.soil(spark, sf)


@register("ML16_build_master", """
SELECT trim(country) AS country, trim(region) AS region, year,
       make_timestamp(year, 1, 1, 0, 0, 0) AS "timestamp",
       trim(crop_type) AS crop_type, temperature, rainfall,
       coalesce(pri.humidity, (SELECT quantile_cont(humidity, 0.5) FROM soil), 60.0) AS humidity,
       pri.N AS N, pri.P AS P, pri.K AS K, pri.ph AS ph, crop_yield
FROM obs LEFT JOIN (
    SELECT lower(trim(label)) AS pkey, quantile_cont(N, 0.5) AS N, quantile_cont(P, 0.5) AS P,
           quantile_cont(K, 0.5) AS K, quantile_cont(ph, 0.5) AS ph,
           quantile_cont(humidity, 0.5) AS humidity
    FROM soil WHERE lower(trim(label)) <> '' GROUP BY 1) pri
  ON lower(trim(obs.crop_type)) = pri.pkey
WHERE trim(country) <> '' AND trim(crop_type) <> ''
  AND temperature IS NOT NULL AND rainfall IS NOT NULL AND crop_yield IS NOT NULL
""", views=("obs", "soil"))
def q_build_master(spark, sf):
    climate, soil = master_inputs(spark, sf)
    return build_master(climate, soil)


def climate_means(spark, sf):
    """Yearly climate rows from ``obs``: means per (country, crop, year).

    rainfall and yield are exact decimals (4 and 8 places); they are averaged
    as exact integer units, so every sum is exact whatever the summation
    order and both engines produce the same double.
    """
    o = V.obs(spark, sf).select(
        "country", "crop_type", "year", "temperature",
        F.round(F.col("rainfall") * 1e4).cast("long").alias("rain_u"),
        F.round(F.col("crop_yield") * 1e8).cast("long").alias("yield_u"))
    g = group_mean(o, ["country", "crop_type", "year"], ["temperature", "rain_u", "yield_u"])
    return g.select("country", "crop_type", "year", F.col("temperature").alias("temperature_c"),
                    (F.col("rain_u") / 1e4).alias("precipitation_mm"), (F.col("yield_u") / 1e8).alias("crop_yield"))


CLIM_SQL = """clim AS (
  SELECT country, crop_type, year, avg(temperature) AS temperature_c,
         avg(CAST(round(rainfall * 1e4) AS BIGINT)) / 1e4 AS precipitation_mm,
         avg(CAST(round(crop_yield * 1e8) AS BIGINT)) / 1e8 AS crop_yield
  FROM obs WHERE country IS NOT NULL AND crop_type IS NOT NULL AND year IS NOT NULL GROUP BY ALL)"""


def timeline_inputs(spark, sf):
    climate = climate_means(spark, sf)
    w = V.weather(spark, sf)
    cache = (with_geo_key(w, "latitude", "longitude", "last_updated")
             .groupBy("lat_key", "lon_key", "day_key")
             .agg(F.avg("temperature_celsius").alias("nasa_temp_c"), F.sum("precip_mm").alias("nasa_precip_mm"),
                  F.avg("humidity").alias("nasa_rh2m")))
    return climate, w, cache


TIMELINE_COLUMNS = ["country", "crop_type", "year", "timestamp", "month", "quarter", "temperature_c",
                    "precipitation_mm", "crop_yield", "weather_temp_c", "weather_precip_mm", "weather_humidity",
                    "crop_yield_lag1", "crop_yield_trend3", "latitude", "longitude", "nasa_temp_c",
                    "nasa_precip_mm", "nasa_rh2m", "temp_delta", "precip_delta", "yield_per_precip"]

TIMELINE_SQL = "WITH " + CLIM_SQL + """,
wy AS (
  SELECT country, CAST(year(last_updated) AS INTEGER) AS year, avg(temperature_celsius) AS weather_temp_c,
         avg(precip_mm) AS weather_precip_mm, avg(humidity) AS weather_humidity
  FROM weather WHERE country IS NOT NULL AND last_updated IS NOT NULL GROUP BY ALL),
cent AS (
  SELECT country, avg(latitude) AS latitude, avg(longitude) AS longitude FROM weather
  WHERE country IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY country),
cache AS (
  SELECT CAST(round(latitude * 1000) AS BIGINT) AS lat_key, CAST(round(longitude * 1000) AS BIGINT) AS lon_key,
         strftime(last_updated, '%Y%m%d') AS day_key, avg(temperature_celsius) AS nasa_temp_c,
         sum(precip_mm) AS nasa_precip_mm, avg(humidity) AS nasa_rh2m
  FROM weather GROUP BY ALL),
t AS (
  SELECT clim.*, make_timestamp(clim.year, 1, 1, 0, 0, 0) AS "timestamp",
         wy.weather_temp_c, wy.weather_precip_mm, wy.weather_humidity
  FROM clim LEFT JOIN wy ON clim.country = wy.country AND clim.year = wy.year),
t2 AS (
  SELECT t.*, CAST(month("timestamp") AS INTEGER) AS month, CAST(quarter("timestamp") AS INTEGER) AS quarter,
         lag(crop_yield) OVER (PARTITION BY t.country, crop_type ORDER BY "timestamp") AS crop_yield_lag1,
         avg(crop_yield) OVER (PARTITION BY t.country, crop_type ORDER BY "timestamp"
                               ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS crop_yield_trend3,
         cent.latitude, cent.longitude
  FROM t LEFT JOIN cent ON t.country = cent.country)
SELECT t2.country, crop_type, year, "timestamp", month, quarter,
       round(temperature_c, 6) AS temperature_c, round(precipitation_mm, 6) AS precipitation_mm,
       round(crop_yield, 6) AS crop_yield, round(weather_temp_c, 6) AS weather_temp_c,
       round(weather_precip_mm, 6) AS weather_precip_mm, round(weather_humidity, 6) AS weather_humidity,
       round(crop_yield_lag1, 6) AS crop_yield_lag1, round(crop_yield_trend3, 6) AS crop_yield_trend3,
       round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
       round(c.nasa_temp_c, 6) AS nasa_temp_c, round(c.nasa_precip_mm, 6) AS nasa_precip_mm,
       round(c.nasa_rh2m, 6) AS nasa_rh2m,
       round(temperature_c - weather_temp_c, 6) AS temp_delta,
       round(precipitation_mm - weather_precip_mm, 6) AS precip_delta,
       round(crop_yield / nullif(precipitation_mm, 0.0), 6) AS yield_per_precip
FROM t2 LEFT JOIN cache c
  ON c.lat_key = CAST(round(t2.latitude * 1000) AS BIGINT) AND c.lon_key = CAST(round(t2.longitude * 1000) AS BIGINT)
 AND c.day_key = strftime(t2."timestamp", '%Y%m%d')
"""


@register("ML17_build_timeline", TIMELINE_SQL, views=("obs", "weather"))
def q_build_timeline(spark, sf):
    climate, w, cache = timeline_inputs(spark, sf)
    t = build_timeline(climate, w, cache)
    return round_doubles(t.select(*TIMELINE_COLUMNS), 6)


@register("S9_write_point_extract", "WITH " + CLIM_SQL + """,
cent AS (
  SELECT country, avg(latitude) AS latitude, avg(longitude) AS longitude FROM weather
  WHERE country IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY country)
SELECT clim.country, crop_type, make_timestamp(year, 1, 1, 0, 0, 0) AS "timestamp",
       round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(crop_yield, 6) AS crop_yield
FROM clim LEFT JOIN cent ON clim.country = cent.country
""", views=("obs", "weather"))
def q_point_extract(spark, sf):
    climate, w, _ = timeline_inputs(spark, sf)
    return round_doubles(map_points(build_timeline(climate, w, None)), 6)
