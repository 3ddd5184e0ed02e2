"""Registered feature-preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views as V
from .registry import register
from .rules import BOX_COUNTRY, COUNTRY_BOX, PH_BY_SUBSTRING, PH_DEFAULT, PROVINCE_BOXES
from .util import round_doubles
from ..functions import scalar as X
from ..operators import features as M
from ..operators.aggregates import daily_to_point_climate
from ..operators.ranking import union_tagged


def H(key: str, seed: int = 42) -> str:
    """DuckDB twin of ranking.sample_key."""
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 8) AS BIGINT)"


def SPLIT(key: str) -> str:
    return f"CASE WHEN CAST({H(key)} AS DOUBLE) / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END"


@register("M1_random_split", f"SELECT o_orderkey, {SPLIT('o_orderkey')} AS dataset_split FROM orders")
def q_m1(spark, sf):
    return M.random_split(V.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@register("M2_stratified_split", f"""
SELECT p_partkey, p_type,
       CASE WHEN row_number() OVER (PARTITION BY p_type ORDER BY {H('p_partkey')}, p_partkey)
                 <= floor(count(*) OVER (PARTITION BY p_type) * 0.8) THEN 'train' ELSE 'test' END AS dataset_split
FROM part
""")
def q_m2(spark, sf):
    p = V.read(spark, sf, "part").select("p_partkey", "p_type")
    return M.stratified_split(p, "p_type", "p_partkey")


@register("U1_union_tagged", f"""
SELECT o_orderkey, o_totalprice, {SPLIT('o_orderkey')} AS dataset_split FROM orders
""")
def q_u1(spark, sf):
    o = M.random_split(V.read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", out="s")
    tr = o.where(F.col("s") == "train").drop("s")
    te = o.where(F.col("s") == "test").drop("s")
    return union_tagged(tr, te)


@register("M3_impute_median", f"""
WITH p AS (SELECT place_id, humidity, N, P, K, {SPLIT('place_id')} AS dataset_split FROM places),
m AS (SELECT quantile_cont(humidity, 0.5) AS h, quantile_cont(N, 0.5) AS mn, quantile_cont(P, 0.5) AS pp,
             quantile_cont(K, 0.5) AS mk FROM p WHERE dataset_split = 'train')
SELECT place_id, dataset_split, coalesce(humidity, h) AS humidity, coalesce(N, mn) AS N, coalesce(P, pp) AS P,
       coalesce(K, mk) AS K FROM p CROSS JOIN m
""", views=("places",))
def q_m3(spark, sf):
    p = M.random_split(V.places(spark, sf).select("place_id", "humidity", "N", "P", "K"), "place_id")
    return M.impute_median(p, ["humidity", "N", "P", "K"]).select(
        "place_id", "dataset_split", "humidity", "N", "P", "K")


def priorities(spark, sf):
    o = V.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    o = o.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 9 == 0, F.lit(None))
                     .otherwise(F.col("o_orderpriority")))
    return M.random_split(o, "o_orderkey")


PRIO_SQL = f"""
o AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS prio,
             {SPLIT('o_orderkey')} AS dataset_split FROM orders)"""


@register("M4_impute_mode", f"""
WITH {PRIO_SQL},
md AS (SELECT prio AS mode_prio FROM o WHERE dataset_split = 'train' AND prio IS NOT NULL
       GROUP BY prio ORDER BY count(*) DESC, prio LIMIT 1)
SELECT o_orderkey, dataset_split, coalesce(prio, mode_prio) AS o_orderpriority FROM o CROSS JOIN md
""")
def q_m4(spark, sf):
    o = priorities(spark, sf)
    return M.impute_mode(o, ["o_orderpriority"]).select("o_orderkey", "dataset_split", "o_orderpriority")


@register("M5_standardise", f"""
WITH s AS (SELECT soil_id, N, P, K, temperature, {SPLIT('soil_id')} AS dataset_split FROM soil),
st AS (SELECT avg(N) AS mn, stddev_pop(N) AS sn, avg(P) AS mp, stddev_pop(P) AS sp, avg(K) AS mk,
              stddev_pop(K) AS sk, avg(temperature) AS mt, stddev_pop(temperature) AS stt
       FROM s WHERE dataset_split = 'train')
SELECT soil_id, dataset_split,
       round((N - mn) / CASE WHEN sn = 0 THEN 1.0 ELSE sn END, 6) AS N,
       round((P - mp) / CASE WHEN sp = 0 THEN 1.0 ELSE sp END, 6) AS P,
       round((K - mk) / CASE WHEN sk = 0 THEN 1.0 ELSE sk END, 6) AS K,
       round((temperature - mt) / CASE WHEN stt = 0 THEN 1.0 ELSE stt END, 6) AS temperature
FROM s CROSS JOIN st
""", views=("soil",))
def q_m5(spark, sf):
    s = M.random_split(V.soil(spark, sf).select("soil_id", "N", "P", "K", "temperature"), "soil_id")
    return round_doubles(M.standardise(s, ["N", "P", "K", "temperature"]))


@register("M6_one_hot", f"""
WITH {PRIO_SQL}
SELECT o_orderkey, dataset_split,
  CASE WHEN prio = '1-URGENT' THEN 1.0 ELSE 0.0 END::DOUBLE AS "cat__o_orderpriority_1-URGENT",
  CASE WHEN prio = '2-HIGH' THEN 1.0 ELSE 0.0 END::DOUBLE AS "cat__o_orderpriority_2-HIGH",
  CASE WHEN prio = '3-MEDIUM' THEN 1.0 ELSE 0.0 END::DOUBLE AS "cat__o_orderpriority_3-MEDIUM",
  CASE WHEN prio = '4-NOT SPECIFIED' THEN 1.0 ELSE 0.0 END::DOUBLE AS "cat__o_orderpriority_4-NOT SPECIFIED",
  CASE WHEN prio = '5-LOW' THEN 1.0 ELSE 0.0 END::DOUBLE AS "cat__o_orderpriority_5-LOW"
FROM o
""")
def q_m6(spark, sf):
    o = priorities(spark, sf)
    out = M.one_hot(o, ["o_orderpriority"])
    return out.drop("o_orderpriority", "o_totalprice")


@register("M7_label_encode", """
SELECT p_partkey, p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type_encoded FROM part
""")
def q_m7(spark, sf):
    return M.label_encode(V.read(spark, sf, "part").select("p_partkey", "p_type"), "p_type")


def soil_features(spark, sf):
    s = V.soil(spark, sf)
    band = (F.when(F.col("soil_id") % 11 == 0, F.lit(None).cast("string"))
            .when(F.col("N") < 30, "small").when(F.col("N") < 70, "mid").otherwise("big"))
    return s.withColumn("band", band)


@register("M8_preprocess_table", f"""
WITH s AS (SELECT *, CASE WHEN soil_id % 11 = 0 THEN NULL WHEN N < 30 THEN 'small' WHEN N < 70 THEN 'mid'
                          ELSE 'big' END AS band FROM soil),
sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {H('soil_id')}, soil_id)
                 <= floor(count(*) OVER (PARTITION BY label) * 0.8) THEN 'train' ELSE 'test' END AS dataset_split
       FROM s),
med AS (SELECT quantile_cont(N, 0.5) AS mN, quantile_cont(P, 0.5) AS mP, quantile_cont(K, 0.5) AS mK,
               quantile_cont(temperature, 0.5) AS mT, quantile_cont(humidity, 0.5) AS mH,
               quantile_cont(ph, 0.5) AS mph, quantile_cont(rainfall, 0.5) AS mR FROM sp WHERE dataset_split = 'train'),
imp AS (SELECT soil_id, label, dataset_split, band, coalesce(N, mN) AS N, coalesce(P, mP) AS P, coalesce(K, mK) AS K,
               coalesce(temperature, mT) AS temperature, coalesce(humidity, mH) AS humidity,
               coalesce(ph, mph) AS ph, coalesce(rainfall, mR) AS rainfall FROM sp CROSS JOIN med),
st AS (SELECT avg(N) a1, stddev_pop(N) s1, avg(P) a2, stddev_pop(P) s2, avg(K) a3, stddev_pop(K) s3,
              avg(temperature) a4, stddev_pop(temperature) s4, avg(humidity) a5, stddev_pop(humidity) s5,
              avg(ph) a6, stddev_pop(ph) s6, avg(rainfall) a7, stddev_pop(rainfall) s7
       FROM imp WHERE dataset_split = 'train'),
md AS (SELECT band AS mode_band FROM imp WHERE dataset_split = 'train' AND band IS NOT NULL
       GROUP BY band ORDER BY count(*) DESC, band LIMIT 1),
b AS (SELECT imp.*, coalesce(band, mode_band) AS band2 FROM imp CROSS JOIN md)
SELECT soil_id,
  round((N - a1) / CASE WHEN s1 = 0 THEN 1.0 ELSE s1 END, 6) AS num__N,
  round((P - a2) / CASE WHEN s2 = 0 THEN 1.0 ELSE s2 END, 6) AS num__P,
  round((K - a3) / CASE WHEN s3 = 0 THEN 1.0 ELSE s3 END, 6) AS num__K,
  round((temperature - a4) / CASE WHEN s4 = 0 THEN 1.0 ELSE s4 END, 6) AS num__temperature,
  round((humidity - a5) / CASE WHEN s5 = 0 THEN 1.0 ELSE s5 END, 6) AS num__humidity,
  round((ph - a6) / CASE WHEN s6 = 0 THEN 1.0 ELSE s6 END, 6) AS num__ph,
  round((rainfall - a7) / CASE WHEN s7 = 0 THEN 1.0 ELSE s7 END, 6) AS num__rainfall,
  CASE WHEN band2 = 'big' THEN 1.0 ELSE 0.0 END::DOUBLE AS cat__band_big,
  CASE WHEN band2 = 'mid' THEN 1.0 ELSE 0.0 END::DOUBLE AS cat__band_mid,
  CASE WHEN band2 = 'small' THEN 1.0 ELSE 0.0 END::DOUBLE AS cat__band_small,
  dataset_split, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_encoded
FROM b CROSS JOIN st
""", views=("soil",))
def q_m8(spark, sf):
    out = M.preprocess_table(soil_features(spark, sf), "label", "soil_id")
    return round_doubles(out)


@register("M9_quantile_bins", f"""
WITH o AS (SELECT o_orderkey, o_totalprice, {SPLIT('o_orderkey')} AS dataset_split FROM orders),
e AS (SELECT quantile_cont(o_totalprice, 1.0 / 3) AS e1, quantile_cont(o_totalprice, 2.0 / 3) AS e2
      FROM o WHERE dataset_split = 'train')
SELECT o_orderkey, dataset_split,
       CASE WHEN o_totalprice >= e2 THEN 'high' WHEN o_totalprice >= e1 THEN 'medium' ELSE 'low' END AS yield_band
FROM o CROSS JOIN e
""")
def q_m9(spark, sf):
    o = M.random_split(V.read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    out = M.quantile_bins(o, "o_totalprice", 3, out="yield_band", labels=["low", "medium", "high"])
    return out.select("o_orderkey", "dataset_split", "yield_band")


@register("M10_class_weights", """
SELECT p_partkey, p.p_type, round(n / (k * nc), 9) AS weight
FROM part p JOIN (SELECT p_type, CAST(count(*) AS DOUBLE) AS nc FROM part GROUP BY p_type) c ON p.p_type = c.p_type
CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT p_type) AS DOUBLE) AS k FROM part)
""")
def q_m10(spark, sf):
    p = V.read(spark, sf, "part").select("p_partkey", "p_type")
    return round_doubles(M.class_weights(p, "p_type"), 9)


FEATURE_ORDER = ["N", "P", "K", "temperature", "humidity", "rainfall", "climate_score", "region_type", "ph"]


@register("M12_row_features_with_defaults", """
SELECT place_id, coalesce(N, 70.0) AS N, coalesce(P, 40.0) AS P, coalesce(K, 40.0) AS K, temp AS temperature,
       humidity, rain AS rainfall, round(temp * 0.4 + humidity * 0.3 + rain * 0.3, 9) AS climate_score,
       CASE WHEN rain IS NULL THEN NULL WHEN rain < 250 THEN 'arid' WHEN rain <= 800 THEN 'temperate'
            ELSE 'tropical' END AS region_type, 0.0::DOUBLE AS ph
FROM places
""", views=("places",))
def q_m12(spark, sf):
    p = V.places(spark, sf).select("place_id", "N", "P", "K", F.col("temp").alias("temperature"), "humidity",
                                   F.col("rain").alias("rainfall"))
    return round_doubles(M.row_features_with_defaults(p, FEATURE_ORDER), 9)


def geo_feature_rows(spark, sf):
    """Model row per point: climate (A21) + region (X13) + pH default (X14) + source."""
    w = V.weather(spark, sf)
    pts = w.groupBy("place_id").agg(F.first("country").alias("country"), F.avg("latitude").alias("lat"),
                                    F.avg("longitude").alias("lon"), F.count(F.lit(1)).alias("n"))
    clim = daily_to_point_climate(w, ["place_id"], "temperature_celsius", "precip_mm", "humidity")
    region_in = F.when(F.col("place_id") % 2 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("Region "), (F.col("place_id") % 5).cast("string")))
    r = pts.join(clim, "place_id", "left").withColumn("region_in", region_in)
    rf = X.region_fallback("country", "region_in", "lat", "lon", COUNTRY_BOX, PROVINCE_BOXES, BOX_COUNTRY)
    r = r.withColumns({"country": rf["country"], "region": rf["region"]})
    live_clim = F.col("n") >= 60
    live_geo = F.col("region_in").isNotNull()
    return r.select(
        "place_id", "lat", "lon", F.lit("Wheat").alias("crop_type"), "temperature", "rainfall", "humidity",
        "country", "region",
        X.default_by_substring(F.concat_ws(" ", "country", "region"), PH_BY_SUBSTRING, PH_DEFAULT).alias("ph"),
        F.when(live_clim & live_geo, "live_api").otherwise("fallback").alias("source"))


def _box_case(lat, lon):
    a0, a1, o0, o1 = COUNTRY_BOX
    s = f"CASE WHEN NOT ({lat} BETWEEN {a0} AND {a1} AND {lon} BETWEEN {o0} AND {o1}) THEN NULL "
    for name, b0, b1, c0, c1 in PROVINCE_BOXES:
        s += f"WHEN {lat} BETWEEN {b0} AND {b1} AND {lon} BETWEEN {c0} AND {c1} THEN '{name}' "
    return s + "ELSE 'Unknown' END"


def _ph_case(text):
    s = "CASE "
    for needle, v in PH_BY_SUBSTRING:
        s += f"WHEN contains(lower({text}), '{needle}') THEN {v} "
    return s + f"ELSE {PH_DEFAULT} END::DOUBLE"


@register("M13_geo_feature_row", f"""
WITH p AS (SELECT place_id, first(country) AS country, avg(latitude) AS lat, avg(longitude) AS lon, count(*) AS n,
                  coalesce(avg(temperature_celsius), 25.0) AS temperature, coalesce(sum(precip_mm), 500.0) AS rainfall,
                  coalesce(avg(humidity), 60.0) AS humidity
           FROM weather GROUP BY place_id),
q AS (SELECT *, CASE WHEN place_id % 2 = 0 THEN NULL ELSE 'Region ' || CAST(place_id % 5 AS VARCHAR) END AS region_in,
             {_box_case('lat', 'lon')} AS prov FROM p),
r AS (SELECT *,
        CASE WHEN region_in IS NOT NULL THEN country WHEN prov IS NOT NULL AND prov <> 'Unknown' THEN '{BOX_COUNTRY}'
             ELSE coalesce(country, 'Unknown') END AS country2,
        CASE WHEN region_in IS NOT NULL THEN region_in ELSE coalesce(prov, 'Unknown') END AS region FROM q)
SELECT place_id, round(lat, 6) AS lat, round(lon, 6) AS lon, 'Wheat' AS crop_type, round(temperature, 6) AS temperature,
       round(rainfall, 6) AS rainfall, round(humidity, 6) AS humidity, country2 AS country, region,
       {_ph_case("country2 || ' ' || region")} AS ph,
       CASE WHEN n >= 60 AND region_in IS NOT NULL THEN 'live_api' ELSE 'fallback' END AS source
FROM r
""", views=("weather",))
def q_m13(spark, sf):
    return round_doubles(geo_feature_rows(spark, sf))
