"""Registered join queries (J1 - J7, J9 - J12; J8 with the scenario demos)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views as V
from .demo_scalar import CROP_CASE_SQL, OBS_KEY, crop_name
from .registry import register
from .rules import band_rules, band_rules_sql
from .util import bround, round_doubles
from ..operators import aggregates as A
from ..operators import joins as J


@register("J1_join_priors", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, crop_type, pri.N AS N, pri.ph AS ph
FROM obs LEFT JOIN (SELECT lower(trim(label)) AS pkey, quantile_cont(N, 0.5) AS N, quantile_cont(ph, 0.5) AS ph
                    FROM soil WHERE label IS NOT NULL GROUP BY 1) pri
  ON lower(trim(obs.crop_type)) = pri.pkey
""", views=("obs", "soil"))
def q_j1(spark, sf):
    pri = A.group_median(V.soil(spark, sf), "label", ["N", "ph"])
    fact = V.obs(spark, sf).select(*OBS_KEY, "crop_type")
    return J.join_priors(fact, pri, "crop_type", "label")


@register("J2_join_yearly", """
WITH f AS (SELECT country, year, avg(crop_yield) AS crop_yield FROM obs GROUP BY ALL),
     y AS (SELECT country, CAST(year(last_updated) AS INTEGER) AS year, avg(temperature_celsius) AS weather_temp_c
           FROM weather GROUP BY ALL)
SELECT f.country, f.year, round(crop_yield, 6) AS crop_yield, round(weather_temp_c, 6) AS weather_temp_c
FROM f LEFT JOIN y ON f.country = y.country AND f.year = y.year
""", views=("obs", "weather"))
def q_j2(spark, sf):
    f = A.group_mean(V.obs(spark, sf), ["country", "year"], ["crop_yield"])
    w = V.weather(spark, sf).withColumn("year", F.year("last_updated"))
    y = A.group_mean(w, ["country", "year"], ["temperature_celsius"]).withColumnRenamed(
        "temperature_celsius", "weather_temp_c")
    # the weather snapshots fall in one year, so most rows find no match (left join keeps them)
    return round_doubles(J.join_yearly(f, y, ["country", "year"]))


@register("J3_join_centroid", """
SELECT place_id, places.country, round(c.latitude, 6) AS latitude, round(c.longitude, 6) AS longitude
FROM places LEFT JOIN (SELECT country, avg(latitude) AS latitude, avg(longitude) AS longitude FROM weather
                       WHERE country IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL
                       GROUP BY country) c ON places.country = c.country
""", views=("places", "weather"))
def q_j3(spark, sf):
    cents = A.geo_centroid(V.weather(spark, sf))
    return round_doubles(J.join_centroid(V.places(spark, sf).select("place_id", "country"), cents))


@register("J4_merge_by_key", """
WITH v AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n_view FROM events
           WHERE event_type IN ('view', 'signup') GROUP BY 1),
     c AS (SELECT CAST(ts AS DATE) AS day, round(sum(value), 6) AS click_value FROM events
           WHERE event_type IN ('click', 'purchase') GROUP BY 1),
     e AS (SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS error_mean FROM events
           WHERE event_type NOT IN ('view', 'signup', 'click', 'purchase') GROUP BY 1)
SELECT coalesce(v.day, c.day, e.day) AS day, n_view, click_value, error_mean
FROM v FULL JOIN c ON v.day = c.day FULL JOIN e ON coalesce(v.day, c.day) = e.day
""")
def q_j4(spark, sf):
    e = V.read(spark, sf, "events").withColumn("day", F.to_date("ts"))
    # three sources that share out all events, each covering the days on which it has any
    t = F.col("event_type")
    v = e.where(t.isin("view", "signup")).groupBy("day").agg(
        F.count(F.lit(1)).alias("n_view"))
    c = e.where(t.isin("click", "purchase")).groupBy("day").agg(
        bround(F.sum("value"), 6).alias("click_value"))
    er = e.where(~t.isin("view", "signup", "click", "purchase")).groupBy("day").agg(
        bround(F.avg("value"), 6).alias("error_mean"))
    return J.merge_by_key([v, c, er], "day")


@register("J5_zip_columns", """
SELECT o_orderkey, o_totalprice, o_orderdate FROM orders
""")
def q_j5(spark, sf):
    o = V.read(spark, sf, "orders")
    return J.zip_columns(o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", "o_orderdate"), "o_orderkey")


def cache_demo(spark, sf):
    w = V.weather(spark, sf)
    keyed = J.with_geo_key(w, "latitude", "longitude", "last_updated")
    # the cache holds the readings already fetched: here, the warm ones
    cache = (keyed.where(F.col("temperature_celsius") >= 40).groupBy("lat_key", "lon_key", "day_key")
             .agg(F.avg("temperature_celsius").alias("nasa_temp_c"), F.avg("humidity").alias("nasa_rh2m")))
    points = keyed.select("place_id", "lat_key", "lon_key", "day_key").distinct()
    return points, cache


CACHE_SQL = """
k AS (SELECT event_id, place_id, temperature_celsius, humidity,
             CAST(round(latitude * 1000) AS BIGINT) AS lat_key, CAST(round(longitude * 1000) AS BIGINT) AS lon_key,
             strftime(last_updated, '%Y%m%d') AS day_key FROM weather),
cache AS (SELECT lat_key, lon_key, day_key, avg(temperature_celsius) AS nasa_temp_c, avg(humidity) AS nasa_rh2m
          FROM k WHERE temperature_celsius >= 40 GROUP BY ALL),
pts AS (SELECT DISTINCT place_id, lat_key, lon_key, day_key FROM k)"""


@register("J6_lookup_cached", "WITH " + CACHE_SQL + """
SELECT pts.place_id, pts.lat_key, pts.lon_key, pts.day_key, round(nasa_temp_c, 6) AS nasa_temp_c,
       round(nasa_rh2m, 6) AS nasa_rh2m
FROM pts LEFT JOIN cache ON pts.lat_key = cache.lat_key AND pts.lon_key = cache.lon_key
 AND pts.day_key = cache.day_key
""", views=("weather",))
def q_j6(spark, sf):
    points, cache = cache_demo(spark, sf)
    return round_doubles(J.lookup_cached(points, cache).select(
        "place_id", "lat_key", "lon_key", "day_key", "nasa_temp_c", "nasa_rh2m"))


@register("J7_cache_misses", "WITH " + CACHE_SQL + """
SELECT DISTINCT lat_key, lon_key, day_key FROM pts
WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.lat_key = pts.lat_key AND c.lon_key = pts.lon_key
                  AND c.day_key = pts.day_key)
""", views=("weather",))
def q_j7(spark, sf):
    points, cache = cache_demo(spark, sf)
    return J.cache_misses(points, cache)


CENT_FEATS = ["N", "P", "K", "temperature", "humidity"]


@register("J9_nearest_centroid", """
WITH c AS (SELECT label, avg(N) AS cN, avg(P) AS cP, avg(K) AS cK, avg(temperature) AS cT, avg(humidity) AS cH
           FROM soil GROUP BY label),
d AS (SELECT place_id, label,
             sqrt((N - cN) * (N - cN) + (P - cP) * (P - cP) + (K - cK) * (K - cK)
                  + (temp - cT) * (temp - cT) + (humidity - cH) * (humidity - cH)) AS dist
      FROM places CROSS JOIN c)
SELECT place_id, arg_min(label, struct_pack(a := dist, b := label)) FILTER (WHERE dist IS NOT NULL) AS rule_label,
       round(min(dist), 6) AS rule_distance
FROM d GROUP BY place_id
""", views=("soil", "places"))
def q_j9(spark, sf):
    cents = A.label_centroids(V.soil(spark, sf), "label", CENT_FEATS)
    p = V.places(spark, sf).select("place_id", "N", "P", "K", F.col("temp").alias("temperature"), "humidity")
    out = J.nearest_centroid(p, cents, CENT_FEATS)
    return round_doubles(out.select("place_id", "rule_label", "rule_distance"))


@register("J9_nearest_centroid_emb", """
WITH c AS (SELECT label AS clabel, g.i AS dim, avg(CAST(embedding[g.i + 1] AS DOUBLE)) AS m
           FROM embeddings CROSS JOIN range(0, 64) g(i) GROUP BY label, g.i),
d AS (SELECT vec_id, clabel, sqrt(sum((CAST(embedding[dim + 1] AS DOUBLE) - m) * (CAST(embedding[dim + 1] AS DOUBLE) - m))) AS dist
      FROM embeddings CROSS JOIN c GROUP BY vec_id, clabel)
SELECT vec_id, CAST(arg_min(clabel, struct_pack(a := round(dist, 9), b := clabel)) AS INTEGER) AS rule_label,
       round(min(dist), 6) AS rule_distance
FROM d GROUP BY vec_id
""")
def q_j9e(spark, sf):
    e = V.emb(spark, sf)
    cents = A.label_centroids_array(e, "label", "embedding", 64)
    out = J.nearest_centroid_vec(e.select("vec_id", "embedding"), cents, "embedding")
    return round_doubles(out.select("vec_id", "rule_label", "rule_distance"))


def class_index(spark, sf):
    from .demo_scalar import OBS_KEY as K
    o = V.obs(spark, sf)
    classes = sorted(r[0] for r in J.collect_bounded(A.distinct_sorted(o, "crop_type"), 10_000, "class list"))
    return J.map_label(o.select(*K, "crop_type"), "crop_type", {c: i for i, c in enumerate(classes)}, "class_idx")


@register("J10_map_label", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, obs.crop_type, CAST(m.idx AS INTEGER) AS class_idx
FROM obs JOIN (SELECT crop_type, row_number() OVER (ORDER BY crop_type) - 1 AS idx
               FROM (SELECT DISTINCT crop_type FROM obs WHERE crop_type IS NOT NULL)) m
  ON obs.crop_type = m.crop_type
""", views=("obs",))
def q_j10(spark, sf):
    return class_index(spark, sf)


@register("J11_range_rule_weight", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, o.crop AS crop,
       CASE WHEN b.tmin IS NULL THEN 1.0
            WHEN temperature < b.tmin - 5 OR temperature > b.tmax + 5 THEN 0.0
            WHEN rainfall < b.rmin - 300 OR rainfall > b.rmax + 300 THEN 0.0
            WHEN temperature < b.tmin OR temperature > b.tmax THEN 0.45
            WHEN rainfall < b.rmin OR rainfall > b.rmax THEN 0.45 ELSE 1.0 END::DOUBLE AS weight
FROM (SELECT *, {CROP_CASE_SQL} AS crop FROM obs) o
LEFT JOIN {band_rules_sql()} b ON lower(o.crop) = lower(b.crop)
""", views=("obs",))
def q_j11(spark, sf):
    o = V.obs(spark, sf).select(*OBS_KEY, crop_name().alias("crop"), "temperature", "rainfall")
    w = J.range_rule_weight(o, band_rules(spark), "crop", "temperature", "rainfall")
    return w.select(*OBS_KEY, "crop", "weight")


def place_queries(spark, sf):
    c = V.read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = V.read(spark, sf, "nation").select("n_nationkey", "n_name")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    q = (F.when(k % 4 == 0, F.col("n_name"))
         .when(k % 4 == 1, F.concat(F.lit("supplier#00000000"), (k % 10).cast("string")))
         .when(k % 4 == 2, F.concat(F.lit("0000"), (k % 100).cast("string")))
         .otherwise(F.lit("zzz")))
    return j.select("c_custkey", q.alias("query"))


@register("J12_tiered_match", """
WITH q AS (
  SELECT c_custkey, lower(trim(CASE c_custkey % 4 WHEN 0 THEN n_name
                          WHEN 1 THEN 'supplier#00000000' || CAST(c_custkey % 10 AS VARCHAR)
                          WHEN 2 THEN '0000' || CAST(c_custkey % 100 AS VARCHAR) ELSE 'zzz' END)) AS query
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (
  SELECT c_custkey, place_id,
         CASE WHEN lower(name) = query OR lower(country) = query THEN 1
              WHEN starts_with(lower(name), query) OR starts_with(lower(country), query) THEN 2
              WHEN contains(lower(name), query) OR contains(lower(country), query) THEN 3 END AS tier
  FROM q CROSS JOIN places)
SELECT c_custkey, CAST(min(tier) AS INTEGER) AS tier, arg_min(place_id, struct_pack(a := tier, b := place_id)) AS place_id
FROM m WHERE tier IS NOT NULL GROUP BY c_custkey
""", views=("places",))
def q_j12(spark, sf):
    return J.tiered_match(place_queries(spark, sf), V.places(spark, sf), "c_custkey", "query",
                          ["name", "country"], "place_id")
