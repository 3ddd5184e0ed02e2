"""Registered schema, coercion and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views as V
from .registry import register
from .util import round_doubles
from ..functions.scalar import coerce_double, coerce_timestamp, fill_null
from ..operators import filters as FL
from ..operators import schema as S


@register("P1_profile_columns", """
SELECT 0 AS position, 'o_orderkey' AS column, 'bigint' AS data_type, '' AS roles, count(*) AS n_rows,
       count(*) FILTER (WHERE o_orderkey IS NULL) AS n_null, count(DISTINCT o_orderkey) AS n_distinct,
       CAST(min(o_orderkey) AS VARCHAR) AS min_value, CAST(max(o_orderkey) AS VARCHAR) AS max_value FROM orders
UNION ALL
SELECT 1, 'o_custkey', 'bigint', '', count(*), count(*) FILTER (WHERE o_custkey IS NULL), count(DISTINCT o_custkey),
       CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR) FROM orders
UNION ALL
SELECT 2, 'o_orderstatus', 'string', '', count(*), count(*) FILTER (WHERE o_orderstatus IS NULL),
       count(DISTINCT o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders
UNION ALL
SELECT 3, 'o_orderdate', 'timestamp_ntz', 'time', count(*), count(*) FILTER (WHERE o_orderdate IS NULL),
       count(DISTINCT o_orderdate), CAST(min(o_orderdate) AS VARCHAR), CAST(max(o_orderdate) AS VARCHAR) FROM orders
UNION ALL
SELECT 4, 'o_orderpriority', 'string', '', count(*), count(*) FILTER (WHERE o_orderpriority IS NULL),
       count(DISTINCT o_orderpriority), min(o_orderpriority), max(o_orderpriority) FROM orders
""")
def q_p1(spark, sf):
    o = V.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                                           "o_orderpriority")
    return S.profile_columns(o).drop("null_share")


@register("P7_coerce_numeric", """
SELECT event_id,
       CASE WHEN isnan(TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE)) THEN NULL
            ELSE TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE) END AS k,
       TRY_CAST(trim(props) AS DOUBLE) AS whole
FROM events
""")
def q_p7(spark, sf):
    e = V.read(spark, sf, "events")
    return e.select("event_id", coerce_double(F.get_json_object("props", "$.k")).alias("k"),
                    coerce_double("props").alias("whole"))


@register("P8_coerce_timestamp", """
SELECT event_id,
       TRY_CAST(CASE WHEN event_id % 10 = 0 THEN CAST(ts AS VARCHAR) || 'x'
                     WHEN event_id % 10 = 1 THEN 'not a time' ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP) AS parsed
FROM events
""")
def q_p8(spark, sf):
    e = V.read(spark, sf, "events")
    raw = (F.when(F.col("event_id") % 10 == 0, F.concat(F.col("ts").cast("string"), F.lit("x")))
           .when(F.col("event_id") % 10 == 1, F.lit("not a time")).otherwise(F.col("ts").cast("string")))
    return e.select("event_id", coerce_timestamp(raw).alias("parsed"))


# climate request contract (extras forbidden); the request text is derived
# from each event so malformed, incomplete and over-full requests all occur
CLIMATE_CONTRACT = [S.Field("temperature", "double", required=True),
                    S.Field("rainfall", "double", required=True),
                    S.Field("humidity", "double", required=True)]


def climate_requests(spark, sf):
    e = V.read(spark, sf, "events").select("event_id", "event_type", "value")
    v = F.col("value").cast("string")
    req = (F.when(F.col("event_type") == "view",
                  F.concat(F.lit('{"temperature": '), v, F.lit(', "rainfall": '), v, F.lit(', "humidity": 50}')))
           .when(F.col("event_type") == "click", F.concat(F.lit('{"temperature": '), v, F.lit('}')))
           .when(F.col("event_type") == "error",
                 F.concat(F.lit('{"temperature": '), v, F.lit(', "rainfall": 1, "humidity": 2, "crop_type": "x"}')))
           .when(F.col("event_type") == "signup",
                 F.concat(F.lit('{"temperature": "warm", "rainfall": '), v, F.lit(', "humidity": 3}')))
           .otherwise(F.lit("not json")))
    return e.select("event_id", req.alias("request"))


@register("P9_conform", """
WITH r AS (
  SELECT event_id, CASE event_type
     WHEN 'view' THEN '{"temperature": ' || CAST(value AS VARCHAR) || ', "rainfall": ' || CAST(value AS VARCHAR) || ', "humidity": 50}'
     WHEN 'click' THEN '{"temperature": ' || CAST(value AS VARCHAR) || '}'
     WHEN 'error' THEN '{"temperature": ' || CAST(value AS VARCHAR) || ', "rainfall": 1, "humidity": 2, "crop_type": "x"}'
     WHEN 'signup' THEN '{"temperature": "warm", "rainfall": ' || CAST(value AS VARCHAR) || ', "humidity": 3}'
     ELSE 'not json' END AS request
  FROM events),
p AS (
  SELECT event_id, request, json_valid(request) AS ok,
         CASE WHEN json_valid(request) THEN json_extract_string(request, '$.temperature') END AS t,
         CASE WHEN json_valid(request) THEN json_extract_string(request, '$.rainfall') END AS rf,
         CASE WHEN json_valid(request) THEN json_extract_string(request, '$.humidity') END AS h,
         CASE WHEN json_valid(request) THEN list_sort(list_distinct(list_filter(json_keys(request),
              lambda x: NOT list_contains(['temperature', 'rainfall', 'humidity'], x)))) END AS extra
  FROM r),
q AS (
  SELECT event_id, request, TRY_CAST(t AS DOUBLE) AS temperature, TRY_CAST(rf AS DOUBLE) AS rainfall,
         TRY_CAST(h AS DOUBLE) AS humidity,
         CASE WHEN NOT ok THEN 'invalid json'
              WHEN len(extra) > 0 THEN 'unknown field: ' || array_to_string(extra, ',')
              WHEN t IS NOT NULL AND TRY_CAST(t AS DOUBLE) IS NULL AND lower(t) <> 'null' THEN 'temperature: not a double'
              WHEN t IS NULL THEN 'temperature: required'
              WHEN rf IS NOT NULL AND TRY_CAST(rf AS DOUBLE) IS NULL AND lower(rf) <> 'null' THEN 'rainfall: not a double'
              WHEN rf IS NULL THEN 'rainfall: required'
              WHEN h IS NOT NULL AND TRY_CAST(h AS DOUBLE) IS NULL AND lower(h) <> 'null' THEN 'humidity: not a double'
              WHEN h IS NULL THEN 'humidity: required' END AS reason
  FROM p)
SELECT event_id, request, temperature, rainfall, humidity, reason, reason IS NULL AS accepted FROM q
""")
def q_p9(spark, sf):
    return S.conform(climate_requests(spark, sf), "request", CLIMATE_CONTRACT, extras="forbid")


@register("P10_fill_missing_columns", """
SELECT p_partkey, p_size, CAST(6.5 AS DOUBLE) AS ph, CAST(60.0 AS DOUBLE) AS humidity FROM part
""")
def q_p10(spark, sf):
    p = V.read(spark, sf, "part").select("p_partkey", "p_size")
    return S.fill_missing_columns(p, {"p_size": 0, "ph": 6.5, "humidity": 60.0},
                                  order=["p_partkey", "p_size", "ph", "humidity"])


@register("P11_fill_null", """
SELECT place_id, coalesce(humidity, 60.0) AS humidity, coalesce(N, 70.0) AS N, coalesce(P, 40.0) AS P,
       coalesce(K, 40.0) AS K
FROM places
""", views=("places",))
def q_p11(spark, sf):
    p = V.places(spark, sf)
    return p.select("place_id", fill_null("humidity", 60.0).alias("humidity"), fill_null("N", 70.0).alias("N"),
                    fill_null("P", 40.0).alias("P"), fill_null("K", 40.0).alias("K"))


@register("P12_missing_count", """
SELECT count(*) FILTER (WHERE place_id IS NULL) AS place_id,
       count(*) FILTER (WHERE humidity IS NULL OR isnan(humidity)) AS humidity,
       count(*) FILTER (WHERE N IS NULL OR isnan(N)) AS N,
       count(*) FILTER (WHERE P IS NULL OR isnan(P)) AS P,
       count(*) FILTER (WHERE K IS NULL OR isnan(K)) AS K,
       count(*) FILTER (WHERE place_id IS NULL) + count(*) FILTER (WHERE humidity IS NULL OR isnan(humidity))
     + count(*) FILTER (WHERE N IS NULL OR isnan(N)) + count(*) FILTER (WHERE P IS NULL OR isnan(P))
     + count(*) FILTER (WHERE K IS NULL OR isnan(K)) AS total_missing
FROM places
""", views=("places",))
def q_p12(spark, sf):
    return S.missing_count(V.places(spark, sf), ["place_id", "humidity", "N", "P", "K"])


@register("F1_select_ordered", """
SELECT crop_type, country, year, crop_yield FROM obs
""", views=("obs",))
def q_f1(spark, sf):
    return FL.select_ordered(V.obs(spark, sf), ["crop_type", "country", "year", "crop_yield"])


@register("F3_drop_null_rows", """
SELECT place_id, humidity, N FROM places WHERE humidity IS NOT NULL AND NOT isnan(humidity)
  AND N IS NOT NULL AND NOT isnan(N)
""", views=("places",))
def q_f3(spark, sf):
    return FL.drop_null_rows(V.places(spark, sf).select("place_id", "humidity", "N"), ["humidity", "N"])


@register("F4_drop_blank", """
SELECT conv_id, turn FROM conversations WHERE trim(text) <> '' AND trim(role) <> ''
""")
def q_f4(spark, sf):
    c = V.read(spark, sf, "conversations")
    return FL.drop_blank(c, ["text", "role"]).select("conv_id", "turn")


@register("F5_keep_labelled", """
SELECT event_id, target FROM (
  SELECT event_id, TRY_CAST(trim(CASE WHEN event_type = 'error' THEN 'n/a'
                                      ELSE json_extract_string(props, '$.k') END) AS DOUBLE) AS target
  FROM events) WHERE target IS NOT NULL AND NOT isnan(target)
""")
def q_f5(spark, sf):
    e = V.read(spark, sf, "events")
    t = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.get_json_object("props", "$.k"))
    return FL.keep_labelled(e.select("event_id", t.alias("target")), "target")


@register("F6_finite_only", """
SELECT p_partkey, x FROM (
  SELECT p_partkey, CASE WHEN p_size = 1 THEN 'inf'::DOUBLE WHEN p_size = 2 THEN 'nan'::DOUBLE
                         WHEN p_size = 3 THEN NULL WHEN p_size = 4 THEN '-inf'::DOUBLE
                         ELSE p_retailprice / p_size END AS x FROM part)
WHERE x IS NOT NULL AND NOT isnan(x) AND abs(x) < 'inf'::DOUBLE
""")
def q_f6(spark, sf):
    p = V.read(spark, sf, "part")
    x = (F.when(F.col("p_size") == 1, F.lit(float("inf"))).when(F.col("p_size") == 2, F.lit(float("nan")))
         .when(F.col("p_size") == 3, F.lit(None).cast("double")).when(F.col("p_size") == 4, F.lit(float("-inf")))
         .otherwise(F.col("p_retailprice") / F.col("p_size")))
    return FL.finite_only(p.select("p_partkey", x.alias("x")), ["x"])


@register("F8_in_box", """
SELECT place_id, lat, lng FROM places WHERE lat BETWEEN -30 AND 30 AND lng BETWEEN -100 AND 100
""", views=("places",))
def q_f8(spark, sf):
    return FL.in_box(V.places(spark, sf).select("place_id", "lat", "lng"), "lat", "lng", -30, 30, -100, 100)


@register("P2_resolve_alias", """
SELECT o_orderkey, o_totalprice AS total_price, o_orderstatus AS status FROM orders
""")
def q_p2(spark, sf):
    o = V.read(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("Total  PRICE"),
                                           F.col("o_orderstatus").alias(" Status"))
    return S.rename_aliases(o, {"total_price": ["total price"], "status": ["state", "status"], "absent": ["no such name"]})


@register("P3_rename_present", "SELECT o_orderkey, o_totalprice AS price FROM orders")
def q_p3(spark, sf):
    o = V.read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return S.rename_present(o, {"o_totalprice": "price", "no_such_column": "x"})


@register("P4_normalise_headers", """
SELECT o_orderkey AS order_key, o_orderstatus AS crop_type, o_totalprice AS price FROM orders
""")
def q_p4(spark, sf):
    o = V.read(spark, sf, "orders").select(F.col("o_orderkey").alias(" ORDER_KEY "), F.col("o_orderstatus").alias("Label"),
                                           F.col("o_totalprice").alias("Price"))
    return S.normalise_headers(o)


@register("P5_require_columns", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def q_p5(spark, sf):
    o = V.read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return S.require_columns(o, ["o_orderkey", "o_totalprice", "o_orderdate"], "orders")


@register("P6_infer_feature_kinds", """
SELECT 'o_orderkey' AS feature, 'numeric' AS kind, count(o_orderkey) AS n_values FROM orders
UNION ALL SELECT 'o_custkey', 'numeric', count(o_custkey) FROM orders
UNION ALL SELECT 'o_orderstatus', 'categorical', count(o_orderstatus) FROM orders
UNION ALL SELECT 'o_orderdate', 'categorical', count(o_orderdate) FROM orders
UNION ALL SELECT 'is_open', 'numeric', count(o_orderstatus) FROM orders
""")
def q_p6(spark, sf):
    o = V.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                           (F.col("o_orderstatus") == "O").alias("is_open"))
    num, cat = S.infer_feature_kinds(o, target="o_totalprice")
    counts = o.agg(*[F.count(c).alias(c) for c in num + cat])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(kind).alias("kind"), F.col(c).alias("n_values"))
        for kind, names in (("numeric", num), ("categorical", cat)) for c in names])))


@register("F2_drop_columns_strict", "SELECT o_orderkey, o_totalprice FROM orders")
def q_f2(spark, sf):
    o = V.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return S.drop_columns_strict(o, ["o_orderstatus"])
