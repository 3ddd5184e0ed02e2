"""Registered scalar-expression queries (X1 - X26; X19, X22, X23, X27, X28 are
registered with the decision and series demos)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views as V
from .registry import register
from .rules import (ADDRESS_KEYS, BOX_COUNTRY, COUNTRY_BOX, PH_BY_SUBSTRING, PH_DEFAULT, PROVINCE_BOXES)
from .util import round_doubles
from ..functions import scalar as X
from ..operators.aggregates import quantile_thresholds
from ..operators.joins import collect_bounded

# fixed values: demo mapping of the part types onto crop names
CROP_OF_TYPE = {"ECONOMY": "wheat", "MEDIUM": "rice", "PROMO": "cotton", "SMALL": "maize",
                "STANDARD": "coffee", "LARGE": "millet"}
OBS_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def crop_name(col="crop_type"):
    m = F.create_map(*[x for k, v in CROP_OF_TYPE.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, F.col(col))


CROP_CASE_SQL = ("CASE crop_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CROP_OF_TYPE.items())
                 + " END")


@register("X1_norm_key", "SELECT p_partkey, lower(trim(p_name)) AS name_key FROM part")
def q_x1(spark, sf):
    return V.read(spark, sf, "part").select("p_partkey", X.norm_key("p_name").alias("name_key"))


@register("X2_year_start_ts", """
SELECT o_orderkey, make_timestamp(TRY_CAST(trim(CASE WHEN o_orderkey % 10 = 0 THEN 'abc'
       ELSE CAST(year(o_orderdate) AS VARCHAR) END) AS INTEGER), 1, 1, 0, 0, 0) AS year_start
FROM orders
""")
def q_x2(spark, sf):
    o = V.read(spark, sf, "orders")
    y = F.when(F.col("o_orderkey") % 10 == 0, F.lit("abc")).otherwise(F.year("o_orderdate").cast("string"))
    return o.select("o_orderkey", X.year_start_ts(y).alias("year_start"))


@register("X3_climate_zone", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN rainfall IS NULL OR isnan(rainfall) THEN NULL WHEN rainfall < 250 THEN 'arid'
            WHEN rainfall <= 800 THEN 'temperate' ELSE 'tropical' END AS zone
FROM obs
""", views=("obs",))
def q_x3(spark, sf):
    return V.obs(spark, sf).select(*OBS_KEY, X.climate_zone("rainfall").alias("zone"))


@register("X4_climate_score", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       round(temperature * 0.4 + humidity * 0.3 + rainfall * 0.3, 9) AS climate_score
FROM obs
""", views=("obs",))
def q_x4(spark, sf):
    o = V.obs(spark, sf)
    return round_doubles(o.select(*OBS_KEY, X.climate_score("temperature", "humidity", "rainfall")
                                  .alias("climate_score")), 9)


@register("X6_rice_boost", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN lower({CROP_CASE_SQL}) = 'rice' AND rainfall > 1200 THEN 1.2 ELSE 1.0 END::DOUBLE AS boost
FROM obs
""", views=("obs",))
def q_x6(spark, sf):
    o = V.obs(spark, sf)
    return o.select(*OBS_KEY, X.rice_boost(crop_name(), "rainfall").alias("boost"))


@register("X7_weather_score", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CAST(trunc(greatest(0.0, 100.0 - least(abs(temperature - 24.0) * 3.0, 50.0)
                                   - least(abs(rainfall - 900.0) / 25.0, 50.0))) AS INTEGER) AS weather_score
FROM obs
""", views=("obs",))
def q_x7(spark, sf):
    return V.obs(spark, sf).select(*OBS_KEY, X.weather_score("temperature", "rainfall").alias("weather_score"))


@register("X8_risk_from_probability", """
SELECT o_orderkey, CASE WHEN p > 0.6 THEN 'low' WHEN p >= 0.4 THEN 'medium' ELSE 'high' END AS risk
FROM (SELECT o_orderkey, o_totalprice / 400000.0 AS p FROM orders)
""")
def q_x8(spark, sf):
    o = V.read(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 400000.0).alias("p"))
    return o.select("o_orderkey", X.risk_from_probability("p").alias("risk"))


@register("X9_risk_from_change", """
SELECT o_orderkey, CASE WHEN pct <= -25 THEN 'high' WHEN pct <= -10 THEN 'medium' ELSE 'low' END AS risk
FROM (SELECT o_orderkey, o_totalprice / 2000.0 - 100.0 AS pct FROM orders)
""")
def q_x9(spark, sf):
    o = V.read(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 2000.0 - 100.0).alias("pct"))
    return o.select("o_orderkey", X.risk_from_change("pct").alias("risk"))


@register("X10_risk_from_sign", """
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'low' ELSE 'high' END AS risk FROM customer
""")
def q_x10(spark, sf):
    return V.read(spark, sf, "customer").select("c_custkey", X.risk_from_sign("c_acctbal").alias("risk"))


@register("X11_pct_change", """
SELECT s_suppkey, CASE WHEN b = 0 THEN 0.0 ELSE (s_acctbal - b) / b * 100.0 END AS pct
FROM (SELECT s_suppkey, s_acctbal, CAST(s_suppkey % 3 AS DOUBLE) * 1000.0 AS b FROM supplier)
""")
def q_x11(spark, sf):
    s = V.read(spark, sf, "supplier").select("s_suppkey", "s_acctbal",
                                             ((F.col("s_suppkey") % 3).cast("double") * 1000.0).alias("b"))
    return s.select("s_suppkey", X.pct_change("s_acctbal", "b").alias("pct"))


def grid_points(spark, sf):
    """Points over the country box derived from events."""
    e = V.read(spark, sf, "events")
    return e.select("event_id", "event_type",
                    (F.lit(22.0) + (F.col("event_id") % 170).cast("double") / 10.0).alias("lat"),
                    (F.lit(58.0) + (F.col("user_id") % 230).cast("double") / 10.0).alias("lon"))


GRID_SQL = """grid AS (
  SELECT event_id, event_type, 22.0 + CAST(event_id % 170 AS DOUBLE) / 10.0 AS lat,
         58.0 + CAST(user_id % 230 AS DOUBLE) / 10.0 AS lon FROM events)"""


def _box_case(lat="lat", lon="lon"):
    a0, a1, o0, o1 = COUNTRY_BOX
    s = f"CASE WHEN NOT ({lat} BETWEEN {a0} AND {a1} AND {lon} BETWEEN {o0} AND {o1}) THEN NULL "
    for name, b0, b1, c0, c1 in PROVINCE_BOXES:
        s += f"WHEN {lat} BETWEEN {b0} AND {b1} AND {lon} BETWEEN {c0} AND {c1} THEN '{name}' "
    return s + "ELSE 'Unknown' END"


@register("X12_box_province", f"WITH {GRID_SQL} SELECT event_id, {_box_case()} AS province FROM grid")
def q_x12(spark, sf):
    g = grid_points(spark, sf)
    return g.select("event_id", X.box_province("lat", "lon", COUNTRY_BOX, PROVINCE_BOXES).alias("province"))


def _regions(spark, sf):
    g = grid_points(spark, sf)
    region = (F.when(F.col("event_type") == "view", F.lit("Unknown"))
              .when(F.col("event_type") == "click", F.lit(None).cast("string"))
              .when(F.col("event_type") == "error", F.lit("Some Region"))
              .when(F.col("event_type") == "signup", F.lit(" ")).otherwise(F.lit("None")))
    country = F.when(F.col("event_type") == "error", F.lit("Elsewhere")).otherwise(F.lit(None).cast("string"))
    r = X.region_fallback(country, region, "lat", "lon", COUNTRY_BOX, PROVINCE_BOXES, BOX_COUNTRY)
    return g.select("event_id", r["country"].alias("country"), r["region"].alias("region"))


REGIONS_SQL = GRID_SQL + f""",
rg AS (
  SELECT event_id, lat, lon,
         CASE event_type WHEN 'view' THEN 'Unknown' WHEN 'click' THEN NULL WHEN 'error' THEN 'Some Region'
                         WHEN 'signup' THEN ' ' ELSE 'None' END AS region_in,
         CASE WHEN event_type = 'error' THEN 'Elsewhere' END AS country_in,
         {_box_case()} AS prov
  FROM grid),
reg AS (
  SELECT event_id,
         CASE WHEN trim(region_in) IS NOT NULL AND lower(trim(region_in)) NOT IN ('unknown', 'none', '')
              THEN country_in WHEN prov IS NOT NULL AND prov <> 'Unknown' THEN '{BOX_COUNTRY}'
              ELSE coalesce(country_in, 'Unknown') END AS country,
         CASE WHEN trim(region_in) IS NOT NULL AND lower(trim(region_in)) NOT IN ('unknown', 'none', '')
              THEN trim(region_in) ELSE coalesce(prov, 'Unknown') END AS region
  FROM rg)"""


@register("X13_region_fallback", f"WITH {REGIONS_SQL} SELECT event_id, country, region FROM reg")
def q_x13(spark, sf):
    return _regions(spark, sf)


def _ph_case(text):
    s = "CASE "
    for needle, v in PH_BY_SUBSTRING:
        s += f"WHEN contains(lower({text}), '{needle}') THEN {v} "
    return s + f"ELSE {PH_DEFAULT} END::DOUBLE"


@register("X14_default_by_substring", f"""
WITH {REGIONS_SQL}
SELECT event_id, {_ph_case("country || ' ' || region")} AS ph FROM reg
""")
def q_x14(spark, sf):
    r = _regions(spark, sf)
    txt = F.concat_ws(" ", "country", "region")
    return r.select("event_id", X.default_by_substring(txt, PH_BY_SUBSTRING, PH_DEFAULT).alias("ph"))


@register("X15_deltas", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice - l_quantity AS d1, l_tax - l_discount AS d2
FROM lineitem
""")
def q_x15(spark, sf):
    li = V.read(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     X.delta("l_extendedprice", "l_quantity").alias("d1"),
                     (X.delta("l_tax", "l_discount")).alias("d2"))


@register("X16_safe_ratio", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / nullif(l_discount, 0.0) AS ratio FROM lineitem
""")
def q_x16(spark, sf):
    li = V.read(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     X.safe_ratio("l_extendedprice", "l_discount").alias("ratio"))


@register("X17_log_exp_target", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(ln(1 + crop_yield), 9) AS log_yield,
       round(exp(ln(1 + crop_yield)) - 1, 9) AS back
FROM obs
""", views=("obs",))
def q_x17(spark, sf):
    o = V.obs(spark, sf)
    return round_doubles(o.select(*OBS_KEY, X.log_target("crop_yield").alias("log_yield"),
                                  X.exp_target(X.log_target("crop_yield")).alias("back")), 9)


@register("X18_clamp_nonneg", "SELECT c_custkey, greatest(0.0, c_acctbal) AS clamped FROM customer")
def q_x18(spark, sf):
    return V.read(spark, sf, "customer").select("c_custkey", X.clamp_nonneg("c_acctbal").alias("clamped"))


@register("X20_date_and_geo_keys", """
SELECT event_id, strftime(last_updated, '%Y-%m-%d') AS iso_date,
       CAST(round(latitude * 1000) AS BIGINT) AS lat_key, CAST(round(longitude * 1000) AS BIGINT) AS lon_key
FROM weather
""", views=("weather",))
def q_x20(spark, sf):
    w = V.weather(spark, sf)
    return w.select("event_id", X.date_key_iso(F.date_format("last_updated", "yyyyMMdd")).alias("iso_date"),
                    X.geo_key_part("latitude").alias("lat_key"), X.geo_key_part("longitude").alias("lon_key"))


ADVICE_FEATS = ["N", "P", "K", "rainfall", "temperature"]


def advice(spark, sf):
    th = collect_bounded(quantile_thresholds(V.soil(spark, sf), ADVICE_FEATS), 64, "threshold table")
    lows = {r["feature"]: F.lit(r["low"]) for r in th}
    highs = {r["feature"]: F.lit(r["high"]) for r in th}
    p = V.places(spark, sf)
    vals = {"N": "N", "P": "P", "K": "K", "rainfall": "rain", "temperature": "temp"}
    return p.select("place_id", X.nutrient_advice(vals, lows, highs).alias("advice"))


def _advice_sql():
    th = "(SELECT " + ", ".join(
        f"quantile_cont({f}, 0.25) AS lo_{f}, quantile_cont({f}, 0.75) AS hi_{f}" for f in ADVICE_FEATS) + " FROM soil)"
    parts = []
    for n in ("N", "P", "K"):
        parts.append(f"CASE WHEN {n} < lo_{n} THEN 'increase {n}' WHEN {n} > hi_{n} THEN 'reduce {n}' END")
    parts.append("CASE WHEN rain < lo_rainfall THEN 'consider irrigation / moisture retention' "
                 "WHEN rain > hi_rainfall THEN 'consider drainage / split fertilizer applications' END")
    parts.append("CASE WHEN temp < lo_temperature THEN 'use cold-tolerant practices' "
                 "WHEN temp > hi_temperature THEN 'use heat-stress mitigation practices' END")
    acts = "concat_ws('; ', " + ", ".join(parts) + ")"
    return f"""
SELECT place_id, CASE WHEN {acts} = ''
  THEN 'Maintain balanced NPK; apply fertilizer based on soil test and local guidelines.'
  ELSE 'Fertilizer suggestion: ' || {acts} || '.' END AS advice
FROM places CROSS JOIN {th} th
"""


@register("X21_nutrient_advice", _advice_sql(), views=("soil", "places"))
def q_x21(spark, sf):
    return advice(spark, sf)


def model_metrics(spark, sf):
    """Per-language 'model' metrics table derived from labels x documents."""
    from .demo_stats import predictions
    from ..operators.aggregates import classification_metrics
    d = V.read(spark, sf, "documents").select("doc_id", "lang")
    p = predictions(spark, sf).join(d, "doc_id").where("lang IS NOT NULL").withColumnRenamed("lang", "model")
    return classification_metrics(p, by=["model"])


@register("X24_metric_label", """
WITH p AS (
  SELECT lang AS model, 'q' || CAST(quality AS VARCHAR) || 't' || CAST(toxic AS VARCHAR) AS actual,
         CASE WHEN n_chars < 500 THEN 'q0t0' WHEN n_chars < 5000 THEN 'q1t0'
              WHEN lang = 'en' THEN 'q1t0' ELSE 'q1t1' END AS predicted
  FROM labels JOIN documents USING (doc_id) WHERE lang IS NOT NULL)
SELECT model, CASE WHEN acc IS NOT NULL THEN 'Acc ' || printf('%.2f', acc) || ' | F1 ' || printf('%.2f', 0.0)
                   ELSE 'Metrics tracked' END AS label
FROM (SELECT model, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) AS acc FROM p GROUP BY model)
""")
def q_x24(spark, sf):
    m = model_metrics(spark, sf)
    lab = X.metric_label(F.lit(None).cast("double"), F.lit(None).cast("double"), "accuracy",
                         F.lit(None).cast("double"))
    return m.select("model", lab.alias("label"))


@register("X25_availability_label", """
SELECT source, CASE WHEN count(*) >= 60 THEN 'Online' WHEN count(*) < 30 THEN 'Error' ELSE 'Missing' END AS status
FROM documents GROUP BY source
UNION ALL SELECT 'absent_source', 'Unknown'
""")
def q_x25(spark, sf):
    d = V.read(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    rows = d.select("source", F.lit(True).alias("present"), (F.col("n") >= 60).alias("available"),
                    F.when(F.col("n") < 30, F.lit("too few documents")).alias("error"))
    absent = d.sparkSession.range(1).select(F.lit("absent_source").alias("source"), F.lit(False).alias("present"),
                                            F.lit(None).cast("boolean").alias("available"),
                                            F.lit(None).cast("string").alias("error"))
    allr = rows.unionByName(absent)
    return allr.select("source", X.availability_label("present", "available", "error").alias("status"))


def address_json(spark, sf):
    e = V.read(spark, sf, "events").select("event_id", "event_type", "user_id")
    u = F.col("user_id").cast("string")
    js = (F.when(F.col("event_type") == "view", F.concat(F.lit('{"state": " ", "county": "C'), u, F.lit('"}')))
          .when(F.col("event_type") == "click", F.concat(F.lit('{"province": "P'), u, F.lit('"}')))
          .when(F.col("event_type") == "error", F.lit("{}"))
          .when(F.col("event_type") == "signup", F.concat(F.lit('{"state": "S'), u, F.lit('", "region": "R"}')))
          .otherwise(F.lit('{"region": "R", "state": ""}')))
    return e.select("event_id", js.alias("address"))


@register("X26_first_address_part", """
WITH a AS (
  SELECT event_id, CASE event_type
    WHEN 'view' THEN '{"state": " ", "county": "C' || CAST(user_id AS VARCHAR) || '"}'
    WHEN 'click' THEN '{"province": "P' || CAST(user_id AS VARCHAR) || '"}'
    WHEN 'error' THEN '{}'
    WHEN 'signup' THEN '{"state": "S' || CAST(user_id AS VARCHAR) || '", "region": "R"}'
    ELSE '{"region": "R", "state": ""}' END AS address FROM events)
SELECT event_id, coalesce(nullif(trim(json_extract_string(address, '$.state')), ''),
                          nullif(trim(json_extract_string(address, '$.state_district')), ''),
                          nullif(trim(json_extract_string(address, '$.province')), ''),
                          nullif(trim(json_extract_string(address, '$.county')), ''),
                          nullif(trim(json_extract_string(address, '$.region')), ''), 'Unknown') AS region
FROM a
""")
def q_x26(spark, sf):
    a = address_json(spark, sf)
    return a.select("event_id", X.first_address_part("address", ADDRESS_KEYS).alias("region"))
