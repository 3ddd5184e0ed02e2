"""Registered source / sink queries.

Sink demos write under the shared checkpoint directory (a fresh folder per
call) and read the result back, so the check covers the round trip.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import views as V
from .registry import register
from .util import bround, round_doubles
from ..operators.aggregates import daily_to_point_climate
from ..operators.schema import profile_columns
from ..sources import files as S
from ..sources import history as H
from ..sources import jsonmaps as JM
from ..session import table_path

ORDERS_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderpriority", T.StringType())])


@register("S1_scan_table", "SELECT * FROM orders")
def q_s1(spark, sf):
    return S.scan_table(spark, table_path(sf, "orders"), ORDERS_SCHEMA)


@register("S2_scan_columns", "SELECT o_orderkey, o_orderdate FROM orders")
def q_s2(spark, sf):
    return S.scan_columns(spark, table_path(sf, "orders"), ["o_orderkey", "o_orderdate"])


@register("S3_scan_skip_tag_row", "SELECT event_id, ts, value FROM events")
def q_s3(spark, sf):
    e = V.read(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"),
                                           F.col("ts").cast("string").alias("ts"),
                                           F.col("value").cast("string").alias("value"))
    tag = spark.createDataFrame([("#id", "#date", "#value")], "event_id string, ts string, value string")
    path = S.scratch_path(spark, "tagged-csv")
    S.write_table(tag.unionByName(e), path, fmt="csv")
    return S.scan_skip_tag_row(spark, path, {"event_id": "bigint", "ts": "timestamp_ntz", "value": "double"})


@register("S4_scan_directory", """
SELECT *, 'nation.parquet' AS file_name FROM nation
UNION ALL BY NAME SELECT *, 'region.parquet' AS file_name FROM region
UNION ALL BY NAME SELECT *, 'supplier.parquet' AS file_name FROM supplier
""")
def q_s4(spark, sf):
    return S.scan_directory(spark, {n: table_path(sf, n) for n in ("region", "nation", "supplier")})


PARAMS = {"T2M": "temperature", "PRECTOTCORR": "rainfall", "RH2M": "humidity"}
PARAM_OF_TYPE = {"view": "T2M", "signup": "T2M", "click": "PRECTOTCORR", "purchase": "PRECTOTCORR", "error": "RH2M"}


def daily_docs(spark, sf):
    """One JSON document per user: properties.parameter.<param>.<yyyymmdd> = daily mean."""
    e = V.read(spark, sf, "events")
    m = F.create_map(*[x for k, v in PARAM_OF_TYPE.items() for x in (F.lit(k), F.lit(v))])
    e = e.withColumn("param", F.element_at(m, F.col("event_type"))).where(F.col("param").isNotNull())
    daily = e.groupBy("user_id", "param", F.date_format("ts", "yyyyMMdd").alias("day")).agg(
        bround(F.avg("value"), 6).alias("v"))
    per_param = daily.groupBy("user_id", "param").agg(
        F.map_from_entries(F.collect_list(F.struct("day", "v"))).alias("series"))
    doc = per_param.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("param", "series"))).alias("p"))
    return doc.select("user_id", F.to_json(F.struct(F.struct(F.col("p").alias("parameter")).alias("properties")))
                      .alias("doc"))


@register("S6_keyed_maps_to_rows", """
SELECT user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date,
       round(avg(value) FILTER (WHERE event_type IN ('view', 'signup')), 6) AS temperature,
       round(avg(value) FILTER (WHERE event_type IN ('click', 'purchase')), 6) AS rainfall,
       round(avg(value) FILTER (WHERE event_type = 'error'), 6) AS humidity
FROM events GROUP BY ALL
""")
def q_s6(spark, sf):
    return JM.keyed_maps_to_rows(daily_docs(spark, sf), "user_id", "doc", PARAMS)


def array_docs(spark, sf):
    e = V.read(spark, sf, "events")
    t = F.col("event_type")
    val = F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    g = e.groupBy("user_id").agg(
        F.collect_list(F.when(t.isin("view", "signup"), F.struct(val.alias("x")))).alias("a"),
        F.collect_list(F.when(t.isin("click", "purchase"), F.struct(F.col("value").alias("x")))).alias("b"),
        F.collect_list(F.when((t == "error") & (F.col("user_id") % 7 != 0),
                              F.struct((F.col("value") / 5.0).alias("x")))).alias("c"))
    xs = lambda c: F.transform(c, lambda s: s["x"])
    return g.select("user_id", F.to_json(F.struct(
        xs("a").alias("temperature_2m_mean"), xs("b").alias("precipitation_sum"),
        xs("c").alias("relative_humidity_2m_mean"))).alias("doc"))


@register("S7_parallel_arrays_reduce", """
SELECT user_id,
       round(coalesce(avg(value) FILTER (WHERE event_type IN ('view', 'signup') AND event_id % 10 <> 0), 25.0), 6) AS temperature,
       round(coalesce(sum(value) FILTER (WHERE event_type IN ('click', 'purchase')), 500.0), 6) AS rainfall,
       round(coalesce(avg(value / 5.0) FILTER (WHERE event_type = 'error' AND user_id % 7 <> 0), 60.0), 6) AS humidity
FROM events GROUP BY user_id
""")
def q_s7(spark, sf):
    d = array_docs(spark, sf)
    r = JM.parallel_arrays_reduce(F.col("doc"), [("temperature_2m_mean", "mean", 25.0),
                                                 ("precipitation_sum", "sum", 500.0),
                                                 ("relative_humidity_2m_mean", "mean", 60.0)])
    out = d.select("user_id", r.alias("r")).select(
        "user_id", F.col("r.temperature_2m_mean").alias("temperature"),
        F.col("r.precipitation_sum").alias("rainfall"), F.col("r.relative_humidity_2m_mean").alias("humidity"))
    return round_doubles(out)


@register("S8_write_table", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def q_s8(spark, sf):
    o = V.read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    path = S.write_table(o, S.scratch_path(spark, "orders-copy"))
    return spark.read.parquet(path)


GEO_SCHEMA = ("struct<type:string,id:bigint,properties:struct<name:string,temp:double,rain:double,humidity:double,"
              "N:double,P:double,K:double,lat:double,lng:double>,"
              "geometry:struct<type:string,coordinates:array<double>>>")


@register("S10_to_geojson_features", """
SELECT place_id AS id, 'Feature' AS type, name, temp, rain, coalesce(humidity, 60.0) AS humidity,
       coalesce(N, 75.0) AS N, coalesce(P, 40.0) AS P, coalesce(K, 38.0) AS K, 'Point' AS geometry_type,
       lng AS lon, lat
FROM places
""", views=("places",))
def q_s10(spark, sf):
    p = V.places(spark, sf)
    props = {"name": "name", "temp": "temp", "rain": "rain",
             "humidity": F.coalesce("humidity", F.lit(60.0)), "N": F.coalesce("N", F.lit(75.0)),
             "P": F.coalesce("P", F.lit(40.0)), "K": F.coalesce("K", F.lit(38.0)), "lat": "lat", "lng": "lng"}
    g = JM.to_geojson_features(p, "place_id", props)
    f = F.from_json("feature", GEO_SCHEMA)
    return g.select(f.alias("f")).select(
        F.col("f.id").alias("id"), F.col("f.type").alias("type"), "f.properties.name", "f.properties.temp",
        "f.properties.rain", "f.properties.humidity", "f.properties.N", "f.properties.P", "f.properties.K",
        F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates")[0].alias("lon"),
        F.col("f.geometry.coordinates")[1].alias("lat"))


def snapshots(spark, sf):
    e = V.read(spark, sf, "events")
    half = F.when(F.hour("ts") >= 12, F.lit(12)).otherwise(F.lit(0))
    gen = (F.date_trunc("day", F.col("ts")) + F.make_interval(hours=half)).cast("timestamp_ntz")
    return e.groupBy(gen.alias("generated_at"), F.col("event_type").alias("artifact")).agg(
        bround(F.avg("value"), 6).alias("value")).withColumn("metric", F.lit("mean_value"))


@register("S11_metrics_append", """
WITH s AS (SELECT CAST(date_trunc('day', ts) + INTERVAL (CASE WHEN hour(ts) >= 12 THEN 12 ELSE 0 END) HOUR AS TIMESTAMP)
                    AS generated_at, event_type AS artifact, round(avg(value), 6) AS value, 'mean_value' AS metric
           FROM events GROUP BY ALL),
t AS (SELECT generated_at, row_number() OVER (ORDER BY generated_at DESC) AS r FROM (SELECT DISTINCT generated_at FROM s))
SELECT s.generated_at, artifact, metric, value FROM s JOIN t ON s.generated_at = t.generated_at WHERE r <= 50
""")
def q_s11(spark, sf):
    s = snapshots(spark, sf).select("generated_at", "artifact", "metric", "value")
    newest = s.agg(F.max("generated_at")).scalar()
    base = S.scratch_path(spark, "metrics-history")
    H.append_snapshot(base, s.where(F.col("generated_at") < newest))
    H.append_snapshot(base, s.where(F.col("generated_at") == newest))
    H.drop_snapshots(spark, base, keep=50)
    return H.read_log(spark, base)


@register("S13_schema_report", """
SELECT 0 AS position, 'r_regionkey' AS column, 'int' AS data_type, 'location' AS roles, count(*) AS n_rows,
       count(*) FILTER (WHERE r_regionkey IS NULL) AS n_null, count(DISTINCT r_regionkey) AS n_distinct,
       CAST(min(r_regionkey) AS VARCHAR) AS min_value, CAST(max(r_regionkey) AS VARCHAR) AS max_value FROM region
UNION ALL
SELECT 1, 'r_name', 'string', '', count(*), count(*) FILTER (WHERE r_name IS NULL), count(DISTINCT r_name),
       min(r_name), max(r_name) FROM region
""")
def q_s13(spark, sf):
    prof = profile_columns(V.read(spark, sf, "region")).drop("null_share")
    path = S.write_schema_report(prof, S.scratch_path(spark, "schema-report"))
    return spark.read.schema(prof.schema).json(path)


def annual_docs(spark, sf):
    e = V.read(spark, sf, "events")
    t = F.col("event_type")
    g = e.groupBy("user_id").agg(bround(F.avg(F.when(t.isin("view", "signup"), F.col("value"))), 6).alias("t2m"),
                                 bround(F.avg(F.when(t.isin("click", "purchase"), F.col("value") / 100.0)), 6).alias("pr"),
                                 bround(F.avg(F.when(t == "error", F.col("value") / 5.0)), 6).alias("rh"))
    ann = lambda c: F.create_map(F.lit("ANN"), F.col(c))
    params = F.struct(ann("t2m").alias("T2M"), ann("pr").alias("PRECTOTCORR"))
    params_rh = F.struct(ann("t2m").alias("T2M"), ann("pr").alias("PRECTOTCORR"), ann("rh").alias("RH2M"))
    doc = F.when(F.col("user_id") % 4 == 0, F.to_json(F.struct(F.struct(params.alias("parameter")).alias("properties")))
                 ).otherwise(F.to_json(F.struct(F.struct(params_rh.alias("parameter")).alias("properties"))))
    return g.select("user_id", doc.alias("doc"))


@register("S14_climatology_extract", """
SELECT user_id, coalesce(round(avg(value) FILTER (WHERE event_type IN ('view', 'signup')), 6), 25.0) AS temperature,
       coalesce(round(avg(value / 100.0) FILTER (WHERE event_type IN ('click', 'purchase')), 6), 2.0) * 365.0 AS rainfall,
       CASE WHEN user_id % 4 = 0 THEN 60.0
            ELSE coalesce(round(avg(value / 5.0) FILTER (WHERE event_type = 'error'), 6), 60.0) END AS humidity
FROM events GROUP BY user_id
""")
def q_s14(spark, sf):
    d = annual_docs(spark, sf)
    c = JM.climatology_extract(F.col("doc"), [("T2M", "temperature", 25.0, 1.0), ("PRECTOTCORR", "rainfall", 2.0, 365.0),
                                             ("RH2M", "humidity", 60.0, 1.0)])
    return d.select("user_id", c.alias("c")).select("user_id", "c.temperature", "c.rainfall", "c.humidity")


@register("S15_source_fallback", """
WITH p AS (SELECT place_id, CASE WHEN place_id % 3 = 0 THEN NULL ELSE temp END AS temperature,
                  CASE WHEN place_id % 3 = 0 THEN NULL ELSE rain END AS rainfall,
                  CASE WHEN place_id % 3 = 0 THEN NULL ELSE humidity END AS humidity FROM places),
s AS (SELECT place_id, round(avg(temperature_celsius), 6) AS temperature, round(sum(precip_mm), 6) AS rainfall,
             round(avg(humidity), 6) AS humidity FROM weather GROUP BY place_id)
SELECT p.place_id,
  CASE WHEN coalesce(p.temperature, p.rainfall, p.humidity) IS NOT NULL THEN coalesce(p.temperature, 25.0)
       WHEN coalesce(s.temperature, s.rainfall, s.humidity) IS NOT NULL THEN coalesce(s.temperature, 25.0)
       ELSE 25.0 END AS temperature,
  CASE WHEN coalesce(p.temperature, p.rainfall, p.humidity) IS NOT NULL THEN coalesce(p.rainfall, 500.0)
       WHEN coalesce(s.temperature, s.rainfall, s.humidity) IS NOT NULL THEN coalesce(s.rainfall, 500.0)
       ELSE 500.0 END AS rainfall,
  CASE WHEN coalesce(p.temperature, p.rainfall, p.humidity) IS NOT NULL THEN coalesce(p.humidity, 60.0)
       WHEN coalesce(s.temperature, s.rainfall, s.humidity) IS NOT NULL THEN coalesce(s.humidity, 60.0)
       ELSE 60.0 END AS humidity,
  CASE WHEN coalesce(p.temperature, p.rainfall, p.humidity) IS NOT NULL THEN 'live_api'
       WHEN coalesce(s.temperature, s.rainfall, s.humidity) IS NOT NULL THEN 'fallback' ELSE 'default' END AS source
FROM p LEFT JOIN s ON p.place_id = s.place_id
""", views=("places", "weather"))
def q_s15(spark, sf):
    p = V.places(spark, sf)
    nul = F.col("place_id") % 3 == 0
    prim = p.select("place_id", *[F.when(nul, F.lit(None).cast("double")).otherwise(F.col(a)).alias(b)
                                  for a, b in (("temp", "temperature"), ("rain", "rainfall"), ("humidity", "humidity"))])
    w = V.weather(spark, sf)
    sec = round_doubles(daily_to_point_climate(w, ["place_id"], "temperature_celsius", "precip_mm", "humidity"))
    return JM.source_fallback(prim, sec, "place_id", ["temperature", "rainfall", "humidity"],
                              {"temperature": 25.0, "rainfall": 500.0, "humidity": 60.0})


@register("S5_first_available_source", "SELECT o_orderkey, o_totalprice FROM orders")
def q_s5(spark, sf):
    path = S.first_available_source(spark, [table_path(sf, "no_such_table"), table_path(sf, "orders")])
    return S.scan_columns(spark, path, ["o_orderkey", "o_totalprice"])


@register("S12_model_bundle", """
SELECT o_orderkey, o_totalprice AS price, CAST(o_custkey AS DOUBLE) AS customer, n AS n_status, 2 AS n_features
FROM orders JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) USING (o_orderstatus)
""")
def q_s12(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    o = V.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    feats = ["o_totalprice", "o_custkey"]
    model = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")]).fit(o)
    side = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    path = H.save_model_bundle(spark, S.scratch_path(spark, "bundle"), model, feats, {"rows": 1.0}, {"status": side})
    b = H.load_model_bundle(spark, path, ("status",))
    x = vector_to_array("features")
    scored = b.model.transform(o).join(b.tables["status"], "o_orderstatus")
    return scored.select("o_orderkey", x[0].alias("price"), x[1].alias("customer"), F.col("n").alias("n_status"),
                         F.lit(len(b.features)).alias("n_features"))
