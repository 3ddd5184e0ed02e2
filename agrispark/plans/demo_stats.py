"""Registered aggregation queries (A1 - A24, except A19/A23, registered with
their scenario / series demos)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views as V
from .registry import register
from .util import round_doubles
from ..operators import aggregates as A

CLASSES = ["q0t0", "q0t1", "q1t0", "q1t1"]


def predictions(spark, sf):
    """(doc_id, actual, predicted): labelled classes vs a fixed rule over documents."""
    lab = V.read(spark, sf, "labels")
    doc = V.read(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    j = lab.join(doc, "doc_id")
    actual = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
    pred = (F.when(F.col("n_chars") < 500, "q0t0").when(F.col("n_chars") < 5000, "q1t0")
            .when(F.col("lang") == "en", "q1t0").otherwise("q1t1"))
    return j.select("doc_id", actual.alias("actual"), pred.alias("predicted"))


PRED_SQL = """
pred AS (
  SELECT doc_id, 'q' || CAST(quality AS VARCHAR) || 't' || CAST(toxic AS VARCHAR) AS actual,
         CASE WHEN n_chars < 500 THEN 'q0t0' WHEN n_chars < 5000 THEN 'q1t0'
              WHEN lang = 'en' THEN 'q1t0' ELSE 'q1t1' END AS predicted
  FROM labels JOIN documents USING (doc_id))"""


def _pred_sql(body: str) -> str:
    return "WITH " + PRED_SQL + ",\n" + body.lstrip()[5:] if body.lstrip().upper().startswith("WITH ") \
        else "WITH " + PRED_SQL + "\n" + body


@register("A1_group_median", """
SELECT lower(trim(label)) AS label, quantile_cont(N, 0.5) AS N, quantile_cont(P, 0.5) AS P,
       quantile_cont(K, 0.5) AS K, quantile_cont(ph, 0.5) AS ph
FROM soil WHERE label IS NOT NULL GROUP BY 1
""", views=("soil",))
def q_a1(spark, sf):
    return A.group_median(V.soil(spark, sf), "label", ["N", "P", "K", "ph"])


@register("A2_global_median_fill", """
SELECT place_id, coalesce(humidity, (SELECT quantile_cont(humidity, 0.5) FROM places), 60.0) AS humidity
FROM places
""", views=("places",))
def q_a2(spark, sf):
    return A.fill_with_global_median(V.places(spark, sf), "humidity").select("place_id", "humidity")


@register("A3_group_mean", """
SELECT country, CAST(year(last_updated) AS INTEGER) AS year,
       round(avg(temperature_celsius), 6) AS temperature_celsius, round(avg(precip_mm), 6) AS precip_mm,
       round(avg(humidity), 6) AS humidity
FROM weather WHERE country IS NOT NULL AND last_updated IS NOT NULL GROUP BY ALL
""", views=("weather",))
def q_a3(spark, sf):
    w = V.weather(spark, sf).withColumn("year", F.year("last_updated"))
    return round_doubles(A.group_mean(w, ["country", "year"], ["temperature_celsius", "precip_mm", "humidity"]))


@register("A4_geo_centroid", """
SELECT country, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude
FROM weather WHERE country IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY country
""", views=("weather",))
def q_a4(spark, sf):
    return round_doubles(A.geo_centroid(V.weather(spark, sf)))


@register("A5_label_centroids", """
SELECT label, round(avg(N), 6) AS N, round(avg(P), 6) AS P, round(avg(K), 6) AS K,
       round(avg(temperature), 6) AS temperature, round(avg(humidity), 6) AS humidity
FROM soil WHERE label IS NOT NULL GROUP BY label
""", views=("soil",))
def q_a5(spark, sf):
    return round_doubles(A.label_centroids(V.soil(spark, sf), "label", ["N", "P", "K", "temperature", "humidity"]))


@register("A5_label_centroids_emb", """
SELECT label, CAST(g.i AS INTEGER) AS dim, round(avg(CAST(embedding[g.i + 1] AS DOUBLE)), 6) AS value
FROM embeddings CROSS JOIN range(0, 64) g(i) WHERE label IS NOT NULL GROUP BY label, g.i
""")
def q_a5e(spark, sf):
    c = A.label_centroids_array(V.emb(spark, sf), "label", "embedding", 64)
    return round_doubles(c.select("label", F.posexplode("centroid").alias("dim", "value")))


@register("A6_quantile_thresholds", """
SELECT 'N' AS feature, round(quantile_cont(N, 0.25), 6) AS low, round(quantile_cont(N, 0.75), 6) AS high FROM soil
UNION ALL SELECT 'P', round(quantile_cont(P, 0.25), 6), round(quantile_cont(P, 0.75), 6) FROM soil
UNION ALL SELECT 'K', round(quantile_cont(K, 0.25), 6), round(quantile_cont(K, 0.75), 6) FROM soil
UNION ALL SELECT 'rainfall', round(quantile_cont(rainfall, 0.25), 6), round(quantile_cont(rainfall, 0.75), 6) FROM soil
UNION ALL SELECT 'temperature', round(quantile_cont(temperature, 0.25), 6), round(quantile_cont(temperature, 0.75), 6) FROM soil
""", views=("soil",))
def q_a6(spark, sf):
    return round_doubles(A.quantile_thresholds(V.soil(spark, sf), ["N", "P", "K", "rainfall", "temperature"]))


@register("A7_annualised_city_mean", """
WITH c AS (
  SELECT location_name AS city, avg(temperature_celsius) AS t, avg(precip_mm) * 365.0 AS r, avg(humidity) AS h, count(*) AS n
  FROM weather WHERE location_name IS NOT NULL AND temperature_celsius IS NOT NULL AND precip_mm IS NOT NULL
                 AND humidity IS NOT NULL GROUP BY 1)
SELECT lower(trim(c.city)) AS city_key, max(c.city) AS city, round(arg_max(t, c.city), 6) AS temperature,
       round(arg_max(r, c.city), 6) AS rainfall, round(arg_max(h, c.city), 6) AS humidity, arg_max(n, c.city) AS n_snapshots
FROM c WHERE lower(trim(c.city)) <> '' GROUP BY 1
""", views=("weather",))
def q_a7(spark, sf):
    return round_doubles(A.annualised_city_mean(V.weather(spark, sf), "location_name", "temperature_celsius",
                                                "precip_mm", "humidity"))


@register("A8_mean_of_means", """
WITH d AS (SELECT series_key, CAST(obs_date AS DATE) AS day, avg(CAST(round(value * 100) AS BIGINT)) AS day_mean
           FROM series_raw WHERE obs_date IS NOT NULL GROUP BY ALL)
SELECT series_key, CAST(date_trunc('month', day) AS DATE) AS month, round(avg(day_mean) / 100.0, 6) AS value
FROM d GROUP BY ALL
""", views=("series_raw",))
def q_a8(spark, sf):
    # prices are exact cents: averaging integer cents keeps the day sums exact in any order
    s = V.series_raw(spark, sf).withColumn("value", F.round(F.col("value") * 100).cast("long"))
    out = A.mean_of_means(s, "series_key", "obs_date", "value")
    return round_doubles(out.withColumn("value", F.col("value") / 100.0), 6)


@register("A9_value_counts", """
SELECT crop_type, count(*) AS n FROM obs WHERE crop_type IS NOT NULL GROUP BY crop_type
""", views=("obs",))
def q_a9(spark, sf):
    return A.value_counts(V.obs(spark, sf), "crop_type")


@register("A10_top_class_ratio", """
SELECT max(n) AS top_n, CAST(sum(n) AS BIGINT) AS total, max(n) / sum(n) AS ratio, max(n) / sum(n) > 0.5 AS imbalanced
FROM (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality)
""")
def q_a10(spark, sf):
    out = A.top_class_ratio(V.read(spark, sf, "labels"), "quality")
    return out.withColumn("total", F.col("total").cast("bigint"))


@register("A11_distinct_sorted", """
SELECT DISTINCT country FROM obs WHERE country IS NOT NULL
""", views=("obs",))
def q_a11(spark, sf):
    return A.distinct_sorted(V.obs(spark, sf), "country")


@register("A12_group_mode", """
SELECT country, arg_min(crop_type, struct_pack(a := -n, b := crop_type)) AS crop_type
FROM (SELECT country, crop_type, count(*) AS n FROM obs
      WHERE country IS NOT NULL AND crop_type IS NOT NULL GROUP BY ALL)
GROUP BY country
""", views=("obs",))
def q_a12(spark, sf):
    return A.group_mode(V.obs(spark, sf), "country", "crop_type")


@register("A13_confusion_matrix", _pred_sql("""
SELECT actual, predicted, count(*) AS n FROM pred GROUP BY ALL
"""))
def q_a13(spark, sf):
    return A.confusion_matrix(predictions(spark, sf))


REPORT_SQL = """
cm AS (SELECT actual, predicted, count(*) AS n FROM pred GROUP BY ALL),
sup AS (SELECT actual AS cls, sum(n) AS support FROM cm GROUP BY 1),
prd AS (SELECT predicted AS cls, sum(n) AS n_pred FROM cm GROUP BY 1),
tp AS (SELECT actual AS cls, n AS tp FROM cm WHERE actual = predicted),
pr AS (
  SELECT coalesce(sup.cls, prd.cls) AS cls,
         coalesce(CAST(coalesce(tp.tp, 0) AS DOUBLE) / nullif(CAST(prd.n_pred AS DOUBLE), 0), 0.0) AS precision,
         coalesce(CAST(coalesce(tp.tp, 0) AS DOUBLE) / nullif(CAST(sup.support AS DOUBLE), 0), 0.0) AS recall,
         CAST(coalesce(sup.support, 0) AS BIGINT) AS support
  FROM sup FULL JOIN prd ON sup.cls = prd.cls LEFT JOIN tp ON coalesce(sup.cls, prd.cls) = tp.cls),
rep AS (
  SELECT cls, precision, recall,
         CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
         support FROM pr)"""


@register("A14_classification_report", _pred_sql("WITH " + REPORT_SQL + """
SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep
"""))
def q_a14(spark, sf):
    return round_doubles(A.classification_report(predictions(spark, sf)))


@register("A15_classification_metrics", _pred_sql("WITH " + REPORT_SQL + """
SELECT round((SELECT avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) FROM pred), 6) AS accuracy,
       round(sum(f1 * support) / CAST(sum(support) AS DOUBLE), 6) AS f1_weighted,
       round(avg(f1), 6) AS f1_macro
FROM rep
"""))
def q_a15(spark, sf):
    return round_doubles(A.classification_metrics(predictions(spark, sf)))


def yield_predictions(spark, sf):
    o = V.obs(spark, sf)
    pred = F.lit(0.05) + F.lit(0.004) * F.col("temperature") + F.lit(0.00012) * F.col("rainfall")
    return o.select("region", F.col("crop_yield").alias("actual"), pred.alias("prediction"))


@register("A16_regression_metrics", """
SELECT region, round(sqrt(avg((actual - prediction) * (actual - prediction))), 6) AS rmse,
       round(1.0 - sum((actual - prediction) * (actual - prediction))
                    / (var_pop(actual) FILTER (WHERE prediction IS NOT NULL) * count(actual - prediction)), 6) AS r2,
       count(actual - prediction) AS n
FROM (SELECT region, crop_yield AS actual, 0.05 + 0.004 * temperature + 0.00012 * rainfall AS prediction FROM obs)
GROUP BY region
""", views=("obs",))
def q_a16(spark, sf):
    return round_doubles(A.regression_metrics(yield_predictions(spark, sf), group="region"))


@register("A17_ordinal_label_rmse", _pred_sql("""
SELECT round(sqrt(avg(power(
   CAST(list_position(['q0t0','q0t1','q1t0','q1t1'], actual) - 1 AS DOUBLE)
 - CAST(list_position(['q0t0','q0t1','q1t0','q1t1'], predicted) - 1 AS DOUBLE), 2))), 6) AS rmse
FROM pred
"""))
def q_a17(spark, sf):
    return round_doubles(A.ordinal_label_rmse(predictions(spark, sf), CLASSES))


def _long_metrics(spark, sf):
    p = predictions(spark, sf)
    # majority-class baseline model (written per row so the optimizer cannot fold it into a join key)
    base = p.withColumn("predicted", F.when(F.col("doc_id") >= 0, F.lit("q1t0")).otherwise(F.col("actual")))
    parts = []
    for name, d in (("rule", p), ("baseline", base)):
        m = A.classification_metrics(d)
        r = A.ordinal_label_rmse(d, CLASSES)
        wide = m.select("accuracy", F.col("f1_weighted").alias("f1"), r.scalar().alias("rmse"))
        parts.append(wide.select(F.lit(name).alias("model"), F.inline(F.array(
            F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")),
            F.struct(F.lit("f1").alias("metric"), F.col("f1").alias("value")),
            F.struct(F.lit("rmse").alias("metric"), F.col("rmse").alias("value"))))))
    return parts[0].unionByName(parts[1])


@register("A18_evaluation_matrix", _pred_sql("""
WITH m AS (SELECT 'rule' AS model, actual, predicted FROM pred
           UNION ALL SELECT 'baseline', actual, 'q1t0' FROM pred),
cm AS (SELECT model, actual, predicted, count(*) AS n FROM m GROUP BY ALL),
sup AS (SELECT model, actual AS cls, sum(n) AS support FROM cm GROUP BY ALL),
prd AS (SELECT model, predicted AS cls, sum(n) AS n_pred FROM cm GROUP BY ALL),
tp AS (SELECT model, actual AS cls, n AS tp FROM cm WHERE actual = predicted),
pr AS (
  SELECT coalesce(sup.model, prd.model) AS model,
         coalesce(CAST(coalesce(tp.tp, 0) AS DOUBLE) / nullif(CAST(prd.n_pred AS DOUBLE), 0), 0.0) AS p,
         coalesce(CAST(coalesce(tp.tp, 0) AS DOUBLE) / nullif(CAST(sup.support AS DOUBLE), 0), 0.0) AS r,
         coalesce(sup.support, 0) AS support
  FROM sup FULL JOIN prd ON sup.cls = prd.cls AND sup.model = prd.model
  LEFT JOIN tp ON coalesce(sup.cls, prd.cls) = tp.cls AND coalesce(sup.model, prd.model) = tp.model),
f AS (SELECT model, sum(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END * support) / sum(support) AS f1
      FROM pr GROUP BY model),
a AS (SELECT model, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) AS accuracy,
             sqrt(avg(power(CAST(list_position(['q0t0','q0t1','q1t0','q1t1'], actual)
                   - list_position(['q0t0','q0t1','q1t0','q1t1'], predicted) AS DOUBLE), 2))) AS rmse
      FROM m GROUP BY model)
SELECT a.model, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(rmse, 6) AS rmse
FROM a JOIN f ON a.model = f.model
"""))
def q_a18(spark, sf):
    return round_doubles(A.evaluation_matrix(_long_metrics(spark, sf)))


@register("A20_above_mean_flag", """
SELECT o_orderkey, o_totalprice,
       CASE WHEN o_totalprice > (SELECT avg(o_totalprice) FROM orders) THEN 'low' ELSE 'high' END AS risk
FROM orders
""")
def q_a20(spark, sf):
    o = V.read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return A.above_mean_flag(o, "o_totalprice")


@register("A21_daily_to_point_climate", """
SELECT place_id, CAST(year(last_updated) AS INTEGER) AS year,
       round(coalesce(avg(temperature_celsius), 25.0), 6) AS temperature,
       round(coalesce(sum(precip_mm), 500.0), 6) AS rainfall,
       round(coalesce(avg(humidity), 60.0), 6) AS humidity
FROM weather GROUP BY ALL
""", views=("weather",))
def q_a21(spark, sf):
    w = V.weather(spark, sf).withColumn("year", F.year("last_updated"))
    return round_doubles(A.daily_to_point_climate(w, ["place_id", "year"], "temperature_celsius", "precip_mm",
                                                  "humidity"))


@register("A22_count_distinct_labels", """
SELECT count(DISTINCT crop_type) AS n_classes FROM obs
""", views=("obs",))
def q_a22(spark, sf):
    return A.count_distinct_labels(V.obs(spark, sf), "crop_type")


@register("A24_counts_with_all_classes", _pred_sql("""
SELECT c.class_order, c.actual, coalesce(v.n, 0) AS n
FROM (SELECT * FROM (VALUES (0, 'q0t0'), (1, 'q0t1'), (2, 'q1t0'), (3, 'q1t1'), (4, 'none'))
      t(class_order, actual)) c
LEFT JOIN (SELECT actual, count(*) AS n FROM pred GROUP BY actual) v ON c.actual = v.actual
"""))
def q_a24(spark, sf):
    out = A.counts_with_all_classes(predictions(spark, sf), "actual", CLASSES + ["none"])
    return out.withColumn("class_order", F.col("class_order").cast("int"))
