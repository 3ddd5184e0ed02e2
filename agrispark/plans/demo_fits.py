"""Fitted models whose results SQL can work out by itself: the fitted path of ML3, ML4, ML6, ML8, ML9, ML13, ML19, W7, W8 and M11.

Each fits with the same functions as the larger demos, on features for which
the best model is known in closed form: trees of one cut over a feature with two values, a line
through one feature, clusters far apart, components of two features, a random walk with drift.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..ml import arima as AR
from ..ml import models as ML
from ..operators.oversample import smote
from ..sources.files import scratch_path
from ..sources.history import save_model_bundle
from . import views as V
from .demo_features import H, SPLIT
from .demo_models import filled, imbalanced_soil, yield_table
from .demo_series import FILL_SQL
from .registry import register
from .util import bround, round_doubles

LONG_SQL = f"""
d AS (SELECT doc_id, CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END AS y,
             CAST(length(text) - length(replace(text, ' ', '')) >= 250 AS INT) AS s
      FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL),
sp AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {H('doc_id')}, doc_id) <= floor(count(*) OVER (PARTITION BY y) * 0.8) AS train FROM d),
w AS (SELECT y, 1.0 / count(*) AS wt FROM sp WHERE train GROUP BY y),
leaf AS (SELECT s, y, count(*) * any_value(wt) AS m FROM sp JOIN w USING (y) WHERE train GROUP BY s, y),
pred AS (SELECT s, arg_max(y, m) AS p FROM leaf GROUP BY s)"""


def long_documents(spark, sf):
    d = V.read(spark, sf, "documents").where(F.col("text").isNotNull() & F.col("n_chars").isNotNull())
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    return d.select("doc_id", F.when(F.col("n_chars") > 1500, "long").otherwise("short").alias("size_class"), (spaces >= 250).cast("double").alias("many_words"))


def fit_two_classes(spark, sf):
    return ML.train_label_classifier(long_documents(spark, sf), "size_class", "doc_id", ["many_words"], num_trees=5, min_classes=2, max_depth=1)


@register("ML3_two_class_forest", "WITH " + LONG_SQL + """,
t AS (SELECT y AS actual, p AS predicted FROM sp JOIN pred USING (s) WHERE NOT train),
cls AS (SELECT c.y AS cls, count(*) FILTER (WHERE actual = c.y AND predicted = c.y) AS tp, count(*) FILTER (WHERE actual = c.y) AS sup,
               count(*) FILTER (WHERE predicted = c.y) AS prd FROM t, (SELECT DISTINCT y FROM d) c GROUP BY c.y),
f AS (SELECT sup, CASE WHEN sup + prd > 0 THEN 2.0 * tp / (sup + prd) ELSE 0.0 END AS f1 FROM cls)
SELECT round((SELECT avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) FROM t), 6) AS accuracy,
       round((SELECT sum(f1 * sup) / sum(sup) FROM f), 6) AS f1_weighted,
       round((SELECT sqrt(avg(CASE WHEN actual = predicted THEN 0.0 ELSE 1.0 END)) FROM t), 6) AS index_rmse,
       CAST((SELECT count(*) FROM d) AS DOUBLE) AS n_rows
""")
def q_two_class(spark, sf):
    m = fit_two_classes(spark, sf)["metrics"]
    row = spark.createDataFrame([(m["accuracy"], m["f1_weighted"], m["index_rmse"], float(m["n_rows"]))], "accuracy double, f1_weighted double, index_rmse double, n_rows double")
    return round_doubles(row, 6)


@register("ML9_two_class_labels", "WITH " + LONG_SQL + """
SELECT doc_id, p AS label FROM d JOIN pred USING (s)
""")
def q_two_class_scores(spark, sf):
    fitted = fit_two_classes(spark, sf)
    scores = ML.predict_scores(fitted["model"], long_documents(spark, sf).drop("size_class"), "doc_id")
    best = scores.groupBy("doc_id").agg(F.min(F.struct((-F.col("p")).alias("p"), "label")).alias("b"))
    return best.select("doc_id", "b.label")


LINE_SQL = f"""
t AS (SELECT country || '|' || crop_type || '|' || CAST(year AS VARCHAR) AS row_key, avg(temperature) AS x, avg(crop_yield) AS y FROM obs GROUP BY country, crop_type, year),
s0 AS (SELECT *, {SPLIT('row_key')} AS split FROM t WHERE y IS NOT NULL AND NOT isnan(y) AND abs(y) < 'inf'::DOUBLE),
s AS (SELECT row_key, y, split, coalesce(x, (SELECT quantile_cont(x, 0.5) FROM s0 WHERE split = 'train')) AS x FROM s0),
l AS (SELECT regr_slope(ln(1 + y), x) AS b, regr_intercept(ln(1 + y), x) AS a FROM s WHERE split = 'train'),
p AS (SELECT row_key, y, split, exp(a + b * x) - 1 AS raw FROM s, l)"""


def fit_line(spark, sf):
    return ML.train_yield_regressors(yield_table(spark, sf), "crop_yield", "row_key", ["temperature"], [], num_trees=2, max_depth=2)


@register("ML4_line_metrics", "WITH " + LINE_SQL + """,
m AS (SELECT split, sqrt(avg((y - raw) * (y - raw))) AS rmse, 1 - sum((y - raw) * (y - raw)) / (var_pop(y) * count(*)) AS r2 FROM p GROUP BY split)
SELECT 'linear_regression' AS model, round(max(rmse) FILTER (WHERE split = 'train'), 6) AS train_rmse, round(max(r2) FILTER (WHERE split = 'train'), 6) AS train_r2,
       round(max(rmse) FILTER (WHERE split = 'test'), 6) AS test_rmse, round(max(r2) FILTER (WHERE split = 'test'), 6) AS test_r2 FROM m
""", views=("obs",))
def q_line_metrics(spark, sf):
    return round_doubles(fit_line(spark, sf)["metrics"].where("model = 'linear_regression'").drop("ordinal"), 6)


@register("ML13_line_yield", "WITH " + LINE_SQL + """
SELECT row_key, round(greatest(0.0, raw), 6) AS predicted_yield, CASE WHEN raw > 0 THEN 'low' ELSE 'high' END AS risk_level FROM p
""", views=("obs",))
def q_line_yield(spark, sf):
    t = yield_table(spark, sf)
    return ML.predict_yield(fit_line(spark, sf)["models"]["linear_regression"], t, "row_key").withColumn("predicted_yield", bround("predicted_yield", 6))


@register("ML6_two_far_clusters", """
WITH x AS (SELECT soil_id, CASE WHEN soil_id % 3 = 0 THEN 1000.0 ELSE 0.0 END + N AS v FROM soil),
f AS (SELECT soil_id, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM x)) AS v FROM x),
z AS (SELECT v, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z, v >= 900 AS far FROM f),
g AS (SELECT far, count(*) AS n, var_pop(z) * count(*) AS ss FROM z GROUP BY far)
SELECT n, round((SELECT sum(ss) FROM g), 6) AS inertia FROM g
""", views=("soil",))
def q_far_clusters(spark, sf):
    x = V.soil(spark, sf).select("soil_id", (F.when(F.col("soil_id") % 3 == 0, 1000.0).otherwise(0.0) + F.col("N")).alias("v"))
    fitted = ML.kmeans_fit(x, ["v"], 2, 42)
    return fitted["assigned"].groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).select("n", bround(F.lit(float(fitted["inertia"])), 6).alias("inertia"))


ZED = "(SELECT soil_id, coalesce(N, (SELECT quantile_cont(N, 0.5) FROM soil)) AS a, coalesce(rainfall, (SELECT quantile_cont(rainfall, 0.5) FROM soil)) AS b FROM soil)"


@register("ML8_covariances", f"""
WITH z AS (SELECT (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS za, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS zb FROM {ZED})
SELECT 'z_N' AS a, 'z_N' AS b, round(covar_pop(za, za), 6) AS covariance FROM z
UNION ALL SELECT 'z_N', 'z_rainfall', round(covar_pop(za, zb), 6) FROM z
UNION ALL SELECT 'z_rainfall', 'z_rainfall', round(covar_pop(zb, zb), 6) FROM z
""", views=("soil",))
def q_covariances(spark, sf):
    feats = ["N", "rainfall"]
    return round_doubles(ML.covariances(ML._prepared(V.soil(spark, sf), feats), [f"z_{f}" for f in feats]), 6)


@register("ML8_two_features", f"""
WITH z AS (SELECT soil_id, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS za, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS zb FROM {ZED}),
r AS (SELECT corr(za, zb) AS r FROM z)
SELECT soil_id, round(CASE WHEN r > 0 THEN za + zb ELSE za - zb END / sqrt(2), 6) AS pc1,
       round(CASE WHEN r > 0 THEN za - zb ELSE za + zb END / sqrt(2), 6) AS pc2 FROM z, r
""", views=("soil",))
def q_two_features(spark, sf):
    return round_doubles(ML.pca_project(V.soil(spark, sf), ["N", "rainfall"], "soil_id", 2), 6)


@register("ML19_snapshot_of_a_line", "WITH " + LINE_SQL + """,
m AS (SELECT split, sqrt(avg((y - raw) * (y - raw))) AS rmse FROM p GROUP BY split)
SELECT 'line' AS artifact, true AS available, round(max(rmse) FILTER (WHERE split = 'train'), 6) AS train_rmse, round(max(rmse) FILTER (WHERE split = 'test'), 6) AS test_rmse FROM m
UNION ALL SELECT 'nothing', false, NULL, NULL
""", views=("obs",))
def q_line_snapshot(spark, sf):
    fitted = fit_line(spark, sf)
    metrics = fitted["metrics"].where("model = 'linear_regression'").drop("model", "ordinal").first().asDict()
    path = scratch_path(spark, "bundle-line")
    save_model_bundle(spark, path, fitted["models"]["linear_regression"], ["temperature"], metrics)
    snap = ML.metrics_snapshot(spark, {"line": path, "nothing": scratch_path(spark, "bundle-missing")})
    return snap.select("artifact", "available", *[bround(F.get_json_object("metrics", f"$.{m}").cast("double"), 6).alias(m) for m in ("train_rmse", "test_rmse")])


WALK_SQL = FILL_SQL + """,
z0 AS (SELECT series_key, month, value AS y, value - lag(value) OVER (PARTITION BY series_key ORDER BY month) AS z FROM f WHERE value IS NOT NULL),
w AS (SELECT series_key, count(z) AS n, avg(z) AS mean, var_pop(z) AS sigma2, max(month) AS last, arg_max(y, month) AS y FROM z0 GROUP BY series_key HAVING count(z) >= 4 AND var_pop(z) > 0)"""


@register("W7_random_walk_fit", "WITH " + WALK_SQL + """
SELECT series_key, n, round(mean, 3) AS mean, round(sqrt(sigma2), 2) AS sigma, round(-0.5 * n * (ln(2 * pi() * sigma2) + 1), 4) AS loglik,
       round(n * (ln(2 * pi() * sigma2) + 1) + 4, 4) AS aic FROM w
""", views=("series_raw",))
def q_walk_fit(spark, sf):
    got = AR.arima_fit(filled(spark, sf), order=(0, 1, 0), constant=True).where("model_ok")
    return got.select("series_key", "n", bround("mean", 3).alias("mean"), bround(F.sqrt("sigma2"), 2).alias("sigma"), *[bround(c, 4).alias(c) for c in ("loglik", "aic")])


@register("W7_random_walk_forecast", "WITH " + WALK_SQL + """
SELECT series_key, CAST(h AS INTEGER) AS step, CAST(last + to_months(CAST(h AS INTEGER)) AS DATE) AS month, round(ln(1 + abs(y + h * mean)), 6) AS log_forecast
FROM w, (SELECT unnest(range(1, 7)) AS h)
""", views=("series_raw",))
def q_walk_forecast(spark, sf):
    # logarithms: sums of exact decimals can end on a tie, which the last bit of a mean would break
    got = AR.arima_forecast(filled(spark, sf), order=(0, 1, 0), steps=6, constant=True).where("model_ok")
    return got.select("series_key", "step", "month", bround(F.log(F.abs("forecast") + 1), 6).alias("log_forecast"))


@register("W8_short_series_fall_back", "WITH " + FILL_SQL + """,
s AS (SELECT series_key, month, value FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY month) AS r FROM f) WHERE r <= 5),
t AS (SELECT series_key, avg(value) AS forecast, max(month) AS last FROM s WHERE value IS NOT NULL GROUP BY series_key)
SELECT series_key, CAST(h AS INTEGER) AS step, CAST(last + to_months(CAST(h AS INTEGER)) AS DATE) AS month, round(forecast, 6) AS forecast, 'tail_mean' AS model_type
FROM t, (SELECT unnest(range(1, 5)) AS h)
""", views=("series_raw",))
def q_short_series(spark, sf):
    first = F.row_number().over(Window.partitionBy("series_key").orderBy("month"))
    young = filled(spark, sf).withColumn("r", first).where("r <= 5").drop("r")  # each series as it stood after five months
    return AR.forecast_with_fallback(young, order=(2, 1, 2), steps=4).withColumn("forecast", bround("forecast", 6))


@register("M11_balanced_counts", """
WITH c AS (SELECT CASE WHEN soil_id % 10 = 0 THEN 'rare' WHEN soil_id % 3 = 0 THEN 'mid' ELSE 'common' END AS cls, count(*) AS n FROM soil GROUP BY 1)
SELECT cls, n AS n_real, (SELECT max(n) FROM c) - n AS n_synthetic FROM c
""", views=("soil",))
def q_balanced(spark, sf):
    out = smote(imbalanced_soil(spark, sf), "cls", "soil_id", ["N", "P", "K", "rainfall"], k=5, seed=42)
    return out.groupBy("cls").agg(F.count_if(~F.col("synthetic")).alias("n_real"), F.count_if(F.col("synthetic")).alias("n_synthetic"))
