"""Registered model queries: ML1 - ML9, ML13, ML18, ML19, W7, W8, M11.

Training demos use small forests (T16). Model outputs have no SQL twin
(rows-only check, plus invariant tests); the deterministic parts have exact
twins: fixed-centre k-means assignment, cluster alignment, fixed-formula
yield scoring and the ARIMA(1,1,0) closed form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views as V
from .demo_series import FC_SQL, FILL_SQL, filled
from .registry import register
from .util import bround, round_doubles
from ..functions.scalar import climate_score, climate_zone
from ..ml import arima as AR
from ..ml import models as ML
from ..operators.aggregates import group_mean
from ..operators.oversample import smote
from ..sources import files as S
from ..sources.history import save_model_bundle

SOIL_FEATS = ["N", "P", "K", "temperature", "humidity", "ph", "rainfall"]
SMALL = dict(num_trees=20, max_depth=8)


def _one_row(spark, d: dict):
    keys = sorted(k for k, v in d.items() if isinstance(v, (int, float)) and not isinstance(v, bool))
    return spark.createDataFrame([tuple(float(d[k]) for k in keys)], ", ".join(f"{k} double" for k in keys))


@register("ML1_train_crop_recommender")
def q_ml1(spark, sf):
    r = ML.train_crop_recommender(V.soil(spark, sf), "label", "soil_id", SOIL_FEATS, min_leaf=2, **SMALL)
    return _one_row(spark, r["metrics"])


@register("ML2_train_zone_classifier")
def q_ml2(spark, sf):
    s = V.soil(spark, sf).withColumns({"region_type": climate_zone("rainfall", "temperate"),
                                       "climate_score": climate_score("temperature", "humidity", "rainfall")})
    r = ML.train_zone_classifier(s, "label", "soil_id", ["N", "P", "K", "temperature", "humidity", "rainfall",
                                                          "climate_score"], "region_type", **SMALL)
    return _one_row(spark, r["metrics"])


@register("ML3_train_label_classifier")
def q_ml3(spark, sf):
    r = ML.train_label_classifier(V.soil(spark, sf), "label", "soil_id", num_trees=20, max_depth=8)
    return _one_row(spark, r["metrics"])


def yield_table(spark, sf):
    g = group_mean(V.obs(spark, sf), ["country", "crop_type", "year"],
                   ["temperature", "rainfall", "humidity", "N", "P", "K", "crop_yield"])
    return g.withColumn("row_key", F.concat_ws("|", "country", "crop_type", F.col("year").cast("string")))


@register("ML4_train_yield_regressors")
def q_ml4(spark, sf):
    r = ML.train_yield_regressors(yield_table(spark, sf), "crop_yield", "row_key",
                                  ["temperature", "rainfall", "humidity", "N", "P", "K"], ["crop_type"], **SMALL)
    return r["metrics"].withColumn("best", F.col("model") == F.lit(r["best"]))


@register("ML5_train_yield_band_classifier", heavy=True)
def q_ml5(spark, sf):
    grid = {"numTrees": [10, 20], "maxDepth": [4, 6], "minInstancesPerNode": [1, 2],
            "featureSubsetStrategy": ["sqrt", "all"]}
    r = ML.train_yield_band_classifier(yield_table(spark, sf), "crop_yield", "row_key",
                                       ["temperature", "rainfall", "humidity", "N", "P", "K"], ["country", "crop_type"],
                                       draws=6, folds=3, grid=grid)
    row = dict(r["metrics"])
    row.update({f"param_{k}": v for k, v in r["params"].items() if not isinstance(v, str)})
    return _one_row(spark, row)


@register("ML6_kmeans_fit")
def q_ml6(spark, sf):
    r = ML.kmeans_fit(V.soil(spark, sf), ["N", "P", "rainfall"], 3, 42)
    return r["assigned"].groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "inertia", F.lit(float(r["inertia"])))


KM_FEATS = ["N", "P", "rainfall"]
KM_CENTRES = [(-1.0, -1.0, -1.0), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)]


@register("ML6_kmeans_assign", """
WITH st AS (SELECT quantile_cont(N, 0.5) AS mdN, quantile_cont(P, 0.5) AS mdP, quantile_cont(rainfall, 0.5) AS mdR,
                   avg(N) AS aN, stddev_pop(N) AS sN, avg(P) AS aP, stddev_pop(P) AS sP,
                   avg(rainfall) AS aR, stddev_pop(rainfall) AS sR FROM soil),
z AS (SELECT soil_id, (coalesce(N, mdN) - aN) / sN AS zN, (coalesce(P, mdP) - aP) / sP AS zP,
             (coalesce(rainfall, mdR) - aR) / sR AS zR FROM soil CROSS JOIN st),
d AS (SELECT soil_id, c.cluster, (zN - c.x) * (zN - c.x) + (zP - c.y) * (zP - c.y) + (zR - c.z) * (zR - c.z) AS d2
      FROM z CROSS JOIN (VALUES (0, -1.0, -1.0, -1.0), (1, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0)) c(cluster, x, y, z))
SELECT soil_id, CAST(arg_min(cluster, struct_pack(a := d2, b := cluster)) AS INTEGER) AS cluster FROM d GROUP BY soil_id
""", views=("soil",))
def q_ml6a(spark, sf):
    from ..operators.aggregates import group_quantiles
    s = V.soil(spark, sf)
    md = group_quantiles(s, [], KM_FEATS, 0.5).first()
    st = s.agg(*[F.avg(f).alias(f"a_{f}") for f in KM_FEATS], *[F.stddev_pop(f).alias(f"s_{f}") for f in KM_FEATS]
               ).first()
    out = ML.kmeans_assign(s, KM_FEATS, KM_CENTRES, {f: md[f] for f in KM_FEATS},
                           {f: st[f"a_{f}"] for f in KM_FEATS}, {f: st[f"s_{f}"] for f in KM_FEATS})
    return out.select("soil_id", "cluster")


@register("ML7_cluster_alignment", """
WITH q AS (SELECT quantile_cont(rainfall, 0.33) AS lo, quantile_cont(rainfall, 0.66) AS hi FROM soil),
d AS (SELECT soil_id % 3 AS cluster, CASE WHEN rainfall <= lo THEN 0 WHEN rainfall >= hi THEN 2 ELSE 1 END AS pseudo
      FROM soil CROSS JOIN q),
mp AS (SELECT cluster, arg_min(pseudo, struct_pack(a := -n, b := pseudo)) AS mapped
       FROM (SELECT cluster, pseudo, count(*) AS n FROM d GROUP BY ALL) GROUP BY cluster),
pred AS (SELECT CAST(pseudo AS VARCHAR) AS actual, CAST(mapped AS VARCHAR) AS predicted FROM d JOIN mp USING (cluster)),
cm AS (SELECT actual, predicted, count(*) AS n FROM pred GROUP BY ALL),
sup AS (SELECT actual AS cls, sum(n) AS support FROM cm GROUP BY 1),
prd AS (SELECT predicted AS cls, sum(n) AS n_pred FROM cm GROUP BY 1),
tp AS (SELECT actual AS cls, n AS tp FROM cm WHERE actual = predicted),
pr AS (SELECT coalesce(CAST(coalesce(tp.tp, 0) AS DOUBLE) / nullif(CAST(prd.n_pred AS DOUBLE), 0), 0.0) AS p,
              coalesce(CAST(coalesce(tp.tp, 0) AS DOUBLE) / nullif(CAST(sup.support AS DOUBLE), 0), 0.0) AS r,
              coalesce(sup.support, 0) AS support
       FROM sup FULL JOIN prd ON sup.cls = prd.cls LEFT JOIN tp ON coalesce(sup.cls, prd.cls) = tp.cls)
SELECT round((SELECT avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) FROM pred), 6) AS accuracy,
       round(sum(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END * support) / sum(support), 6) AS f1,
       round((SELECT sqrt(avg(power(CAST(actual AS DOUBLE) - CAST(predicted AS DOUBLE), 2))) FROM pred), 6) AS rmse
FROM pr
""", views=("soil",))
def q_ml7(spark, sf):
    s = V.soil(spark, sf).withColumn("cluster", F.col("soil_id") % 3)
    return round_doubles(ML.cluster_alignment(s, "cluster", "rainfall"))


@register("ML8_pca_project")
def q_ml8(spark, sf):
    return ML.pca_project(V.soil(spark, sf), ["N", "P", "K", "temperature", "humidity", "rainfall"], "soil_id", 2)


@register("ML9_predict_scores")
def q_ml9(spark, sf):
    soil = V.soil(spark, sf)
    r = ML.train_crop_recommender(soil, "label", "soil_id", SOIL_FEATS, min_leaf=2, **SMALL)
    rows = soil.fillna({"ph": 6.5})
    return ML.predict_scores(r["model"], rows, "soil_id")


@register("ML13_predict_yield")
def q_ml13(spark, sf):
    t = yield_table(spark, sf)
    r = ML.train_yield_regressors(t, "crop_yield", "row_key", ["temperature", "rainfall", "humidity", "N", "P", "K"],
                                  ["crop_type"], **SMALL)
    return ML.predict_yield(r["best_model"], t, "row_key")


@register("ML13_predict_yield_fixed", """
SELECT row_key, round(greatest(0.0, raw), 9) AS predicted_yield, CASE WHEN raw > 0 THEN 'low' ELSE 'high' END AS risk_level
FROM (SELECT country || '|' || crop_type || '|' || CAST(year AS VARCHAR) AS row_key,
             exp(0.1 + 0.01 * avg(temperature) + 0.0001 * avg(rainfall) - 0.004 * avg(humidity)) - 1 AS raw
      FROM obs GROUP BY country, crop_type, year)
WHERE raw IS NOT NULL AND NOT isnan(raw) AND abs(raw) < 'inf'::DOUBLE
""", views=("obs",))
def q_ml13f(spark, sf):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer
    t = yield_table(spark, sf)
    fixed = PipelineModel(stages=[SQLTransformer(statement=(
        "SELECT *, 0.1 + 0.01 * temperature + 0.0001 * rainfall - 0.004 * humidity AS prediction FROM __THIS__"))])
    out = ML.predict_yield(fixed, t, "row_key")
    return out.withColumn("predicted_yield", bround("predicted_yield", 9))


@register("W7_arima_forecast")
def q_w7(spark, sf):
    return AR.arima_forecast(filled(spark, sf), "series_key", "month", "value", (1, 1, 1), 12)


@register("W7_arima_110_coefficients", "WITH " + FILL_SQL + """,
z0 AS (SELECT series_key, month, value - lag(value) OVER (PARTITION BY series_key ORDER BY month) AS z
       FROM f WHERE value IS NOT NULL),
z1 AS (SELECT series_key, z, lag(z) OVER (PARTITION BY series_key ORDER BY month) AS zl FROM z0)
SELECT series_key, round(regr_slope(z, zl), 6) AS phi1, round(regr_intercept(z, zl), 4) AS c, count(*) AS n
FROM z1 WHERE z IS NOT NULL AND zl IS NOT NULL GROUP BY series_key
""", views=("series_raw",))
def q_w7b(spark, sf):
    out = AR.ar1_on_differences(filled(spark, sf))
    return out.withColumns({"phi1": bround("phi1", 6), "c": bround("c", 4)})


@register("W7_arima_fit")
def q_w7f(spark, sf):
    return AR.arima_fit(filled(spark, sf), "series_key", "month", "value", (1, 1, 1))


@register("W8_forecast_with_fallback")
def q_w8(spark, sf):
    # series that cannot be fitted fall back to the tail mean (see the unit tests)
    return AR.forecast_with_fallback(filled(spark, sf), "series_key", "month", "value", (2, 1, 2), 12)


@register("W7_arima_110_forecast", "WITH " + FILL_SQL + """,
z0 AS (SELECT series_key, month, value AS y, value - lag(value) OVER (PARTITION BY series_key ORDER BY month) AS z
       FROM f WHERE value IS NOT NULL),
z1 AS (SELECT *, lag(z) OVER (PARTITION BY series_key ORDER BY month) AS zl,
              row_number() OVER (PARTITION BY series_key ORDER BY month DESC) AS rd FROM z0),
co AS (SELECT series_key, regr_slope(z, zl) AS phi, regr_intercept(z, zl) AS c FROM z1
       WHERE z IS NOT NULL AND zl IS NOT NULL GROUP BY 1 HAVING count(*) > 4 AND regr_sxx(z, zl) > 0),
s1 AS (SELECT series_key, month, phi, c, y, c + phi * z AS a FROM z1 JOIN co USING (series_key) WHERE rd = 1),
s2 AS (SELECT *, c + phi * a AS b FROM s1),
s3 AS (SELECT *, c + phi * b AS d FROM s2),
u AS (SELECT series_key, month, 1 AS step, y + a AS forecast FROM s3
      UNION ALL SELECT series_key, month, 2, y + a + b FROM s3
      UNION ALL SELECT series_key, month, 3, y + a + b + d FROM s3)
SELECT series_key, CAST(step AS INTEGER) AS step, CAST(month + to_months(CAST(step AS INTEGER)) AS DATE) AS month,
       round(forecast, 3) AS forecast FROM u
""", views=("series_raw",))
def q_w7c(spark, sf):
    out = AR.arima_forecast(filled(spark, sf), "series_key", "month", "value", (1, 1, 0), 3, method="least_squares")
    return out.where("model_ok").select("series_key", "step", "month", bround("forecast", 3).alias("forecast"))


@register("W8_rainfall_holdout")
def q_w8h(spark, sf):
    return AR.forecast_holdout(filled(spark, sf))


@register("W9_rainfall_holdout_tail_mean", "WITH " + FC_SQL + """,
med AS (SELECT series_key, quantile_cont(value, 0.5) AS med FROM s WHERE split = 'train' GROUP BY 1),
d AS (SELECT s.series_key, CAST(s.value >= med.med AS INTEGER) AS y, CAST(tm.forecast >= med.med AS INTEGER) AS p,
             s.value - tm.forecast AS e
      FROM s JOIN tm ON s.series_key = tm.series_key JOIN med ON s.series_key = med.series_key
      WHERE s.split = 'test' AND s.series_ok),
g AS (SELECT series_key, count(*) AS steps, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS accuracy,
             sum(CASE WHEN y = 1 AND p = 1 THEN 1.0 ELSE 0.0 END) AS tp,
             sum(CASE WHEN y <> p THEN 1.0 ELSE 0.0 END) AS wrong, sqrt(avg(e * e)) AS rmse FROM d GROUP BY 1)
SELECT series_key, 'tail_mean' AS model_type, steps, round(accuracy, 6) AS accuracy,
       round(coalesce(2 * tp / nullif(2 * tp + wrong, 0), 0.0), 6) AS f1, round(rmse, 6) AS rmse FROM g
""", views=("series_raw",))
def q_w9h(spark, sf):
    return round_doubles(AR.forecast_holdout(filled(spark, sf), order=None), 6)


def imbalanced_soil(spark, sf):
    s = V.soil(spark, sf)
    lab = F.when(F.col("soil_id") % 10 == 0, "rare").when(F.col("soil_id") % 3 == 0, "mid").otherwise("common")
    return s.withColumn("cls", lab).fillna({"ph": 6.5})


@register("M11_smote")
def q_m11(spark, sf):
    return smote(imbalanced_soil(spark, sf), "cls", "soil_id", ["N", "P", "K", "rainfall"], k=5, seed=42)


@register("ML18_training_run", heavy=True)
def q_ml18(spark, sf):
    base, bundle = S.scratch_path(spark, "metrics-history"), S.scratch_path(spark, "bundle-yield")
    ML.training_run(spark, V.soil(spark, sf), "label", "soil_id", SOIL_FEATS, base, 1, num_trees=10, max_depth=6)
    y = ML.train_yield_regressors(yield_table(spark, sf), "crop_yield", "row_key",
                                  ["temperature", "rainfall", "humidity", "N", "P", "K"], ["crop_type"], num_trees=10, max_depth=6)
    best = y["metrics"].where(F.col("model") == y["best"]).drop("model", "ordinal").first().asDict()
    save_model_bundle(spark, bundle, y["best_model"], [], best)
    return ML.training_run(spark, V.soil(spark, sf), "label", "soil_id", SOIL_FEATS, base, 2, num_trees=10,
                           max_depth=6, yield_bundle=bundle)


@register("ML19_metrics_snapshot")
def q_ml19(spark, sf):
    soil = V.soil(spark, sf)
    r = ML.train_crop_recommender(soil, "label", "soil_id", SOIL_FEATS, num_trees=10, max_depth=6)
    path = S.scratch_path(spark, "bundle-recommender")
    save_model_bundle(spark, path, r["model"], r["features"], r["metrics"], {"centroids": r["centroids"]})
    return ML.metrics_snapshot(spark, {"crop_recommender": path, "yield": S.scratch_path(spark, "missing")})
