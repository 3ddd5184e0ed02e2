"""Invariants for model-based and iterative operators (no SQL twin)."""

import math

import pytest
from pyspark.sql import functions as F

from agrispark.ml import arima as AR
from agrispark.ml import models as ML
from agrispark.operators.oversample import smote
from agrispark.plans import views as V
from conftest import SF_SMALL

SOIL_FEATS = ["N", "P", "K", "temperature", "humidity", "ph", "rainfall"]


def test_smote_balances_classes_and_stays_on_segments(spark):
    df = spark.range(600).select(F.col("id").alias("k"),
                                 F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 3 == 0, "mid")
                                  .otherwise("common").alias("c"),
                                 (F.col("id") % 17).cast("double").alias("x"),
                                 (F.col("id") % 5).cast("double").alias("y"))
    out = smote(df, "c", "k", ["x", "y"], k=5, seed=1)
    counts = {r["c"]: r["count"] for r in out.groupBy("c").count().collect()}
    assert len(set(counts.values())) == 1
    syn = out.where("synthetic")
    # synthetic points stay inside the class's bounding box (convex combinations)
    box = {r["c"]: r for r in df.groupBy("c").agg(F.min("x").alias("x0"), F.max("x").alias("x1"),
                                                  F.min("y").alias("y0"), F.max("y").alias("y1")).collect()}
    for r in syn.collect():
        b = box[r["c"]]
        assert b["x0"] - 1e-9 <= r["x"] <= b["x1"] + 1e-9 and b["y0"] - 1e-9 <= r["y"] <= b["y1"] + 1e-9
    again = smote(df, "c", "k", ["x", "y"], k=5, seed=1).where("synthetic")
    assert sorted(map(tuple, syn.select("c", "x", "y").collect())) == sorted(map(tuple, again.select("c", "x", "y").collect()))


def test_arima_forecasts_every_step_and_ar1_recovers_a_trend(spark):
    # y_t = 2 t + noise-free: differences are constant -> forecast continues the line
    df = spark.range(60).select(F.lit("s").alias("series_key"),
                                F.add_months(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("month"),
                                (F.col("id") * 2.0 + F.sin(F.col("id"))).alias("value"))
    fc = AR.forecast_with_fallback(df, order=(1, 1, 1), steps=12).orderBy("step").collect()
    assert len(fc) == 12 and all(r["forecast"] is not None and math.isfinite(r["forecast"]) for r in fc)
    last = df.agg(F.max("value")).first()[0]
    assert abs(fc[0]["forecast"] - last) < 10


def test_short_series_falls_back_to_tail_mean(spark):
    df = spark.range(5).select(F.lit("s").alias("series_key"),
                               F.add_months(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("month"),
                               F.col("id").cast("double").alias("value"))
    fc = AR.forecast_with_fallback(df, order=(2, 1, 2), steps=3).collect()
    assert {r["model_type"] for r in fc} == {"tail_mean"} and len(fc) == 3
    assert all(r["forecast"] == 2.0 for r in fc)


def _months(spark, n, key, value):
    return spark.range(n).select(F.lit(key).alias("series_key"),
                                 F.add_months(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("month"), value.alias("value"))


def test_each_series_gets_its_own_steps_and_a_line_goes_on(spark):
    """Steps per series; d = 2 continues a noisy parabola; a flat series (singular) falls back."""
    a = _months(spark, 60, "a", F.col("id") * F.col("id") + F.sin(F.col("id")))
    df = a.unionByName(_months(spark, 40, "flat", F.lit(7.0))).unionByName(_months(spark, 40, "b", F.sin(F.col("id") * 1.7) + F.col("id")))
    steps = spark.createDataFrame([("a", 3), ("flat", 2), ("b", 5)], "series_key string, steps int")
    rows = AR.forecast_with_fallback(df, order=(1, 2, 1), steps=steps).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["step"]):
        got.setdefault(r["series_key"], []).append(r)
    assert {k: [r["step"] for r in v] for k, v in got.items()} == {"a": [1, 2, 3], "flat": [1, 2], "b": [1, 2, 3, 4, 5]}
    assert {r["model_type"] for r in got["flat"]} == {"tail_mean"} and {r["forecast"] for r in got["flat"]} == {7.0}
    assert all(r["model_type"].startswith("arima") and abs(r["forecast"] - (59 + r["step"]) ** 2) < 40 for r in got["a"])


def test_holdout_scores_every_holdout_month(spark):
    df = _months(spark, 60, "long", F.sin(F.col("id") / 3) * 5 + F.col("id")).unionByName(_months(spark, 20, "short", F.col("id").cast("double")))
    got = AR.forecast_holdout(df, order=(2, 1, 2)).collect()
    assert [(r["series_key"], r["steps"]) for r in got] == [("long", 12)]
    assert got[0]["model_type"] == "arima(2, 1, 2)" and 0 <= got[0]["accuracy"] <= 1 and got[0]["rmse"] < 30
    flat = AR.forecast_holdout(df, order=None).collect()
    assert [(r["model_type"], r["steps"]) for r in flat] == [("tail_mean", 12)]


def test_probability_rows_sum_to_one_and_metrics_in_range(spark):
    soil = V.soil(spark, SF_SMALL)
    r = ML.train_crop_recommender(soil, "label", "soil_id", SOIL_FEATS, num_trees=5, max_depth=4)
    assert 0.0 <= r["metrics"]["accuracy"] <= 1.0 and 0.0 <= r["metrics"]["f1_weighted"] <= 1.0
    scores = ML.predict_scores(r["model"], soil.fillna({"ph": 6.5}), "soil_id")
    sums = scores.groupBy("soil_id").agg(F.sum("p").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert abs(sums[0] - 1.0) < 1e-9 and abs(sums[1] - 1.0) < 1e-9


def test_kmeans_inertia_falls_with_k(spark):
    soil = V.soil(spark, SF_SMALL)
    i2 = ML.kmeans_fit(soil, ["N", "P", "rainfall"], 2)["inertia"]
    i6 = ML.kmeans_fit(soil, ["N", "P", "rainfall"], 6)["inertia"]
    assert i6 < i2


def test_label_classifier_needs_five_classes(spark):
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("y"),
                                F.rand(1).alias("temperature"), F.rand(2).alias("rainfall"), F.rand(3).alias("humidity"))
    with pytest.raises(ValueError):
        ML.train_label_classifier(df, "y", "k", num_trees=2)


def test_yield_regressors_pick_by_test_rmse(spark):
    from agrispark.plans.demo_models import yield_table
    r = ML.train_yield_regressors(yield_table(spark, SF_SMALL), "crop_yield", "row_key",
                                  ["temperature", "rainfall", "humidity"], [], num_trees=5, max_depth=4)
    rows = {x["model"]: x for x in r["metrics"].collect()}
    best = min(rows.values(), key=lambda x: x["test_rmse"])["model"]
    assert r["best"] == best


def test_bundle_roundtrip_and_missing(spark, tmp_path):
    from agrispark.sources.history import load_model_bundle, save_model_bundle
    soil = V.soil(spark, SF_SMALL)
    r = ML.train_crop_recommender(soil, "label", "soil_id", SOIL_FEATS, num_trees=3, max_depth=3)
    p = str(tmp_path / "bundle")
    save_model_bundle(spark, p, r["model"], r["features"], r["metrics"], {"centroids": r["centroids"]})
    b = load_model_bundle(spark, p, ("centroids",))
    assert b.available and b.features == SOIL_FEATS and b.tables["centroids"].count() == 6
    missing = load_model_bundle(spark, str(tmp_path / "nope"))
    assert not missing.available


def _separable(spark):
    """100 rows of each of two classes far apart, and one class of a single row that sorts first."""
    rows = [(i, "m" if i % 2 else "z", float(i % 2) * 100 + i % 7, float(i % 2) * 50 + i % 5, 1.0) for i in range(200)]
    return spark.createDataFrame([*rows, (999, "aaa", 500.0, 500.0, 1.0)], "k long, label string, temperature double, rainfall double, humidity double")


def test_a_class_that_training_misses_shifts_no_label(spark):
    df = _separable(spark)
    r = ML.train_crop_recommender(df, "label", "k", ["temperature", "rainfall"], num_trees=5, max_depth=4)
    test = r["metrics"]["accuracy"]
    assert test >= 0.95  # the lone row alone can be missed
    top = {x["k"]: x["label"] for x in ML.predict_scores(r["model"], df.drop("label"), "k").where("p > 0.5").collect()}
    want = {x["k"]: x["label"] for x in df.where("k < 999").collect()}
    assert {k: v for k, v in top.items() if k < 999} == want


def test_smote_deals_out_rows_of_one_projection(spark):
    """Copies have no width to cut into buckets; neighbours still come from their own class."""
    df = spark.range(900).select(F.col("id").alias("k"), F.when(F.col("id") < 300, "rare").otherwise("common").alias("c"),
                                 F.lit(3.0).alias("x"), F.when(F.col("id") < 300, 1.0).otherwise(2.0).alias("y"))
    out = smote(df, "c", "k", ["x", "y"], k=3, seed=1, rows_per_bucket=50)
    assert {(r["c"], r["count"]) for r in out.groupBy("c").count().collect()} == {("rare", 600), ("common", 600)}
    assert {(r["x"], r["y"]) for r in out.where("synthetic").collect()} == {(3.0, 1.0)}


def test_label_classifier_tells_the_tables_size(spark):
    rows = [(i, f"c{i % 5}" if i < 50 else "c0", float(i % 5), float(i % 5) * 2, 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, label string, temperature double, rainfall double, humidity double")
    m = ML.train_label_classifier(df, "label", "k", num_trees=3, max_depth=3)["metrics"]
    assert (m["n_rows"], m["n_classes"], m["top_class_ratio"]) == (60, 5, 20 / 60)


def test_yield_bands_from_numbers_and_categories(spark):
    """A category alone decides the band: the forest must use it; all six metrics are there."""
    rows = [(i, "abc"[i % 3], float(i % 7) if i % 11 else None, (i % 3) * 10.0) for i in range(180)]
    df = spark.createDataFrame(rows, "k long, crop string, temp double, y double")
    grid = {"numTrees": [5], "maxDepth": [4, 5], "minInstancesPerNode": [1], "featureSubsetStrategy": ["all"]}
    r = ML.train_yield_band_classifier(df, "y", "k", ["temp"], ["crop"], draws=6, folds=2, grid=grid)
    assert len(r["search"]) == 2 and len(r["features"]) == 4
    assert {f"{s}_{m}" for s in ("train", "test") for m in ("accuracy", "f1_weighted", "f1_macro")} <= set(r["metrics"])
    assert r["metrics"]["test_accuracy"] == r["metrics"]["train_accuracy"] == 1.0


def test_best_classifier_within_tolerance(spark):
    from agrispark.operators.ranking import pick_best_model
    m = spark.createDataFrame([("a", 0.9, 0.5, 1), ("b", 0.9 - 1e-13, 0.7, 2), ("c", 0.8, 1.0, 0), ("d", 0.9, 0.7, 3)],
                              "model string, f1_weighted double, accuracy double, ordinal int")
    assert pick_best_model(m, "classification").first()["model"] == "b"


def test_training_run_has_every_artifact(spark, tmp_path):
    soil = V.soil(spark, SF_SMALL)
    got = ML.training_run(spark, soil, "label", "soil_id", SOIL_FEATS, str(tmp_path / "h"), 1, num_trees=3, max_depth=3).collect()
    names = {}
    for r in got:
        names.setdefault(r[1], set()).add(r[2])
    assert {"inertia", "accuracy", "f1", "rmse"} <= names["clustering"] and names["yield"] == {"available"}
    assert "accuracy" in names["crop_recommender"] and "classifier" in names


def test_scenarios_are_scored_without_join_or_shuffle(spark):
    from agrispark.plans.decide import simulate_climate_risk
    rows = spark.range(50).select(F.col("id").alias("k"), (F.col("id") + 1.0).alias("temperature"), F.lit(100.0).alias("rainfall"), F.lit(40.0).alias("humidity"))
    z, risk = simulate_climate_risk(rows, "k", [("baseline", 0, 1, 1, None), ("dry", 2, 0.5, 0.9, 38.0)],
                                    lambda d: d.withColumn("prediction", F.col("rainfall") / 10 + F.col("temperature")))
    got = {(r["k"], r["scenario"]): r for r in z.collect()}
    assert len(got) == 100 and got[0, "dry"]["predicted_yield"] == 8.0 and got[0, "dry"]["humidity"] == 38.0
    assert abs(got[0, "dry"]["change_pct"] - (8.0 / 11.0 - 1) * 100) < 1e-9 and got[3, "baseline"]["change_pct"] == 0.0
    plan = z._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert risk.count() == 50


def test_principal_components_are_checked_against_the_covariances(spark):
    import numpy as np
    feats = ["N", "P", "K", "rainfall"]
    d = ML._prepared(V.soil(spark, SF_SMALL), feats)
    z = [f"z_{f}" for f in feats]
    x = np.array([[r[c] for c in z] for r in d.select(*z).collect()])
    cov = np.cov(x.T, bias=True)
    got = {(r["a"], r["b"]): r["covariance"] for r in ML.covariances(d, z).collect()}
    assert len(got) == 10 and all(abs(cov[z.index(a), z.index(b)] - v) < 1e-9 for (a, b), v in got.items())
    parts = ML.principal_components(d, z, 4)
    for value, w in parts:
        assert np.allclose(cov @ w, value * np.array(w), atol=1e-9)
        size = np.abs(w)
        assert w[int(np.flatnonzero(size >= size.max() - 1e-9)[0])] > 0  # of equal sizes the first
    proj = np.array([[r["pc1"], r["pc2"]] for r in ML.pca_project(V.soil(spark, SF_SMALL), feats, "soil_id", 2).collect()])
    assert np.allclose(np.cov(proj.T, bias=True), np.diag([parts[0][0], parts[1][0]]), atol=1e-9)


def test_independent_fits_run_together_and_keep_their_order(spark):
    import threading
    meet = threading.Barrier(3, timeout=60)

    def call(i):
        meet.wait()  # three at once, or this times out
        return spark.range(10 * i).count()

    assert ML.together(spark, [lambda i=i: call(i) for i in range(6)], at_once=3) == [0, 10, 20, 30, 40, 50]
    with pytest.raises(ZeroDivisionError):
        ML.together(spark, [lambda: 1, lambda: 1 // 0])


def test_training_tables_in_one_file_are_spread_over_tasks(spark, monkeypatch):
    from agrispark.ml import models as M
    rows = [(i, f"c{i % 5}", float(i % 7), float(i % 11), float(i % 13)) for i in range(400)] + [(None, "c0", 1.0, 1.0, 1.0)] * 2
    one = spark.createDataFrame(rows, "k long, label string, temperature double, rainfall double, humidity double").coalesce(1)
    assert M.spread(one) is one
    monkeypatch.setattr(M, "SPREAD_ROWS", 100)
    dealt = M.spread(one)
    assert dealt.rdd.getNumPartitions() == 5 and max(dealt.rdd.glom().map(len).collect()) < 200
    assert sorted(dealt.collect(), key=str) == sorted(one.collect(), key=str)
    seen, split = [], M.stratified_split
    monkeypatch.setattr(M, "stratified_split", lambda d, *a: seen.append(d.rdd.getNumPartitions()) or split(d, *a))
    M.train_label_classifier(one.where("k is not null"), "label", "k", num_trees=2, max_depth=2)
    assert seen == [4]
