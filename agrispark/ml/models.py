"""MLlib training and scoring jobs (ML1 - ML9, ML13, ML18, ML19).

Statistics are fit on the training split only; models are MLlib
``Pipeline``s, so fitting and scoring run on the executors. The metrics that
come back to the driver are single aggregated rows.

Defaults follow the reference (300 trees, min leaf 2, depth unbounded ->
MLlib's cap of 30); demo queries pass small forests (T16).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp_nonneg, is_finite, risk_from_sign
from ..operators.aggregates import (classification_metrics, group_mode, label_centroids, ordinal_label_rmse,
                                    quantile_thresholds, regression_metrics)
from ..operators.features import (class_weights, impute_median, impute_mode, one_hot, quantile_bins, random_split,
                                  standardise, stratified_split)
from ..operators.joins import collect_bounded
from ..operators.quality import require_min_classes

MAX_DEPTH = 30  # MLlib's limit; the reference's trees are unbounded


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage for data that several fits / evaluations reuse.

    A reliable checkpoint into the shared ``spark.checkpoint.dir`` (it survives
    executor loss, unlike a local checkpoint or cache).
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a training table that one task is given, about.
SPREAD_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` in parts of about ``SPREAD_ROWS`` rows, written once; unchanged if it has enough parts.

    A well-packed Parquet file of a million rows is one or two scan tasks, and
    everything fitted on it would go on in as many. The rows are dealt and ordered by a hash of
    the whole row, so neither a hot nor a null key matters and equal input gives equal parts.
    """
    parts = -(-df.count() // SPREAD_ROWS)
    if parts <= df.rdd.getNumPartitions():
        return df
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return materialize(df.repartition(parts, row).sortWithinPartitions(row))


def together(spark, calls: Sequence, at_once: int = 4) -> list:
    """Results of independent jobs, ``at_once`` of them running at a time, each in a scheduler pool of its own.

    Small jobs of several fits fill each other's idle cores; with
    ``spark.scheduler.mode=FAIR`` the pools share the cluster evenly. The first error is raised.
    """
    from concurrent.futures import ThreadPoolExecutor
    from pyspark import inheritable_thread_target

    def run(i, call):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{i % at_once}")
        try:
            return call()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(run), i, call) for i, call in enumerate(calls)]]


def _metrics_row(df: DataFrame) -> dict:
    return collect_bounded(df, 1, "metrics")[0].asDict()


def _rf_classifier(label_idx: str, num_trees: int, min_leaf: int, max_depth: int, seed: int,
                   subset: str = "auto", weight: str | None = None):
    kw = dict(labelCol=label_idx, featuresCol="features", numTrees=num_trees, minInstancesPerNode=min_leaf,
              maxDepth=min(max_depth, MAX_DEPTH), seed=seed, featureSubsetStrategy=subset)
    if weight:
        kw["weightCol"] = weight
    return RandomForestClassifier(**kw)


def fitted_labels(model: PipelineModel) -> list[str]:
    """Labels in the order of the model's class indexes: those of its own label indexer (the first stage)."""
    return list(model.stages[0].labels)


def _score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Predictions without the label indexer: rows to score need no label, or one that training never saw."""
    return PipelineModel(model.stages[1:]).transform(rows)


def _classify_eval(model: PipelineModel, test: DataFrame, label: str, classes: list[str]) -> dict:
    """Metrics on ``test``. Predictions are named by the fitted indexer; ``classes`` (all that occur) only order the index error."""
    lab = F.element_at(F.array(*[F.lit(c) for c in fitted_labels(model)]), F.col("prediction").cast("int") + 1)
    p = _score(model, test).select(F.col(label).alias("actual"), lab.alias("predicted"))
    m = _metrics_row(classification_metrics(p))
    m["index_rmse"] = _metrics_row(ordinal_label_rmse(p, classes))["rmse"]
    return m


def _classes(df: DataFrame, label: str) -> list[str]:
    return sorted(r[0] for r in collect_bounded(df.select(label).where(F.col(label).isNotNull()).distinct(),
                                                100_000, "class list"))


def train_crop_recommender(df: DataFrame, label: str, key: str, feats: Sequence[str], num_trees: int = 300,
                           min_leaf: int = 2, max_depth: int = MAX_DEPTH, seed: int = 42) -> dict:
    """ML1: forest on soil features, stratified split, metrics, and rule tables fit on train."""
    d = stratified_split(spread(df.where(F.col(label).isNotNull())), label, key, 0.2, seed)
    d = materialize(impute_median(materialize(d), list(feats)))
    classes = _classes(d, label)
    idx = StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc")
    pipe = Pipeline(stages=[idx, VectorAssembler(inputCols=list(feats), outputCol="features"),
                            _rf_classifier("label_idx", num_trees, min_leaf, max_depth, seed)])
    train = d.where(F.col("dataset_split") == "train")
    model = pipe.fit(train)
    metrics = _classify_eval(model, d.where(F.col("dataset_split") == "test"), label, classes)
    return {"model": model, "metrics": metrics, "classes": fitted_labels(model), "features": list(feats),
            "centroids": label_centroids(train, label, list(feats)),
            "thresholds": quantile_thresholds(train, [f for f in ("N", "P", "K", "rainfall", "temperature")
                                                      if f in feats])}


def train_zone_classifier(df: DataFrame, label: str, key: str, numeric: Sequence[str], zone: str = "region_type",
                          num_trees: int = 300, min_leaf: int = 2, max_depth: int = MAX_DEPTH, seed: int = 42) -> dict:
    """ML2: balanced forest (class weights), sqrt feature subsets, numeric + one-hot zone; rows with a null are dropped."""
    d = materialize(stratified_split(spread(df.na.drop(subset=[label, *numeric, zone])), label, key, 0.2, seed))
    train = class_weights(d.where(F.col("dataset_split") == "train"), label, "weight")
    classes = _classes(d, label)
    stages = [StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc"),
              StringIndexer(inputCol=zone, outputCol="zone_idx", stringOrderType="alphabetAsc", handleInvalid="keep"),
              OneHotEncoder(inputCols=["zone_idx"], outputCols=["zone_vec"], dropLast=False, handleInvalid="keep"),
              VectorAssembler(inputCols=[*numeric, "zone_vec"], outputCol="features"),
              _rf_classifier("label_idx", num_trees, min_leaf, max_depth, seed, "sqrt", "weight")]
    model = Pipeline(stages=stages).fit(train)
    metrics = _classify_eval(model, d.where(F.col("dataset_split") == "test"), label, classes)
    return {"model": model, "metrics": metrics, "classes": fitted_labels(model), "features": [*numeric, zone]}


def train_label_classifier(df: DataFrame, label: str, key: str, feats: Sequence[str] = ("temperature", "rainfall",
                                                                                      "humidity"),
                           num_trees: int = 200, min_classes: int = 5, max_depth: int = MAX_DEPTH,
                           seed: int = 42) -> dict:
    """ML3: balanced forest on the climate features; at least ``min_classes`` classes (Q3).

    The metrics also tell the table's size: rows, classes and the largest class's share.
    """
    require_min_classes(df, label, min_classes)
    d = stratified_split(spread(df.where(F.col(label).isNotNull())), label, key, 0.2, seed)
    d = materialize(impute_median(materialize(d), list(feats)))
    train = class_weights(d.where(F.col("dataset_split") == "train"), label, "weight")
    classes = _classes(d, label)
    pipe = Pipeline(stages=[StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc"),
                            VectorAssembler(inputCols=list(feats), outputCol="features"),
                            _rf_classifier("label_idx", num_trees, 1, max_depth, seed, "auto", "weight")])
    model = pipe.fit(train)
    metrics = _classify_eval(model, d.where(F.col("dataset_split") == "test"), label, classes)
    size = d.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_classes"), F.max("n").alias("top")).first()
    metrics |= {"n_rows": size["n_rows"], "n_classes": size["n_classes"], "top_class_ratio": size["top"] / size["n_rows"]}
    return {"model": model, "metrics": metrics, "classes": fitted_labels(model), "features": list(feats)}


def _regression_pipeline(numeric: Sequence[str], cats: Sequence[str], estimator) -> Pipeline:
    stages = []
    vec_in = list(numeric)
    for c in cats:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetAsc",
                                 handleInvalid="keep"),
                   OneHotEncoder(inputCols=[f"{c}__idx"], outputCols=[f"{c}__vec"], dropLast=False,
                                 handleInvalid="keep")]
        vec_in.append(f"{c}__vec")
    stages += [VectorAssembler(inputCols=vec_in, outputCol="features", handleInvalid="keep"), estimator]
    return Pipeline(stages=stages)


def train_yield_regressors(df: DataFrame, target: str, key: str, numeric: Sequence[str], cats: Sequence[str] = (),
                           num_trees: int = 300, min_leaf: int = 2, max_depth: int = MAX_DEPTH,
                           seed: int = 42) -> dict:
    """ML4: forest and linear regression on log1p(target); compare on test RMSE."""
    d = df.withColumn(target, F.col(target).cast("double")).where(is_finite(target))
    d = materialize(random_split(d, key, 0.2, seed))
    d = impute_median(d, list(numeric)).withColumn("__y", F.log1p(target))
    d = materialize(impute_mode(d, list(cats)) if cats else d)
    train = d.where(F.col("dataset_split") == "train")
    models = {
        "random_forest": RandomForestRegressor(labelCol="__y", featuresCol="features", numTrees=num_trees,
                                               minInstancesPerNode=min_leaf, maxDepth=min(max_depth, MAX_DEPTH),
                                               seed=seed),
        "linear_regression": LinearRegression(labelCol="__y", featuresCol="features", solver="normal"),
    }
    rows, fitted = [], {}
    for i, (name, est) in enumerate(models.items()):
        m = _regression_pipeline(numeric, cats, est).fit(train)
        fitted[name] = m
        pred = m.transform(d).select("dataset_split", F.col(target).alias("actual"),
                                     F.expm1("prediction").alias("prediction"))
        met = {r["dataset_split"]: r for r in regression_metrics(pred, group="dataset_split").collect()}
        rows.append((name, i, met["train"]["rmse"], met["train"]["r2"], met["test"]["rmse"], met["test"]["r2"]))
    spark = df.sparkSession
    table = spark.createDataFrame(rows, "model string, ordinal int, train_rmse double, train_r2 double, "
                                        "test_rmse double, test_r2 double")
    from ..operators.ranking import pick_best_model
    best = pick_best_model(table, "regression", "ordinal").first()["model"]
    return {"models": fitted, "metrics": table, "best": best, "best_model": fitted[best]}


#: The yield-band forest's search space (``min_samples_split`` has no MLlib twin; unbounded depth is MLlib's limit).
YIELD_BAND_GRID = {"numTrees": [300, 500, 800], "maxDepth": [MAX_DEPTH, 6, 10, 14], "minInstancesPerNode": [1, 2, 4, 6],
                   "featureSubsetStrategy": ["sqrt", "log2", "all"]}


def encode_features(df: DataFrame, numeric: Sequence[str], cats: Sequence[str], keep: Sequence[str],
                    split_col: str = "dataset_split") -> tuple[DataFrame, list[str]]:
    """Median-imputed, standardised numerics and mode-imputed, one-hot categories, all fit on the train rows.

    Returns (``keep`` columns plus features ``x0``, ``x1``, ..., feature names);
    unseen categories are all zeros.
    """
    d = df.withColumns({c: F.col(c).cast("double") for c in numeric})
    d = standardise(impute_median(d, list(numeric), split_col), list(numeric), split_col, "num__") if numeric else d
    d = one_hot(impute_mode(d, list(cats), split_col), list(cats), split_col) if cats else d
    made = [c for c in d.columns if c.startswith(("num__", "cat__"))]
    feats = [f"x{i}" for i in range(len(made))]
    return d.select(*keep, *[F.col(f"`{c}`").alias(f) for c, f in zip(made, feats)]), feats


def train_yield_band_classifier(df: DataFrame, target: str, key: str, numeric: Sequence[str], cats: Sequence[str] = (),
                                draws: int = 6, folds: int = 3, seed: int = 42, grid: dict | None = None,
                                oversample: bool = True) -> dict:
    """ML5: 3 quantile bands (M9, train edges), encode, SMOTE, balanced forest; random search x k-fold by weighted F1.

    The search is our own fold loop, so imputation, scaling, categories and
    oversampling are fit on a fold's training part alone (``CrossValidator``
    would oversample before splitting). SMOTE works on the encoded features;
    rows are weighted by class after it. ``draws`` different points of the
    grid are tried (all, if there are fewer), several at a time; the first best one wins. Metrics:
    accuracy, weighted and macro F1 on train and test, and the search's best.
    """
    import itertools
    import random
    from ..operators.oversample import smote
    grid = grid or YIELD_BAND_GRID
    d = random_split(df.where(is_finite(target)), key, 0.2, seed)
    d = quantile_bins(materialize(d), target, 3, out="band", labels=["low", "medium", "high"])
    fold = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(folds))
    d = materialize(d.select(key, *numeric, *cats, "dataset_split", "band", fold.alias("__fold")))
    classes = ["high", "low", "medium"]
    space = list(itertools.product(*grid.values()))
    params = [dict(zip(grid, p)) for p in random.Random(seed).sample(space, min(draws, len(space)))]

    def prepared(rows):
        """(balanced training rows, all rows encoded, feature names): the same for all draws."""
        rows, feats = encode_features(rows, numeric, cats, [key, "band", "dataset_split"])
        rows = materialize(rows)
        part = rows.where(F.col("dataset_split") == "train")
        part = smote(part, "band", key, feats, k=5, seed=seed) if oversample else part
        return materialize(class_weights(part, "band", "weight")), rows, feats

    def fit(part, feats, prm):
        rf = _rf_classifier("label_idx", prm["numTrees"], prm["minInstancesPerNode"], prm["maxDepth"], seed,
                            prm["featureSubsetStrategy"], "weight")
        pipe = Pipeline(stages=[StringIndexer(inputCol="band", outputCol="label_idx", stringOrderType="alphabetAsc"),
                                VectorAssembler(inputCols=feats, outputCol="features"), rf])
        return pipe.fit(part)

    def score(part, rows, feats, prm):
        return _classify_eval(fit(part, feats, prm), rows.where(F.col("dataset_split") == "test"), "band", classes)["f1_weighted"]

    f1s = [[] for _ in params]
    train = d.where(F.col("dataset_split") == "train")
    for f in range(folds):
        part, rows, feats = prepared(train.withColumn("dataset_split", F.when(F.col("__fold") == f, "test").otherwise("train")))
        for i, f1 in enumerate(together(df.sparkSession, [lambda prm=prm: score(part, rows, feats, prm) for prm in params])):
            f1s[i].append(f1)
    scores = [sum(x) / len(x) for x in f1s]
    best_i = max(range(len(params)), key=lambda i: (scores[i], -i))
    part, rows, feats = prepared(d)
    model = fit(part, feats, params[best_i])
    metrics = {"cv_f1_weighted": scores[best_i]}
    for split in ("train", "test"):
        m = _classify_eval(model, rows.where(F.col("dataset_split") == split), "band", classes)
        metrics |= {f"{split}_{k}": m[k] for k in ("accuracy", "f1_weighted", "f1_macro")}
    return {"model": model, "metrics": metrics, "params": params[best_i], "search": list(zip(params, scores)), "features": feats}


# --------------------------------------------------------------------------
# Clustering, projection
# --------------------------------------------------------------------------

def _prepared(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    d = spread(df)
    d = d if "dataset_split" in d.columns else d.withColumn("dataset_split", F.lit("train"))
    d = materialize(impute_median(materialize(d), list(feats)))
    return materialize(standardise(d, list(feats), prefix="z_"))


def kmeans_fit(df: DataFrame, feats: Sequence[str], k: int = 3, seed: int = 42) -> dict:
    """ML6: median impute -> population-std scaling -> KMeans(k, seed); inertia from the summary."""
    d = _prepared(df, feats)
    z = [f"z_{f}" for f in feats]
    pipe = Pipeline(stages=[VectorAssembler(inputCols=z, outputCol="features"),
                            KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster")])
    model = pipe.fit(d)
    return {"model": model, "inertia": model.stages[-1].summary.trainingCost,
            "assigned": model.transform(d).drop("features")}


def kmeans_assign(df: DataFrame, feats: Sequence[str], centres: Sequence[Sequence[float]], medians: dict,
                  means: dict, stds: dict) -> DataFrame:
    """ML6 (assign): fixed centres; null inputs get the medians, absent columns 0.0.

    Distances are a projection over a literal array (no join); ties -> lowest index.
    """
    d = df
    for f in feats:
        if f not in d.columns:
            d = d.withColumn(f, F.lit(0.0))
    zs = {f: (F.coalesce(F.col(f).cast("double"), F.lit(medians[f])) - F.lit(means[f]))
          / F.lit(stds[f] if stds[f] else 1.0) for f in feats}
    structs = []
    for i, c in enumerate(centres):
        d2 = None
        for f, cv in zip(feats, c):
            t = (zs[f] - F.lit(float(cv))) * (zs[f] - F.lit(float(cv)))
            d2 = t if d2 is None else d2 + t
        structs.append(F.struct(d2.alias("d2"), F.lit(i).alias("cluster")))
    return d.withColumn("cluster", F.array_min(F.array(*structs))["cluster"])


def cluster_alignment(df: DataFrame, cluster: str, target: str, qs=(0.33, 0.66)) -> DataFrame:
    """ML7: pseudo labels from target quantiles; cluster -> majority pseudo label; accuracy, F1, RMSE."""
    from ..operators.aggregates import quantiles
    qq = quantiles(df, [], target, list(qs), ["lo", "hi"])
    lo = qq.select("lo").scalar()
    hi = qq.select("hi").scalar()
    d = df.withColumn("pseudo", F.when(F.col(target) <= lo, 0).when(F.col(target) >= hi, 2).otherwise(1))
    mapping = group_mode(d, cluster, "pseudo").withColumnRenamed("pseudo", "mapped")
    j = d.join(mapping, cluster, "left").select(F.col("pseudo").cast("string").alias("actual"),
                                                F.col("mapped").cast("string").alias("predicted"))
    m = classification_metrics(j)
    r = ordinal_label_rmse(j, ["0", "1", "2"])
    return m.select("accuracy", F.col("f1_weighted").alias("f1"), r.scalar().alias("rmse"))


def covariances(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """(a, b, covariance): population covariance of each pair of features (a <= b by place), from one aggregation."""
    pairs = [(i, j) for i in range(len(feats)) for j in range(i, len(feats))]
    aggs = [F.covar_pop(F.col(feats[i]), F.col(feats[j])).alias(f"c{i}_{j}") for i, j in pairs]
    rows = [F.struct(F.lit(feats[i]).alias("a"), F.lit(feats[j]).alias("b"), F.col(f"c{i}_{j}").alias("covariance")) for i, j in pairs]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def principal_components(df: DataFrame, feats: Sequence[str], k: int = 2) -> list[tuple[float, list[float]]]:
    """(variance, loadings) of the ``k`` first components of the features, by falling variance.

    Only the covariances, a number per pair of features, reach the driver. The
    sign is fixed: the loading of the largest size (of equal ones the first) is positive.
    """
    import numpy as np
    m, at = np.zeros((len(feats), len(feats))), {f: i for i, f in enumerate(feats)}
    for r in collect_bounded(covariances(df, feats), len(feats) ** 2, "covariances"):
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["covariance"]
    value, vector = np.linalg.eigh(m)
    out = []
    for i in range(len(feats) - 1, max(-1, len(feats) - 1 - k), -1):
        v = vector[:, i]
        size = np.abs(v)
        lead = int(np.flatnonzero(size >= size.max() - 1e-9)[0])
        out.append((float(value[i]), (v if v[lead] > 0 else -v).tolist()))
    return out


def pca_project(df: DataFrame, feats: Sequence[str], key: str, k: int = 2) -> DataFrame:
    """ML8: projection of imputed + standardised features on their first components, whose sign is fixed
    (``principal_components``). The features are centred, so the projections are too."""
    d = _prepared(df, feats)
    z = [f"z_{f}" for f in feats]
    parts = principal_components(d, z, k)

    def on(loadings):
        terms = [F.col(c) * F.lit(v) for c, v in zip(z, loadings)]
        return sum(terms[1:], terms[0])

    return d.select(key, *[on(w).alias(f"pc{i + 1}") for i, (_, w) in enumerate(parts)])


# --------------------------------------------------------------------------
# Scoring
# --------------------------------------------------------------------------

def predict_scores(model: PipelineModel, rows: DataFrame, key: str) -> DataFrame:
    """ML9: (row, label, p) from the probability vector, named by the fitted label indexer; narrow (posexplode)."""
    pr = _score(model, rows).select(key, vector_to_array("probability").alias("__p"))
    lab = F.array(*[F.lit(c) for c in fitted_labels(model)])
    x = pr.select(key, F.posexplode("__p").alias("__i", "p"))
    return x.select(key, F.element_at(lab, F.col("__i") + 1).alias("label"), "p")


def predict_yield(model: PipelineModel, rows: DataFrame, key: str, log_target: bool = True) -> DataFrame:
    """ML13: predict, undo log1p, drop non-finite, clamp at 0, risk by sign."""
    p = model.transform(rows)
    y = F.expm1("prediction") if log_target else F.col("prediction")
    out = p.select(key, y.alias("raw")).where(is_finite("raw"))
    return out.select(key, clamp_nonneg("raw").alias("predicted_yield"), risk_from_sign("raw").alias("risk_level"))


# --------------------------------------------------------------------------
# Orchestration helpers (ML18, ML19)
# --------------------------------------------------------------------------

def metrics_rows(artifact: str, metrics: dict, generated_at) -> list[tuple]:
    return [(generated_at, artifact, k, float(v)) for k, v in metrics.items()
            if isinstance(v, (int, float)) and v is not None]


def training_run(spark, soil: DataFrame, label: str, key: str, feats: Sequence[str], history_base: str,
                 version: int = 1, num_trees: int = 20, max_depth: int = 8, seed: int = 42,
                 yield_bundle: str | None = None) -> DataFrame:
    """ML18: run ML1, ML6 and ML3 in order, append one metrics snapshot (S11) to the log at ``history_base``.

    ``version`` is not needed by the log any more; every run adds its own snapshot.

    The snapshot has the recommender's metrics, clustering inertia and
    alignment with rainfall (ML7: accuracy, F1, RMSE), the classifier's metrics,
    and those of the yield model saved at ``yield_bundle``. A classifier
    that can't be trained, or a yield model that isn't there, has ``available`` 0.
    """
    import datetime as dt
    from ..sources.history import HISTORY_SCHEMA, append_snapshot, load_model_bundle, read_log
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    soil = spread(soil)
    rec = train_crop_recommender(soil, label, key, feats, num_trees, 2, max_depth, seed)
    km = kmeans_fit(soil, feats, 3, seed)
    rows = metrics_rows("crop_recommender", rec["metrics"], now) + [(now, "clustering", "inertia", km["inertia"])]
    if "rainfall" in feats:
        aligned = cluster_alignment(materialize(km["assigned"].select("cluster", "rainfall")), "cluster", "rainfall")
        rows += metrics_rows("clustering", _metrics_row(aligned), now)
    try:
        clf = train_label_classifier(soil, label, key, [f for f in ("temperature", "rainfall", "humidity")
                                                        if f in feats], num_trees, 5, max_depth, seed)
        rows += metrics_rows("classifier", clf["metrics"], now)
    except ValueError:
        rows.append((now, "classifier", "available", 0.0))
    saved = load_model_bundle(spark, yield_bundle) if yield_bundle else None
    rows += metrics_rows("yield", saved.metrics, now) if saved and saved.available else [(now, "yield", "available", 0.0)]
    snap = spark.createDataFrame(rows, HISTORY_SCHEMA)
    append_snapshot(history_base, snap)
    return read_log(spark, history_base)


def metrics_snapshot(spark, bundles: dict[str, str]) -> DataFrame:
    """ML19: one row per bundle: available, metrics (JSON text), error."""
    import json
    from ..sources.history import load_model_bundle
    rows = []
    for name, path in bundles.items():
        b = load_model_bundle(spark, path)
        rows.append((name, b.available, json.dumps(b.metrics, sort_keys=True), path, b.error))
    return spark.createDataFrame(rows, "artifact string, available boolean, metrics string, path string, error string")
