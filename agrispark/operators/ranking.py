"""Sorts, top-k, sampling, model selection and unions.

Global ordering only happens at output (``orderBy`` = range-partitioned
sort) or as ``orderBy(...).limit(n)``, which Spark plans as TakeOrdered:
each partition keeps its own top n and only n rows per partition reach the
final merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_timeline(df: DataFrame, cols: Sequence[str] = ("country", "crop_type", "timestamp")) -> DataFrame:
    """L1: order by country, crop, time (output only)."""
    return df.orderBy(*cols)


def top_k_per_row(scores: DataFrame, row_key: str, label: str, score: str, k: int = 3) -> DataFrame:
    """L2: top-k labels per row by score, ties -> label order.

    ``scores`` is long: (row, label, score). Ranking is a window partitioned
    by row key only; each partition holds one row's labels (bounded by the
    number of classes), so no hot key can form.
    """
    w = Window.partitionBy(row_key).orderBy(F.col(score).desc(), F.col(label))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_array(labels: Column, probs: Column, k: int = 3) -> Column:
    """L2, narrow form: top-k (label, p) structs from parallel arrays, no shuffle.

    Sorted by p descending, then label ascending (``array_sort`` on a struct
    of (-p, label)).
    """
    z = F.arrays_zip(probs.alias("p"), labels.alias("label"))
    keyed = F.transform(z, lambda s: F.struct((-s["p"]).alias("neg"), s["label"].alias("label"), s["p"].alias("p")))
    top = F.slice(F.array_sort(keyed), 1, k)
    return F.transform(top, lambda s: F.struct(s["label"].alias("label"), s["p"].alias("p")))


def argmax_label(scores: DataFrame, row_key: str, label: str, score: str) -> DataFrame:
    """L3: best class and its probability per row; ties -> first label."""
    best = scores.groupBy(row_key).agg(
        F.min(F.struct((-F.col(score)).alias("neg"), F.col(label).alias("lab"))).alias("__b"))
    return best.select(row_key, F.col("__b.lab").alias("best_label"), (-F.col("__b.neg")).alias("best_p"))


def first_match(df: DataFrame, group: str, ordinal: str) -> DataFrame:
    """L4: the first row (lowest ordinal) per group; ``min_by`` keeps it to one aggregate."""
    cols = [c for c in df.columns if c != group]
    g = df.groupBy(group).agg(F.min_by(F.struct(*cols), F.col(ordinal)).alias("__r"))
    return g.select(group, "__r.*")


def sample_key(key: Column | str, seed: int) -> Column:
    """Deterministic 32-bit hash of (key, seed) from md5, reproducible in SQL."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(k.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows when larger (order by md5(key|seed), TakeOrdered)."""
    return df.orderBy(sample_key(key, seed), F.col(key)).limit(n)


def pick_best_model(metrics: DataFrame, kind: str = "regression", ordinal: str = "ordinal") -> DataFrame:
    """Best model.

    Regression: lowest test RMSE; RMSEs within 1e-12 are equal and then the
    higher R^2 wins; the earlier model wins exact ties. Classification:
    highest weighted F1 (within 1e-12 likewise), then accuracy, then earlier.
    ``metrics`` holds one row per model; the within-1e-12 rule is applied by
    comparing each model with the best value (a scalar subquery).
    """
    if kind == "regression":
        best_rmse = metrics.agg(F.min("test_rmse")).scalar()
        cand = metrics.where(F.col("test_rmse") <= best_rmse + F.lit(1e-12))
        return cand.orderBy(F.col("test_r2").desc(), F.col("test_rmse"), F.col(ordinal)).limit(1)
    cand = metrics.where(F.col("f1_weighted") >= metrics.agg(F.max("f1_weighted")).scalar() - F.lit(1e-12))
    return cand.orderBy(F.col("accuracy").desc(), F.col(ordinal)).limit(1)


def leaderboard(metrics: DataFrame, kind: str = "regression", name: str = "model") -> DataFrame:
    """All models ordered by test RMSE (or weighted F1 descending), with rank."""
    if kind == "regression":
        w = Window.orderBy(F.col("test_rmse"), F.col(name))
    else:
        w = Window.orderBy(F.col("f1_weighted").desc(), F.col(name))
    # metric tables hold one row per model: the un-partitioned window is tiny
    return metrics.withColumn("rank", F.row_number().over(w))


def union_tagged(train: DataFrame, test: DataFrame, tag: str = "dataset_split") -> DataFrame:
    """Stack two frames with a split tag."""
    return train.withColumn(tag, F.lit("train")).unionByName(test.withColumn(tag, F.lit("test")))


def history_forecast_union(history: DataFrame, forecast: DataFrame, date: str = "date",
                           hist_val: str = "rainfall", fc_val: str = "prediction",
                           keys: Sequence[str] = ()) -> DataFrame:
    """One date axis; history and forecast in separate, null-padded columns.

    The forecast column is ``rainfall ?? prediction`` of the forecast rows.
    """
    h = history.select(*keys, F.col(date).alias("date"), F.col(hist_val).alias("history"))
    fc_cols = forecast.columns
    fv = F.coalesce(*[F.col(c) for c in (hist_val, fc_val) if c in fc_cols])
    f = forecast.select(*keys, F.col(date).alias("date"), fv.alias("forecast"))
    return h.unionByName(f, allowMissingColumns=True)


def shape_series_points(points: Column, numeric: bool = False) -> Column:
    """Forecast points -> array of struct(date, rainfall, prediction).

    Numeric points become ('Step i', v or 0, v or 0); struct points keep their
    date (else 'Step i') and fill rainfall / prediction from each other, then 0.
    """
    def one(p, i):
        step = F.concat(F.lit("Step "), (i + 1).cast("string"))
        if numeric:
            v = F.coalesce(p.cast("double"), F.lit(0.0))
            return F.struct(step.alias("date"), v.alias("rainfall"), v.alias("prediction"))
        return F.struct(F.coalesce(p["date"], step).alias("date"),
                        F.coalesce(p["rainfall"], p["prediction"], F.lit(0.0)).alias("rainfall"),
                        F.coalesce(p["prediction"], p["rainfall"], F.lit(0.0)).alias("prediction"))
    return F.transform(points, one)


def key_union(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Distinct union of keys (sort at output)."""
    out = None
    for p in parts:
        s = p.select(key)
        out = s if out is None else out.union(s)
    return out.distinct()
