"""ARIMA(p, d, q) forecasts for many series at once.

Two ways to estimate. ``method="likelihood"`` (the default) maximises the exact
Gaussian likelihood of the differenced series (``statespace``): a series is one
row, an array of 8 bytes a point, and a task fits its series in batches. A
monthly series has as many points as the calendar has months, so such rows are
small; Spark deals the series to the tasks.

``method="least_squares"`` is Hannan-Rissanen (two-stage least squares), which
never needs a series in one place:

* differencing and all lags are window functions partitioned by series;
* least squares uses per-series **normal equations**: sums of cross products
  are a plain ``groupBy`` aggregation (partial aggregation on every
  partition, so a long series is never pulled into one task);
* stage-1 residuals are computed by joining the per-series coefficients back;
* only the tiny (p+q+1)-square solves and the h-step recursion run in Python,
  in ``mapInPandas`` over **one aggregated row per series**, a batch of series
  at a time (stacked solves, no further shuffle).

``forecast_with_fallback`` (W8) falls back to the tail mean (W6) per series
when the fit fails (too short, singular, non-finite) and records which model
produced each forecast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import binary_above_median_eval, chrono_split, tail_mean_forecast, with_steps
from .statespace import Fit, ahead, fit


def _lags(df: DataFrame, key: str, order: str, col: str, n: int, prefix: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({f"{prefix}{i}": F.lag(col, i).over(w) for i in range(1, n + 1)})


def _normal_eq_sums(df: DataFrame, key: str, y: str, xs: list[str]) -> DataFrame:
    """Per-series sums of x_i*x_j and x_i*y (x_0 = 1) over complete rows."""
    ok = F.col(y).isNotNull()
    for x in xs:
        ok = ok & F.col(x).isNotNull()
    d = df.where(ok)
    cols = [F.lit(1.0)] + [F.col(x) for x in xs]
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy")]
    for i, a in enumerate(cols):
        aggs.append(F.sum(a * F.col(y)).alias(f"xy{i}"))
        for j in range(i, len(cols)):
            aggs.append(F.sum(a * cols[j]).alias(f"xx{i}_{j}"))
    return d.groupBy(key).agg(*aggs)


def _normal_matrices(pdf: pd.DataFrame, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Stacked X'X (series, m, m) and X'y (series, m) from the columns of ``_normal_eq_sums``."""
    a = np.zeros((len(pdf), m, m))
    for i in range(m):
        for j in range(i, m):
            a[:, i, j] = a[:, j, i] = pdf[f"xx{i}_{j}"].to_numpy(np.float64)
    return a, np.stack([pdf[f"xy{i}"].to_numpy(np.float64) for i in range(m)], axis=1)


def _solve(a: np.ndarray, b: np.ndarray, enough: np.ndarray) -> np.ndarray:
    """Coefficients of every series at once; NaN where there are too few rows, or a singular or non-finite system."""
    beta = np.full(b.shape, np.nan)
    ok = enough & np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
    ok[ok] = np.linalg.slogdet(a[ok])[0] != 0
    beta[ok] = np.linalg.solve(a[ok], b[ok][..., None])[..., 0]
    beta[~np.isfinite(beta).all(axis=1)] = np.nan
    return beta


def _coef_batches(key: str, m: int, names: list[str]):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            beta = _solve(*_normal_matrices(pdf, m), pdf["n"].to_numpy() > m)
            yield pd.DataFrame({key: pdf[key]} | {n: beta[:, i] for i, n in enumerate(names)})
    return f


def arima_forecast(series: DataFrame, key: str = "series_key", order_col: str = "month", value: str = "value",
                   order: tuple[int, int, int] = (1, 1, 1), steps: int | DataFrame = 12,
                   method: str = "likelihood", constant: bool | None = None, long_ar: int | None = None) -> DataFrame:
    """Per series ARIMA(p, d, q) -> (key, step, month, forecast, aic, model_ok).

    ``steps``: one number for all series, or a frame (key, steps) with one for
    each. A series that can't be fitted has one row, step 0, not ok. ``method``:
    "likelihood" (``constant``: with a mean of the differenced series; by default only
    where nothing is differenced) or "least_squares" (always with one; ``long_ar``: lags of its first regression).
    """
    if method == "likelihood":
        return _likelihood_forecast(series, key, order_col, value, order, steps, constant)
    if method != "least_squares":
        raise ValueError(f"unknown method {method!r}")
    p, d, q = order
    kt = series.schema[key].dataType.simpleString()
    s = series.where(F.col(value).isNotNull()).select(key, order_col, F.col(value).cast("double").alias("y"))
    w = Window.partitionBy(key).orderBy(order_col)
    z = s.withColumn("z", F.col("y"))
    for i in range(d):
        z = z.withColumn("z", F.col("z") - F.lag("z", 1).over(w))

    # stage 1: long AR(m) on the differenced series -> residuals
    m = long_ar or max(p + q + 2, 4)
    z1 = _lags(z, key, order_col, "z", m, "a")
    ar_names = ["c"] + [f"phi{i}" for i in range(1, m + 1)]
    eq1 = _normal_eq_sums(z1, key, "z", [f"a{i}" for i in range(1, m + 1)])
    schema1 = f"{key} {kt}, " + ", ".join(f"{n} double" for n in ar_names)
    c1 = eq1.mapInPandas(_coef_batches(key, m + 1, ar_names), schema1)
    fit1 = F.col("c")
    for i in range(1, m + 1):
        fit1 = fit1 + F.col(f"phi{i}") * F.col(f"a{i}")
    z2 = z1.join(c1, key, "left").withColumn("e", F.col("z") - fit1).select(key, order_col, "y", "z", "e")

    # stage 2: z_t on p lags of z and q lags of the stage-1 residuals
    z2 = _lags(_lags(z2, key, order_col, "z", p, "zl"), key, order_col, "e", q, "el")
    xs = [f"zl{i}" for i in range(1, p + 1)] + [f"el{i}" for i in range(1, q + 1)]
    eq2 = _normal_eq_sums(z2, key, "z", xs)

    # tail state for the recursion: last max(p, q, d) rows (bounded per series), the latest first
    lastn = max(p, q, d, 1)
    wd = Window.partitionBy(key).orderBy(F.col(order_col).desc())
    tail = (z2.withColumn("__r", F.row_number().over(wd)).where(F.col("__r") <= lastn)
              .groupBy(key).agg(*[F.max(F.when(F.col("__r") == i, F.col(c))).alias(f"{c}_{i}")
                                  for c in ("y", "z", "e") for i in range(1, lastn + 1)],
                                F.max(order_col).alias("last_month")))
    inp = with_steps(eq2.join(tail, key), key, steps)
    k2 = p + q + 1
    undo = [(-1) ** (i + 1) * math.comb(d, i) for i in range(1, d + 1)]  # y_t = z_t + sum of undo_i * y_{t-i}
    out_cols = [key, "step", "last_month", "forecast", "aic", "model_ok"]

    def fit_and_forecast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf["n"].to_numpy(np.float64)
            xx, xy = _normal_matrices(pdf, k2)
            beta = _solve(xx, xy, n > k2 + 2)
            # SSE = y'y - 2 b'X'y + b'X'Xb from the same sums
            sse = pdf["yy"].to_numpy(np.float64) - 2 * (beta * xy).sum(axis=1) + np.einsum("si,sij,sj->s", beta, xx, beta)
            aic = n * np.log(np.maximum(sse, 1e-12) / n) + 2 * k2
            ys, zs, es = ([pdf[f"{c}_{i}"].to_numpy(np.float64) for i in range(1, lastn + 1)] for c in ("y", "z", "e"))
            es = [np.nan_to_num(e) for e in es]
            fitted = np.isfinite(np.stack([beta[:, 0], *zs[:p], *ys[:max(d, 1)]])).all(axis=0)
            want = pdf["__steps"].to_numpy(np.int64)
            parts = [pd.DataFrame({key: pdf[key], "step": 0, "last_month": pdf["last_month"], "forecast": np.nan,
                                   "aic": aic, "model_ok": False})[~fitted]]
            for h in range(1, int(want[fitted].max(initial=0)) + 1):
                zhat = beta[:, 0] + sum(beta[:, 1 + i] * zs[i] for i in range(p)) + sum(beta[:, 1 + p + j] * es[j] for j in range(q))
                yhat = zhat + sum(u * ys[i] for i, u in enumerate(undo))
                zs, es, ys = [zhat, *zs], [np.zeros(len(pdf)), *es], [yhat, *ys]
                ok = np.isfinite(yhat)
                parts.append(pd.DataFrame({key: pdf[key], "step": h, "last_month": pdf["last_month"],
                                           "forecast": np.where(ok, yhat, np.nan), "aic": aic, "model_ok": ok})[fitted & (want >= h)])
            yield from (x[out_cols] for x in parts if len(x))

    lm_type = series.schema[order_col].dataType.simpleString()
    res = inp.mapInPandas(
        fit_and_forecast, f"{key} {kt}, step int, last_month {lm_type}, forecast double, aic double, model_ok boolean")
    return res.select(key, "step", F.add_months("last_month", F.col("step")).alias("month"),
                      *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("forecast", "aic")], "model_ok")


#: Series that one batch of fits holds, and points (with what pads the shorter ones).
FIT_SERIES, FIT_POINTS = 256, 1 << 20


def _packed(series: DataFrame, key: str, order_col: str, value: str) -> DataFrame:
    """(key, y, last): each series as one array in the order of time, nulls left out; dealt to all tasks, however small the rows are."""
    s = series.where(F.col(value).isNotNull()).select(key, F.struct(F.col(order_col).alias("t"), F.col(value).cast("double").alias("v")).alias("__p"))
    dealt = s.repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    rows = dealt.groupBy(key).agg(F.sort_array(F.collect_list("__p")).alias("__p"))
    return rows.select(key, F.col("__p.v").alias("y"), F.element_at("__p.t", -1).alias("last"))


def _fit_groups(ys: list[np.ndarray]) -> Iterator[list[int]]:
    """Rows to fit together: series of about equal length, within the bounds of a batch."""
    group: list[int] = []
    for i in sorted(range(len(ys)), key=lambda i: len(ys[i])):
        if group and (len(group) >= FIT_SERIES or (len(group) + 1) * len(ys[i]) > FIT_POINTS):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def _likelihood_fits(pdf: pd.DataFrame, order: tuple[int, int, int], constant: bool) -> Iterator[tuple[list[int], list[np.ndarray], Fit, np.ndarray]]:
    """(rows, their values, fits, AIC) of a batch of packed series."""
    p, d, q = order
    ys = [np.asarray(y, np.float64) for y in pdf["y"]]
    for rows in _fit_groups(ys):
        own = [ys[i] for i in rows]
        fitted = fit([np.diff(y, d) if len(y) > d else y[:0] for y in own], p, q, constant)
        yield rows, own, fitted, -2 * fitted.loglik + 2 * (p + q + constant + 1)


def arima_fit(series: DataFrame, key: str = "series_key", order_col: str = "month", value: str = "value",
              order: tuple[int, int, int] = (1, 1, 1), constant: bool | None = None) -> DataFrame:
    """The maximum-likelihood models: (key, n, mean, ar, ma, sigma2, loglik, aic, model_ok), a row per series with a value."""
    kt, with_mean = series.schema[key].dataType.simpleString(), order[1] == 0 if constant is None else constant

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows, own, f, aic in _likelihood_fits(pdf, order, with_mean):
                none = ~f.ok
                yield pd.DataFrame({key: pdf[key].iloc[rows], "n": [max(0, len(y) - order[1]) for y in own], "mean": np.where(none, np.nan, f.mean), "ar": [x.tolist() for x in f.phi],
                                    "ma": [x.tolist() for x in f.theta], "sigma2": np.where(none, np.nan, f.sigma2), "loglik": np.where(none, np.nan, f.loglik), "aic": np.where(none, np.nan, aic), "model_ok": f.ok})

    out = _packed(series, key, order_col, value).mapInPandas(run, f"{key} {kt}, n long, mean double, ar array<double>, ma array<double>, sigma2 double, loglik double, aic double, model_ok boolean")
    return out.select(key, "n", *[F.when(F.col("model_ok"), F.col(c)).alias(c) for c in ("mean", "ar", "ma", "sigma2", "loglik", "aic")], "model_ok")


def _likelihood_forecast(series: DataFrame, key: str, order_col: str, value: str, order: tuple[int, int, int], steps: int | DataFrame, constant: bool | None) -> DataFrame:
    d, with_mean = order[1], order[1] == 0 if constant is None else constant
    undo = [(-1) ** (i + 1) * math.comb(d, i) for i in range(1, d + 1)]  # y_t = z_t + sum of undo_i * y_{t-i}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows, own, f, aic in _likelihood_fits(pdf, order, with_mean):
                keys, last, want = (pdf[c].iloc[rows].to_numpy() for c in (key, "last", "__steps"))
                zs = ahead(f, int(want[f.ok].max(initial=0)))
                past = [np.array([y[-i] if len(y) >= i else np.nan for y in own]) for i in range(1, d + 1)]
                made = np.full(zs.shape, np.nan)
                for h in range(zs.shape[1]):
                    made[:, h] = zs[:, h] + sum(u * y for u, y in zip(undo, past))
                    past = [made[:, h], *past][:d]
                ok = f.ok & np.isfinite(made).all(axis=1)
                n = np.where(ok, want, 0)  # rows of a series; a series without a model has one, step 0
                at = np.repeat(np.arange(len(rows)), np.maximum(n, ~ok))
                step = np.arange(len(at)) - np.repeat(np.cumsum(np.maximum(n, ~ok)) - np.maximum(n, ~ok), np.maximum(n, ~ok)) + ok[at]
                value_at = np.where(ok[at], made[at, np.maximum(step - 1, 0)] if zs.shape[1] else np.nan, np.nan)
                yield pd.DataFrame({key: keys[at], "step": step.astype(np.int32), "last_month": last[at], "forecast": value_at, "aic": np.where(ok, aic, np.nan)[at], "model_ok": ok[at]})

    kt, lt = series.schema[key].dataType.simpleString(), series.schema[order_col].dataType.simpleString()
    res = with_steps(_packed(series, key, order_col, value), key, steps).mapInPandas(run, f"{key} {kt}, step int, last_month {lt}, forecast double, aic double, model_ok boolean")
    return res.select(key, "step", F.add_months("last_month", F.col("step")).alias("month"),
                      *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("forecast", "aic")], "model_ok")


def forecast_with_fallback(series: DataFrame, key: str = "series_key", order_col: str = "month",
                           value: str = "value", order=(1, 1, 1), steps: int | DataFrame = 12) -> DataFrame:
    """ARIMA where it fits, else the tail mean of the last 6 points; ``model_type`` records which.

    ``steps``: one number for all series, or a frame (key, steps).
    """
    ar = arima_forecast(series, key, order_col, value, order, steps)
    good = with_steps(ar.where(F.col("model_ok")).groupBy(key).agg(F.count(F.lit(1)).alias("__n")), key, steps).where(
        F.col("__n") == F.col("__steps")).select(key)
    arima_rows = ar.join(good, key, "left_semi").select(key, "step", "month", "forecast",
                                                        F.lit(f"arima{order}").alias("model_type"))
    fb = tail_mean_forecast(series.where(F.col(value).isNotNull()), key, order_col, value, 6, steps)
    fb_rows = fb.join(good, key, "left_anti").select(key, "step", "month", "forecast",
                                                     F.lit("tail_mean").alias("model_type"))
    return arima_rows.unionByName(fb_rows)


def forecast_holdout(series: DataFrame, key: str = "series_key", order_col: str = "month", value: str = "value",
                     order: tuple[int, int, int] | None = (2, 1, 2), frac: float = 0.8) -> DataFrame:
    """Rainfall training job (W5, W8, W9): each series' model scored on its own holdout months.

    The first ``frac`` of a series' months train, the rest are forecast, as many
    steps as there are (``order=None``: by the tail mean only). Returns (key,
    model_type, steps, accuracy, f1, rmse). Series with too little history for
    W5's rule have no row.
    """
    s = chrono_split(series, key, order_col, frac).where("series_ok")
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    steps = test.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("steps"))
    known = train.where(F.col(value).isNotNull())
    if order is None:
        fc = tail_mean_forecast(known, key, order_col, value, 6, steps).withColumn("model_type", F.lit("tail_mean"))
    else:
        fc = forecast_with_fallback(known, key, order_col, value, order, steps)
    scored = test.join(fc.select(key, order_col, "forecast", "model_type"), [key, order_col])
    named = scored.groupBy(key).agg(F.max("model_type").alias("model_type"), F.count(F.lit(1)).alias("steps"))
    return named.join(binary_above_median_eval(train, scored, key, value, "forecast"), key)


def ar1_on_differences(series: DataFrame, key: str = "series_key", order_col: str = "month",
                       value: str = "value") -> DataFrame:
    """ARIMA(1, 1, 0) special case in closed form: slope / intercept of z_t on z_{t-1}."""
    w = Window.partitionBy(key).orderBy(order_col)
    z = series.where(F.col(value).isNotNull()).withColumn("z", F.col(value) - F.lag(value, 1).over(w))
    z = z.withColumn("zl", F.lag("z", 1).over(w)).where(F.col("z").isNotNull() & F.col("zl").isNotNull())
    return z.groupBy(key).agg(F.regr_slope("z", "zl").alias("phi1"), F.regr_intercept("z", "zl").alias("c"),
                              F.count(F.lit(1)).alias("n"))
