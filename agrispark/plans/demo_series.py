"""Registered series queries (W1 - W6, W9 - W12, A23, U2, X28, ML15).

All series are keyed by nation (``series_key``), so the windows partition by
key and every series runs in parallel.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views as V
from .registry import register
from .util import bround, round_doubles
from ..operators import windows as W
from ..operators.aggregates import series_summary
from ..operators.ranking import history_forecast_union, shape_series_points


def monthly(spark, sf):
    return W.month_bucket(V.series_raw(spark, sf), "series_key", "obs_date", "value")


def filled(spark, sf):
    return W.interpolate_linear(monthly(spark, sf), "series_key", "month", "value")


def split(spark, sf):
    return W.chrono_split(filled(spark, sf), "series_key", "month", 0.8, 24, 6)


def forecast(spark, sf):
    s = split(spark, sf)
    return W.tail_mean_forecast(s.where(F.col("split") == "train"), "series_key", "month", "value", 6, 12)


MB_SQL = """
m AS (SELECT series_key, CAST(date_trunc('month', obs_date) AS DATE) AS month, avg(value) AS value
      FROM series_raw WHERE obs_date IS NOT NULL AND series_key IS NOT NULL GROUP BY ALL),
span AS (SELECT series_key, min(month) AS lo, max(month) AS hi FROM m GROUP BY 1),
grid AS (SELECT series_key, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                INTERVAL 1 MONTH)) AS DATE) AS month FROM span),
mb AS (SELECT g.series_key, g.month, m.value FROM grid g LEFT JOIN m ON g.series_key = m.series_key
       AND g.month = m.month)"""

FILL_SQL = MB_SQL + """,
p AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY month) AS pos FROM mb),
q AS (SELECT *,
   last_value(value IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY month
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
   last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY month
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
   first_value(value IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY month
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
   first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY month
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np
   FROM p),
f AS (SELECT series_key, month,
   CASE WHEN value IS NOT NULL THEN value
        WHEN pv IS NOT NULL AND nv IS NOT NULL
        THEN pv + (nv - pv) * (CAST(pos - pp AS DOUBLE) / CAST(np - pp AS DOUBLE)) END AS value
   FROM q)"""

SPLIT_SQL = FILL_SQL + """,
s0 AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY month) AS rn,
              count(*) OVER (PARTITION BY series_key) AS n FROM f),
s AS (SELECT series_key, month, value,
             CASE WHEN rn <= CAST(floor(n * 0.8) AS INTEGER) THEN 'train' ELSE 'test' END AS split,
             CAST(floor(n * 0.8) AS INTEGER) >= 24 AND n - CAST(floor(n * 0.8) AS INTEGER) >= 6 AS series_ok
      FROM s0)"""

FC_SQL = SPLIT_SQL + """,
tr AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY month DESC) AS rd FROM s
       WHERE split = 'train'),
tm AS (SELECT series_key, avg(value) AS forecast, max(month) AS last FROM tr WHERE rd <= 6 GROUP BY 1),
fc AS (SELECT series_key, CAST(g.i AS INTEGER) AS step, CAST(last + to_months(CAST(g.i AS INTEGER)) AS DATE) AS month,
              forecast FROM tm CROSS JOIN range(1, 13) g(i))"""


@register("W3_month_bucket", "WITH " + MB_SQL + " SELECT series_key, month, round(value, 6) AS value FROM mb",
          views=("series_raw",))
def q_w3(spark, sf):
    return round_doubles(monthly(spark, sf), 6)


@register("A23_series_summary", "WITH " + MB_SQL + """
SELECT series_key, count(*) AS n_points, min(month) AS first_month, max(month) AS last_month FROM mb GROUP BY 1
""", views=("series_raw",))
def q_a23(spark, sf):
    return series_summary(monthly(spark, sf), "series_key", "month")


@register("W1_lag_by", "WITH " + MB_SQL + """
SELECT series_key, month, round(value, 6) AS value,
       round(lag(value) OVER (PARTITION BY series_key ORDER BY month), 6) AS value_lag1
FROM mb
""", views=("series_raw",))
def q_w1(spark, sf):
    return round_doubles(W.lag_by(monthly(spark, sf), ["series_key"], ["month"], "value", 1), 6)


@register("W2_rolling_mean", "WITH " + MB_SQL + """
SELECT series_key, month, round(value, 6) AS value,
       round(avg(value) OVER (PARTITION BY series_key ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6)
         AS value_trend3
FROM mb
""", views=("series_raw",))
def q_w2(spark, sf):
    return round_doubles(W.rolling_mean(monthly(spark, sf), ["series_key"], ["month"], "value", 3), 6)


@register("W4_interpolate_linear", "WITH " + FILL_SQL + " SELECT series_key, month, round(value, 6) AS value FROM f",
          views=("series_raw",))
def q_w4(spark, sf):
    return round_doubles(filled(spark, sf), 6)


@register("W5_chrono_split", "WITH " + SPLIT_SQL + """
SELECT series_key, month, round(value, 6) AS value, split, series_ok FROM s
""", views=("series_raw",))
def q_w5(spark, sf):
    return round_doubles(split(spark, sf), 6)


@register("W6_tail_mean_forecast", "WITH " + FC_SQL + """
SELECT series_key, step, month, round(forecast, 6) AS forecast FROM fc
""", views=("series_raw",))
def q_w6(spark, sf):
    return round_doubles(forecast(spark, sf), 6)


@register("W9_binary_above_median_eval", "WITH " + FC_SQL + """,
med AS (SELECT series_key, quantile_cont(value, 0.5) AS med FROM s WHERE split = 'train' GROUP BY 1),
d AS (SELECT s.series_key, CAST(s.value >= med.med AS INTEGER) AS y, CAST(fc.forecast >= med.med AS INTEGER) AS p,
             s.value - fc.forecast AS e
      FROM s JOIN fc ON s.series_key = fc.series_key AND s.month = fc.month
      JOIN med ON s.series_key = med.series_key WHERE s.split = 'test'),
g AS (SELECT series_key, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS accuracy,
             sum(CASE WHEN y = 1 AND p = 1 THEN 1.0 ELSE 0.0 END) AS tp,
             sum(CASE WHEN y = 0 AND p = 1 THEN 1.0 ELSE 0.0 END) AS fp,
             sum(CASE WHEN y = 1 AND p = 0 THEN 1.0 ELSE 0.0 END) AS fn,
             sqrt(avg(e * e)) AS rmse FROM d GROUP BY 1)
SELECT series_key, round(accuracy, 6) AS accuracy,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1, round(rmse, 6) AS rmse FROM g
""", views=("series_raw",))
def q_w9(spark, sf):
    s = split(spark, sf)
    fc = forecast(spark, sf)
    test = s.where(F.col("split") == "test").join(fc.select("series_key", "month", "forecast"),
                                                  ["series_key", "month"])
    out = W.binary_above_median_eval(s.where(F.col("split") == "train"), test, "series_key", "value", "forecast")
    return round_doubles(out, 6)


@register("W10_trailing_days", """
SELECT event_id, last_updated FROM weather
WHERE CAST(last_updated AS DATE) BETWEEN (SELECT max(CAST(last_updated AS DATE)) FROM weather) - 6
                                     AND (SELECT max(CAST(last_updated AS DATE)) FROM weather)
""", views=("weather",))
def q_w10(spark, sf):
    return W.trailing_days(V.weather(spark, sf).select("event_id", "last_updated"), "last_updated", 7)


def metrics_history(spark, sf):
    """Daily metric snapshots per event type (wide; nullable metric columns)."""
    e = V.read(spark, sf, "events").withColumn("generated_at", F.to_date("ts"))
    g = e.groupBy(F.col("event_type").alias("model"), "generated_at").agg(F.avg("value").alias("m"))
    t = F.col("model")
    return g.select("model", "generated_at",
                    F.when(t.isin("view", "click"), bround("m", 6)).alias("rmse"),
                    F.lit(None).cast("double").alias("holdout_rmse"),
                    F.when(t == "purchase", bround(F.col("m") / 500.0, 6)).alias("holdout_accuracy"),
                    F.when(t == "error", bround(F.col("m") / 500.0, 6)).alias("accuracy"))


@register("W11_metric_trend", """
WITH g AS (SELECT event_type AS model, CAST(ts AS DATE) AS generated_at, avg(value) AS m FROM events GROUP BY ALL),
h AS (SELECT model, generated_at,
             CASE WHEN model IN ('view', 'click') THEN round(m, 6) END AS rmse,
             CAST(NULL AS DOUBLE) AS holdout_rmse,
             CASE WHEN model = 'purchase' THEN round(m / 500.0, 6) END AS holdout_accuracy,
             CASE WHEN model = 'error' THEN round(m / 500.0, 6) END AS accuracy FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY generated_at DESC) AS rn FROM h),
c AS (SELECT * FROM r WHERE rn = 1), p AS (SELECT * FROM r WHERE rn = 2),
j AS (SELECT c.model,
        CASE WHEN c.rmse IS NOT NULL THEN 'rmse' WHEN c.holdout_rmse IS NOT NULL THEN 'holdout_rmse'
             WHEN c.holdout_accuracy IS NOT NULL THEN 'holdout_accuracy' WHEN c.accuracy IS NOT NULL THEN 'accuracy'
        END AS metric,
        coalesce(c.rmse, c.holdout_rmse, c.holdout_accuracy, c.accuracy) AS cur,
        CASE WHEN c.rmse IS NOT NULL OR c.holdout_rmse IS NOT NULL THEN 'lower_better'
             WHEN c.holdout_accuracy IS NOT NULL OR c.accuracy IS NOT NULL THEN 'higher_better' END AS dirn,
        CASE WHEN p.model IS NOT NULL THEN coalesce(p.rmse, p.holdout_rmse, p.holdout_accuracy, p.accuracy)
             ELSE coalesce(c.rmse, c.holdout_rmse, c.holdout_accuracy, c.accuracy) END AS prev
      FROM c LEFT JOIN p ON c.model = p.model)
SELECT model, metric, cur AS current, prev AS previous,
       CASE WHEN metric IS NULL OR cur IS NULL OR prev IS NULL THEN 'No trend'
            WHEN abs(cur - prev) < 1e-9 THEN 'Stable'
            WHEN dirn = 'lower_better' THEN CASE WHEN cur - prev < 0 THEN 'Improving' ELSE 'Regressing' END
            ELSE CASE WHEN cur - prev > 0 THEN 'Improving' ELSE 'Regressing' END END AS trend
FROM j
""")
def q_w11(spark, sf):
    return W.metric_trend(metrics_history(spark, sf))


@register("W12_calendar_parts", """
SELECT o_orderkey, CAST(coalesce(month(o_orderdate), 1) AS INTEGER) AS month,
       CAST(coalesce(quarter(o_orderdate), 1) AS INTEGER) AS quarter, CAST(year(o_orderdate) AS INTEGER) AS year_of
FROM orders
""")
def q_w12(spark, sf):
    o = V.read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return W.calendar_parts(o, "o_orderdate").drop("o_orderdate")


@register("U2_history_forecast_union", "WITH " + FC_SQL + """
SELECT series_key, month AS date, round(value, 6) AS history, CAST(NULL AS DOUBLE) AS forecast FROM s
WHERE split = 'test'
UNION ALL SELECT series_key, month, NULL, round(forecast, 6) FROM fc
""", views=("series_raw",))
def q_u2(spark, sf):
    s = split(spark, sf).where(F.col("split") == "test")
    fc = forecast(spark, sf).withColumnRenamed("forecast", "prediction")
    out = history_forecast_union(s, fc, "month", "value", "prediction", keys=["series_key"])
    return round_doubles(out, 6)


@register("X28_shape_series_point", "WITH " + FC_SQL + """
SELECT series_key, step AS pos, 'Step ' || CAST(step AS VARCHAR) AS date, round(forecast, 6) AS rainfall,
       round(forecast, 6) AS prediction FROM fc
UNION ALL
SELECT series_key, step, strftime(month, '%Y-%m-%d'), round(CASE WHEN step % 2 = 0 THEN forecast ELSE 0.0 END, 6),
       round(CASE WHEN step % 2 = 0 THEN forecast ELSE 0.0 END, 6) FROM fc
""", views=("series_raw",))
def q_x28(spark, sf):
    fc = forecast(spark, sf)
    # numeric points, and struct points where odd steps carry no value at all
    per = fc.groupBy("series_key").agg(F.array_sort(F.collect_list(F.struct(
        "step", "forecast", F.date_format("month", "yyyy-MM-dd").alias("date")))).alias("pts"))
    nums = per.select("series_key", F.transform("pts", lambda p: p["forecast"]).alias("arr"))
    structs = per.select("series_key", F.transform("pts", lambda p: F.struct(
        p["date"].alias("date"),
        F.when(p["step"] % 2 == 0, p["forecast"]).alias("rainfall"),
        F.lit(None).cast("double").alias("prediction"))).alias("arr"))
    a = nums.select("series_key", F.posexplode(shape_series_points(F.col("arr"), numeric=True)).alias("i", "s"))
    b = structs.select("series_key", F.posexplode(shape_series_points(F.col("arr"))).alias("i", "s"))
    out = a.unionByName(b).select("series_key", (F.col("i") + 1).alias("pos"), "s.date", "s.rainfall", "s.prediction")
    return round_doubles(out, 6)


@register("ML15_historical_window", """
WITH d AS (SELECT place_id, CAST(last_updated AS DATE) AS date, round(sum(precip_mm), 6) AS rainfall,
                  round(avg(temperature_celsius), 6) AS temperature, round(avg(humidity), 6) AS humidity
           FROM weather GROUP BY ALL)
SELECT place_id, date, rainfall, temperature, humidity FROM d
WHERE date BETWEEN (SELECT max(date) FROM d) - 89 AND (SELECT max(date) FROM d)
""", views=("weather",))
def q_ml15(spark, sf):
    w = V.weather(spark, sf)
    daily = w.groupBy("place_id", F.to_date("last_updated").alias("date")).agg(
        bround(F.sum("precip_mm"), 6).alias("rainfall"), bround(F.avg("temperature_celsius"), 6).alias("temperature"),
        bround(F.avg("humidity"), 6).alias("humidity"))
    return W.trailing_days(daily, "date", 90)
