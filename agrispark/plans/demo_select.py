"""Registered sort / top-k / sampling / model-selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views as V
from .demo_features import H, SPLIT
from .registry import register
from .util import bround, round_doubles
from ..operators import ranking as L
from ..operators.aggregates import group_mean, regression_metrics

# fixed values: the six demo classes scored per order
SCORE_LABELS = ["cotton", "maize", "millet", "rice", "wheat", "coffee"]


def order_scores(spark, sf):
    """Long (o_orderkey, label, score): a fixed formula stands in for model probabilities.

    The per-row fan-out is the fixed label list, inlined as a literal array.
    """
    o = V.read(spark, sf, "orders").select("o_orderkey")
    arr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(lab).alias("label")) for i, lab in enumerate(SCORE_LABELS)])
    x = o.select("o_orderkey", F.inline(arr))
    score = ((F.col("o_orderkey") * (F.col("i") + 3)) % 7).cast("double") / 7.0
    return x.select("o_orderkey", "label", score.alias("score"))


SCORES_SQL = "s AS (SELECT o_orderkey, label, CAST((o_orderkey * (i + 3)) % 7 AS DOUBLE) / 7.0 AS score " \
             "FROM orders CROSS JOIN (VALUES " + ", ".join(f"({i}, '{lab}')" for i, lab in enumerate(SCORE_LABELS)) \
             + ") t(i, label))"


@register("L1_sort_timeline", """
SELECT country, crop_type, year, round(avg(crop_yield), 6) AS crop_yield FROM obs GROUP BY ALL
""", views=("obs",))
def q_l1(spark, sf):
    g = group_mean(V.obs(spark, sf), ["country", "crop_type", "year"], ["crop_yield"])
    return round_doubles(L.sort_timeline(g, ["country", "crop_type", "year"]))


@register("L2_top_k_per_row", "WITH " + SCORES_SQL + """
SELECT * FROM (SELECT o_orderkey, label, score,
                      CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, label) AS INTEGER) AS rank
               FROM s) WHERE rank <= 3
""")
def q_l2(spark, sf):
    return L.top_k_per_row(order_scores(spark, sf), "o_orderkey", "label", "score", 3)


@register("L2_top_k_array", "WITH " + SCORES_SQL + """
SELECT o_orderkey, CAST(rank AS INTEGER) AS rank, label, score FROM (
  SELECT o_orderkey, label, score, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, label) AS rank
  FROM s) WHERE rank <= 3
""")
def q_l2a(spark, sf):
    s = order_scores(spark, sf)
    # one list of (label, score) pairs per row (bounded by the class count), split into parallel arrays
    per = s.groupBy("o_orderkey").agg(F.collect_list(F.struct("label", "score")).alias("ls"))
    labels = F.transform("ls", lambda x: x["label"])
    probs = F.transform("ls", lambda x: x["score"])
    top = per.select("o_orderkey", F.posexplode(L.top_k_array(labels, probs, 3)).alias("r", "t"))
    return top.select("o_orderkey", (F.col("r") + 1).alias("rank"), F.col("t.label").alias("label"),
                      F.col("t.p").alias("score"))


@register("L3_argmax_label", "WITH " + SCORES_SQL + """
SELECT o_orderkey, arg_min(label, struct_pack(a := -score, b := label)) AS best_label, max(score) AS best_p
FROM s GROUP BY o_orderkey
""")
def q_l3(spark, sf):
    return L.argmax_label(order_scores(spark, sf), "o_orderkey", "label", "score")


@register("L4_first_match", """
SELECT country, min(place_id) AS place_id, arg_min(name, place_id) AS name, arg_min(lat, place_id) AS lat,
       arg_min(lng, place_id) AS lng
FROM places GROUP BY country
""", views=("places",))
def q_l4(spark, sf):
    p = V.places(spark, sf).select("country", "place_id", "name", "lat", "lng")
    return L.first_match(p, "country", "place_id")


@register("L5_sample_rows", f"""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY {H('o_orderkey')}, o_orderkey LIMIT 100
""")
def q_l5(spark, sf):
    o = V.read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return L.sample_rows(o, 100, "o_orderkey", 42)


def region_models(spark, sf):
    """One 'model' per region: metrics of a fixed yield formula (test = M1 split rows)."""
    from ..operators.features import random_split
    o = V.obs(spark, sf)
    pred = F.lit(0.05) + F.lit(0.004) * F.col("temperature") + F.lit(0.00012) * F.col("rainfall")
    d = o.select("region", "l_orderkey", F.col("crop_yield").alias("actual"), pred.alias("prediction"))
    d = random_split(d, "l_orderkey").where(F.col("dataset_split") == "test")
    m = regression_metrics(d, group="region")
    ordinal = F.substring("region", 1, 1)
    return m.select(F.col("region").alias("model"), bround("rmse", 6).alias("test_rmse"),
                    bround("r2", 6).alias("test_r2"), F.col("n"), ordinal.alias("ordinal"))


REGION_MODELS_SQL = f"""
rm AS (SELECT region AS model, round(sqrt(avg((actual - prediction) * (actual - prediction))), 6) AS test_rmse,
              round(1.0 - sum((actual - prediction) * (actual - prediction)) / (var_pop(actual) * count(*)), 6) AS test_r2,
              count(*) AS n, substr(region, 1, 1) AS ordinal
       FROM (SELECT region, l_orderkey, crop_yield AS actual,
                    0.05 + 0.004 * temperature + 0.00012 * rainfall AS prediction FROM obs)
       WHERE {SPLIT('l_orderkey')} = 'test' GROUP BY region)"""


@register("L6_pick_best_model", "WITH " + REGION_MODELS_SQL + """
SELECT * FROM rm WHERE test_rmse <= (SELECT min(test_rmse) FROM rm) + 1e-12
ORDER BY test_r2 DESC, test_rmse, ordinal LIMIT 1
""", views=("obs",))
def q_l6(spark, sf):
    return L.pick_best_model(region_models(spark, sf), "regression", "ordinal")


REGION_CLASSIFIERS_SQL = """
rc AS (SELECT region, crop_yield >= 0.3 AS y, 0.05 + 0.004 * temperature + 0.00012 * rainfall >= 0.3 AS p FROM obs
       WHERE crop_yield IS NOT NULL AND temperature IS NOT NULL AND rainfall IS NOT NULL AND region IS NOT NULL),
rt AS (SELECT region, CAST(count(*) FILTER (WHERE y AND p) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE NOT y AND NOT p) AS DOUBLE) AS tn,
              CAST(count(*) FILTER (WHERE y <> p) AS DOUBLE) AS wrong, CAST(count(*) FILTER (WHERE y) AS DOUBLE) AS pos,
              CAST(count(*) AS DOUBLE) AS n FROM rc GROUP BY region),
rm AS (SELECT region AS model, round((tp + tn) / n, 6) AS accuracy,
              round((pos * coalesce(2 * tp / nullif(2 * tp + wrong, 0), 0.0)
                     + (n - pos) * coalesce(2 * tn / nullif(2 * tn + wrong, 0), 0.0)) / n, 6) AS f1_weighted,
              substr(region, 1, 1) AS ordinal FROM rt)"""


@register("L6_pick_best_classifier", "WITH " + REGION_CLASSIFIERS_SQL + """
SELECT * FROM rm WHERE f1_weighted >= (SELECT max(f1_weighted) FROM rm) - 1e-12 ORDER BY accuracy DESC, ordinal LIMIT 1
""", views=("obs",))
def q_l6c(spark, sf):
    """One 'classifier' per region: yield of at least 0.3 by a fixed formula; class measures from its counts alone."""
    pred = F.lit(0.05) + F.lit(0.004) * F.col("temperature") + F.lit(0.00012) * F.col("rainfall")
    d = V.obs(spark, sf).select("region", (F.col("crop_yield") >= 0.3).alias("y"), (pred >= 0.3).alias("p")).na.drop()
    g = d.groupBy("region").agg(*[F.count_if(c).cast("double").alias(n) for n, c in (
        ("tp", F.col("y") & F.col("p")), ("tn", ~F.col("y") & ~F.col("p")), ("wrong", F.col("y") != F.col("p")), ("pos", F.col("y")))],
        F.count(F.lit(1)).cast("double").alias("n"))

    def f1(t):
        return F.coalesce(F.try_divide(2 * F.col(t), 2 * F.col(t) + F.col("wrong")), F.lit(0.0))
    m = g.select(F.col("region").alias("model"), bround((F.col("tp") + F.col("tn")) / F.col("n"), 6).alias("accuracy"),
                 bround((F.col("pos") * f1("tp") + (F.col("n") - F.col("pos")) * f1("tn")) / F.col("n"), 6).alias("f1_weighted"),
                 F.substring("region", 1, 1).alias("ordinal"))
    return L.pick_best_model(m, "classification", "ordinal")


@register("L7_leaderboard", "WITH " + REGION_MODELS_SQL + """
SELECT *, CAST(row_number() OVER (ORDER BY test_rmse, model) AS INTEGER) AS rank FROM rm
""", views=("obs",))
def q_l7(spark, sf):
    return L.leaderboard(region_models(spark, sf), "regression", "model")


@register("U3_key_union", """
SELECT DISTINCT strftime(ts, '%Y%m%d') AS day_key FROM events
""")
def q_u3(spark, sf):
    e = V.read(spark, sf, "events").withColumn("day_key", F.date_format("ts", "yyyyMMdd"))
    parts = [e.where(F.col("event_type") == t) for t in ("view", "click", "error", "signup", "purchase")]
    return L.key_union(parts, "day_key")
