"""Decision jobs over scored rows (ML10 - ML12, ML14, X27).

Inputs are tables, not single requests: ``rows`` carries a row key and the
climate features; ``scores`` is long ``(row key, label, p)`` as produced by
``ml.models.predict_scores`` (or any fixed probability table). Every step
partitions by the row key only, so the largest group is one row's labels
(bounded by the class count) and nothing concentrates on a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators.aggregates import worst_change
from ..operators.filters import allowed_labels
from ..operators.joins import apply_scenarios, bounded_broadcast, join_keyed, nearest_centroid
from ..operators.ranking import argmax_label


def _ranked(df: DataFrame, key: str, order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def classify_with_constraints(rows: DataFrame, scores: DataFrame, zone_rules: DataFrame, band_rules: DataFrame,
                              key: str, k: int = 3, zone_default: str = "tropical") -> DataFrame:
    """ML11: zone filter (F7) -> band weights (X5/J11) + rice boost (X6) -> top-k (L2)
    -> renormalised confidences (X19) -> risk from the un-normalised top score (X8),
    plus climate/weather scores (X4, X7) and insight text (X22).

    Output: one row per (row, rank <= k): label, adjusted score, confidence and
    the per-row fields repeated.
    """
    r = rows.select(key, "temperature", "rainfall", "humidity").withColumn(
        "region_type", X.climate_zone("rainfall", zone_default))
    s = join_keyed(scores, r, key)
    s = allowed_labels(s, zone_rules, key, "label", "region_type")
    b = band_rules.select(F.lower("crop").alias("__rc"), "tmin", "tmax", "rmin", "rmax")
    s = s.join(bounded_broadcast(b, what="band rules"), F.lower(F.col("label")) == F.col("__rc"), "left")
    w = X.climate_weight("temperature", "rainfall", "tmin", "tmax", "rmin", "rmax")
    adj = F.when(F.col("fallback"), F.col("p")).otherwise(F.col("p") * w * X.rice_boost("label", "rainfall"))
    s = s.withColumn("score", adj).drop("__rc", "tmin", "tmax", "rmin", "rmax")
    s = _ranked(s, key, [F.col("score").desc(), F.col("p").desc(), F.col("label")]).where(F.col("rank") <= k)
    wk = Window.partitionBy(key)
    total = F.sum("score").over(wk)
    top = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(wk)
    top_label = F.max(F.when(F.col("rank") == 1, F.col("label"))).over(wk)
    s = s.withColumns({
        "confidence": F.col("score") / F.when(total == 0, F.lit(1.0)).otherwise(total),
        "risk_level": X.risk_from_probability(F.coalesce(top, F.lit(0.0))),
        "climate_score": X.climate_score("temperature", "humidity", "rainfall"),
        "weather_score": X.weather_score("temperature", "rainfall"),
        "insight": X.insight_text(top_label, "rainfall"),
    })
    return s.select(key, "rank", "label", "score", "confidence", "risk_level", "region_type", "climate_score",
                    "weather_score", F.col("insight.summary").alias("summary"),
                    F.array_join("insight.warnings", ";").alias("warnings"), "fallback")


def recommend_zone(rows: DataFrame, scores: DataFrame, zone_rules: DataFrame, key: str, k: int = 3,
                   zone_default: str = "tropical") -> DataFrame:
    """ML12: zone filter (F7) -> top-k of the raw probabilities; no climate weights."""
    r = rows.select(key, "rainfall").withColumn("region_type", X.climate_zone("rainfall", zone_default))
    s = allowed_labels(join_keyed(scores, r, key), zone_rules, key, "label", "region_type")
    s = _ranked(s, key, [F.col("p").desc(), F.col("label")]).where(F.col("rank") <= k)
    return s.select(key, "rank", "label", "p", "region_type", "fallback")


def renormalise_top(top: DataFrame, key: str, score: str = "p", out: str = "share") -> DataFrame:
    """Share of the top-k sum per row; a zero sum divides by 1."""
    t = F.sum(score).over(Window.partitionBy(key))
    return top.withColumn(out, F.col(score) / F.when(t == 0, F.lit(1.0)).otherwise(t))


def recommend_hybrid(rows: DataFrame, scores: DataFrame, centroids: DataFrame, thresholds: Sequence,
                     feats: Sequence[str], key: str, min_conf: float = 0.40) -> DataFrame:
    """ML10: model argmax (L3) + nearest centroid (J9) + confidence gate (X23) + advice.

    ``thresholds``: rows of (feature, low, high) (a small fitted table).
    """
    best = argmax_label(scores, key, "label", "p")
    r = nearest_centroid(rows, centroids, feats)
    lows = {t["feature"]: F.lit(t["low"]) for t in thresholds}
    highs = {t["feature"]: F.lit(t["high"]) for t in thresholds}
    vals = {f: f for f in ("N", "P", "K", "rainfall", "temperature") if f in lows}
    j = join_keyed(r, best, key, "left")
    gate = X.confidence_gate("best_label", "rule_label", "best_p", min_conf)
    return j.select(key, gate["label"].alias("best_crop"), gate["selection"].alias("selection"),
                    F.col("best_label").alias("model_prediction"), F.col("best_p").alias("model_confidence"),
                    F.col("rule_label").alias("rule_prediction"), F.col("rule_distance"),
                    X.nutrient_advice(vals, lows, highs).alias("fertilizer_suggestion"))


def linear_yield(coefs: dict, intercept: float):
    """A fixed linear yield model as a column expression (stand-in for a fitted model)."""
    expr = F.lit(float(intercept))
    for c, w in coefs.items():
        expr = expr + F.lit(float(w)) * F.col(c)
    return expr


#: What scenarios change.
CLIMATE = ("temperature", "rainfall", "humidity")


def simulate_climate_risk(rows: DataFrame, key: str, scenarios, predict) -> tuple[DataFrame, DataFrame]:
    """ML14: scenarios (J8) -> predict -> percent change vs baseline (X11) -> worst change (A19) -> risk.

    ``predict`` maps a DataFrame with temperature / rainfall / humidity to a
    ``prediction`` column and keeps the rows. Each scenario is scored once, side
    by side in the row, so the baseline is at hand without a join or shuffle.
    The first scenario named 'baseline' is the one that changes are told against.
    Returns (per-scenario rows, per-row risk).
    """
    names = [s[0] for s in scenarios]
    cols, y = rows.columns, rows
    for i, scenario in enumerate(scenarios):
        x = apply_scenarios(y.select(*cols, *[f"__y{j}" for j in range(i)], F.struct(*[F.col(c) for c in CLIMATE]).alias("__was")), [scenario])
        x = predict(x).withColumn(f"__y{i}", F.struct(*[F.col(c) for c in CLIMATE], X.clamp_nonneg("prediction").alias("predicted_yield")))
        y = x.withColumns({c: F.col("__was")[c] for c in CLIMATE}).select(*cols, *[f"__y{j}" for j in range(i + 1)])
    base = F.col(f"__y{names.index('baseline')}")["predicted_yield"]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.col(f"__y{i}").alias("y")) for i, n in enumerate(names)])).alias("__s")
    z = y.select(*[c for c in cols if c not in CLIMATE], base.alias("__base"), each)
    z = z.select(*[F.col("__s.y")[c].alias(c) if c in CLIMATE else F.col(c) for c in cols], F.col("__s.scenario").alias("scenario"),
                 F.col("__s.y")["predicted_yield"].alias("predicted_yield"), "__base")
    z = z.withColumn("change_pct", X.pct_change("predicted_yield", "__base")).drop("__base")
    return z, worst_change(z, key)


def merge_results(keys: DataFrame, key: str, sources: Sequence[tuple[DataFrame, dict]], defaults: dict) -> DataFrame:
    """Per output field, the first source that has it, then a default.

    ``sources`` = [(frame keyed by ``key``, {out_field: source column}), ...]
    in priority order; ``defaults`` = {out_field: Column or value} and may
    refer to columns of ``keys``.
    """
    j = keys
    cols = {}
    for i, (src, mapping) in enumerate(sources):
        sel = [F.col(key)] + [F.col(c).alias(f"__s{i}_{f}") for f, c in mapping.items()]
        j = join_keyed(j, src.select(*sel), key, "left")
        for f in mapping:
            cols.setdefault(f, []).append(F.col(f"__s{i}_{f}"))
    out = [F.col(key)]
    for f, d in defaults.items():
        dv = d if hasattr(d, "alias") else F.lit(d)
        out.append(F.coalesce(*cols.get(f, []), dv).alias(f))
    return j.select(*out)
