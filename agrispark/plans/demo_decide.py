"""Registered decision and quality queries: F7, J8, A19, X5, X19, X22, X23, X27,
ML10 - ML12, ML14, Q1 - Q7.

Rows are customers with climate features derived from their keys and
balances; "model probabilities" are a fixed formula per (row, class) so the
SQL twin can reproduce them exactly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views as V
from .decide import (classify_with_constraints, linear_yield, merge_results, recommend_hybrid, recommend_zone,
                     renormalise_top, simulate_climate_risk)
from .registry import register
from .rules import CROP_BANDS, SCENARIOS, ZONE_CROPS, band_rules, band_rules_sql, zone_rules, zone_rules_sql
from .util import bround, round_doubles
from ..functions import scalar as X
from ..operators import quality as Q
from ..operators.aggregates import label_centroids, quantile_thresholds, worst_change
from ..operators.filters import allowed_labels
from ..operators.joins import apply_scenarios, bounded_broadcast, collect_bounded, join_keyed

CLASSES = sorted({c for cs in ZONE_CROPS.values() for c in cs} | set(CROP_BANDS))


def climate_rows(spark, sf):
    c = V.read(spark, sf, "customer").select("c_custkey", "c_acctbal")
    k = F.col("c_custkey")
    return c.select("c_custkey",
                    (F.lit(5.0) + (k % 35).cast("double")).alias("temperature"),
                    (F.abs(F.col("c_acctbal")) / 3.0).alias("rainfall"),
                    (F.lit(30.0) + (k % 60).cast("double")).alias("humidity"),
                    ((k % 100).cast("double") + 2.0).alias("N"),
                    (k % 90).cast("double").alias("P"),
                    ((k % 61).cast("double") + 5.0).alias("K"))


ROWS_SQL = """
r AS (SELECT c_custkey, 5.0 + CAST(c_custkey % 35 AS DOUBLE) AS temperature, abs(c_acctbal) / 3.0 AS rainfall,
             30.0 + CAST(c_custkey % 60 AS DOUBLE) AS humidity, CAST(c_custkey % 100 AS DOUBLE) + 2.0 AS N,
             CAST(c_custkey % 90 AS DOUBLE) AS P, CAST(c_custkey % 61 AS DOUBLE) + 5.0 AS K FROM customer)"""


def fixed_scores(spark, sf, classes=None):
    """Long (c_custkey, label, p) with p = ((key * (k + 7)) % 13) / 12 for class index k."""
    classes = classes or CLASSES
    c = V.read(spark, sf, "customer").select("c_custkey")
    arr = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(lab).alias("label")) for i, lab in enumerate(classes)])
    x = c.select("c_custkey", F.inline(arr))
    return x.select("c_custkey", "label",
                    ((F.col("c_custkey") * (F.col("k") + 7)) % 13).cast("double").alias("__p")).select(
        "c_custkey", "label", (F.col("__p") / 12.0).alias("p"))


def _scores_sql(classes=None):
    classes = classes or CLASSES
    vals = ", ".join(f"({i}, '{lab}')" for i, lab in enumerate(classes))
    return (f"sc AS (SELECT c_custkey, label, CAST((c_custkey * (k + 7)) % 13 AS DOUBLE) / 12.0 AS p "
            f"FROM customer CROSS JOIN (VALUES {vals}) t(k, label))")


ZONE_SQL = "CASE WHEN rainfall IS NULL THEN 'tropical' WHEN rainfall < 250 THEN 'arid' " \
           "WHEN rainfall <= 800 THEN 'temperate' ELSE 'tropical' END"

WEIGHT_SQL = """CASE WHEN b.tmin IS NULL THEN 1.0
            WHEN temperature < b.tmin - 5 OR temperature > b.tmax + 5 THEN 0.0
            WHEN rainfall < b.rmin - 300 OR rainfall > b.rmax + 300 THEN 0.0
            WHEN temperature < b.tmin OR temperature > b.tmax THEN 0.45
            WHEN rainfall < b.rmin OR rainfall > b.rmax THEN 0.45 ELSE 1.0 END"""

F7_SQL = f"""{ROWS_SQL},
{_scores_sql()},
z AS (SELECT *, {ZONE_SQL} AS region_type FROM r),
j AS (SELECT sc.c_custkey, sc.label, sc.p, z.temperature, z.rainfall, z.humidity, z.region_type,
             zr.crop IS NOT NULL AS allowed
      FROM sc JOIN z ON sc.c_custkey = z.c_custkey
      LEFT JOIN {zone_rules_sql()} zr ON zr.zone = z.region_type AND zr.crop = lower(sc.label)),
f AS (SELECT *, NOT bool_or(allowed) OVER (PARTITION BY c_custkey) AS fallback FROM j),
g AS (SELECT * FROM f WHERE allowed OR fallback)"""


@register("F7_allowed_labels", "WITH " + F7_SQL + " SELECT c_custkey, label, p, region_type, allowed, fallback FROM g")
def q_f7(spark, sf):
    rows = climate_rows(spark, sf).withColumn("region_type", X.climate_zone("rainfall", "tropical"))
    s = join_keyed(fixed_scores(spark, sf), rows.select("c_custkey", "region_type"), "c_custkey")
    out = allowed_labels(s, zone_rules(spark), "c_custkey", "label", "region_type")
    return out.select("c_custkey", "label", "p", "region_type", "allowed", "fallback")


@register("X5_climate_weight", f"""
WITH {ROWS_SQL},
{_scores_sql()}
SELECT sc.c_custkey, sc.label, ({WEIGHT_SQL})::DOUBLE AS weight
FROM sc JOIN r ON sc.c_custkey = r.c_custkey LEFT JOIN {band_rules_sql()} b ON lower(sc.label) = lower(b.crop)
""")
def q_x5(spark, sf):
    rows = climate_rows(spark, sf)
    b = band_rules(spark).select(F.lower("crop").alias("__rc"), "tmin", "tmax", "rmin", "rmax")
    s = join_keyed(fixed_scores(spark, sf), rows, "c_custkey")
    j = s.join(bounded_broadcast(b, what="band rules"), F.lower("label") == F.col("__rc"), "left")
    return j.select("c_custkey", "label",
                    X.climate_weight("temperature", "rainfall", "tmin", "tmax", "rmin", "rmax").alias("weight"))


ML11_SQL = "WITH " + F7_SQL + f""",
w AS (SELECT g.*, CASE WHEN fallback THEN p
                  ELSE p * ({WEIGHT_SQL}) * (CASE WHEN lower(label) = 'rice' AND rainfall > 1200 THEN 1.2 ELSE 1.0 END)
                  END AS score
      FROM g LEFT JOIN {band_rules_sql()} b ON lower(g.label) = lower(b.crop)),
rk AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, p DESC, label) AS rank FROM w),
t AS (SELECT * FROM rk WHERE rank <= 3),
u AS (SELECT *, sum(score) OVER (PARTITION BY c_custkey) AS total,
             max(CASE WHEN rank = 1 THEN score END) OVER (PARTITION BY c_custkey) AS top,
             max(CASE WHEN rank = 1 THEN label END) OVER (PARTITION BY c_custkey) AS top_label FROM t)
SELECT c_custkey, CAST(rank AS INTEGER) AS rank, label, round(score, 9) AS score,
       round(score / CASE WHEN total = 0 THEN 1.0 ELSE total END, 9) AS confidence,
       CASE WHEN coalesce(top, 0.0) > 0.6 THEN 'low' WHEN coalesce(top, 0.0) >= 0.4 THEN 'medium' ELSE 'high' END
         AS risk_level,
       region_type, round(temperature * 0.4 + humidity * 0.3 + rainfall * 0.3, 9) AS climate_score,
       CAST(trunc(greatest(0.0, 100.0 - least(abs(temperature - 24.0) * 3.0, 50.0)
                                   - least(abs(rainfall - 900.0) / 25.0, 50.0))) AS INTEGER) AS weather_score,
       CASE WHEN top_label IS NULL THEN 'No crop recommendation'
            ELSE 'Ideal for ' || upper(substr(top_label, 1, 1)) || lower(substr(top_label, 2))
                 || ' due to moderate rainfall' END AS summary,
       CASE WHEN rainfall < 300 THEN 'Low rainfall' ELSE '' END AS warnings, fallback
FROM u"""


def ml11(spark, sf):
    return classify_with_constraints(climate_rows(spark, sf), fixed_scores(spark, sf), zone_rules(spark),
                                     band_rules(spark), "c_custkey")


@register("ML11_classify_with_constraints", ML11_SQL)
def q_ml11(spark, sf):
    return round_doubles(ml11(spark, sf), 9)


@register("X22_insight_text", "WITH base AS (" + ML11_SQL + ") SELECT c_custkey, summary, warnings FROM base "
          "WHERE rank = 1")
def q_x22(spark, sf):
    return ml11(spark, sf).where(F.col("rank") == 1).select("c_custkey", "summary", "warnings")


ML12_SQL = "WITH " + F7_SQL + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY p DESC, label) AS rank FROM g)
SELECT c_custkey, CAST(rank AS INTEGER) AS rank, label, p, region_type, fallback FROM rk WHERE rank <= 3"""


def ml12(spark, sf):
    return recommend_zone(climate_rows(spark, sf), fixed_scores(spark, sf), zone_rules(spark), "c_custkey")


@register("ML12_recommend_zone", ML12_SQL)
def q_ml12(spark, sf):
    return ml12(spark, sf)


@register("X19_renormalise", "WITH base AS (" + ML12_SQL + """)
SELECT c_custkey, rank, label,
       round(p / CASE WHEN sum(p) OVER (PARTITION BY c_custkey) = 0 THEN 1.0
                      ELSE sum(p) OVER (PARTITION BY c_custkey) END, 9) AS share FROM base""")
def q_x19(spark, sf):
    out = renormalise_top(ml12(spark, sf), "c_custkey", "p", "share")
    return round_doubles(out.select("c_custkey", "rank", "label", "share"), 9)


@register("X27_merge_results", "WITH a AS (" + ML11_SQL + "), b AS (" + ML12_SQL + f"""),
{ROWS_SQL}
SELECT r.c_custkey,
       coalesce(CASE WHEN r.temperature <= 35 THEN a.risk_level END, 'high') AS risk_level,
       coalesce(CASE WHEN r.temperature <= 35 THEN a.region_type END,
                CASE WHEN r.rainfall < 250 THEN 'arid' WHEN r.rainfall <= 800 THEN 'temperate' ELSE 'tropical' END)
         AS region_type,
       coalesce(CASE WHEN r.rainfall >= 300 THEN b.label END, CASE WHEN r.temperature <= 35 THEN a.label END, '')
         AS top_crop
FROM r LEFT JOIN (SELECT * FROM a WHERE rank = 1) a ON r.c_custkey = a.c_custkey
LEFT JOIN (SELECT * FROM b WHERE rank = 1) b ON r.c_custkey = b.c_custkey
""")
def q_x27(spark, sf):
    rows = climate_rows(spark, sf).select("c_custkey", "rainfall", "temperature")
    # each upstream result is missing for part of the rows (a source that did not answer)
    a = join_keyed(ml11(spark, sf).where(F.col("rank") == 1), rows.where(F.col("temperature") <= 35).select("c_custkey"), "c_custkey", "left_semi")
    b = join_keyed(ml12(spark, sf).where(F.col("rank") == 1), rows.where(F.col("rainfall") >= 300).select("c_custkey"), "c_custkey", "left_semi")
    return merge_results(rows, "c_custkey",
                         [(b, {"top_crop": "label"}),
                          (a, {"risk_level": "risk_level", "region_type": "region_type", "top_crop": "label"})],
                         {"risk_level": "high", "region_type": X.climate_zone("rainfall", "tropical"),
                          "top_crop": ""})


HYBRID_FEATS = ["N", "P", "K", "temperature", "humidity"]
ADVICE_FEATS = ["N", "P", "K", "rainfall", "temperature"]


def ml10(spark, sf):
    soil = V.soil(spark, sf)
    classes = sorted(r[0] for r in collect_bounded(soil.select("label").distinct(), 10_000, "class list"))
    scores = fixed_scores(spark, sf, classes)
    cents = label_centroids(soil, "label", HYBRID_FEATS)
    th = collect_bounded(quantile_thresholds(soil, ADVICE_FEATS), 64, "thresholds")
    return recommend_hybrid(climate_rows(spark, sf), scores, cents, th, HYBRID_FEATS, "c_custkey")


def _ml10_sql():
    adv_parts = []
    for n in ("N", "P", "K"):
        adv_parts.append(f"CASE WHEN r.{n} < lo_{n} THEN 'increase {n}' WHEN r.{n} > hi_{n} THEN 'reduce {n}' END")
    adv_parts.append("CASE WHEN r.rainfall < lo_rainfall THEN 'consider irrigation / moisture retention' "
                     "WHEN r.rainfall > hi_rainfall THEN 'consider drainage / split fertilizer applications' END")
    adv_parts.append("CASE WHEN r.temperature < lo_temperature THEN 'use cold-tolerant practices' "
                     "WHEN r.temperature > hi_temperature THEN 'use heat-stress mitigation practices' END")
    acts = "concat_ws('; ', " + ", ".join(adv_parts) + ")"
    th = ", ".join(f"quantile_cont({f}, 0.25) AS lo_{f}, quantile_cont({f}, 0.75) AS hi_{f}" for f in ADVICE_FEATS)
    return f"""
WITH {ROWS_SQL},
cls AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k FROM (SELECT DISTINCT label FROM soil)),
sc AS (SELECT c_custkey, label, CAST((c_custkey * (k + 7)) % 13 AS DOUBLE) / 12.0 AS p FROM customer CROSS JOIN cls),
best AS (SELECT c_custkey, arg_min(label, struct_pack(a := -p, b := label)) AS best_label, max(p) AS best_p
         FROM sc GROUP BY 1),
cent AS (SELECT label, avg(N) AS cN, avg(P) AS cP, avg(K) AS cK, avg(temperature) AS cT, avg(humidity) AS cH
         FROM soil GROUP BY label),
d AS (SELECT c_custkey, label, sqrt((N - cN) * (N - cN) + (P - cP) * (P - cP) + (K - cK) * (K - cK)
                                    + (temperature - cT) * (temperature - cT) + (humidity - cH) * (humidity - cH)) AS dist
      FROM r CROSS JOIN cent),
nn AS (SELECT c_custkey, arg_min(label, struct_pack(a := round(dist, 9), b := label)) AS rule_label,
              min(dist) AS rule_distance FROM d GROUP BY 1),
th AS (SELECT {th} FROM soil)
SELECT r.c_custkey,
       CASE WHEN best_p IS NULL OR best_p < 0.4 THEN rule_label ELSE best_label END AS best_crop,
       CASE WHEN best_p IS NULL OR best_p < 0.4 THEN 'rule_based' ELSE 'trained_model' END AS selection,
       best_label AS model_prediction, round(best_p, 9) AS model_confidence, rule_label AS rule_prediction,
       round(rule_distance, 6) AS rule_distance,
       CASE WHEN {acts} = '' THEN 'Maintain balanced NPK; apply fertilizer based on soil test and local guidelines.'
            ELSE 'Fertilizer suggestion: ' || {acts} || '.' END AS fertilizer_suggestion
FROM r JOIN nn ON r.c_custkey = nn.c_custkey LEFT JOIN best ON r.c_custkey = best.c_custkey CROSS JOIN th
"""


@register("ML10_recommend_hybrid", _ml10_sql(), views=("soil",))
def q_ml10(spark, sf):
    out = ml10(spark, sf)
    return out.withColumns({"model_confidence": bround("model_confidence", 9),
                            "rule_distance": bround("rule_distance", 6)})


@register("X23_confidence_gate", "WITH base AS (" + _ml10_sql() + ") SELECT c_custkey, best_crop, selection FROM base",
          views=("soil",))
def q_x23(spark, sf):
    return ml10(spark, sf).select("c_custkey", "best_crop", "selection")


YIELD_COEFS = {"temperature": 0.03, "rainfall": 0.001, "humidity": 0.01}
YIELD_INTERCEPT = 2.0


def _predict(df):
    return df.withColumn("prediction", linear_yield(YIELD_COEFS, YIELD_INTERCEPT))


def _scen_sql():
    vals = ", ".join(f"('{n}', {float(dt)}, {float(fr)}, {float(fh)}, {'NULL' if fl is None else float(fl)})"
                     for n, dt, fr, fh, fl in SCENARIOS)
    return f"""
sce AS (SELECT * FROM (VALUES {vals}) t(scenario, d_temp, f_rain, f_hum, hum_floor)),
x AS (SELECT c_custkey, scenario, temperature + d_temp AS temperature, rainfall * f_rain AS rainfall,
             CASE WHEN hum_floor IS NULL THEN humidity ELSE greatest(hum_floor, humidity * f_hum) END AS humidity
      FROM r CROSS JOIN sce),
y AS (SELECT *, greatest(0.0, 2.0 + 0.03 * temperature + 0.001 * rainfall + 0.01 * humidity) AS predicted_yield FROM x),
z AS (SELECT y.*, CASE WHEN b.base = 0 THEN 0.0 ELSE (predicted_yield - b.base) / b.base * 100.0 END AS change_pct
      FROM y JOIN (SELECT c_custkey, predicted_yield AS base FROM y WHERE scenario = 'baseline') b
        ON y.c_custkey = b.c_custkey)"""


@register("J8_apply_scenarios", f"""
WITH {ROWS_SQL}, {_scen_sql()}
SELECT c_custkey, scenario, round(temperature, 9) AS temperature, round(rainfall, 9) AS rainfall,
       round(humidity, 9) AS humidity FROM x
""")
def q_j8(spark, sf):
    rows = climate_rows(spark, sf).select("c_custkey", "temperature", "rainfall", "humidity")
    out = apply_scenarios(rows, SCENARIOS)
    return round_doubles(out.select("c_custkey", "scenario", "temperature", "rainfall", "humidity"), 9)


@register("ML14_simulate_climate_risk", f"""
WITH {ROWS_SQL}, {_scen_sql()}
SELECT c_custkey, scenario, round(predicted_yield, 9) AS predicted_yield, round(change_pct, 9) + 0.0 AS change_pct FROM z
""")
def q_ml14(spark, sf):
    rows = climate_rows(spark, sf).select("c_custkey", "temperature", "rainfall", "humidity")
    z, _ = simulate_climate_risk(rows, "c_custkey", SCENARIOS, _predict)
    return round_doubles(z.select("c_custkey", "scenario", "predicted_yield", "change_pct"), 9)


@register("A19_worst_change", f"""
WITH {ROWS_SQL}, {_scen_sql()}
SELECT c_custkey, round(min(change_pct), 9) AS worst_change,
       CASE WHEN min(change_pct) <= -25 THEN 'high' WHEN min(change_pct) <= -10 THEN 'medium' ELSE 'low' END
         AS risk_level
FROM z GROUP BY c_custkey
""")
def q_a19(spark, sf):
    rows = climate_rows(spark, sf).select("c_custkey", "temperature", "rainfall", "humidity")
    z, _ = simulate_climate_risk(rows, "c_custkey", SCENARIOS, _predict)
    return round_doubles(worst_change(z, "c_custkey"), 9)


# --------------------------------------------------------------------------
# Quality
# --------------------------------------------------------------------------

@register("Q1_assert_no_nulls", """
SELECT count(*) FILTER (WHERE humidity IS NULL) + count(*) FILTER (WHERE N IS NULL)
     + count(*) FILTER (WHERE P IS NULL) + count(*) FILTER (WHERE K IS NULL) AS total_missing,
       count(*) FILTER (WHERE humidity IS NULL) + count(*) FILTER (WHERE N IS NULL)
     + count(*) FILTER (WHERE P IS NULL) + count(*) FILTER (WHERE K IS NULL) = 0 AS passed
FROM places
""", views=("places",))
def q_q1(spark, sf):
    return Q.assert_no_nulls(V.places(spark, sf), ["humidity", "N", "P", "K"])


def doc_frame(spark, sf):
    d = V.read(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lab = V.read(spark, sf, "labels")
    return d.join(lab, "doc_id", "left")


Q2_TEXT = ["text", "lang", "source"]
Q2_NUM = ["n_chars", "toxic"]
Q2_CATEGORIES = ["lang", "source", "quality"]


def _q2_sql():
    parts = []
    for c in Q2_TEXT:
        parts.append(f"""
SELECT 'single_value' AS "check", '{c}' AS "column", CAST(count(DISTINCT {c}) AS DOUBLE) AS metric,
       count(DISTINCT {c}) > 1 AS passed FROM d
UNION ALL SELECT 'mixed_nulls', '{c}', CAST(count(*) FILTER (WHERE lower(trim({c})) IN ('null', 'nan', '')) AS DOUBLE),
       count(*) FILTER (WHERE lower(trim({c})) IN ('null', 'nan', '')) = 0 FROM d
UNION ALL SELECT 'special_characters', '{c}',
       round(coalesce(avg(CASE WHEN {c} IS NOT NULL THEN CASE WHEN regexp_matches({c}, '[\\p{{L}}\\p{{N}}]') THEN 0.0 ELSE 1.0 END END), 0.0), 6),
       coalesce(avg(CASE WHEN {c} IS NOT NULL THEN CASE WHEN regexp_matches({c}, '[\\p{{L}}\\p{{N}}]') THEN 0.0 ELSE 1.0 END END), 0.0) < 0.1 FROM d
UNION ALL SELECT 'string_variants', '{c}', CAST(count(DISTINCT {c}) - count(DISTINCT lower(trim({c}))) AS DOUBLE),
       count(DISTINCT {c}) = count(DISTINCT lower(trim({c}))) FROM d""")
    for j, c in enumerate(Q2_NUM):
        parts.append(f"""
SELECT 'single_value', '{c}', CAST(count(DISTINCT {c}) AS DOUBLE), count(DISTINCT {c}) > 1 FROM d
UNION ALL SELECT 'feature_label_correlation', '{c}', round(abs(coalesce(corr(CAST({c} AS DOUBLE), CAST(quality AS DOUBLE)), 0.0)), 6),
       abs(coalesce(corr(CAST({c} AS DOUBLE), CAST(quality AS DOUBLE)), 0.0)) < 0.95 FROM d""")
        for c2 in Q2_NUM[j + 1:]:
            parts.append(f"""
SELECT 'feature_feature_correlation', '{c}|{c2}', round(abs(coalesce(corr(CAST({c} AS DOUBLE), CAST({c2} AS DOUBLE)), 0.0)), 6),
       abs(coalesce(corr(CAST({c} AS DOUBLE), CAST({c2} AS DOUBLE)), 0.0)) < 0.95 FROM d""")
    parts.append("""
SELECT 'duplicate_rows', 'text', CAST(coalesce(sum(n - 1), 0) AS DOUBLE), coalesce(sum(n - 1), 0) = 0
FROM (SELECT text, count(*) AS n, count(DISTINCT quality) AS nl FROM d GROUP BY text)
UNION ALL SELECT 'conflicting_labels', 'quality', CAST(count(*) FILTER (WHERE nl > 1) AS DOUBLE),
       count(*) FILTER (WHERE nl > 1) = 0
FROM (SELECT text, count(*) AS n, count(DISTINCT quality) AS nl FROM d GROUP BY text)""")
    for c in Q2_TEXT:
        parts.append(f"""
SELECT 'length_outliers', '{c}', round(coalesce(avg(CASE WHEN {c} IS NOT NULL THEN
         CASE WHEN length({c}) < q1 - 1.5 * (q3 - q1) OR length({c}) > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END END), 0.0), 6),
       coalesce(avg(CASE WHEN {c} IS NOT NULL THEN
         CASE WHEN length({c}) < q1 - 1.5 * (q3 - q1) OR length({c}) > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END END), 0.0) < 0.05
FROM d CROSS JOIN (SELECT quantile_cont(CAST(length({c}) AS DOUBLE), 0.25) AS q1,
                          quantile_cont(CAST(length({c}) AS DOUBLE), 0.75) AS q3 FROM d)""")
    for c in Q2_TEXT:
        parts.append(f"""
SELECT 'mixed_types', '{c}', round(coalesce(odd, 0.0), 6), coalesce(odd, 0.0) < 0.01
FROM (SELECT (nn + nd + nw - greatest(nn, nd, nw)) / nullif(CAST(nn + nd + nw AS DOUBLE), 0) AS odd
      FROM (SELECT nn, nd, n - nn - nd - nb AS nw
            FROM (SELECT count({c}) AS n, count(*) FILTER (WHERE regexp_matches({c}, '{Q.NUMBER_LIKE}')) AS nn,
                         count(*) FILTER (WHERE regexp_matches({c}, '{Q.DATE_LIKE}')) AS nd, count(*) FILTER (WHERE trim({c}) = '') AS nb FROM d)))""")
    for i, a in enumerate(Q2_CATEGORIES):
        for b in Q2_CATEGORIES[i + 1:]:
            parts.append(f"""
SELECT 'association', '{a}|{b}', round(v, 6), v < 0.95
FROM (SELECT CASE WHEN least(max(ka), max(kb)) > 1 THEN sqrt(greatest(sum(n * n / (CAST(na AS DOUBLE) * nb)) - 1, 0.0) / (least(max(ka), max(kb)) - 1)) ELSE 0.0 END AS v
      FROM (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb,
                   (SELECT count(DISTINCT {a}) FROM d WHERE {b} IS NOT NULL) AS ka, (SELECT count(DISTINCT {b}) FROM d WHERE {a} IS NOT NULL) AS kb
            FROM (SELECT {a} AS a, {b} AS b, count(*) AS n FROM d WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL)))""")
    return ("WITH d AS (SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM documents "
            "LEFT JOIN labels USING (doc_id))\n" + "\nUNION ALL".join(parts))


@register("Q2_integrity_report", _q2_sql())
def q_q2(spark, sf):
    rep = Q.integrity_report(doc_frame(spark, sf), Q2_TEXT, label="quality", numeric_cols=Q2_NUM, dup_cols=["text"], categorical_cols=Q2_CATEGORIES)
    return rep.withColumn("metric", bround("metric", 6))


@register("Q3_min_classes", "SELECT count(DISTINCT p_type) AS n_classes, count(DISTINCT p_type) >= 5 AS passed "
          "FROM part")
def q_q3(spark, sf):
    return Q.min_classes(V.read(spark, sf, "part"), "p_type", 5)


@register("Q4_min_history", """
WITH s AS (SELECT series_key, count(*) AS n FROM (
    SELECT series_key, month FROM (
      SELECT series_key, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH))
             AS DATE) AS month
      FROM (SELECT series_key, min(CAST(date_trunc('month', obs_date) AS DATE)) AS lo,
                   max(CAST(date_trunc('month', obs_date) AS DATE)) AS hi FROM series_raw GROUP BY 1)))
  GROUP BY 1)
SELECT series_key, CAST(floor(n * 0.8) AS BIGINT) AS n_train, CAST(n - floor(n * 0.8) AS BIGINT) AS n_test,
       floor(n * 0.8) >= 24 AND n - floor(n * 0.8) >= 6 AS passed FROM s
""", views=("series_raw",))
def q_q4(spark, sf):
    from .demo_series import split
    return Q.min_history(split(spark, sf), "series_key", "split")


@register("Q5_non_empty", """
SELECT count(*) AS n_rows, count(*) > 0 AS passed FROM weather WHERE humidity > 80
""", views=("weather",))
def q_q5(spark, sf):
    w = V.weather(spark, sf).where(F.col("humidity") > 80)
    Q.require_non_empty(w, "humid snapshots")
    return w.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("passed", F.col("n_rows") > 0)


@register("Q6_forbidden_label_check", f"""
WITH {ROWS_SQL}, {_scores_sql()},
z AS (SELECT *, {ZONE_SQL} AS region_type FROM r)
SELECT region_type, label, count(*) AS n_violations
FROM sc JOIN z ON sc.c_custkey = z.c_custkey
WHERE NOT EXISTS (SELECT 1 FROM {zone_rules_sql()} zr WHERE zr.zone = z.region_type AND zr.crop = lower(sc.label))
GROUP BY ALL
""")
def q_q6(spark, sf):
    rows = climate_rows(spark, sf).withColumn("region_type", X.climate_zone("rainfall", "tropical"))
    raw = join_keyed(fixed_scores(spark, sf), rows.select("c_custkey", "region_type"), "c_custkey").withColumn("fallback", F.lit(False))
    return Q.forbidden_label_check(raw, "region_type", "label", zone_rules(spark))


@register("Q7_reject_counts", """
SELECT step, rule, rows_in, rows_out, rows_in - rows_out AS rejected FROM (
  SELECT 1 AS step, 'country present' AS rule, count(*) AS rows_in,
         count(*) FILTER (WHERE trim(country) <> '') AS rows_out FROM obs
  UNION ALL SELECT 2, 'temperature >= 2', count(*) FILTER (WHERE trim(country) <> ''),
         count(*) FILTER (WHERE trim(country) <> '' AND temperature >= 2) FROM obs
  UNION ALL SELECT 3, 'rainfall below 2000', count(*) FILTER (WHERE trim(country) <> '' AND temperature >= 2),
         count(*) FILTER (WHERE trim(country) <> '' AND temperature >= 2 AND rainfall < 2000) FROM obs
  UNION ALL SELECT 4, 'yield positive',
         count(*) FILTER (WHERE trim(country) <> '' AND temperature >= 2 AND rainfall < 2000),
         count(*) FILTER (WHERE trim(country) <> '' AND temperature >= 2 AND rainfall < 2000 AND crop_yield > 0.2)
  FROM obs)
""", views=("obs",))
def q_q7(spark, sf):
    o = V.obs(spark, sf)
    steps = [("country present", F.trim("country") != ""), ("temperature >= 2", F.col("temperature") >= 2),
             ("rainfall below 2000", F.col("rainfall") < 2000), ("yield positive", F.col("crop_yield") > 0.2)]
    return Q.reject_counts(o, steps)
