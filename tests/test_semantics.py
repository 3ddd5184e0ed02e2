"""Golden cases and edge cases (nulls, NaN, ties, defaults) per operator."""

import math

import pytest
from pyspark.sql import functions as F

from agrispark.functions import scalar as X
from agrispark.operators import aggregates as A
from agrispark.operators import features as M
from agrispark.operators import filters as FL
from agrispark.operators import joins as J
from agrispark.operators import quality as Q
from agrispark.operators import ranking as L
from agrispark.operators import schema as S
from agrispark.operators import windows as W
from agrispark.plans.decide import classify_with_constraints, recommend_zone
from agrispark.plans.rules import band_rules, zone_rules
from agrispark.sources.history import metrics_append


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()] if cols else [tuple(r) for r in df.collect()]


def final_plan(df):
    """The adaptive plan as it ran."""
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    return p.split("== Initial Plan ==")[0]


# --- zones and scores: the service's golden cases --------------------------------

@pytest.mark.parametrize("t,rain,hum,zone", [(30, 150, 40, "arid"), (27, 2300, 85, "tropical"),
                                             (12, 600, 76, "temperate")])
def test_zone_goldens(spark, t, rain, hum, zone):
    df = spark.createDataFrame([(t, float(rain), hum)], "t int, r double, h int")
    assert df.select(X.climate_zone("r")).first()[0] == zone


def test_zone_of_null_rain_is_a_choice(spark):
    df = spark.createDataFrame([(None,)], "r double")
    assert df.select(X.climate_zone("r")).first()[0] is None
    assert df.select(X.climate_zone("r", "tropical")).first()[0] == "tropical"
    assert df.select(X.climate_zone("r", "temperate")).first()[0] == "temperate"


def test_climate_score_golden(spark):
    df = spark.createDataFrame([(30.0, 40.0, 150.0)], "t double, h double, r double")
    assert math.isclose(df.select(X.climate_score("t", "h", "r")).first()[0], 69.0)


def test_weather_score_truncates(spark):
    df = spark.createDataFrame([(24.0, 900.0), (25.5, 900.0), (60.0, 5000.0)], "t double, r double")
    assert [r[0] for r in df.select(X.weather_score("t", "r")).collect()] == [100, 95, 0]


def test_coffee_absent_from_arid_and_temperate(spark):
    r = spark.createDataFrame([(1, 30.0, 150.0, 40.0), (2, 12.0, 600.0, 76.0)],
                              "id int, temperature double, rainfall double, humidity double")
    labels = ["coffee", "cotton", "maize", "rice", "millet"]
    sc = spark.createDataFrame([(i, lab, 0.9 if lab == "coffee" else 0.1) for i in (1, 2) for lab in labels],
                               "id int, label string, p double")
    out = classify_with_constraints(r, sc, zone_rules(spark), band_rules(spark), "id")
    assert "coffee" not in {x[0] for x in out.select("label").collect()}
    z = recommend_zone(r, sc, zone_rules(spark), "id")
    assert "coffee" not in {x[0] for x in z.select("label").collect()}
    viol = Q.forbidden_label_check(
        out.withColumnRenamed("region_type", "zone"), "zone", "label", zone_rules(spark))
    assert viol.count() == 0


def test_zone_filter_falls_back_when_nothing_survives(spark):
    r = spark.createDataFrame([(1, 30.0, 100.0, 40.0)], "id int, temperature double, rainfall double, humidity double")
    sc = spark.createDataFrame([(1, "coffee", 0.7), (1, "banana", 0.3)], "id int, label string, p double")
    out = classify_with_constraints(r, sc, zone_rules(spark), band_rules(spark), "id")
    got = rows(out.orderBy("rank"), "label", "fallback")
    assert got == [("coffee", True), ("banana", True)]


def test_all_weights_zero_gives_high_risk(spark):
    # cotton is allowed in arid, but 60 C is far outside its band -> weight 0
    r = spark.createDataFrame([(1, 60.0, 100.0, 40.0)], "id int, temperature double, rainfall double, humidity double")
    sc = spark.createDataFrame([(1, "cotton", 0.9)], "id int, label string, p double")
    out = classify_with_constraints(r, sc, zone_rules(spark), band_rules(spark), "id").first()
    assert out["score"] == 0.0 and out["confidence"] == 0.0 and out["risk_level"] == "high"


def test_every_label_of_a_row_gets_a_climate_weight(spark, tmp_path):
    """A label without a band weighs 1 and stays, in the query and its SQL twin; repeated keys meet each other."""
    import duckdb
    from agrispark.plans.demo_decide import CLASSES
    from agrispark.plans.registry import load_all
    x5 = load_all()["X5_climate_weight"]
    path = str(tmp_path / "customer.parquet")
    spark.createDataFrame([(20, -2400.0), (35, 0.0), (70, None), (41, 900.0), (41, 6000.0)], "c_custkey long, c_acctbal double").coalesce(1).write.parquet(path)
    got = rows(x5.fn(spark, str(tmp_path)), "c_custkey", "label", "weight")
    banded = {20: {"wheat": 1.0, "rice": 1.0, "cotton": 1.0, "maize": 1.0, "sugarcane": 1.0, "coffee": 0.0}}
    banded[35] = banded[70] = {"wheat": 0.45, "rice": 0.0, "cotton": 0.0, "maize": 0.0, "sugarcane": 0.0, "coffee": 0.0}
    for key, weights in banded.items():
        assert sorted(r[1:] for r in got if r[0] == key) == sorted({**dict.fromkeys(CLASSES, 1.0), **weights}.items())
    assert len(CLASSES) > 6 and len([r for r in got if r[0] == 41]) == 4 * len(CLASSES)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert sorted(got) == sorted(con.execute(x5.sql).fetchall())


# --- coercion, NaN and null keys ------------------------------------------------

def test_coerce_double_nan_and_junk(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("nan",), ("abc",), (None,)], "s string")
    assert [r[0] for r in df.select(X.coerce_double("s")).collect()] == [1.5, 2.0, None, None, None]


def test_coerce_timestamp_bad_is_null(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("nope",)], "s string")
    out = [r[0] for r in df.select(X.coerce_timestamp("s")).collect()]
    assert out[0] is not None and out[1] is None


def test_null_group_keys_dropped(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 5.0), ("A ", 3.0)], "k string, v double")
    assert sorted(rows(A.group_median(df, "k", ["v"]))) == [("a", 2.0)]


def test_median_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "v double")
    assert A.global_median(df, "v").first()[0] == 3.0


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "b"), ("g", "a")], "k string, v string")
    assert rows(A.group_mode(df, "k", "v")) == [("g", "a")]


def test_drop_null_rows_treats_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert FL.drop_null_rows(df, ["v"]).count() == 1


def test_fill_missing_columns_only_absent(spark):
    df = spark.createDataFrame([(None,)], "N double")
    out = S.fill_missing_columns(df, {"N": 0.0, "ph": 6.5}).first()
    assert out["N"] is None and out["ph"] == 6.5


def test_require_columns_names_all_missing(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        S.require_columns(df, ["a", "b", "c"])


def test_drop_unknown_column_is_error(spark):
    with pytest.raises(ValueError):
        S.drop_columns_strict(spark.createDataFrame([(1,)], "a int"), ["zz"])


# --- request contract ------------------------------------------------------------

def test_conform_rejects_unknown_and_missing(spark):
    df = spark.createDataFrame([('{"temperature": 1, "rainfall": 2, "humidity": 3}',),
                                ('{"temperature": 1, "rainfall": 2, "humidity": 3, "crop_type": "x"}',),
                                ("{}",), ("not json",)], "j string")
    f = [S.Field("temperature", required=True), S.Field("rainfall", required=True), S.Field("humidity", required=True)]
    out = rows(S.conform(df, "j", f), "accepted", "reason")
    assert out[0] == (True, None)
    assert out[1] == (False, "unknown field: crop_type")
    assert out[2] == (False, "temperature: required")
    assert out[3] == (False, "invalid json")


def test_conform_defaults_and_aliases(spark):
    df = spark.createDataFrame([('{"n": 10}',), ("{}",)], "j string")
    f = [S.Field("N", default=70.0, aliases=("n",)), S.Field("ph", default=6.5)]
    out = rows(S.conform(df, "j", f, extras="ignore"), "N", "ph", "accepted")
    assert out == [(10.0, 6.5, True), (70.0, 6.5, True)]


# --- windows -----------------------------------------------------------------------

def test_interpolation_by_position(spark):
    df = spark.createDataFrame([("s", 1, 1.0), ("s", 2, None), ("s", 3, None), ("s", 4, 4.0), ("s", 5, None)],
                               "k string, t int, v double")
    out = [r[0] for r in W.interpolate_linear(df, "k", "t", "v").orderBy("t").select("v").collect()]
    assert out == [1.0, 2.0, 3.0, 4.0, None]


def test_lag_and_rolling_min_periods(spark):
    df = spark.createDataFrame([("c", 1, 3.0), ("c", 2, 6.0), ("c", 3, 9.0), ("c", 4, 12.0)],
                               "k string, t int, v double")
    d = W.rolling_mean(W.lag_by(df, ["k"], ["t"], "v"), ["k"], ["t"], "v")
    got = rows(d.orderBy("t"), "v_lag1", "v_trend3")
    assert got == [(None, 3.0), (3.0, 4.5), (6.0, 6.0), (9.0, 9.0)]


def test_month_bucket_fills_every_month(spark):
    df = spark.createDataFrame([("s", "2020-01-15", 1.0), ("s", "2020-04-02", 4.0)], "k string, d string, v double")
    df = df.withColumn("d", F.to_date("d"))
    out = W.month_bucket(df, "k", "d", "v").orderBy("month")
    assert [r["value"] for r in out.collect()] == [1.0, None, None, 4.0]


def test_chrono_split_flags_short_series(spark):
    df = spark.range(20).select(F.lit("s").alias("k"), F.col("id").alias("t"))
    out = W.chrono_split(df, "k", "t")
    assert out.where("split = 'train'").count() == 16
    assert out.select("series_ok").distinct().first()[0] is False


def test_trailing_days_rejects_nonpositive(spark):
    with pytest.raises(ValueError):
        W.trailing_days(spark.range(1), "id", 0)


# --- splits, sampling, model choice ---------------------------------------------

def test_stratified_split_exact_counts_with_a_hot_class(spark):
    # one class holds 2/3 of the rows: counts must still be exact per class
    df = spark.range(3000).select(F.col("id").alias("key"),
                                  F.when(F.col("id") % 3 == 0, "small").otherwise("hot").alias("label"))
    out = M.stratified_split(df, "label", "key", 0.2, 42, buckets=64)
    got = dict(rows(out.where("dataset_split = 'train'").groupBy("label").count()))
    assert got == {"hot": 1600, "small": 800}
    ref = (df.withColumn("h", L.sample_key("key", 42))
             .withColumn("rn", F.row_number().over(
                 __import__("pyspark").sql.Window.partitionBy("label").orderBy("h", "key"))))
    n = {"hot": 2000, "small": 1000}
    exp = {r["key"] for r in ref.collect() if r["rn"] <= int(n[r["label"]] * 0.8)}
    assert {r["key"] for r in out.where("dataset_split = 'train'").collect()} == exp


def test_random_split_is_deterministic(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = rows(M.random_split(df, "k").orderBy("k"))
    b = rows(M.random_split(df, "k").orderBy("k"))
    assert a == b and 100 < sum(1 for r in a if r[1] == "test") < 300


def test_pick_best_model_goldens(spark):
    run1 = spark.createDataFrame([("forest", 4.6195, 0.9680, 0), ("linear", 15.3135, 0.6489, 1)],
                                 "model string, test_rmse double, test_r2 double, ordinal int")
    run2 = spark.createDataFrame([("forest", 9.6546, 0.8358, 0), ("linear", 8.8697, 0.8614, 1)],
                                 "model string, test_rmse double, test_r2 double, ordinal int")
    assert L.pick_best_model(run1).first()["model"] == "forest"
    assert L.pick_best_model(run2).first()["model"] == "linear"


def test_quantile_bins_edge_goes_up(spark):
    df = spark.createDataFrame([(float(v), "train") for v in range(1, 10)], "y double, dataset_split string")
    out = M.quantile_bins(df, "y", 3).orderBy("y")
    # tertile edges of 1..9 are 3.666.. and 6.333..
    assert [r["y_bin"] for r in out.collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_standardise_uses_population_std_and_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0, "train"), (3.0, 5.0, "train")], "a double, b double, dataset_split string")
    out = rows(M.standardise(df, ["a", "b"]), "a", "b")
    assert out == [(-1.0, 0.0), (1.0, 0.0)]


def test_one_hot_unseen_is_all_zero(spark):
    df = spark.createDataFrame([("x", "train"), ("y", "train"), ("z", "test"), (None, "test")],
                               "c string, dataset_split string")
    out = M.one_hot(df, ["c"])
    assert [c for c in out.columns if c.startswith("cat__")] == ["cat__c_x", "cat__c_y"]
    assert rows(out.where("dataset_split = 'test'"), "cat__c_x", "cat__c_y") == [(0.0, 0.0), (0.0, 0.0)]


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "y string")
    w = dict(rows(M.class_weights(df, "y").distinct(), "y", "weight"))
    assert w == {"a": 4 / 6, "b": 2.0}


# --- history, joins --------------------------------------------------------------

def test_metrics_history_keeps_newest_50(spark):
    snaps = spark.range(51).select(F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("generated_at"),
                                   F.lit("yield").alias("artifact"), F.lit("rmse").alias("metric"),
                                   F.col("id").cast("double").alias("value"))
    hist = snaps.where("value < 50")
    new = snaps.where("value = 50")
    kept = metrics_append(hist, new, keep=50)
    vals = sorted(r[0] for r in kept.select("value").collect())
    assert len(vals) == 50 and vals[0] == 1.0 and vals[-1] == 50.0
    assert metrics_append(None, new, keep=50).count() == 1
    more = spark.range(100, 109).select(F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("generated_at"),
                                        F.lit("yield").alias("artifact"), F.lit("rmse").alias("metric"), F.col("id").cast("double").alias("value"))
    assert metrics_append(snaps, more).count() == 60  # nothing goes unless the caller asks


def test_nearest_centroid_tie_goes_to_first_label(spark):
    cents = spark.createDataFrame([("b", 1.0), ("a", -1.0)], "label string, x double")
    r = spark.createDataFrame([(0, 0.0), (1, None)], "id int, x double")
    out = rows(J.nearest_centroid(r, cents, ["x"]).orderBy("id"), "rule_label", "rule_distance")
    assert out == [("a", 1.0), (None, None)]


def test_tiered_match_prefers_exact_then_prefix_then_contains(spark):
    places = spark.createDataFrame([(1, "Lahore", "Pakistan"), (2, "Lahore Cantt", "Pakistan"),
                                    (3, "Karachi", "Pakistan")], "ord int, name string, country string")
    q = spark.createDataFrame([(1, "lahore"), (2, "laho"), (3, "rach"), (4, "zzz"), (5, "pakistan")],
                              "qid int, q string")
    got = sorted(rows(J.tiered_match(q, places, "qid", "q", ["name", "country"], "ord")))
    assert got == [(1, 1, 1), (2, 2, 1), (3, 3, 3), (5, 1, 1)]


def test_apply_scenarios_fanout_and_floor(spark):
    from agrispark.plans.rules import SCENARIOS
    r = spark.createDataFrame([(1, 20.0, 100.0, 12.0)], "id int, temperature double, rainfall double, humidity double")
    out = {x["scenario"]: x for x in J.apply_scenarios(r, SCENARIOS).collect()}
    assert len(out) == 5
    assert out["drought_risk"]["humidity"] == 10.0 and math.isclose(out["drought_risk"]["rainfall"], 60.0)
    assert out["heatwave_risk"]["temperature"] == 24.0


def test_reject_counts_chain(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "")], "x int, s string")
    out = rows(Q.reject_counts(df, [("x present", F.col("x").isNotNull()), ("s not blank", F.trim("s") != "")]),
               "rows_in", "rows_out")
    assert out == [(3, 2), (2, 1)]


def test_guards_raise(spark):
    with pytest.raises(Q.DataQualityError):
        Q.require_non_empty(spark.range(0))
    with pytest.raises(Q.DataQualityError):
        Q.require_min_classes(spark.createDataFrame([("a",), ("b",)], "y string"), "y", 5)


# --- metadata helpers (no Spark job) ---------------------------------------------

def test_resolve_alias_and_renames(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "`Crop Type` int, Temperature double, rain double")
    assert S.resolve_alias(df, ["croptype", "crop_type"]) == "Crop Type"
    assert S.resolve_alias(df, ["yield"]) is None
    out = S.rename_aliases(df, {"crop_type": ["Crop Type"], "rainfall": ["rain", "precip"]})
    assert out.columns == ["crop_type", "Temperature", "rainfall"]
    assert S.rename_present(df, {"rain": "rainfall", "absent": "x"}).columns == ["Crop Type", "Temperature", "rainfall"]


def test_normalise_headers_label_to_crop_type(spark):
    df = spark.createDataFrame([(1, "x")], "` N ` int, Label string")
    assert S.normalise_headers(df).columns == ["n", "crop_type"]
    df2 = spark.createDataFrame([("a", "b")], "label string, crop_type string")
    assert S.normalise_headers(df2).columns == ["label", "crop_type"]


def test_infer_feature_kinds(spark):
    df = spark.createDataFrame([(1, 2.0, True, "x", "y")], "a int, b double, c boolean, d string, target string")
    assert S.infer_feature_kinds(df, "target") == (["a", "b", "c"], ["d"])


def test_scan_missing_file_and_first_available(spark, tmp_path):
    from agrispark.sources import files as SF
    with pytest.raises(FileNotFoundError):
        SF.scan_table(spark, str(tmp_path / "absent.parquet"))
    p = str(tmp_path / "present")
    spark.range(3).write.parquet(p)
    assert SF.first_available_source(spark, [str(tmp_path / "absent"), p]) == p
    with pytest.raises(FileNotFoundError):
        SF.first_available_source(spark, [str(tmp_path / "absent")])


def test_climatology_day_variant(spark):
    from agrispark.sources.jsonmaps import climatology_extract
    doc = '{"properties": {"parameter": {"T2M": {"20240101": 11.5}, "PRECTOTCORR": {"20240101": 2.0}}}}'
    df = spark.createDataFrame([(doc,)], "d string")
    c = climatology_extract(F.col("d"), [("T2M", "t", 25.0, 1.0), ("PRECTOTCORR", "r", 2.0, 365.0),
                                         ("RH2M", "h", 60.0, 1.0)], period="20240101")
    r = df.select(c.alias("c")).select("c.*").first()
    assert (r["t"], r["r"], r["h"]) == (11.5, 730.0, 60.0)


def test_streaming_frames_are_refused(spark):
    from agrispark.streaming import require_bounded
    s = spark.readStream.format("rate").load()
    with pytest.raises(ValueError):
        require_bounded(s)


@pytest.mark.parametrize("accuracy", [100_000, 1000, 100])
def test_exact_quantile_matches_percentile_with_a_hot_group(spark, accuracy):
    # group 0 holds two thirds of the rows, many duplicates; group 5 is all null; a null key is a group
    df = spark.range(6000).select((F.col("id") % 3).alias("k"), (F.rand(7) * 100).alias("v"))
    df = df.union(spark.range(6000).select(F.lit(0).cast("long").alias("k"), F.floor(F.rand(3) * 7).cast("double")))
    df = df.union(spark.createDataFrame([(5, None), (5, float("nan")), (6, 2.5), (7, 1.0), (7, 4.0), (None, 3.0), (8, float("inf")), (8, 1.0), (8, float("-inf"))], "k long, v double"))
    qs = [0.0, 0.5, 0.25, 1 / 3, 0.999, 1.0]
    got = {r[0]: r[1:] for r in rows(A.exact_quantiles(df, ["k"], "v", qs, accuracy=accuracy))}
    clean = df.where(~F.isnan("v") | F.col("v").isNull())
    want = {r[0]: r[1:] for r in rows(clean.groupBy("k").agg(*[F.percentile("v", F.lit(q)) for q in qs]))}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}


def test_exact_quantiles_read_the_rows_twice_for_any_number_of_quantiles(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(20000).select(F.lit("hot").alias("k"), F.rand(5).alias("v")).write.parquet(path)
    sketch = A._brackets(spark.read.parquet(path).select(F.struct("k").alias("__grp"), F.col("v").alias("__x")), [0.1, 0.5, 0.9], 1000)
    out = A.exact_quantiles(spark.read.parquet(path), ["k"], "v", [0.1, 0.5, 0.9])
    assert final_plan(sketch).count("FileScan parquet") == 1
    p = final_plan(out)
    assert p.count("ReadSchema: struct<k:string,v:double>") == 1 and "ReusedExchange" in p  # other scans are of the brackets


def test_measured_join_gives_the_same_rows_broadcast_or_salted(spark):
    fact = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    side = spark.createDataFrame([("hot", 1), ("k0", 2), ("k6", 3), ("unused", 4)], "k string, w int")
    for how in ("left", "inner", "left_semi"):
        right = side.select("k") if how == "left_semi" else side
        want = sorted(map(repr, rows(fact.join(right, ["k"], how))))
        assert sorted(map(repr, rows(J.join_measured(fact, right, ["k"], how)))) == want
        assert sorted(map(repr, rows(J.join_measured(fact, right, ["k"], how, limit=0, salts=4)))) == want


def test_rows_are_not_shuffled_on_their_label(spark, tmp_path):
    path = str(tmp_path / "fact")
    spark.range(5000).select("id", F.when(F.col("id") % 4 > 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 12)).alias("y")).write.parquet(path)
    fact = spark.read.parquet(path)
    priors = spark.createDataFrame([("HOT", 1.0), ("c0", 2.0)], "p string, m double")
    for df in (J.join_priors(fact, priors, "y", "p"), M.class_weights(fact, "y"), M.label_encode(fact, "y"), M.stratified_split(fact, "y", "id"),
               J.map_label(fact, "y", {"hot": 1}, "c")):
        p = final_plan(df)
        assert "BroadcastHashJoin" in p and "hashpartitioning" not in p and "SortMergeJoin" not in p


def test_first_k_equals_row_number_with_hot_null_and_small_groups(spark):
    from agrispark.operators.ranking import sample_key
    from pyspark.sql import Window
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 100 == 1, None).otherwise("b").alias("g"))
    df = df.union(spark.createDataFrame([(9001, "one"), (None, "none")], "id long, g string"))
    ks = spark.createDataFrame([("a", 700), ("b", 10**9), (None, 3), ("one", 1), ("none", 0)], "g string, k long")
    for buckets in (65536, 4):
        got = sorted(r[0] for r in rows(M.first_k_by_hash(df, "g", "id", ks, 3, buckets).where("__take"), "id"))
        rn = F.row_number().over(Window.partitionBy("g").orderBy(sample_key("id", 3), "id"))
        want = df.withColumn("rn", rn).join(ks.withColumnRenamed("g", "g2"), F.col("g").eqNullSafe(F.col("g2"))).where("rn <= k")
        assert got == sorted(r[0] for r in rows(want, "id"))


def test_five_thousand_classes(spark):
    df = spark.range(6000).select("id", F.format_string("c%05d", F.col("id") % 5000).alias("y"))
    assert rows(M.label_encode(df, "y").agg(F.max("y_encoded"), F.sum((F.col("y_encoded") == F.substring("y", 2, 5).cast("int")).cast("int")))) == [(4999, 6000)]
    m = {f"c{i:05d}": i for i in range(1, 5000)}
    assert rows(J.map_label(df, "y", m, "c").agg(F.count("c"), F.count("y"), F.max("c"))) == [(5998, 6000, 4999)]
    one = J.map_label(df.select("y", "id"), "y", m)
    assert one.columns == ["y", "id"] and one.schema["y"].dataType.simpleString() == "int"
    cents = df.where("id < 5000").select(F.col("y").alias("label"), F.col("id").cast("double").alias("x"), F.array(F.col("id").cast("double")).alias("centroid"))
    pts = spark.createDataFrame([(17.2,), (4999.0,), (None,), (2.5,)], "x double").withColumn("v", F.when(F.col("x").isNotNull(), F.array("x")))
    want = [("c00017",), ("c04999",), (None,), ("c00002",)]
    for block in (10_000, 700):
        assert rows(J.nearest_centroid(pts, cents, ["x"], block=block), "rule_label") == want
        assert rows(J.nearest_centroid_vec(pts, cents, "v", block=block), "rule_label") == want


def test_one_row_per_key_enters_the_place_join(spark):
    places = spark.range(2000).select(F.col("id").alias("ord"), F.concat(F.lit("a place "), F.col("id")).alias("name"))
    q = spark.range(50).select(F.col("id").alias("qid"), F.lit("a").alias("q"))
    out = J.tiered_match(q, places, "qid", "q", ["name"], "ord")
    assert sorted(rows(out)) == [(i, 2, 0) for i in range(50)]


def test_bounded_broadcast_refuses_large_tables(spark):
    from agrispark.operators.joins import bounded_broadcast
    assert bounded_broadcast(spark.range(10), max_rows=10).count() == 10
    with pytest.raises(ValueError):
        bounded_broadcast(spark.range(11), max_rows=10)


def test_binary_rounding_matches_the_sql_engine_at_ties(spark, duck):
    from agrispark.plans.util import bround
    vals = [2.675, 1069.9843875, 243062.6053125, -2.5e-7, 0.125, 1.0000005]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(bround("x", 6)).collect()]
    want = [duck.execute(f"SELECT round({v!r}::DOUBLE, 6)").fetchall()[0][0] for v in vals]
    assert [g + 0.0 for g in got] == [w + 0.0 for w in want]


# --- wrong readings put right ----------------------------------------------------

def test_trailing_days_takes_any_length(spark):
    df = spark.range(6000).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    assert W.trailing_days(df, "d", 5000).count() == 5000


def test_city_means_per_spelling(spark):
    df = spark.createDataFrame([("Lahore", 10.0, 1.0, 5.0), ("lahore", 30.0, 2.0, 5.0), ("lahore", None, 9.0, 9.0)],
                               "city string, t double, r double, h double")
    got = rows(A.annualised_city_mean(df, "city", "t", "r", "h"))
    assert got == [("lahore", "lahore", 30.0, 730.0, 5.0, 1)]


def test_regression_metrics_over_scored_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (100.0, None), (None, 5.0)], "actual double, prediction double")
    r = A.regression_metrics(df).first()
    assert (r["rmse"], r["r2"], r["n"]) == (1.0, 0.0, 2)


def test_calendar_parts_of_null(spark):
    df = spark.createDataFrame([(None,)], "d date")
    r = W.calendar_parts(df, "d").first()
    assert (r["month"], r["quarter"], r["year_of"]) == (1, 1, None)


def test_role_words(spark):
    roles = S.column_roles(["Month", "season", "State", "crop", "x"])
    assert roles["time"] == ["Month", "season"] and roles["location"] == ["State"]


def test_nearest_centroid_without_a_distance(spark):
    cents = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0]), ("c", None)], "label string, centroid array<double>")
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], "id int, v array<double>")
    assert rows(J.nearest_centroid_vec(df, cents, "v").orderBy("id"), "rule_label", "rule_distance") == [("b", 0.0), (None, None)]
    flat = spark.createDataFrame([("a", None), ("b", 4.0)], "label string, x double")
    one = spark.createDataFrame([(1.0,)], "x double")
    assert rows(J.nearest_centroid(one, flat, ["x"]), "rule_label") == [("b",)]


def test_text_in_any_script_is_text(spark):
    df = spark.createDataFrame([("\u043f\u0440\u0438\u0432\u0435\u0442",), ("!!!",)], "t string")
    got = {r["check"]: r["metric"] for r in Q.integrity_report(df, ["t"]).where("column = 't'").collect()}
    assert got["special_characters"] == 0.5


def test_a_cluster_must_name_its_shared_folder():
    from agrispark import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_class_measures_from_one_confusion_matrix(spark):
    """Hand-made: a null prediction counts for support but not for accuracy; the predictions are scanned once."""
    from agrispark.operators.aggregates import classification_metrics, classification_report, ordinal_label_rmse
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("b", None)], "actual string, predicted string")
    m = classification_metrics(df).first()
    assert m["accuracy"] == 0.5
    rep = {r["cls"]: r for r in classification_report(df).collect()}
    assert (rep["a"]["precision"], rep["a"]["recall"], rep["a"]["support"]) == (0.5, 0.5, 2)
    assert (rep["b"]["precision"], rep["b"]["recall"]) == (0.5, 0.5) and rep["c"]["f1"] == 0.0 and rep[None]["support"] == 0
    assert abs(m["f1_weighted"] - (0.5 * 2 + 0.5 * 2) / 5) < 1e-12
    assert abs(ordinal_label_rmse(df, ["a", "b", "c"]).first()[0] - ((0 + 1 + 0 + 4) / 4) ** 0.5) < 1e-12
    plan = classification_metrics(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
