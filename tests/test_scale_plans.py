"""Operators whose keys may be hot: the same rows as the plain way, and no task with a whole key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from agrispark.operators import joins as J
from agrispark.operators import windows as W


def _plain(df, keys, order):
    w = Window.partitionBy(*keys).orderBy(*order)
    nk = F.greatest(*[F.col(k).isNull().cast("int") for k in keys]) == 1
    return df.withColumns({"v_lag2": F.when(~nk, F.lag("v", 2).over(w)), "v_trend4": F.when(~nk, F.avg("v").over(w.rowsBetween(-3, 0)))})


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_windows_of_a_key_with_all_rows_are_cut_into_segments(spark):
    base = spark.range(3000).select(F.lit("x").alias("k"), F.lit("y").alias("c"), (F.col("id") * 7919 % 3000).alias("t"), F.when(F.col("id") % 11 > 0, F.col("id") % 13).cast("double").alias("v"))
    small = spark.range(40).select(F.when(F.col("id") % 4 > 0, F.concat(F.lit("s"), F.col("id") % 5)).alias("k"), F.lit("y").alias("c"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    df = base.unionByName(small)
    expect = _rows(_plain(df, ["k", "c"], ["t"]))
    for rows in (10, 100, 1000, 10**9):
        got = W.rolling_mean(W.lag_by(df, ["k", "c"], ["t"], "v", 2, segment_rows=rows), ["k", "c"], ["t"], "v", 4, segment_rows=rows)
        assert _rows(got) == expect, rows
    seg = W.segments(df, ["k", "c"], ["t"], -(-3040 * 2 // 400))
    largest = seg.groupBy("__seg").count().agg(F.max("count")).first()[0]
    assert largest <= 400  # no task gets more than a segment
    assert seg.where("k = 'x'").select("__seg").distinct().count() > 5


def test_segments_shorter_than_what_a_window_looks_back(spark):
    df = spark.range(60).select(F.lit("x").alias("k"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    got = W.look_back(df, ["k"], ["t"], 9, {"s": lambda w: F.sum("v").over(w.rowsBetween(-9, 0))}, segment_rows=4).orderBy("t").collect()
    assert [r["s"] for r in got] == [float(sum(range(max(0, i - 9), i + 1))) for i in range(60)]


def test_a_series_with_all_rows_is_filled_and_split_in_segments(spark):
    # gaps over whole segments, edges without a value, a series without any, one of one row, a null key
    hot = spark.range(2000).select(F.lit("x").alias("k"), (F.col("id") * 7919 % 2000).alias("t"))
    hot = hot.withColumn("v", F.when((F.col("t") > 30) & (F.col("t") < 1900) & ~F.col("t").between(500, 1100) & (F.col("t") % 5 == 0), F.col("t") * F.col("t") % 97).cast("double"))
    none = spark.range(50).select(F.lit("none").alias("k"), F.col("id").alias("t"), F.lit(None).cast("double").alias("v"))
    null = spark.range(40).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 7 == 3, F.col("id")).cast("double").alias("v"))
    df = hot.unionByName(none).unionByName(null).unionByName(spark.createDataFrame([("one", 3, 2.5)], "k string, t long, v double"))
    filled, split = _rows(W.interpolate_linear(df, "k", "t", "v", "f")), _rows(W.chrono_split(df, "k", "t"))
    assert sum("f=None" in r for r in filled) < len(filled) / 4
    for size in (60, 1500):
        assert _rows(W.interpolate_linear(df, "k", "t", "v", "f", segment_rows=size)) == filled, size
        assert _rows(W.chrono_split(df, "k", "t", segment_rows=size)) == split, size
    assert W.in_segments(df, "k", "t", 2000) is None
    seg = W.in_segments(df, "k", "t", 100, known="v")
    assert seg.groupBy("__seg").count().agg(F.max("count")).first()[0] <= 100
    dates = df.withColumn("t", F.date_add(F.lit("2000-01-01").cast("date"), F.col("t").cast("int")))
    assert W.in_segments(dates, "k", "t", 10) is None  # a row a date: never that long
    assert W.chrono_split(df.limit(0), "k", "t").count() == 0 and W.interpolate_linear(df.limit(0), "k", "t", "v").count() == 0


def test_tiered_match_equals_comparing_all_names(spark):
    rnd = random.Random(5)
    names = ["".join(rnd.choice("abAB é") for _ in range(rnd.randrange(0, 9))) for _ in range(200)] + [None, "springfield", "Spring", "new spring"]
    texts = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(0, 6))) for _ in range(150)] + [None, "", " spring ", "zzz", "abzzz", "a", "é"]
    places = spark.createDataFrame(list(enumerate(names)), "ord int, name string").withColumn("alt", F.reverse("name"))
    queries = spark.createDataFrame(list(enumerate(texts)), "q int, text string")
    expect = {}
    for i, t in enumerate(texts):
        hits = []
        for o, n in enumerate(names):
            for x in ([] if not n or t is None else [n.lower(), n[::-1].lower()]):
                key = t.strip(" ").lower()
                if key in x:
                    hits.append((1 if x == key else 2 if x.startswith(key) else 3, o))
        if hits:
            expect[i] = min(hits)
    got = {r["q"]: (r["tier"], r["ord"]) for r in J.tiered_match(queries, places, "q", "text", ["name", "alt"], "ord").collect()}
    assert got == expect
    assert J.tiered_match(queries.limit(0), places, "q", "text", ["name"], "ord").count() == 0


def test_tiered_match_verifies_only_names_with_the_rarest_gram(spark):
    names = [(i, "common town") for i in range(300)] + [(300, "common qxz town")]
    places = spark.createDataFrame(names, "ord int, name string")
    got = J.tiered_match(spark.createDataFrame([(1, "common qxz"), (2, "common"), (3, "mon tow"), (4, "common qqq")], "q int, text string"), places, "q", "text", ["name"], "ord")
    assert sorted(map(tuple, got.collect())) == [(1, 2, 300), (2, 2, 0), (3, 3, 0)]


def test_codes_of_many_labels_are_numbered_range_by_range(spark, capsys):
    from agrispark.operators import features as M
    rows = [(f"L{(i * 7919) % 5000:05d}é" if i % 17 else None,) for i in range(8000)]
    df = spark.createDataFrame(rows, "lab string").repartition(5)
    order = {v: i for i, v in enumerate(sorted({r[0] for r in rows} - {None}))}
    for small in (0, 10, 10_000):
        codes = M.sorted_codes(df, "lab", small)
        assert {r["lab"]: r["code"] for r in codes.collect()} == order
        codes.explain()
        assert "SinglePartition" not in capsys.readouterr().out
    got = M.label_encode(df, "lab").collect()
    assert len(got) == len(rows) and all(r["lab_encoded"] == (None if r["lab"] is None else order[r["lab"]]) for r in got)


def test_one_hot_of_a_million_categories_is_a_sparse_vector(spark):
    from agrispark.operators import features as M
    n = 1_000_000
    df = spark.range(n + 40).select(F.concat(F.lit("v"), F.lpad((F.col("id") % (n + 20)).cast("string"), 7, "0")).alias("c"), (F.col("id") % 3).cast("string").alias("d"),
                                    F.when(F.col("id") < n, "train").otherwise("test").alias("dataset_split"), F.col("id"))
    out = M.one_hot(df, ["c", "d"])
    assert [c for c in out.columns if c.startswith("cat__")] == ["cat__d_0", "cat__d_1", "cat__d_2", "cat__c"]
    rows = {r["id"]: r["cat__c"] for r in out.where(F.col("id").isin(0, 777_777, n - 1, n, n + 25)).select("id", "cat__c").collect()}
    assert {i: (v.size, v.indices.tolist(), v.values.tolist()) for i, v in rows.items()} == {
        0: (n, [0], [1.0]), 777_777: (n, [777_777], [1.0]), n - 1: (n, [n - 1], [1.0]), n: (n, [], []), n + 25: (n, [5], [1.0])}


def test_sparse_and_wide_forms_agree(spark):
    from agrispark.operators import features as M
    df = spark.createDataFrame([("b", "train"), ("a", "train"), (None, "train"), ("z", "test"), ("a", "test"), ("c", "train")], "c string, dataset_split string")
    wide = {(r["c"], r["dataset_split"]): [r["cat__c_a"], r["cat__c_b"], r["cat__c_c"]] for r in M.one_hot(df, ["c"]).collect()}
    thin = {(r["c"], r["dataset_split"]): r["cat__c"].toArray().tolist() for r in M.one_hot(df, ["c"], max_categories=2).collect()}
    assert wide == thin and thin["z", "test"] == [0, 0, 0] == thin[None, "train"]


def test_profile_counts_distinct_values_without_expanding(spark, capsys):
    from agrispark.operators import schema as S
    df = spark.createDataFrame([(1, "a", 0.0, [1]), (1, "b", -0.0, [2]), (None, None, float("nan"), None), (2, "a", float("nan"), [1])], "i int, s string, d double, arr array<int>")
    out = S.profile_columns(df)
    assert {r["column"]: (r["n_rows"], r["n_null"], r["n_distinct"]) for r in out.collect()} == {"i": (4, 1, 2), "s": (4, 1, 2), "d": (4, 2, 2), "arr": (4, 1, None)}
    out.explain()
    assert "Expand" not in capsys.readouterr().out
    assert {r["n_distinct"] for r in S.profile_columns(df.limit(0)).collect()} == {0, None}


def test_type_census_and_associations(spark):
    from agrispark.operators import quality as Q
    df = spark.createDataFrame([("1", "x", "p"), ("2.5e3", "x", "p"), (" -7 ", "y", "q"), ("2020-01-31", "y", "q"), ("word", "x", "p"), ("", "y", None), (None, None, "q")], "a string, b string, c string")
    assert tuple(Q.type_census(df, ["a"]).first()) == ("a", 3, 1, 1, 1)
    got = {r["column"]: (r["n"], round(r["association"], 9)) for r in Q.associations(df, ["b", "c"]).collect()}
    assert got == {"b|c": (5, 1.0)}
    assert Q.associations(df.withColumn("k", F.lit("same")), ["b", "k"]).first()["association"] == 0.0
    rep = {(r["check"], r["column"]): (round(r["metric"], 6), r["passed"]) for r in Q.integrity_report(df, ["a", "b"], categorical_cols=["b", "c"]).collect()}
    assert rep["mixed_types", "a"] == (0.4, False) and rep["mixed_types", "b"] == (0.0, True) and rep["association", "b|c"] == (1.0, False)


def test_quantiles_agree_whichever_way_the_groups_go(spark):
    from agrispark.operators import aggregates as A
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), (F.rand(7) * 100).alias("v"))
    df = df.union(spark.range(4000).select(F.lit(0).cast("long"), F.floor(F.rand(3) * 7).cast("double")))
    df = df.union(spark.createDataFrame([(5, None), (5, float("nan")), (6, 2.5), (7, 1.0), (7, 4.0), (None, 3.0), (8, float("inf")), (8, 1.0), (8, float("-inf"))], "k long, v double"))
    qs = [0.0, 0.5, 0.25, 1 / 3, 0.999, 1.0]
    for keys in (["k"], []):
        whole, parts = (sorted(map(repr, A.quantiles(df, keys, "v", qs, whole_group=n).collect())) for n in (10**6, 10))
        assert whole == parts
    assert [tuple(r) for r in A.quantiles(df.limit(0), [], "v", [0.5]).collect()] == [(None,)]
    assert A.quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0
