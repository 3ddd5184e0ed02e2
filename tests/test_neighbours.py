"""Nearest neighbours by projection trees: exact in a leaf, recall against brute force beyond, and SMOTE's use of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrispark.operators import neighbours as N
from agrispark.operators.oversample import smote


def frame(spark, z, labels):
    rows = [(i, str(c), [float(x) for x in v]) for i, (v, c) in enumerate(zip(z, labels))]
    return spark.createDataFrame(rows, "key long, cls string, z array<double>").repartition(4)


def true_distances(z, labels, k):
    """Distances of the k nearest of the same class, for every point."""
    out = {}
    for c in set(labels):
        rows = np.flatnonzero(np.array(labels) == c)
        p = z[rows]
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        d.sort(axis=1)
        out |= {int(i): row[:min(k, len(rows) - 1)] for i, row in zip(rows, d)}
    return out


def recall(got, z, labels, k):
    """Share of the true k nearest that were found (a point as near as the k-th counts: ties have no order)."""
    truth = true_distances(z, labels, k)
    hit = sum(sum(x["d"] <= truth[r["key"]][-1] + 1e-9 for x in r["neighbours"]) for r in got if len(truth[r["key"]]))
    return hit / sum(map(len, truth.values()))


def test_a_leaf_is_searched_exactly(spark):
    rng = np.random.default_rng(1)
    z = rng.standard_normal((700, 5))
    labels = ["a"] * 500 + ["b"] * 195 + ["c"] * 4 + ["d"]
    got = N.nearest_neighbours(frame(spark, z, labels), "cls", "key", "z", k=5).collect()
    truth = true_distances(z, labels, 5)
    assert len(got) == 700
    for r in got:
        assert np.allclose([x["d"] for x in r["neighbours"]], truth[r["key"]]) and all(labels[x["key"]] == r["cls"] and x["key"] != r["key"] for x in r["neighbours"])


@pytest.mark.parametrize("kind", ["plain", "clustered", "tied", "hot"])
def test_recall_of_trees(spark, kind):
    """Leaves of 256 points in a class of 6,000: four trees find at least nine of ten true neighbours."""
    rng = np.random.default_rng(7)
    n = 6000
    if kind == "plain":
        z = rng.standard_normal((n, 6))
    elif kind == "clustered":
        z = rng.standard_normal((40, 6))[rng.integers(0, 40, n)] * 4 + 0.2 * rng.standard_normal((n, 6))
    elif kind == "tied":
        z = rng.integers(0, 4, (n, 5)).astype(float)
    else:
        z = np.where(rng.random((n, 1)) < 0.4, 1.0, rng.standard_normal((n, 6)))  # four rows of ten are one point
    labels = np.where(np.arange(n) < 5400, "big", "small").tolist()
    df = frame(spark, z, labels)
    for sample in (N.SAMPLE, 2000):  # cuts from all points, and from a sample of them
        got = N.nearest_neighbours(df, "cls", "key", "z", k=5, leaf=256, group=1024, sample=sample, cut_sample=64).collect()
        assert len(got) == n and all(len(r["neighbours"]) == 5 for r in got)
        share = recall(got, z, labels, 5)
        print(f"recall {kind}, cuts from {sample} points: {share:.3f}")
        assert share >= 0.9
    again = N.nearest_neighbours(df.repartition(7), "cls", "key", "z", k=5, leaf=256, group=1024, sample=2000, cut_sample=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_nulls_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "a", [1.0, None]), (2, "a", [1.0, 0.0]), (3, None, [0.0, 0.0]), (4, "b", [2.0, 2.0])], "key long, cls string, z array<double>")
    got = {r["key"]: [(x["d"], x["key"]) for x in r["neighbours"]] for r in N.nearest_neighbours(df, "cls", "key", "z", k=3).collect()}
    assert got == {1: [(0.0, 2)], 2: [(0.0, 1)], 4: []}
    assert N.nearest_neighbours(df.where("key < 0"), "cls", "key", "z").count() == 0


def test_smote_interpolates_towards_true_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "big", float(rng.normal()), float(rng.normal())) for i in range(300)] + [(1000 + i, "few", float(i), 0.0) for i in range(20)] + [(2000, "one", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "key long, cls string, x double, y double")
    out = smote(df, "cls", "key", ["x", "y"], k=2, seed=3)
    assert {r["cls"]: r["count"] for r in out.groupBy("cls").count().collect()} == {"big": 300, "few": 300, "one": 300}
    few = [r["x"] for r in out.where("synthetic and cls = 'few'").collect()]
    assert len(few) == 280 and all(0 <= x <= 19 for x in few) and any(abs(x - round(x)) > 0.05 for x in few)
    assert {(r["x"], r["y"]) for r in out.where("cls = 'one'").collect()} == {(5.0, 5.0)}
    assert out.where("synthetic and key is not null").count() == 0 and out.where(F.col("x").isNull()).count() == 0
