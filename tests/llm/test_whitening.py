"""Whitening against a dense eigendecomposition, and every awkward vector."""

import math

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from agrispark.llm import whitening as W

ROWS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), *[StructField(c, StringType()) for c in ("id", "x", "component", "n", "j")]])


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d", "e") for i, v in rows], ROWS).repartition(3)


def dense(rows, wanted=4):
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows], dtype=np.int64)
    fit = np.unique(x, axis=0)
    mean = fit.mean(axis=0)
    v = (fit - mean).T @ (fit - mean) / len(fit)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:wanted], q[:, ::-1][:, :wanted]
    return x, fit, e, np.trace(v), (x - mean) @ q / np.sqrt(e)


def check(spark, rows, wanted=4):
    x, fit, e, trace, z = dense(rows, wanted)
    got = W.whiten(table(spark, rows), wanted=wanted).collect()
    n, s = len(fit), fit.sum(axis=0)
    far = {i: int(((n * v - s) ** 2).sum()) for (i, _), v in zip(rows, x)}
    at = {(r["id"], r["component"]): r for r in got}
    assert len(got) == len(rows) * wanted and len(at) == len(got)
    for c in range(wanted):
        mine = np.array([at[i, c + 1]["whitened"] for i, _ in rows])
        assert min(np.abs(mine - z[:, c]).max(), np.abs(mine + z[:, c]).max()) < 1e-8  # either sign, the same for all rows
        assert abs(at[rows[0][0], c + 1]["explained"] / (e[c] / trace) - 1) < 1e-10
    assert {r["n"] for r in got} == {n} and all(r["deviation"] == far[r["id"]] for r in got)
    assert max(r["identity_error"] for r in got) < 1e-8


@pytest.mark.parametrize("d", [6, 50])
def test_equals_a_dense_decomposition(spark, d):
    rng = np.random.default_rng(d)
    base = rng.standard_normal((300, d)) * np.linspace(3, 0.5, d)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[i % 3].tolist()) for i in range(40)]
    check(spark, rows)


def test_a_flat_spectrum_is_certified_too():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    e = np.concatenate(([5, 5, 3, 1.02], np.linspace(1.0, 0.98, 86)))
    v = (q * e) @ q.T
    values, vectors, residual = W.leading_components(lambda b: v @ b, 90, 4)
    assert np.allclose(values, e[:4], rtol=1e-12) and residual.max() < 1e-10
    assert np.abs(v @ vectors - vectors * values).max() < 1e-10 and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)


def test_passes_that_never_converge_are_told():
    v = np.diag(np.linspace(1, 2, 200))
    rng = np.random.default_rng(1)
    with pytest.raises(RuntimeError, match="not certified"):
        W.leading_components(lambda b: v @ b + rng.standard_normal(b.shape), 200, 4, max_passes=30)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0, 2.0]), (2, [0.5, -1.0, 0.0]), (3, [-0.001, 3.0, -0.0]), (4, [2.0, 2.0, 1.0]), (4, [1.5, 0.25, -3.0]), (None, [0.0, 1.0, 7.0]), (7, [1.0, 0.0, 2.0])]
    bad = [(8, None), (9, [1.0, None, 2.0]), (10, [1.0, nan, 2.0]), (11, [inf, 1.0, 2.0]), (12, []), (13, [1.0, 2.0])]
    got = W.whiten(table(spark, good + bad)).collect()
    assert len(got) == 3 * len(good) and {r["n"] for r in got} == {6} and {r["id"] for r in got} == {i for i, _ in good}
    same = {(r["id"], r["component"]): r["whitened"] for r in got if r["id"] in (1, 7)}
    assert all(same[1, c] == same[7, c] for c in (1, 2, 3))


def test_lower_rank_equal_rows_and_empty(spark):
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)]
    assert {r["component"] for r in W.whiten(table(spark, line)).collect()} == {1}
    assert W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    empty = W.whiten(table(spark, []))
    assert empty.count() == 0 and empty.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_entries_beyond_a_long_product_stay_exact(spark):
    rows = [(1, [1e16, 0.0]), (2, [-1e16, 1.0]), (3, [0.0, 2.0])]
    got = {(r["id"], r["component"]): r for r in W.whiten(table(spark, rows)).collect()}
    assert got[1, 1]["deviation"] is None  # does not fit
    assert abs(abs(got[1, 1]["whitened"]) - math.sqrt(1.5)) < 1e-9
