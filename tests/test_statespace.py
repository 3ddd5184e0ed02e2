"""Maximum-likelihood ARIMA: the filter against dense covariances, the fit against other parameters, the jobs as a whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrispark.ml import arima as AR
from agrispark.ml import statespace as S


def dense_loglik(z, phi, theta):
    """Likelihood from the autocovariances of a long moving average, with the best variance."""
    psi = np.zeros(3000)
    psi[0] = 1
    for j in range(1, len(psi)):
        psi[j] = (theta[j - 1] if j <= len(theta) else 0) + sum(phi[i] * psi[j - 1 - i] for i in range(min(len(phi), j)))
    n = len(z)
    cov = np.array([psi[:len(psi) - h] @ psi[h:] for h in range(n)])[np.abs(np.subtract.outer(range(n), range(n)))]
    s2 = z @ np.linalg.solve(cov, z) / n
    return -0.5 * (n * np.log(2 * np.pi * s2) + np.linalg.slogdet(cov)[1] + n)


@pytest.mark.parametrize("p,q", [(0, 0), (1, 0), (0, 1), (1, 1), (2, 2), (3, 1)])
def test_filter_equals_the_dense_covariance(p, q):
    rng = np.random.default_rng(p * 10 + q)
    for lead in (0, 6):
        phi, theta = S.from_partial(rng.uniform(-1, 1, (1, p))), -S.from_partial(rng.uniform(-1, 1, (1, q)))
        z = rng.standard_normal(15)
        got = S.kalman(np.concatenate((np.zeros(lead), z))[None], np.array([lead]), phi, theta)
        assert got.loglik[0] == pytest.approx(dense_loglik(z, phi[0], theta[0]), abs=1e-8)


def test_partial_autocorrelations_round_trip():
    x = np.random.default_rng(1).uniform(-2, 2, (50, 4))
    assert np.allclose(S.to_partial(S.from_partial(x), 1 - 1e-12), x)
    assert np.isfinite(S.to_partial(np.array([[2.5, -1.7], [0.0, 1.0]]))).all()  # not stationary: pulled in


def simulated(rng, n, count):
    out = []
    for i in range(count):
        e, z = rng.standard_normal(n + 50), np.zeros(n + 50)
        for t in range(2, n + 50):
            z[t] = 0.6 * z[t - 1] - 0.2 * z[t - 2] + e[t] + 0.4 * e[t - 1]
        out.append(5 + z[50 + i % 7:])
    return out


def test_a_fit_is_never_less_likely_than_two_regressions_and_is_at_a_top():
    rng = np.random.default_rng(3)
    series = simulated(rng, 90, 12) + [np.cumsum(rng.standard_normal(60)), rng.standard_normal(40) ** 3]
    for p, q in [(1, 0), (1, 1), (2, 2)]:
        got = S.fit(series, p, q, True)
        assert got.ok.all()
        for i, s in enumerate(series):
            c = s - s.mean()
            phi, theta = S.least_squares_start(c, p, q, False)
            inside = np.abs(np.roots([1, *-phi])).max(initial=0) < 1
            if inside:
                first = S.kalman(c[None], np.array([0]), phi[None], theta[None]).loglik[0]
                assert got.loglik[i] >= first - 1e-7
            for _ in range(5):  # no better point close by
                x = S.to_partial(got.phi[i:i + 1], 1 - 1e-9) + rng.normal(0, 0.02, (1, p))
                y = S.to_partial(-got.theta[i:i + 1], 1 - 1e-9) + rng.normal(0, 0.02, (1, q))
                near = S.kalman((s - got.mean[i])[None], np.array([0]), S.from_partial(x), -S.from_partial(y)).loglik[0]
                assert near <= got.loglik[i] + 1e-4


def test_parameters_are_found_and_do_not_depend_on_the_batch():
    series = simulated(np.random.default_rng(4), 4000, 1) + simulated(np.random.default_rng(5), 100, 3)
    got = S.fit(series, 2, 1, True)
    assert np.allclose(got.phi[0], [0.6, -0.2], atol=0.08) and np.allclose(got.theta[0], [0.4], atol=0.08) and abs(got.mean[0] - 5) < 0.2 and abs(got.sigma2[0] - 1) < 0.08
    alone = S.fit(series[1:2], 2, 1, True)
    assert alone.loglik[0] == pytest.approx(got.loglik[1], abs=1e-5)


def test_series_that_have_no_model():
    got = S.fit([np.zeros(0), np.arange(3.0), np.full(30, 7.0), np.array([1.0, np.nan] * 20), np.random.default_rng(0).standard_normal(30)], 1, 1, True)
    assert got.ok.tolist() == [False, False, False, False, True]


def months(spark, n, key, value):
    return spark.range(n).select(F.lit(key).alias("series_key"), F.add_months(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("month"), value.alias("value"))


def test_models_and_forecasts_of_many_series(spark):
    wave = F.sin(F.col("id") * 1.3) * 3 + F.cos(F.col("id") * F.col("id")) + F.col("id") * 0.1
    df = months(spark, 70, "a", wave).unionByName(months(spark, 44, "b", wave + F.pow(F.col("id"), F.lit(0.5)))).unionByName(months(spark, 30, "flat", F.lit(2.0))).unionByName(months(spark, 4, "short", wave))
    df = df.unionByName(months(spark, 5, "void", F.lit(None).cast("double")))
    fits = {r["series_key"]: r for r in AR.arima_fit(df, order=(1, 1, 1)).collect()}
    assert set(fits) == {"a", "b", "flat", "short"} and [k for k in fits if fits[k]["model_ok"]] and not fits["flat"]["model_ok"] and fits["flat"]["aic"] is None
    assert fits["a"]["n"] == 69 and fits["a"]["aic"] == pytest.approx(-2 * fits["a"]["loglik"] + 6)
    rows = AR.arima_forecast(df, order=(1, 1, 1), steps=spark.createDataFrame([("a", 4), ("b", 2), ("flat", 3), ("short", 1)], "series_key string, steps int")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["step"]):
        got.setdefault(r["series_key"], []).append(r)
    assert {k: [r["step"] for r in v] for k, v in got.items()} == {"a": [1, 2, 3, 4], "b": [1, 2], "flat": [0], "short": [0]}
    # by hand: the fitted ARMA(1, 1) of the differences, from the last value and the last shock
    y = np.array([r["value"] for r in df.where("series_key = 'a'").orderBy("month").collect()])
    z, f = np.diff(y), fits["a"]
    state = S.kalman(z[None], np.array([0]), np.array([f["ar"]]), np.array([f["ma"]])).state[0]
    assert got["a"][0]["forecast"] == pytest.approx(y[-1] + state[0], abs=1e-9)
    assert got["a"][1]["forecast"] == pytest.approx(y[-1] + state[0] + f["ar"][0] * state[0] + state[1], abs=1e-9)
    assert str(got["a"][0]["month"]) == "2005-11-01" and got["a"][0]["aic"] == pytest.approx(f["aic"])


def test_likelihood_with_a_constant_is_at_least_that_of_the_regressions(spark):
    """On the demo series: the default method's model with a mean against the two-stage fit's parameters."""
    from agrispark.plans.demo_models import filled
    from conftest import SF_SMALL
    series = filled(spark, SF_SMALL)
    rows = AR._packed(series, "series_key", "month", "value").collect()
    zs = [np.diff(np.array(r["y"])) for r in rows]
    best = S.fit(zs, 1, 1, True)
    assert len(zs) and best.ok.any()
    for i in np.flatnonzero(best.ok):
        c = zs[i] - zs[i].mean()
        phi, theta = S.least_squares_start(c, 1, 1, False)
        if abs(phi[0]) < 1:
            assert best.loglik[i] >= S.kalman(c[None], np.array([0]), phi[None], theta[None]).loglik[0] - 1e-7
