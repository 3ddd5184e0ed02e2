"""Exact Gaussian likelihood of ARMA models for a batch of series at once, and its maximum.

Each function works on stacked arrays: one row per series (or per series and
trial parameter), so a step of the Kalman filter is a handful of array
operations however many series there are. Parameters are searched in a space
without bounds (partial autocorrelations between -1 and 1, as x / sqrt(1 + x^2)), where
every point is a stationary and invertible model; the mean is in units of the
series' deviation and the variance is concentrated out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Largest partial autocorrelation that a start may have.
EDGE = 0.99
ITERATIONS = 200


def from_partial(x: np.ndarray) -> np.ndarray:
    """(series, k) free numbers -> coefficients of a stationary autoregression (Durbin-Levinson)."""
    r = x / np.sqrt(1 + x * x)
    out = np.zeros_like(r)
    for k in range(r.shape[1]):
        before = out[:, :k].copy()
        out[:, :k] = before - r[:, k:k + 1] * before[:, ::-1]
        out[:, k] = r[:, k]
    return out


def to_partial(phi: np.ndarray, edge: float = EDGE) -> np.ndarray:
    """The free numbers of given coefficients; partial autocorrelations outside +-``edge`` are pulled in."""
    left = phi.astype(float).copy()
    r = np.zeros_like(left)
    for k in range(phi.shape[1] - 1, -1, -1):
        r[:, k] = np.clip(left[:, k], -edge, edge)
        if k:
            own = r[:, k:k + 1]
            left[:, :k] = (left[:, :k] + own * left[:, :k][:, ::-1]) / (1 - own * own)
    return r / np.sqrt(1 - r * r)


def _state_cov(phi: np.ndarray, load: np.ndarray) -> np.ndarray:
    """Stationary covariance P = T P T' + R R' of the state, T being the companion matrix of ``phi``."""
    m, r = phi.shape
    t = np.zeros((m, r, r))
    t[:, :, 0] = phi
    t[:, np.arange(r - 1), np.arange(1, r)] += 1
    kron = np.einsum("mij,mkl->mikjl", t, t).reshape(m, r * r, r * r)
    rr = (load[:, :, None] * load[:, None, :]).reshape(m, r * r, 1)
    return np.linalg.solve(np.eye(r * r) - kron, rr)[:, :, 0].reshape(m, r, r)


@dataclass
class Filtered:
    """Log-likelihood, variance of the shocks, and the state that forecasts the next value."""

    loglik: np.ndarray
    sigma2: np.ndarray
    state: np.ndarray


def kalman(z: np.ndarray, start: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> Filtered:
    """Filter of zero-mean ARMA series: ``z`` (m, t), each row's values from ``start`` on; phi (m, p), theta (m, q).

    The variance is the one that makes the likelihood largest.
    """
    m, steps = z.shape
    r = max(phi.shape[1], theta.shape[1] + 1)
    f = np.zeros((m, r))
    f[:, :phi.shape[1]] = phi
    load = np.zeros((m, r))
    load[:, 0], load[:, 1:1 + theta.shape[1]] = 1, theta
    noise = load[:, :, None] * load[:, None, :]
    p, a = _state_cov(f, load), np.zeros((m, r))
    square, logs = np.zeros(m), np.zeros(m)
    first = int(start.min())
    for i in range(first, steps):
        live = start <= i
        every = live.all()
        spread = p[:, 0, 0]
        shock = z[:, i] - a[:, 0]
        gain = p[:, :, 0] / spread[:, None]
        square += np.where(live, shock * shock / spread, 0.0)
        logs += np.where(live, np.log(spread), 0.0)
        b = a + gain * shock[:, None]
        left = p - gain[:, :, None] * p[:, None, 0, :]
        new_a = f * b[:, :1]
        new_a[:, :-1] += b[:, 1:]
        # T left T' + R R': rows, then columns
        rows = f[:, :, None] * left[:, None, 0, :]
        rows[:, :-1] += left[:, 1:]
        new_p = noise + rows[:, :, None, 0] * f[:, None, :]
        new_p[:, :, :-1] += rows[:, :, 1:]
        if every:
            a, p = new_a, new_p
        else:
            a, p = np.where(live[:, None], new_a, a), np.where(live[:, None, None], new_p, p)
    n = steps - start
    sigma2 = square / n
    with np.errstate(divide="ignore"):
        loglik = -0.5 * (n * (np.log(2 * np.pi) + 1 + np.log(sigma2)) + logs)
    return Filtered(loglik, sigma2, a)


@dataclass
class Fit:
    """Models of a batch: mean of the series, coefficients, variance, log-likelihood, forecasting state; ``ok`` where there is a model."""

    mean: np.ndarray
    phi: np.ndarray
    theta: np.ndarray
    sigma2: np.ndarray
    loglik: np.ndarray
    state: np.ndarray
    ok: np.ndarray


class _Search:
    """Log-likelihood of the series of a batch as a function of their free numbers."""

    def __init__(self, z, start, p, q, constant):
        self.start, self.p, self.q, self.constant = start, p, q, constant
        n = z.shape[1] - start
        live = np.arange(z.shape[1]) >= start[:, None]
        self.centre = np.where(live, z, 0).sum(axis=1) / n if constant else np.zeros(len(z))
        self.scale = np.sqrt(np.where(live, (z - self.centre[:, None]) ** 2, 0).sum(axis=1) / n)
        self.scale[~(self.scale > 0)] = 1.0
        self.z = np.where(live, z, 0.0)

    def parts(self, x, rows):
        mean = self.centre[rows] + self.scale[rows] * x[:, -1] if self.constant else np.zeros(len(x))
        return mean, from_partial(x[:, :self.p]), -from_partial(x[:, self.p:self.p + self.q])

    def filtered(self, x, rows):
        mean, phi, theta = self.parts(x, rows)
        return kalman(self.z[rows] - mean[:, None], self.start[rows], phi, theta)

    def __call__(self, x, rows):
        with np.errstate(all="ignore"):
            got = self.filtered(x, rows).loglik
        return np.where(np.isfinite(got), got, -np.inf)

    def gradient(self, x, rows):
        """Central differences, all of them in one filter run."""
        k, h = x.shape[1], 1e-5
        at = np.repeat(x[:, None, :], 2 * k, axis=1)
        for i in range(k):
            at[:, 2 * i, i] += h
            at[:, 2 * i + 1, i] -= h
        got = self(at.reshape(-1, k), np.repeat(rows, 2 * k)).reshape(len(x), k, 2)
        g = (got[:, :, 0] - got[:, :, 1]) / (2 * h)
        return np.where(np.isfinite(g), g, 0.0)

    def climb(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BFGS from ``x`` for all series at once, each with its own curvature and step; a step never lowers a likelihood."""
        m, k = x.shape
        every = np.arange(m)
        value, x = self(x, every), x.copy()
        if not k:
            return x, value
        g = self.gradient(x, every)
        inverse = np.repeat(np.eye(k)[None], m, axis=0) * 0.05
        going = np.isfinite(value)
        for _ in range(ITERATIONS):
            rows = np.flatnonzero(going)
            if not len(rows):
                break
            way = np.einsum("mij,mj->mi", inverse[rows], g[rows])
            slope = (way * g[rows]).sum(axis=1)
            bad = ~(slope > 0)
            way[bad], inverse[rows[bad]] = 0.05 * g[rows[bad]], np.eye(k) * 0.05
            slope = (way * g[rows]).sum(axis=1)
            length = np.minimum(1.0, 2.0 / np.maximum(np.abs(way).max(axis=1), 1e-300))
            done = np.zeros(len(rows), bool)
            new_x, new_v = x[rows].copy(), value[rows].copy()
            for _ in range(25):
                todo = np.flatnonzero(~done)
                if not len(todo):
                    break
                trial = x[rows[todo]] + length[todo, None] * way[todo]
                got = self(trial, rows[todo])
                up = got >= value[rows[todo]] + 1e-4 * length[todo] * slope[todo]
                new_x[todo[up]], new_v[todo[up]], done[todo[up]] = trial[up], got[up], True
                length[todo[~up]] /= 3
            gained = new_v - value[rows]
            new_g = self.gradient(new_x, rows)
            s, y = new_x - x[rows], g[rows] - new_g  # of the negative likelihood
            sy = (s * y).sum(axis=1)
            good = sy > 1e-12
            if good.any():
                r, sg, yg, c = rows[good], s[good], y[good], 1 / sy[good]
                left = np.eye(k) - c[:, None, None] * sg[:, :, None] * yg[:, None, :]
                inverse[r] = left @ inverse[r] @ left.transpose(0, 2, 1) + c[:, None, None] * sg[:, :, None] * sg[:, None, :]
            x[rows], value[rows], g[rows] = new_x, new_v, new_g
            flat = np.abs(new_g).max(axis=1) < 1e-4
            going[rows[~done | flat | (gained < 1e-9)]] = False
        return x, value


def least_squares_start(z: np.ndarray, p: int, q: int, constant: bool) -> tuple[np.ndarray, np.ndarray]:
    """(phi, theta) of one series by two regressions (Hannan-Rissanen); zeros where they can't be solved."""
    def regress(y, xs):
        x = np.stack([*xs, *([np.ones(len(y))] if constant else [])], axis=1) if xs or constant else np.zeros((len(y), 0))
        return np.linalg.lstsq(x, y, rcond=None)[0], x

    m = max(p + q + 2, 4)
    phi, theta = np.zeros(p), np.zeros(q)
    if len(z) <= 2 * m + q + 2:
        return phi, theta
    beta, x = regress(z[m:], [z[m - i:len(z) - i] for i in range(1, m + 1)])
    e = np.concatenate((np.zeros(m), z[m:] - x @ beta))
    a = m + q
    beta, _ = regress(z[a:], [z[a - i:len(z) - i] for i in range(1, p + 1)] + [e[a - i:len(z) - i] for i in range(1, q + 1)])
    if not np.isfinite(beta).all():
        return phi, theta
    return beta[:p], beta[p:p + q]


def fit(series: list[np.ndarray], p: int, q: int, constant: bool) -> Fit:
    """Maximum-likelihood ARMA(p, q) of each (differenced) series, from two starts: two regressions, and no correlation.

    A series with fewer than p + q + 4 values, without variation or with a
    non-finite value has no model.
    """
    m, k = len(series), p + q + constant
    n = np.array([len(s) for s in series])
    ok = np.array([len(s) >= p + q + 4 and bool(np.isfinite(s).all()) and float(np.ptp(s)) > 1e-9 * max(1.0, float(np.abs(s).max())) for s in series], bool)
    out = Fit(np.full(m, np.nan), np.full((m, p), np.nan), np.full((m, q), np.nan), np.full(m, np.nan), np.full(m, np.nan), np.full((m, max(p, q + 1)), np.nan), ok)
    rows = np.flatnonzero(ok)
    if not len(rows):
        return out
    width = int(n[rows].max())
    z, start = np.zeros((len(rows), width)), width - n[rows]
    begin = np.zeros((2, len(rows), k))
    for i, s in enumerate(series[r] for r in rows):
        z[i, start[i]:] = s
        phi, theta = least_squares_start(s - s.mean() if constant else s, p, q, False)
        begin[0, i, :p] = to_partial(phi[None], EDGE)[0]
        begin[0, i, p:p + q] = to_partial(-theta[None], EDGE)[0]
    begin[1, :, :p + q] = 0.1
    search = _Search(z, start, p, q, constant)
    (x, value), (x2, value2) = search.climb(begin[0]), search.climb(begin[1])
    better = value2 > value
    x[better], value[better] = x2[better], value2[better]
    every = np.arange(len(rows))
    mean, phi, theta = search.parts(x, every)
    last = search.filtered(x, every)
    out.mean[rows], out.phi[rows], out.theta[rows], out.sigma2[rows], out.loglik[rows], out.state[rows] = mean, phi, theta, last.sigma2, last.loglik, last.state
    out.ok[rows] = np.isfinite(value) & np.isfinite(last.state).all(axis=1) & (last.sigma2 > 0)
    return out


def ahead(fitted: Fit, steps: int) -> np.ndarray:
    """(series, steps) forecasts of the fitted (differenced) series."""
    phi = np.zeros_like(fitted.state)
    phi[:, :fitted.phi.shape[1]] = fitted.phi
    a, out = fitted.state, np.empty((len(phi), steps))
    for h in range(steps):
        out[:, h] = fitted.mean + a[:, 0]
        new = phi * a[:, :1]
        new[:, :-1] += a[:, 1:]
        a = new
    return out
