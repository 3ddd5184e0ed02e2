"""Embedding whitening: Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance are found without ever forming it:
every step is one distributed pass that multiplies the centred vectors' XᵀX
with a thin block Q. A Chebyshev recurrence over such passes damps the unwanted
part of the spectrum, QR and a Rayleigh-Ritz step turn the block into
eigenvectors, and the residuals |VQ - Qθ| of the wanted ones certify them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import columns, materialize, prepare

#: Columns of the block besides the wanted ones: the damped part of the spectrum starts behind them.
GUARD = 28
#: Residual of a certified component, as a share of its eigenvalue.
TOLERANCE = 1e-13
#: A residual that no longer falls (rounding in the passes) is accepted up to this share of the largest eigenvalue.
ROUNDING = 1e-11
DEGREE, MAX_PASSES, SEED = 10, 400, 7
_LONG = (1 << 63) - 1


def steps(vector: Column, scale: int = 256) -> Column:
    """floor(scale * c) of every entry, as long (beyond the range of a long: its ends); null for a vector that is null or holds null or non-finite entries."""
    v = vector.cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(sound, F.transform(v, lambda c: F.floor(c * float(scale))))


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> tuple[DataFrame, int]:
    """(id, x) of the rows that remain, and the dimension: the commonest length (of several the longest)."""
    rows = columns(vectors, id_col, vec_col).toDF("id", "v").select("id", steps(F.col("v"), scale).alias("x")).where("x IS NOT NULL AND size(x) > 0")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    return rows.where(F.size("x") == d), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def fit_list(rows: DataFrame, d: int) -> DataFrame:
    """Each distinct vector once, as blocks: one row (rows, x) holds the int64 entries of a batch of vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), d).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["rows", "x"])

    return materialize(rows.select("x").distinct().mapInArrow(run, "rows long, x binary"), "whitening-fit")


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for b in batches:
        for raw in b.column(0):
            yield np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, d)


def sums(fit: DataFrame, d: int) -> tuple[int, list[int], list[int], int]:
    """(n, sums, sums of squares, largest absolute entry) of the fit list, exact."""
    wide = DecimalType(38, 0)
    schema = StructType([StructField("j", IntegerType()), StructField("s", wide), StructField("q", wide), StructField("top", wide), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, top = 0, [0] * d, [0] * d, [0] * d
        for x in _blocks(batches, d):
            high = np.maximum(np.abs(x.max(axis=0).astype(object)), np.abs(x.min(axis=0).astype(object)))
            w = x if int(high.max()) ** 2 * len(x) <= _LONG else x.astype(object)  # python's integers where a long is too small
            n += len(x)
            s, q = [a + int(b) for a, b in zip(s, w.sum(axis=0))], [a + int(b) for a, b in zip(q, (w * w).sum(axis=0))]
            top = [max(a, int(b)) for a, b in zip(top, high)]
        if n:
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), *[pa.array(v, kind) for v in (s, q, top)], pa.array([n] * d, pa.int64())], schema.names)

    got = fit.select("x").mapInArrow(run, schema).groupBy("j").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("top").alias("top"), F.sum("n").alias("n")).orderBy("j").collect()
    if not got:
        return 0, [], [], 0
    return got[0]["n"], [int(r["s"]) for r in got], [int(r["q"]) for r in got], max(int(r["top"]) for r in got)


def covariance_times(fit: DataFrame, q: np.ndarray, mean: np.ndarray, n: int) -> np.ndarray:
    """V q in one pass: each task adds up its (x - mean)ᵀ((x - mean) q), a row per dimension; rows of a dimension are summed by Spark."""
    d, k = q.shape
    shared = fit.sparkSession.sparkContext.broadcast((q, mean))
    names = [f"y{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, centre = shared.value
        out, seen = np.zeros((d, k)), False
        for x in _blocks(batches, d):
            c = x - centre
            out += c.T @ (c @ block)
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), *[pa.array(np.ascontiguousarray(out[:, i])) for i in range(k)]], ["j", *names])

    schema = "j int, " + ", ".join(f"{c} double" for c in names)
    got = fit.select("x").mapInArrow(run, schema).groupBy("j").agg(*[F.sum(c).alias(c) for c in names]).orderBy("j").toArrow()
    shared.unpersist()
    return np.stack([got.column(c).to_numpy() for c in names], axis=1) / n


def leading_components(times, d: int, wanted: int, guard: int = GUARD, degree: int = DEGREE, seed: int = SEED,
                       tolerance: float = TOLERANCE, max_passes: int = MAX_PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, residuals), falling, of the ``wanted`` largest; ``times(q)`` is V q.

    Damps [0, smallest Ritz value of the block] by a scaled Chebyshev
    polynomial, whose first product is the one that Rayleigh-Ritz needed
    anyway. Stops when every wanted residual is at most ``tolerance`` of its
    eigenvalue, or no longer falls and is rounding only (``ROUNDING``); else it
    fails after ``max_passes`` passes. Components of a numerically zero eigenvalue are left out.
    """
    k = min(d, wanted + guard)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, k)))[0]
    passes, before = 0, np.inf
    while True:
        vq = times(q)
        passes += 1
        small = q.T @ vq
        theta, u = np.linalg.eigh((small + small.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        top = max(float(theta[0]), 0.0)
        live = int((theta[:wanted] > 1e-13 * d * top).sum()) if top else 0
        residual = np.linalg.norm(vq[:, :live] - q[:, :live] * theta[:live], axis=0)
        worst = float((residual / theta[:live]).max()) if live else 0.0
        stalled = worst >= before / 2 and bool((residual <= ROUNDING * top).all())
        if worst <= tolerance or stalled:
            return theta[:live], q[:, :live] / np.linalg.norm(q[:, :live], axis=0), residual
        if passes >= max_passes:
            raise RuntimeError(f"components not certified after {passes} passes: residual {worst:.1e} of the eigenvalue")
        before = worst
        # scaled Chebyshev recurrence over [0, high]; theta[0] keeps the numbers in range
        high = max(float(theta[-1]), 1e-300)
        half = centre = high / 2
        first = sigma = half / (top - centre) if top > centre else 1.0
        old, new = q, (vq - centre * q) * (sigma / half)
        for _ in range(degree - 1):
            after = 1 / (2 / first - sigma)
            old, new = new, (times(new) - centre * new) * (2 * after / half) - (sigma * after) * old
            sigma = after
            passes += 1
        q = np.linalg.qr(new)[0]


def identity_error(fit: DataFrame, weights: np.ndarray, mean: np.ndarray, n: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, in one pass."""
    d, p = weights.shape
    shared = fit.sparkSession.sparkContext.broadcast((weights, mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, centre = shared.value
        out = np.zeros((p + 1, p))
        for x in _blocks(batches, d):
            z = (x - centre) @ w
            out[:p] += z.T @ z
            out[p] += z.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], ["i", "v"])

    got = fit.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow().column("v").to_numpy()
    second, first = got[:p * p].reshape(p, p) / n, got[p * p:] / n
    return float(np.abs(second - np.outer(first, first) - np.eye(p)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", wanted: int = 4, scale: int = 256) -> DataFrame:
    """Whitened coordinates: (id, component, n, deviation, whitened, explained, identity_error), a row per remaining row and component.

    Entries count in steps of 1 / ``scale``. A row remains if its vector is
    neither null nor empty, holds no null or non-finite entry and has the
    commonest length of these (of several the longest). The model is fitted to each distinct vector once; null and
    repeated ids are rows like others. There are fewer components than
    ``wanted`` if the fit list has a lower rank (none, so no rows, if all its
    vectors are equal or the table is empty); equal eigenvalues have some
    orthonormal components of their space. A deviation too large for a long is null. Other columns are not read.
    """
    spark = prepare(vectors.sparkSession)
    rows, d = usable(vectors, id_col, vec_col, scale)
    schema = StructType([StructField("id", vectors.schema[id_col].dataType), StructField("deviation", LongType()), StructField("z", ArrayType(DoubleType()))])
    out = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    fit = fit_list(rows, d) if d else None
    n, total, squares, top = sums(fit, d) if d else (0, [], [], 0)
    variances = [(n * q - s * s) / (n * n) for s, q in zip(total, squares)]  # integers, one rounding
    trace = float(sum(variances))
    if not trace:
        flat = StructType([schema[0], StructField("component", IntegerType()), StructField("n", LongType()), schema[1], *[StructField(c, DoubleType()) for c in out[4:]]])
        return spark.createDataFrame([], flat)
    mean = np.array([s / n for s in total])
    e, vec, _ = leading_components(lambda q: covariance_times(fit, q, mean, n), d, wanted)
    weights = vec / np.sqrt(e)
    error, share = identity_error(fit, weights, mean, n), [float(v / trace) for v in e]
    exact = d * (2 * n * top) ** 2 <= _LONG
    shared = spark.sparkContext.broadcast((weights, mean, np.array(total, np.int64 if exact else object)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, centre, whole = shared.value
        for b in batches:
            x = _matrix(b.column(1), d)
            z = (x - centre) @ w
            apart = n * (x if exact else x.astype(object)) - whole
            far = (apart * apart).sum(axis=1)
            far = pa.array(far if exact else [int(v) if v <= _LONG else None for v in far], pa.int64())
            ends = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), far, pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], schema.names)

    done = rows.select("id", "x").mapInArrow(run, schema).select("id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return done.select("id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.element_at(F.array(*[F.lit(s) for s in share]), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
