"""Quality classifier: naive Bayes support vectors.

Indicators of hashed n-grams are scaled by the log-ratio of their class
counts; a linear hinge-loss model is fitted to them by dual coordinate descent;
a logistic curve turns its margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from .common import columns, materialize, prepare, text_slices

#: Bins of hashed n-grams.
BINS = 1 << 18
#: Bound on the labelled rows that the hinge-loss model is fitted to (about; a fixed hash of the id chooses them).
#: Class counts are always those of all labelled rows.
FIT_ROWS = 20_000
#: Bound on the n-gram bins of these rows together (8 bytes each while fitting), so long texts don't fill the task:
#: rows are taken in the order of the same hash until it is reached.
FIT_BINS = 40_000_000
#: Up to so many labels (16 bytes each) go to the texts by broadcast, more by a shuffle join.
BROADCAST_LABELS = 1_000_000
COST, EPOCHS, SEED = 1.0, 12, 11
SMOOTH = 1.0
STEP = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What a byte says about its word: lower case 1, upper case 2, digit 4, other character 8, symbol 16.
_CLASS = np.array([0 if _SPACE[b] else 8 if b >= 128 else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 4 if 48 <= b <= 57 else 16 for b in range(256)], np.uint8)


def _bin(code: np.ndarray, salt: int) -> np.ndarray:
    mixed = (code + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(46)) & np.uint64(BINS - 1)).astype(np.int64)


def slice_bins(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bins of all n-grams of a slice of texts, as (bins, starts): text i has bins[starts[i]:starts[i + 1]] of each part.

    N-grams are runs of 3 and 4 bytes, and runs of 1 to 4 word shapes. A word's
    shape is the classes of the characters in it and whether it repeats the word before.
    """
    out, x = [], data.astype(np.uint64)
    ends = offsets[1:]
    for n in (3, 4):
        code = np.zeros(len(x), np.uint64)
        if len(x) >= n:
            for k in range(n):
                code[:len(x) - n + 1] = code[:len(x) - n + 1] << np.uint64(8) | x[k:len(x) - n + 1 + k]
        out.append((_bin(code, n << 40), np.stack((offsets[:-1], np.maximum(ends - n + 1, offsets[:-1])))))
    if not len(x):
        return out
    space = _SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    head = offsets[:-1][offsets[:-1] < len(data)]
    start[head] = ~space[head]  # a text's first word starts with the text
    first = np.flatnonzero(start)
    if not len(first):
        return out
    shape = np.bitwise_or.reduceat(_CLASS[data], first).astype(np.uint64)
    at = np.arange(len(data))
    at -= np.repeat(np.concatenate(([0], first)), np.diff(np.concatenate(([0], first, [len(data)]))))
    letters = np.where(space, np.uint64(0), (x + np.uint64(1)) * _POWERS[np.minimum(at, len(_POWERS) - 1)])
    word = np.add.reduceat(letters, first)
    starts = np.searchsorted(first, offsets)
    same = np.zeros(len(first), np.uint64)
    same[1:] = word[1:] == word[:-1]
    same[starts[:-1][starts[:-1] < len(first)]] = 0
    code = shape | same << np.uint64(5)
    for n in range(1, 5):
        gram = np.zeros(len(code), np.uint64)
        if len(code) >= n:
            for k in range(n):
                gram[:len(code) - n + 1] = gram[:len(code) - n + 1] << np.uint64(6) | code[k:len(code) - n + 1 + k]
        out.append((_bin(gram, (8 + n) << 40), np.stack((starts[:-1], np.maximum(starts[1:] - n + 1, starts[:-1])))))
    return out


_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64))


def _different(bins: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """Each bin once: the place that was written last keeps it."""
    at = np.arange(len(bins), dtype=stamp.dtype)
    stamp[bins] = at
    return bins[stamp[bins] == at]


def text_bins(data: np.ndarray, offsets: np.ndarray, stamp: np.ndarray) -> Iterator[np.ndarray]:
    """Different bins of each text of a slice. ``stamp`` is a scratch array of ``BINS`` numbers.

    A text of more than ``STEP`` bytes goes in steps that overlap by a few bytes, so it needs little memory.
    """
    if len(offsets) == 2 and len(data) > STEP:
        seen = np.zeros(0, np.int64)
        for at in range(0, len(data), STEP):
            part = data[at:at + STEP + 3]
            own = [bins[span[0, 0]:span[1, 0]] for bins, span in slice_bins(part, np.array([0, len(part)]))]
            seen = _different(np.concatenate([seen, *own]), stamp)
        yield seen
        return
    parts = slice_bins(data, offsets)
    for i in range(len(offsets) - 1):
        yield _different(np.concatenate([bins[span[0, i]:span[1, i]] for bins, span in parts]), stamp)


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = SEED, n_bins: int = BINS) -> np.ndarray:
    """Weights (the last is the bias) that minimise |w|^2 / 2 + cost * hinge loss, by dual coordinate descent."""
    w, alpha = np.zeros(n_bins + 1), np.zeros(len(y))
    square = np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, v = rows[i], values[i]
            slope = y[i] * (w[at] @ v + w[-1]) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                w[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve that is likeliest for the margins (Platt's smoothed targets, Newton steps)."""
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g = np.array([(p - target) @ margins, (p - target).sum()])
        k = p * (1 - p)
        h = np.array([[k @ margins**2 + 1e-6, k @ margins], [k @ margins, k.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max() / 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


@dataclass
class Model:
    """Log-count ratios, weights and calibration."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, bins: np.ndarray) -> float:
        r = self.ratio[bins]
        norm = float(np.sqrt(r @ r))
        return (float(r @ self.weight[bins]) / norm if norm else 0.0) + self.bias

    def score(self, bins: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(bins) + self.offset, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality",
          fit_rows: int = FIT_ROWS, broadcast_labels: int = BROADCAST_LABELS, fit_bins: int = FIT_BINS) -> Model:
    """Fit the model to the documents that ``labels`` (one row per id) has.

    One pass over the labelled texts adds up class counts per bin in each task,
    over all of them, and picks the bins of the rows to fit to.
    """
    known = materialize(columns(labels, label_id, label_col).toDF("lid", "y").where("lid IS NOT NULL AND y IS NOT NULL").groupBy("lid").agg(F.max(F.col("y").cast("int")).alias("y")).where("y IN (0, 1)"), "labels")
    n = known.count()
    side = F.broadcast(known) if n <= broadcast_labels else known
    share = min(1.0, fit_rows / n) if n else 1.0
    place = F.pmod(F.xxhash64("lid"), F.lit(1 << 30))
    rows = columns(docs, id_col, text_col).toDF("id", "text").join(side, F.col("id") == F.col("lid")).select("text", "y", F.when(place < int(share * (1 << 30)), place).alias("fit"))
    schema = StructType([*[StructField(c, LongType()) for c in ("bin", "ones", "zeros", "y", "place")], StructField("bins", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stamp, counts, docs_of = np.zeros(BINS, np.int32), np.zeros((2, BINS), np.int64), np.zeros(2, np.int64)
        for b in batches:
            y, fit = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
            for first, last, data, offsets in text_slices(b, 0):
                own_y, own_place, own = [], [], []
                for i, bins in enumerate(text_bins(data, offsets, stamp), first):
                    counts[y[i], bins] += 1
                    docs_of[y[i]] += 1
                    if fit[i] is not None:
                        own_y.append(int(y[i]))
                        own_place.append(fit[i])
                        own.append(np.sort(bins).astype("<u4").tobytes())
                none = pa.nulls(len(own), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array(own_y, pa.int64()), pa.array(own_place, pa.int64()), pa.array(own, pa.binary())], schema.names)
        at = np.flatnonzero(counts.any(axis=0))
        cols = [np.append(at, -1), np.append(counts[1, at], docs_of[1]), np.append(counts[0, at], docs_of[0])]
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.nulls(len(at) + 1, pa.int64()), pa.nulls(len(at) + 1, pa.int64()), pa.nulls(len(at) + 1, pa.binary())], schema.names)

    seen = materialize(rows.mapInArrow(run, schema), "quality-counts")
    got = seen.where("bin IS NOT NULL").groupBy("bin").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).toArrow()
    counts, total = np.zeros((2, BINS)), np.zeros(2)
    for at, one, zero in zip(*[got.column(c).to_numpy() for c in ("bin", "ones", "zeros")], strict=True):
        if at < 0:
            total[:] = zero, one
        else:
            counts[:, at] = zero, one
    if total.min() == 0:  # one class or none: a constant score
        score = float((total[1] + 0.5) / (total.sum() + 1)) if total.sum() else 0.5
        return Model(np.zeros(BINS, np.float32), np.zeros(BINS, np.float32), 0.0, 1.0, float(np.log(score / (1 - score))))
    p, q = counts[1] + SMOOTH, counts[0] + SMOOTH
    ratio = (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def fit_model(table: pa.Table) -> pa.Table:
        raw, y = table.column("bins").to_pylist(), np.where(table.column("y").to_numpy() > 0, 1.0, -1.0)
        order = sorted(range(len(raw)), key=lambda i: (raw[i], y[i]))  # the same fit whatever the order of rows
        bins, y = [np.frombuffer(raw[i], "<u4") for i in order], y[order]
        del raw
        values = []
        for at in bins:
            r = shared.value[at]
            values.append(r / np.float32(np.sqrt(r @ r) or 1.0))
        w = descend(bins, values, y)
        slope, offset = calibrate(np.array([w[at] @ v + w[-1] for at, v in zip(bins, values, strict=True)]), y)
        return pa.table({"weight": pa.array([w.tobytes()], pa.binary()), "slope": [slope], "offset": [offset]})

    picked = seen.where("bins IS NOT NULL")
    upto, total_bins = 1 << 30, 0
    for r in picked.groupBy("place").agg(F.sum(F.octet_length("bins") / 4).cast("long").alias("n")).orderBy("place").toLocalIterator():  # at most about ``fit_rows`` rows of two numbers
        total_bins += r["n"]
        if total_bins > fit_bins:
            upto = r["place"]
            break
    sample = picked.where(F.col("place") < upto).select("y", "bins", F.lit(0).alias("one"))
    made = sample.groupBy("one").applyInArrow(fit_model, "weight binary, slope double, offset double").first()
    if made is None:  # no row is within the bound
        return Model(ratio, np.zeros(BINS, np.float32), 0.0, 1.0, float(np.log((total[1] + 0.5) / (total[0] + 0.5))))
    w = np.frombuffer(made["weight"], np.float64)
    return Model(ratio, w[:-1].astype(np.float32), float(w[-1]), made["slope"], made["offset"])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text; only the text is read. A null or empty text has the score of a text without n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stamp, own = np.zeros(BINS, np.int32), shared.value
        for b in batches:
            scores = [own.score(bins) for _, _, data, offsets in text_slices(b, 1) for bins in text_bins(data, offsets, stamp)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], schema.names)

    return columns(docs, id_col, text_col).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """The fold whose labels are never read: CRC-32 of the id as text, modulo 4, is 2 (a null id has no label)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             fit_rows: int = FIT_ROWS, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """Quality score of every document: (id, held_out, score, predicted), a row for each input row.

    Learned from the labels of rows outside the held-out fold; of several
    labels of one id the largest counts, null ones don't. Without labels every
    score is 0.5; with one class it is constant. Null and repeated ids are rows like others; an empty table gives
    none; other columns are not read.
    """
    prepare(docs.sparkSession)
    model = train(docs, labels.where(~held_out("doc_id")), id_col, text_col, "doc_id", label_col, fit_rows, broadcast_labels)
    return score_documents(docs, model, id_col, text_col).select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
