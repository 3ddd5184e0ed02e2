import numpy as np
import pytest
from agrispark.llm import quality
from helpers import SF, awkward, docs
from pyspark.sql import functions as F


def slow_bins(raw):
    """Different bins of one text, n-gram by n-gram."""
    out = set()
    one = lambda code, salt: out.add(int(quality._bin(np.array([code], np.uint64), salt)[0]))
    for n in (3, 4):
        for i in range(len(raw) - n + 1):
            one(int.from_bytes(raw[i:i + n], "big"), n << 40)
    shapes, before = [], None
    for w in raw.split():
        shape = 0
        for b in w:
            shape |= int(quality._CLASS[b])
        shapes.append(shape | (w == before) << 5)
        before = w
    for n in range(1, 5):
        for i in range(len(shapes) - n + 1):
            code = 0
            for s in shapes[i:i + n]:
                code = code << 6 | s
            one(code, (8 + n) << 40)
    return sorted(out)


TEXTS = ["", "a", "ab cd", "  lead and trail  ", "Same same same SAME", "x\n\ny 12 Ünï $$$ ***", "one two two three"]


def test_bins_equal_brute_force(monkeypatch):
    raws = [t.encode() for t in TEXTS]
    stamp = np.zeros(quality.BINS, np.int32)
    data, offsets = np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])
    got = [sorted(x.tolist()) for x in quality.text_bins(data, offsets, stamp)]
    assert got == [slow_bins(r) for r in raws]


def test_descent_reaches_the_dual_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0, 1.0, -1.0)
    w = quality.descend([np.arange(8)] * 60, list(x), y, cost=0.5, epochs=3000, n_bins=8)
    primal = lambda w: w @ w / 2 + 0.5 * np.maximum(0, 1 - y * (x @ w[:8] + w[8])).sum()
    best = primal(w)
    for _ in range(300):
        assert primal(w + rng.normal(size=9) * rng.choice([1e-3, 1e-2, 0.1])) >= best - 1e-4


def test_calibration_follows_the_odds():
    margins = np.repeat([-1.0, 1.0], 200)
    y = np.concatenate((np.repeat([1.0, -1.0], [40, 160]), np.repeat([1.0, -1.0], [160, 40])))
    a, b = quality.calibrate(margins, y)
    assert abs(1 / (1 + np.exp(-(a + b))) - 0.8) < 0.01 and abs(1 / (1 + np.exp(a - b)) - 0.2) < 0.01


def labels(spark, rows):
    return spark.createDataFrame([(*r, None, "clash") for r in rows], "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize("bound", [quality.BROADCAST_LABELS, 0])
def test_held_out_quality(spark, bound):
    """Labels of the held-out fold are never read, by either way of joining them."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    lied = lab.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    got = quality.classify(df, lied, broadcast_labels=bound)
    far = got.withColumnRenamed("id", "doc_id").join(lab, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    assert (far["predicted"] == far["quality"]).mean() > 0.97
    good, bad = far[far["quality"] == 1]["score"], far[far["quality"] == 0]["score"]
    assert len(bad) and (good.to_numpy()[:, None] > bad.to_numpy()).mean() > 0.98


def test_awkward_rows(spark):
    rows = awkward()
    got = quality.classify(docs(spark, rows), labels(spark, [(1, 1), (6, 0), (6, None), (8, 0), (9, 1), (9, 0), (None, 1), (77, 1), (10, 2)])).collect()
    assert sorted((r["id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert len({r["score"] for r in got if r["id"] in (3, 4)}) == 1
    for few in ([], [(1, 1)], [(2, None)]):
        flat = quality.classify(docs(spark, rows), labels(spark, few)).collect()
        assert len({r["score"] for r in flat}) == 1 and len(flat) == len(rows)
    assert quality.classify(docs(spark, []), labels(spark, [(1, 1)])).collect() == []


def test_long_text_in_steps(monkeypatch):
    raw = ("Some words of a long text, with $$$ and ÜÜ. " * 50).encode()
    stamp = np.zeros(quality.BINS, np.int32)
    whole = set(next(quality.text_bins(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), stamp)).tolist())
    monkeypatch.setattr(quality, "STEP", 300)
    steps = set(next(quality.text_bins(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), stamp)).tolist())
    shapes = {int(x) for x in whole}  # steps may cut a word in two, which only adds shapes
    assert shapes <= steps


def test_the_fit_is_bounded_in_bins(spark):
    """Rows are taken in the order of the hash until the bound; the class counts stay whole, and a bound under the first row leaves the prior."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    whole, tight, none = (quality.train(df, labels, fit_bins=n) for n in (quality.FIT_BINS, 20_000, 1))
    assert (whole.ratio == tight.ratio).all() and (whole.ratio == none.ratio).all()
    assert np.abs(whole.weight).sum() > 0 and (whole.weight != tight.weight).any()
    assert not none.weight.any() and 0 < none.score(np.array([1, 2])) < 1
