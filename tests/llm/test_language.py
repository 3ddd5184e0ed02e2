import numpy as np
import pytest
from agrispark.llm import language
from helpers import awkward, docs
from pyspark.sql import functions as F


def model():
    rng = np.random.default_rng(0)
    counts = np.zeros((3, language.BINS), np.int64)
    for k in range(3):
        counts[k, 100 * k:100 * k + 150] = rng.integers(5, 500, 150)  # neighbours share 50 bins
    return language.Mixture(["a", "b", "c"], counts), counts


def draw(counts, parts, n, seed):
    rng = np.random.default_rng(seed)
    p = sum(w * counts[k] / counts[k].sum() for k, w in parts.items())
    return np.unique(rng.choice(language.BINS, n, p=p), return_counts=True)


@pytest.mark.parametrize("parts", [{0: 1.0}, {1: 1.0}, {0: 0.7, 2: 0.3}, {1: 0.55, 2: 0.45}, {0: 0.5, 1: 0.3, 2: 0.2}])
def test_mixture_is_recovered(parts):
    mix, counts = model()
    got = dict(mix.infer(*draw(counts, parts, 3000, 4)))
    assert set(got) == {"abc"[k] for k in parts}
    assert all(abs(got["abc"[k]] - w) < 0.07 for k, w in parts.items()) and abs(sum(got.values()) - 1) < 1e-6


def test_chosen_set_is_the_best_of_all_sets():
    """Brute force over all sets of the largest languages, and one language by its own likelihood."""
    mix, counts = model()
    for seed, parts in enumerate([{0: 1.0}, {0: 0.8, 1: 0.2}, {2: 0.9, 0: 0.1}]):
        bins, n = draw(counts, parts, 400, seed)
        logp = mix.logp[:, bins].astype(float)
        price = language.PENALTY * np.log(n.sum() + 1)
        whole, _ = mix._em(np.exp(logp - logp.max(0)), n, 0.0)
        order = np.argsort(-whole)
        values = {(int(np.argmax(logp @ n)),): float((logp @ n).max())}
        for k in (2, 3):
            values[tuple(order[:k])] = mix._em(np.exp(logp - logp.max(0))[order[:k]], n, float(n @ logp.max(0)))[1] - (k - 1) * price
        assert {x for x, _ in mix.infer(bins, n)} == {"abc"[k] for k in max(values, key=values.get)}


def test_counts_equal_brute_force(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("ab cd", "x"), ("", "x"), (None, "x"), ("ÄB  cd", "y"), ("abc", None), ("a", "z"), ("Ab CD", "x")])]
    langs, counts = language.train(docs(spark, rows), F.lit(True))
    assert langs == ["x", "y", "z"]
    for k, name in enumerate(langs):
        want = np.zeros(language.BINS, np.int64)
        for _, t, lang in rows:
            if lang == name:
                bins, n = language.gram_counts(np.frombuffer((t or "").encode(), np.uint8))
                want[bins] += n
        assert (counts[k] == want).all()


def test_awkward_rows(spark):
    rows = [(*r, "en" if i % 2 else "de") for i, r in enumerate(awkward())] + [(50, "12345 !!", "en"), (51, "ñ", None)]
    got = language.identify(docs(spark, rows)).collect()
    assert sorted((r["id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    unknown = {r["id"] for r in got if r["lang_pred"] == "und"}
    assert {3, 4, 5, 50} <= unknown and not unknown & {1, 6, 7, 51}
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "und") for r in got)
    assert language.identify(docs(spark, [])).collect() == []
    df = docs(spark, rows)
    left = language.identify(df, keep_above=0.4)
    assert left.columns == df.columns and left.count() == sum(r["lang_pred"] != "und" and r["score"] >= 0.4 for r in got)


def test_nothing_learned(spark):
    got = language.identify(docs(spark, [(1, "some text", None), (2, "more text", None)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(df).withColumnRenamed("id", "doc_id").join(df, "doc_id").where(language.held_out())
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_long_text_in_steps():
    data = np.frombuffer(("Wörter und words " * 300).encode(), np.uint8)
    one, two = language.gram_counts(data), language.gram_counts(data, step=101)
    assert all((a == b).all() for a, b in zip(one, two, strict=True))


@pytest.mark.parametrize("n_langs", [2, 3, 5])
def test_texts_too_short_for_a_trigram_are_told_whatever_the_number_of_languages(spark, n_langs):
    rows = [(i, f"{w} und {w} " * 30, lang) for i, (lang, w) in enumerate([("x", "on"), ("y", "y"), ("z", "zu"), ("v", "va"), ("w", "we")][:n_langs])]
    short = [(10, "y", None), (11, "on", None), (12, "  y", None), (13, "ñ", None), (14, "1", None)]
    df = docs(spark, rows + short)
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in language.identify(df, F.lit(True)).collect()}
    assert got[10] == got[12] == ("y", 1.0) and got[11] == ("x", 1.0) and got[13][1] == 1.0 and got[14] == ("und", 0.0)
    assert {r["doc_id"] for r in language.identify(df, F.lit(True), keep_above=0.4).collect()} >= {10, 11, 12, 13}
