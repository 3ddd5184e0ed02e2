"""Language identification by mixture inference over byte n-grams.

Training counts hashed byte trigrams per language. A document is a mixture of
languages: expectation-maximisation finds the proportions that make its
trigrams likeliest, and the set of languages is the one with the best likelihood
less a penalty for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import columns, prepare, text_slices

#: Bins of hashed trigrams: a model has this many numbers for each language, whatever the corpus.
BINS = 1 << 16
SMOOTH = 0.5
#: Penalty for a further language, times log(trigrams). Neighbouring trigrams share letters, so it is well over the usual 1/2.
PENALTY = 5.0
EM_STEPS = 12
UNKNOWN = "und"
#: A-Z in lower case, all other ASCII but letters as space.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def grams(data: np.ndarray) -> np.ndarray:
    """Bin of the trigram that starts at each byte but the last two; -1 where it begins with two spaces."""
    x = FOLD[data].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int32)
    code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    out = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
    out[(x[:-2] == 32) & (x[1:-1] == 32)] = -1
    return out


def gram_counts(data: np.ndarray, step: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(bins, counts) of one text."""
    total = np.bincount(grams(data[:step + 2]) + 1, minlength=BINS + 1)
    for at in range(step, len(data) - 2, step):
        total += np.bincount(grams(data[at:at + step + 2]) + 1, minlength=BINS + 1)
    bins = np.flatnonzero(total[1:])
    return bins, total[1:][bins]


def known_counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``gram_counts``; a text without a trigram of its own is read as a word between spaces."""
    bins, counts = gram_counts(data)
    return (bins, counts) if len(bins) else gram_counts(np.pad(data, 1, constant_values=32))


class Mixture:
    """Languages with their trigram log-likelihoods."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTH
        self.logp = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)

    def _em(self, like: np.ndarray, counts: np.ndarray, base: float) -> tuple[np.ndarray, float]:
        """Proportions and log-likelihood of the mixture of the rows of ``like``."""
        k, n = len(like), counts.sum()
        share = np.full(k, 1 / k)
        for _ in range(EM_STEPS if k > 1 else 0):
            part = share @ like
            share = share * (like @ (counts / part)) / n
        return share, base + float(counts @ np.log(share @ like))

    def infer(self, bins: np.ndarray, counts: np.ndarray) -> list[tuple[str, float]]:
        """Languages of the best set with their proportions, largest first."""
        if not len(self.langs):
            return []
        logp = self.logp[:, bins]
        top = logp.max(axis=0) if len(bins) else np.zeros(0, np.float32)
        like, base = np.exp((logp - top).astype(np.float64)), float(counts @ top) if len(bins) else 0.0
        if not len(bins):
            return [(self.langs[0], 1 / len(self.langs))]
        price = PENALTY * np.log(counts.sum() + 1)
        share, _ = self._em(like, counts, base)
        single = logp @ counts
        order = np.lexsort((np.arange(len(share)), -share))
        first = int(np.argmax(single))
        best, score = ([first], np.ones(1)), float(single[first])
        # the sets of the largest 2, 3, ... languages; one gives at most ``base`` less its penalties
        for k in range(2, len(self.langs) + 1):
            if base - (k - 1) * price <= score:
                break
            share_k, value = self._em(like[order[:k]], counts, base)
            if value - (k - 1) * price > score:
                best, score = (list(order[:k]), share_k), value - (k - 1) * price
        chosen = sorted(zip(best[0], best[1], strict=True), key=lambda x: (-x[1], self.langs[x[0]]))
        return [(self.langs[i], float(p)) for i, p in chosen]


def train(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their trigram counts over all rows that ``learn`` (a condition) takes and that have a language.

    Each task adds up its rows first, so a task sends at most one row per
    language and bin. The model, ``BINS`` numbers per language, comes to the driver.
    """
    schema = StructType([StructField("lang", StringType()), StructField("bin", LongType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for first, last, data, offsets in text_slices(b, 0):
                bins = np.append(grams(data), [-1, -1])[:len(data)] + 1
                for e in offsets[1:]:  # trigrams over the end of a text
                    bins[max(0, e - 2):e] = 0
                owner = np.repeat(np.arange(first, last), np.diff(offsets))
                codes = {x: i for i, x in enumerate(dict.fromkeys(langs[first:last]))}
                code = np.array([codes[x] for x in langs[first:last]], np.int64)[owner - first]
                counts = np.bincount(code * (BINS + 1) + bins, minlength=len(codes) * (BINS + 1)).reshape(-1, BINS + 1)[:, 1:]
                for x, i in codes.items():
                    if x is not None:
                        total[x] = total[x] + counts[i] if x in total else counts[i]
        for x, n in total.items():
            at = np.flatnonzero(n)
            if not len(at):  # the language is known, without any trigram
                at = np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], schema.names)

    rows = docs.where(learn).where(F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col).cast("string"))
    got = rows.mapInArrow(run, schema).groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BINS), np.int64)
    if langs:
        place = {x: i for i, x in enumerate(langs)}
        counts[[place[x] for x in got.column("lang").to_pylist()], got.column("bin").to_numpy()] = got.column("n").to_numpy()
    return langs, counts


def held_out(id_col: str = "doc_id"):
    """The fold that is never learned from: CRC-32 of the id as text, modulo 3, is 1 (a null id is never learned from either)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(docs: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             keep_above: float | None = None) -> DataFrame:
    """Languages of every whole text, learned from the rows of ``docs`` that ``learn`` takes.

    Returns (id, lang_pred, score, langs): the language with the largest
    proportion, that proportion, and the chosen set in order. ``und`` with
    score 0 if the text is null or has no letter, or if nothing was learned;
    a text too short for a trigram ("a", "ñ") counts as a word between spaces.
    Neither language, source nor id is read for a prediction. With
    ``keep_above`` it returns the rows themselves, all columns, without those that
    are ``und`` or whose score is lower (no language makes up that much of them).
    Null and repeated ids are rows like others (a null id is never learned
    from); ties go to the first language by name; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    learn = ~held_out(id_col) if learn is None else learn
    langs, counts = train(docs, learn, id_col, text_col, lang_col)
    shared = spark.sparkContext.broadcast((langs, counts))
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("langs", ArrayType(StringType()))])
    at = 1 if keep_above is None else docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Mixture(*shared.value)
        for b in batches:
            texts, made = b.column(at), []
            for first, last, data, offsets in text_slices(b, at):
                for i in range(first, last):
                    raw = data[offsets[i - first]:offsets[i - first + 1]]
                    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
                    known = bool(model.langs) and (bool(ascii_letter.any()) or has_letter(texts[i].as_py() or ""))
                    made.append(model.infer(*known_counts(raw)) if known else [(UNKNOWN, 0.0)])
            if keep_above is not None:
                yield b.filter(pa.array([m[0][0] != UNKNOWN and m[0][1] >= keep_above for m in made], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0][0] for m in made], pa.string()), pa.array([m[0][1] for m in made], pa.float64()), pa.array([[x for x, _ in m] for m in made], pa.list_(pa.string()))], schema.names)

    return docs.mapInArrow(run, docs.schema) if keep_above is not None else columns(docs, id_col, text_col).mapInArrow(run, schema)
