"""Packing along a space-filling curve.

Each text becomes a hashed vector, a fixed random projection takes it to a few
dimensions, and its Hilbert key is its place on a curve through that space.
Documents are range-sorted by key and laid end to end, so neighbours on the
curve share sequences; cutting at the sequence length leaves no padding but in
the last sequence.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import columns, materialize, prepare, text_slices

FEATURES = 256
DIMENSIONS = 3
#: Bits of a dimension; the key has DIMENSIONS * BITS.
BITS = 10
#: Leading bits of a key by which its running total is made first.
CELL_BITS = 16
SEED = 7
#: Bytes of text that a range of the curve has at least, and at most: the size aimed at, about (a text is not cut, so a longer one makes a larger range).
LEAST_BYTES, MOST_BYTES = 8 << 20, 128 << 20
#: Words, and pieces of words, whose ids a worker remembers (about 200 bytes each).
CACHE = 700_000

# Fixed values of byte-level BPE: the pattern of its pieces, and the letter that stands for each byte in its vocabulary.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def hashed_vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Relative frequencies of hashed four-byte runs, a row for each text (zero for fewer than four bytes)."""
    code = np.zeros(len(data), np.uint8)
    for first in range(min(4, max(len(data) - 3, 0))):  # the runs that start at first, first + 4, ...
        runs = data[first:first + (len(data) - first) // 4 * 4].view(">u4").astype(np.uint32)
        code[first:first + 4 * len(runs):4] = (runs * np.uint32(2654435761)) >> np.uint32(24)
    counts = [np.bincount(code[a:max(a, b - 3)], minlength=FEATURES) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.array(counts) / np.maximum(np.diff(offsets) - 3, 1)[:, None]


def project(vectors: np.ndarray, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Cells of the vectors in a few dimensions: signed random directions, squashed to the grid."""
    directions = np.random.default_rng(SEED).choice([-1.0, 1.0], (vectors.shape[1], dimensions))
    at = vectors @ directions * 4
    return np.minimum(((np.tanh(at) + 1) / 2 * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each cell on the Hilbert curve (Skilling's transform, all rows at a time)."""
    x = cells.T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Encoder(dict):
    """Token ids of texts, a word at a time, with the tokenizer file's own steps.

    The pre-tokenizer never joins a single space, or a single line break, to what stands before
    it, so the ids of a text are those of its words, each with the space
    before it. Words are looked up here and encoded by the library when new.
    Texts with runs of white space, or with a special token's own string, go to the
    library whole. Ids are kept as little-endian bytes of ``kind``.
    """

    _BREAKS = re.compile(r"\s[ \n]|\n\s")

    def __init__(self, path: str, cache: int = CACHE):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size(True) <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # words one by one only where the file says what is relied on here: byte-level with its own pattern, nothing else
        with open(path) as f:
            spec = json.load(f)
        steps, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.by_word = (steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps.get("add_prefix_space") and not spec.get("normalizer")
                        and not model.get("dropout") and not model.get("ignore_merges"))
        self.model = self.tokenizer.model
        self.line_break = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __missing__(self, word: str) -> bytes:
        """Ids of a word or of one piece of the pattern, which is a word of its own."""
        parts = [word] if word.isalpha() or word[:1] == " " and word[1:].isalpha() else PATTERN.findall(word)
        if len(parts) == 1:
            out = array(self.code, [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(BYTE_LETTERS))]).tobytes()
        else:
            out = b"".join(map(self.__getitem__, parts))
        if len(self) < self.cache:
            self[word] = out
        return out

    def _plain(self, text: str) -> bool:
        """Whether no white space follows other white space, and no special token's string is in the text."""
        if text.isascii() and not any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"):
            broken = any(x in text for x in ("  ", " \n", "\n ", "\n\n"))
        else:
            broken = self._BREAKS.search(text)
        return not broken and not any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        if not self.by_word or not self._plain(text):
            return self.whole(text)
        get, out = self.__getitem__, []
        for line in text.split("\n"):
            words = line.replace(" ", "\x00 ").split("\x00") if "\x00" not in line else None
            out.append(b"".join(map(get, words)) if words else self.whole(line))
        return self.line_break.join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and worker process; a reused worker keeps its words."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def ranges(size: int, tasks: int) -> int:
    """Ranges of the curve for ``size`` bytes of text: the session's ``tasks``, fewer for little text and as many more as it takes for much."""
    return max(1, min(tasks, -(-size // LEAST_BYTES)), -(-size // MOST_BYTES))


def _keys(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(Hilbert key, bytes) of each text of a batch."""
    keys, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in text_slices(batch, column):
        keys.append(hilbert_key(project(hashed_vectors(data, offsets))))
        sizes.append(np.diff(offsets))
    return np.concatenate(keys), np.concatenate(sizes)


def curve_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the curve with about as many bytes each: (first key, first part, parts) of each range, in order.

    The bytes at each key are summed and written, running totals are made in
    two levels (the cells of the key's leading bits, at most 2^CELL_BITS, then the keys of one cell), and
    a range ends where the total passes a multiple of the size aimed at. A single key
    with more than that, a group of copies, is a range of several parts. Only the ranges come to the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes = _keys(b, 0)
            key, at = np.unique(keys, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(at, sizes + 1, len(key)).astype(np.int64))], ["key", "w"])

    seen = columns(docs, text_col).mapInArrow(run, "key long, w long").groupBy("key").agg(F.sum("w").alias("w"))
    weights = materialize(seen.withColumn("cell", F.shiftright("key", DIMENSIONS * BITS - CELL_BITS)), "curve-weights")
    total = weights.agg(F.sum("w").alias("w")).first()["w"] or 0
    parts = ranges(total, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    aim = max(1, -(-total // parts))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell: bounded
    cells = weights.groupBy("cell").agg(F.sum("w").alias("__w")).select("cell", F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy("cell").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)  # at most 2^(30 - CELL_BITS) keys
    placed = weights.join(cells, "cell").select("key", "w", (F.col("__base") + F.coalesce(F.sum("w").over(inner), F.lit(0))).alias("at"))
    heavy = F.col("w") > aim
    starts = placed.groupBy(F.expr(f"at div {aim}").alias("range"), F.when(heavy, F.col("key")).alias("alone")).agg(F.min("key").alias("key"), F.max(F.when(heavy, F.col("w"))).alias("w"))
    first = {}
    for r in starts.select("key", "w").collect():
        first[r["key"]] = -(-r["w"] // aim) if r["w"] else 1
        if r["w"]:  # what comes behind a key of its own is another range
            first.setdefault(r["key"] + 1, 1)
    key = np.array(sorted(first) or [0], np.int64)
    many = np.array([first[k] for k in sorted(first)] or [1], np.int64)
    return key, np.cumsum(many) - many, many


def curve_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, key), range-sorted by Hilbert key over all partitions. A hash of the id parts rows of one key, so copies spread over tasks.

    The number of ranges grows with the bytes of the texts, and each has about as many bytes (``curve_ranges``).
    """
    shared = docs.sparkSession.sparkContext.broadcast(curve_ranges(docs, id_col, text_col))
    n = int(shared.value[2].sum())
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("text", StringType()), StructField("tie", LongType()), StructField("key", LongType()), StructField("part", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, base, many = shared.value
        for b in batches:
            key, _ = _keys(b, 1)
            at = np.maximum(np.searchsorted(first, key, side="right") - 1, 0)
            share = b.column(2).to_numpy(zero_copy_only=False) / 2.0 ** 64 + 0.5  # rises with the tie
            part = base[at] + np.minimum((share * many[at]).astype(np.int64), many[at] - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(key), pa.array(part)], schema.names)

    text = F.col(f"`{text_col}`").cast("string")
    tied = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(F.col(f"`{id_col}`"), F.octet_length(text)).alias("tie"))
    keyed = tied.mapInArrow(run, schema)
    return keyed.repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("key", "tie", "id").select("id", "text", "key")


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of ``length`` tokens along the curve.

    Returns one row per piece: (id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids), ids being the piece's token ids as little-endian
    unsigned 32-bit numbers. A document's ids end with ``end_id``; the laid-out
    ids are cut at each multiple of ``length``, so only the last sequence can be
    short. A null or empty text is the end id alone; null and repeated ids are
    documents of their own; an empty table gives no rows; other columns are
    not read. ``tokenizer`` is the path of a tokenizer file on every machine.

    Texts are shuffled once, in ranges of about equal bytes, tokenised where
    they lie in curve order and written; only the ranges and a token count per
    partition come to the driver.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    mid = StructType([StructField("id", kind), StructField("part", LongType()), StructField("at", LongType()), StructField("ids", BinaryType()), StructField("n", LongType())])

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.kind).tobytes()
        for b in batches:
            for first in range(0, b.num_rows, 500):
                rows = b.slice(first, 500)
                ids = [enc.encode(x.as_py() or "") + end for x in rows.column(1)]
                n = np.array([len(x) // enc.kind.itemsize for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(ids), part)), pa.array(starts), pa.array(ids, pa.binary()), pa.array(n)], mid.names)

    laid = materialize(curve_order(docs, id_col, text_col).mapInArrow(tokenise, mid), "tokens")
    totals = laid.groupBy("part").agg(F.sum("n").alias("n")).collect()
    base, bases = 0, {}
    for r in sorted(totals, key=lambda r: r["part"]):
        bases[r["part"]] = base
        base += r["n"]
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = StructType([StructField("id", kind), *[StructField(x, LongType()) for x in names], StructField("ids", BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                rows, owner, cols, ids = b.slice(lo, 500), [], [[] for _ in names], []
                for i, (part, at, raw, n) in enumerate(zip(*[rows.column(c).to_pylist() for c in range(1, 5)], strict=True)):
                    width = len(raw) // n
                    where, start = bases[part] + at, 0
                    while start < n:
                        size = min(n - start, length - where % length)
                        piece = raw[start * width:(start + size) * width]
                        if width != 4:
                            piece = np.frombuffer(piece, f"<u{width}").astype("<u4").tobytes()
                        owner.append(i)
                        ids.append(piece)
                        for c, v in zip(cols, (start, size, zlib.crc32(piece), n, where // length, where % length), strict=True):
                            c.append(v)
                        start, where = start + size, where + size
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, pa.int64()) for c in cols], pa.array(ids, pa.binary())], out.names)

    return laid.mapInArrow(cut, out)
