"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks; each chunk has a polynomial hash, and the hash of a
text follows from those of its chunks: ``H(ab) = H(a) * B^len(b) + H(b)``. The
chunks of a huge text can so be hashed side by side, in one step or in
different tasks (``combine_chunks``). Texts of one fingerprint are then
compared chunk by chunk, so a chance hit never merges two texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import columns, materialize, prepare, text_slices

#: Two primes below 2^31 and a base for each: a 62-bit fingerprint whose products fit 64 bits.
PRIMES = ((2147483647, 1048583), (2147483629, 1299721))
#: Bytes of a chunk. 65,536 products of a byte and a residue sum to less than 2^55.
CHUNK = 1 << 16
#: Bytes from which a text's chunks are dealt out and hashed in different tasks.
HUGE = 8 << 20
#: Bits of the table of fingerprints that occur more than once (a bound: 4 MB, whatever the corpus).
FILTER_BITS = 1 << 25


class Polynomial:
    """Polynomial hash modulo one prime; a byte counts as its value plus one."""

    def __init__(self, prime: int, base: int):
        self.prime, self.base = prime, base
        powers = np.ones(1, np.uint64)
        while len(powers) < CHUNK:  # doubles: the second half is the first, shifted
            powers = np.concatenate((powers, powers * np.uint64(pow(base, len(powers), prime)) % np.uint64(prime)))
        self.powers = powers

    def chunks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the chunks [start, end) that lie one after another in ``data``; none is empty."""
        after = np.repeat(ends, ends - starts) - 1 - np.arange(len(data))
        terms = (data.astype(np.uint64) + np.uint64(1)) * self.powers[after]
        return np.add.reduceat(terms, starts) % np.uint64(self.prime)

    def shift(self, n: int) -> int:
        return pow(self.base, n, self.prime)

    def combine(self, left: int, right: int, right_length: int) -> int:
        """Hash of two texts put together."""
        return (left * self.shift(right_length) + right) % self.prime


def fingerprint_slice(polynomials: list[Polynomial], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints, one row for each text of the slice, from the hashes of its chunks."""
    lengths = np.diff(offsets)
    n_chunks = -(-lengths // CHUNK)
    owner = np.repeat(np.arange(len(lengths)), n_chunks)
    out = np.zeros((len(lengths), len(polynomials)), np.int64)
    if not len(owner):
        return out
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    starts = offsets[owner] + nth * CHUNK
    ends = np.minimum(starts + CHUNK, offsets[owner + 1])
    for k, poly in enumerate(polynomials):
        shift_chunk = poly.shift(CHUNK)
        hashes = []
        step = 32  # chunks at a time, so a huge text needs little memory
        many = ends[-1] - starts[0] > step * CHUNK
        for a in range(0, len(owner), step if many else len(owner)):
            b = a + step if many else len(owner)
            s, e = starts[a:b], ends[a:b]
            hashes.append(poly.chunks(data[s[0]:e[-1]], s - s[0], e - s[0]))
        hashes = np.concatenate(hashes).astype(np.int64)
        single = n_chunks[owner] == 1
        out[owner[single], k] = hashes[single]
        for i in np.flatnonzero(n_chunks > 1):
            h = 0
            mine = np.flatnonzero(owner == i)
            for j in mine:
                length = int(ends[j] - starts[j])
                h = (h * (shift_chunk if length == CHUNK else poly.shift(length)) + int(hashes[j])) % poly.prime
            out[i, k] = h
    return out


def combine_chunks(chunks: DataFrame, key: list[str], primes=PRIMES) -> DataFrame:
    """Fingerprints of texts that are stored as rows of chunks.

    ``chunks`` has the key columns, ``after`` (bytes of the text behind the
    chunk) and ``data`` (binary, up to ``CHUNK`` bytes). Each chunk is hashed
    and shifted in whatever task it is; only sums modulo the primes are
    shuffled. Returns key, n_bytes, h1, h2. A null chunk counts as empty.
    """
    prepare(chunks.sparkSession)
    names = [f"h{i + 1}" for i in range(len(primes))]
    fields = [chunks.schema[k] for k in key] + [StructField("n", LongType())] + [StructField(n, LongType()) for n in names]
    primes = [tuple(map(int, p)) for p in primes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        polys = [Polynomial(*p) for p in primes]
        for b in batches:
            data = [x.as_py() or b"" for x in b.column(len(key) + 1)]
            after = [x.as_py() or 0 for x in b.column(len(key))]
            cols = [[], *[[] for _ in polys]]
            for raw, n in zip(data, after, strict=True):
                cols[0].append(len(raw))
                one = fingerprint_slice(polys, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
                for k, p in enumerate(polys):
                    cols[k + 1].append(int(one[k]) * p.shift(n) % p.prime)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(key))], *[pa.array(c, pa.int64()) for c in cols]], [f.name for f in fields])

    hashed = columns(chunks, *key, "after", "data").mapInArrow(run, StructType(fields))
    return hashed.groupBy(*key).agg(F.sum("n").alias("n_bytes"), *[F.expr(f"cast(pmod(sum({n}), {p}) as long)").alias(n) for n, (p, _) in zip(names, primes, strict=True)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes=PRIMES, chunk_rows: bytes | None = None, huge: int = HUGE) -> DataFrame:
    """(id, n_bytes, h1, h2, sha): length, fingerprint and SHA-256 of every whole text in UTF-8.

    Texts of more than ``huge`` bytes have no fingerprint yet (``huge_chunks`` makes it). With
    ``chunk_rows`` (the table of repeated fingerprints) it returns the chunks of the
    other texts that are in it instead: (n_bytes, h1, h2, sha, chunk, data).
    """
    primes = [tuple(map(int, p)) for p in primes]
    shared = docs.sparkSession.sparkContext.broadcast(chunk_rows) if chunk_rows is not None else None
    head = [StructField("id", docs.schema[id_col].dataType)]
    tail = [StructField("n_bytes", LongType()), StructField("h1", LongType()), StructField("h2", LongType()), StructField("sha", StringType())]
    schema = StructType(head + tail if shared is None else tail + [StructField("chunk", LongType()), StructField("data", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        polys = [Polynomial(*p) for p in primes]
        table = np.frombuffer(shared.value, np.uint8) if shared is not None else None
        for b in batches:
            for first, last, data, offsets in text_slices(b, 1):
                sizes, view = np.diff(offsets), memoryview(data)
                far = sizes > huge
                fp = np.zeros((len(sizes), len(polys)), np.int64) if far.all() else fingerprint_slice(polys, data, offsets)
                sha = lambda i: hashlib.sha256(view[offsets[i]:offsets[i + 1]]).hexdigest()  # noqa: B023, E731
                if table is None:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(sizes), pa.array(fp[:, 0], mask=far), pa.array(fp[:, 1], mask=far), pa.array([sha(i) for i in range(last - first)])], schema.names)
                    continue
                slot = filter_slot(sizes, fp[:, 0], fp[:, 1])
                for i in np.flatnonzero(table[slot >> 3] >> (slot & 7) & 1 & ~far):
                    parts = range(0, max(1, int(sizes[i])), CHUNK)
                    k, lo = len(parts), int(offsets[i])
                    yield pa.RecordBatch.from_arrays([pa.array([int(x)] * k, pa.int64()) for x in (sizes[i], fp[i, 0], fp[i, 1])] + [pa.array([sha(i)] * k), pa.array(range(k), pa.int64()), pa.array([bytes(view[lo + at:min(lo + at + CHUNK, int(offsets[i + 1]))]) for at in parts], pa.binary())], schema.names)

    return columns(docs, id_col, text_col).mapInArrow(run, schema)


def huge_chunks(docs: DataFrame, text_col: str, huge: int = HUGE) -> DataFrame:
    """(sha, row, chunk, after, data): the chunks of every text of more than ``huge`` bytes, written, so that any task can take any of them."""
    raw = columns(docs, text_col).toDF("text").where(F.octet_length("text") > huge).select(
        F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("row"), F.octet_length("text").cast("long").alias("n"), F.col("text").cast("binary").alias("raw"))
    count = ((F.col("n") + CHUNK - 1) / CHUNK).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(
        i.cast("long").alias("chunk"), F.greatest(F.col("n") - (i + 1).cast("long") * CHUNK, F.lit(0)).alias("after"), F.substring("raw", i * CHUNK + 1, F.lit(CHUNK)).alias("data")))
    return materialize(raw.select("sha", "row", F.inline(parts)), "huge-chunks")


def filter_slot(n_bytes, h1, h2):
    """Bit of a fingerprint in the table of repeated ones (the same sum as in ``_repeated``)."""
    return (n_bytes + h1 + h2) % FILTER_BITS


def _repeated(groups: DataFrame) -> bytes:
    """Bit table of the fingerprints of more than one row.

    At most ``FILTER_BITS`` bits come to the driver, as rows of 4 KB that
    Spark has put together. A bit set by chance only sends more rows on.
    """
    slot = groups.where("group_size > 1").select(F.expr(f"pmod(n_bytes + h1 + h2, {FILTER_BITS})").alias("slot"))
    rows = slot.groupBy(F.expr("slot div 32768").alias("at")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("bits")).collect()
    table = bytearray(FILTER_BITS // 8)
    for r in rows:
        table[r["at"] * 4096:(r["at"] + 1) * 4096] = r["bits"]
    return bytes(table)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primes=PRIMES, huge: int = HUGE) -> DataFrame:
    """Group of equal texts of every row: (id, keep_id, group_size, kept, text_sha256).

    Rows are equal when their texts are identical (null counts as empty). Of
    each group the row with the largest id stays, ids in Spark's order, null
    lowest; of repeated rows with that id one stays. Fingerprint groups are
    verified by comparing their texts chunk by chunk (least and greatest chunk
    at each place, combined before the shuffle, so a group never meets in one
    task); a group that holds different texts is split by SHA-256. Empty table:
    no rows. Other columns are not read. Chunks of a text of more than ``huge``
    bytes are hashed in different tasks and combined (``combine_chunks``).
    """
    prepare(docs.sparkSession)
    rows = materialize(fingerprints(docs, id_col, text_col, primes, huge=huge), "fingerprints")
    key = ["n_bytes", "h1", "h2"]
    parts = None
    if rows.where("h1 IS NULL").limit(1).count():
        parts = huge_chunks(docs, text_col, huge)
        made = combine_chunks(parts, ["sha", "row"], primes).groupBy("sha").agg(F.max("h1").alias("m1"), F.max("h2").alias("m2"))  # copies have the same
        made = materialize(made, "huge-fingerprints")
        rows = materialize(rows.join(made, "sha", "left").select("id", "n_bytes", F.coalesce("h1", "m1").alias("h1"), F.coalesce("h2", "m2").alias("h2"), "sha"), "all-fingerprints")
        sized = parts.groupBy("sha", "row").agg(F.sum(F.octet_length("data")).cast("long").alias("n_bytes")).groupBy("sha").agg(F.max("n_bytes").alias("n_bytes"))
        parts = parts.join(made.join(sized, "sha").select("sha", "n_bytes", F.col("m1").alias("h1"), F.col("m2").alias("h2")), "sha").select(*key, "chunk", "data")
    groups = materialize(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id")), "groups")
    chunks = fingerprints(docs, id_col, text_col, primes, _repeated(groups), huge).drop("sha")
    if parts is not None:
        chunks = chunks.unionByName(parts)
    unequal = (chunks.groupBy(*key, "chunk").agg(F.min("data").alias("least"), F.max("data").alias("greatest"))
               .where("least <> greatest").select(*key).distinct().withColumn("split", F.lit(True)))
    unequal = materialize(unequal, "unequal")
    one = groups.join(unequal, key, "left_anti")
    split = (rows.join(unequal, key, "left_semi").groupBy(*key, "sha").agg(F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id")))
    named = materialize(one.withColumn("sub", F.lit("")).unionByName(split.withColumnRenamed("sha", "sub")), "named")
    w = Window.partitionBy("id", *key, "sha").orderBy("id")
    ranked = rows.withColumn("nth", F.row_number().over(w))
    # rows of a split group carry their digest as a further key
    marked = materialize(ranked.join(unequal, key, "left").withColumn("sub", F.when(F.col("split"), F.col("sha")).otherwise("")), "marked")
    return marked.join(named, [*key, "sub"]).select(
        "id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
