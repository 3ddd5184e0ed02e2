"""Line deduplication over sharded cuckoo filters and exact reference counts.

Exact postings (key, id) are the truth; counts per key follow from them. A
cuckoo filter per shard of keys answers "certainly not in the table" in
memory, takes deletions as well as insertions, and so spares most lines a
look-up in the exact tables: a filter only says which rows must be looked up, never
what to drop. ``LineIndex`` keeps both across batches of new and withdrawn
documents, as tables of changes; ``dedup_lines`` is one insertion and a pass over the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import columns, materialize, prepare, scratch_path

SLOTS = 4
#: Bytes that a filter takes for each key at most (slots of two bytes, at least two fifths of them full), and keys of one shard.
KEY_BYTES, SHARD_KEYS = 5, 500_000
#: Changes of an index that are read together before they are written as one.
COMPACT = 24
#: Total bytes of filters that may be broadcast; beyond it every line is looked up in the exact table.
FILTER_BYTES = 64 << 20
#: Bytes of the exact table of repeated keys (24 a key) that may be broadcast; beyond it keys are looked up by a join.
EXACT_BYTES = 64 << 20
WHITE = " \t\n\x0b\x0c\r"


def line_key(line: str) -> str:
    """The line without ASCII white space at its ends and with A-Z in lower case."""
    s = line.strip(WHITE)
    return s.lower() if s.isascii() else s.encode().lower().decode()


def key_digest(key: str) -> bytes:
    return hashlib.blake2b(key.encode(), digest_size=16).digest()


class CuckooFilter:
    """Cuckoo filter with 16-bit tags and four slots a bucket, over 64-bit hashes.

    A tag can move between two buckets, each the other's number xor a hash of
    the tag. When an insertion finds no place, the table doubles: it is built
    again from ``keys`` (all hashes in it), which the exact table holds.
    """

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets
        self.mask = np.uint64(len(buckets) - 1)

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        keys = np.unique(keys)
        size = 1
        while size * SLOTS * 0.85 < len(keys):
            size *= 2
        while True:
            made = cls(np.zeros((size, SLOTS), np.uint16))
            if made.insert(keys):
                return made
            size *= 2

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        tag = ((keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)  # 0 is an empty slot
        return tag, (keys & self.mask).astype(np.int64)

    def _other(self, tag: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ ((tag.astype(np.uint64) * np.uint64(0x5BD1E995)) & self.mask).astype(np.int64)

    def insert(self, keys: np.ndarray, rounds: int = 500) -> bool:
        """Insert hashes, all of them a round at a time; False if some found no place."""
        tag, bucket = self._places(keys)
        rng = np.random.default_rng(len(keys))
        for _ in range(rounds):
            for _side in range(2):
                for slot in range(SLOTS):
                    if not len(tag):
                        return True
                    free = np.flatnonzero(self.buckets[bucket, slot] == 0)
                    _, one = np.unique(bucket[free], return_index=True)  # one tag for a free slot
                    put = free[one]
                    self.buckets[bucket[put], slot] = tag[put]
                    rest = np.ones(len(tag), bool)
                    rest[put] = False
                    tag, bucket = tag[rest], bucket[rest]
                bucket = self._other(tag, bucket)
            # both buckets are full: take a victim's slot, the victim goes to its other bucket
            if not len(tag):
                return True
            _, one = np.unique(bucket, return_index=True)
            slot = rng.integers(0, SLOTS, len(one))
            victim = self.buckets[bucket[one], slot].copy()
            self.buckets[bucket[one], slot] = tag[one]
            tag[one] = victim
            bucket[one] = self._other(victim, bucket[one])
        return not len(tag)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        tag, bucket = self._places(keys)
        return (self.buckets[bucket] == tag[:, None]).any(1) | (self.buckets[self._other(tag, bucket)] == tag[:, None]).any(1)

    def delete(self, keys: np.ndarray) -> None:
        """Remove one copy of each hash; each must have been inserted."""
        for tag, a, b in zip(*(p := self._places(keys)), self._other(*p), strict=True):
            for bucket in (a, b):
                at = np.flatnonzero(self.buckets[bucket] == tag)
                if len(at):
                    self.buckets[bucket, at[0]] = 0
                    break


def shard_of(digests: list[bytes], shards: int) -> np.ndarray:
    """Shard of each digest: its second four bytes, as in ``_shard``."""
    return (np.frombuffer(b"".join(digests), ">u4")[1::4] % shards).astype(np.int64)


def _shard(shards: int):
    return F.pmod(F.conv(F.hex(F.substring("key", 5, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard")


def as_hash(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64)[::2]


def postings(docs: DataFrame, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id): digests of the document's different line keys of at least ``min_chars`` code points."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = [], []
            for i, x in enumerate(b.column(1)):
                own = {k for line in (x.as_py() or "").split("\n") if len(k := line_key(line)) >= min_chars}
                keys += map(key_digest, own)
                rows += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0).take(pa.array(rows, pa.int64()))], ["key", "id"])

    return columns(docs, id_col, text_col).mapInArrow(run, StructType([StructField("key", BinaryType()), StructField("id", kind)]))


def references(posts: DataFrame) -> DataFrame:
    """Exact reference counts: (key, n_docs, holder), holder being the largest id."""
    return posts.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("holder"))


def filters(keys: DataFrame, shards: int) -> DataFrame:
    """A cuckoo filter for each shard of the keys: (shard, filter). Shards are rows of their own, built side by side."""
    digest = keys.select("key", _shard(shards))

    def build(table: pa.Table) -> pa.Table:
        made = CuckooFilter.build(as_hash(table.column("key").to_pylist()))
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "filter": pa.array([made.buckets.tobytes()], pa.binary())})

    return digest.groupBy("shard").applyInArrow(build, "shard int, filter binary")


def make_filters(keys: DataFrame, shards: int, limit: int = FILTER_BYTES) -> list[bytes] | None:
    """The filters of a written table of keys, or None, and none built, if they could pass ``limit`` bytes.

    There are as many shards as keep each at some ``SHARD_KEYS`` keys, ``shards`` at least.
    """
    n = keys.count()
    if n * KEY_BYTES > limit:
        return None
    shards = max(shards, -(-n // SHARD_KEYS))
    out = [b""] * shards
    for r in filters(keys, shards).toLocalIterator():
        out[r["shard"]] = bytes(r["filter"])
    return out


def maybe_known(raw: list[bytes], digests: list[bytes]) -> np.ndarray:
    """For each digest whether its shard's filter has it."""
    hashes = as_hash(digests)
    home, out = shard_of(digests, len(raw)), np.zeros(len(hashes), bool)
    for s in np.unique(home):
        if raw[s]:
            mine = home == s
            out[mine] = CuckooFilter(np.frombuffer(raw[s], np.uint16).reshape(-1, SLOTS)).contains(hashes[mine])
    return out


class ExactTable:
    """Repeated keys and their holders, sorted: 24 bytes a key."""

    def __init__(self, keys: list[bytes], holders: np.ndarray):
        whole = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        order = np.lexsort((whole[:, 1], whole[:, 0]))
        self.first, self.second, self.holders = whole[order, 0], whole[order, 1], holders[order]

    def find(self, digests: list[bytes]) -> np.ndarray:
        """Place of each digest in the table, -1 without one."""
        whole = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        at = np.searchsorted(self.first, whole[:, 0])
        out = np.full(len(at), -1)
        live = at < len(self.first)
        while live.any():  # keys that share their first half stand next to each other
            live[live] = self.first[at[live]] == whole[live, 0]
            same = live & (self.second[np.minimum(at, len(self.first) - 1)] == whole[:, 1])
            out[same] = at[same]
            live &= ~same
            at = at + live
            live &= at < len(self.first)
        return out


def load_exact(repeated: DataFrame, limit: int = EXACT_BYTES) -> ExactTable | None:
    """The exact table, if its ids are whole numbers and it has ``limit`` bytes at most; else None."""
    if not isinstance(repeated.schema["holder"].dataType, (LongType, IntegerType)) or repeated.count() * 24 > limit:
        return None
    got = repeated.where("holder IS NOT NULL").toArrow()  # without a holder every id is null, and none loses a line
    return ExactTable(got.column("key").to_pylist(), got.column("holder").to_numpy().astype(np.int64))


def _apply(text: str, drop: set[bytes], min_chars: int) -> tuple[int, int, str]:
    lines = text.split("\n")
    kept = [x for x in lines if not (len(k := line_key(x)) >= min_chars and key_digest(k) in drop)] if drop else lines
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def drop_repeated_lines(docs: DataFrame, refs: DataFrame, min_docs: int = 5, min_chars: int = 40, shards: int = 64,
                        id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES, exact_bytes: int = EXACT_BYTES) -> DataFrame:
    """Documents without the lines that ``refs`` counts in ``min_docs`` or more documents, but for the holder's.

    Returns (id, n_lines, n_dropped, text). Filters over the repeated keys tell
    which lines may be among them; those are looked up in the exact table:
    where they were read while that table is small enough to go out, else by a
    join that shuffles only documents with a line in question. Either way
    gives the same rows.
    """
    repeated = materialize(refs.where(F.col("n_docs") >= min_docs).select("key", "holder"), "repeated")
    raw = make_filters(repeated, shards, filter_bytes)
    exact = load_exact(repeated, exact_bytes)
    shared = docs.sparkSession.sparkContext.broadcast((raw, exact))
    kind = docs.schema[id_col].dataType
    schema = StructType([StructField("id", kind), StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("text", StringType()), StructField("ask", ArrayType(BinaryType()))])
    arrow = [pa.int64(), pa.int64(), pa.string()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, exact = shared.value
        for b in batches:
            texts, ids = [x or "" for x in b.column(1).to_pylist()], b.column(0).to_pylist()
            keys, owner = [], []
            for i, t in enumerate(texts):
                own = {k for x in t.split("\n") if len(k := line_key(x)) >= min_chars}
                keys += map(key_digest, own)
                owner += [i] * len(own)
            hits = np.flatnonzero(maybe_known(raw, keys)) if raw is not None and keys else np.arange(len(keys))
            ask: list[set[bytes]] = [set() for _ in texts]
            if exact is not None and len(hits):
                at = exact.find([keys[j] for j in hits])
                hits = [j for j, k in zip(hits, at, strict=True) if k >= 0 and exact.holders[k] != ids[owner[j]]]
            for j in hits:
                ask[owner[j]].add(keys[j])
            made = [_apply(t, a if exact is not None else set(), min_chars) for t, a in zip(texts, ask, strict=True)]
            cols = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), arrow, strict=True)] if made else [pa.array([], k) for k in arrow]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([list(a) for a in ask], pa.list_(pa.binary()))], schema.names)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_apply(t, set(d or ()), min_chars) for t, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), arrow, strict=True)] if made else [pa.array([], k) for k in arrow]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], schema.names[:4])

    scanned = columns(docs, id_col, text_col).mapInArrow(scan, schema)
    if exact is not None:
        return scanned.drop("ask")
    scanned = materialize(scanned, "scanned")
    done = scanned.where("size(ask) = 0").drop("ask")
    open_ = scanned.where("size(ask) > 0")
    asked = open_.select("id", F.explode("ask").alias("key")).distinct()
    lost = asked.join(repeated, "key").where(~F.col("id").eqNullSafe(F.col("holder"))).groupBy("id").agg(F.collect_set("key").alias("drop"))
    lost = materialize(lost.select(F.col("id").alias("lost_id"), "drop"), "lost")
    rest = open_.join(lost, F.col("id").eqNullSafe(F.col("lost_id")), "left").select("id", "text", "drop")
    return done.unionByName(rest.mapInArrow(finish, StructType(schema.fields[:4])))


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text",
                filter_bytes: int = FILTER_BYTES, exact_bytes: int = EXACT_BYTES) -> DataFrame:
    """Drop lines that occur in many documents from all but the largest id that has them.

    Returns (id, n_lines, n_dropped, text), a row for each input row. Lines
    end at \\n; a null or empty text is one empty line. Keys are counted per
    different id, null being one id (the lowest); rows that repeat an id count
    once and lose or keep lines alike. Empty table: no rows. Other columns are not read.
    """
    index = LineIndex(docs.sparkSession, min_chars, filter_bytes=filter_bytes)
    index.insert(docs, id_col, text_col)
    return index.apply(docs, min_docs, id_col, text_col, exact_bytes)


class LineIndex:
    """Incremental, reversible line index: exact postings and reference counts as tables of changes, cuckoo filters over the keys.

    ``insert`` writes the postings and counts of its documents, ``delete`` the
    ids it takes back and the counts that go with them; nothing written
    before is touched, so a lost executor or a failed run changes nothing. Readers add the changes up.
    After ``COMPACT`` changes they are written as one. Ids must be unique (rows
    of one id in one insertion count once); inserting a known id again has no effect.
    """

    def __init__(self, spark: SparkSession, min_chars: int = 40, shards: int = 64, filter_bytes: int = FILTER_BYTES):
        self.spark, self.min_chars, self.shards, self.filter_bytes = prepare(spark), min_chars, shards, filter_bytes
        self.path, self.raw, self.version = scratch_path(spark, "line-index"), None, 0
        self.built = False  # filters are made when an insertion first needs them
        self.tables: dict[str, list[str]] = {"posts": [], "counts": [], "gone": []}

    def _add(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{self.version}/{name}"
        df.write.parquet(path)
        self.tables[name].append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*self.tables[name])

    @property
    def posts(self) -> DataFrame:
        """(key, id) of the documents that are in the index."""
        posts = self._read("posts")
        if not self.tables["gone"]:
            return posts.select("key", "id")
        last = self._read("gone").groupBy("gone").agg(F.max("until").alias("until"))
        live = posts.join(last, F.col("id").eqNullSafe(F.col("gone")), "left").where(F.col("until").isNull() | (F.col("version") > F.col("until")))
        return live.select("key", "id")

    @property
    def refs(self) -> DataFrame:
        """Exact reference counts: (key, n_docs, holder) of every key with a document, all changes added up.

        Only keys that a deletion has touched have their holder looked up in the postings.
        """
        total = self._read("counts").groupBy("key").agg(F.sum("n").alias("n_docs"), F.max("holder").alias("holder"), F.max("touched").alias("touched")).where("n_docs > 0")
        if not self.tables["gone"]:
            return total.drop("touched")
        total = materialize(total, "line-counts")
        touched = total.where("touched").select("key", "n_docs")
        again = self.posts.join(touched.select("key"), "key", "left_semi").groupBy("key").agg(F.max("id").alias("holder"))
        return total.where("not touched").drop("touched").unionByName(touched.join(again, "key"))

    def _known(self, posts: DataFrame) -> DataFrame:
        """posts with ``known``: False where the key is certainly not in the exact table."""
        if self.raw is None:
            return posts.withColumn("known", F.lit(True))
        shared = self.spark.sparkContext.broadcast(self.raw)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(maybe_known(shared.value, keys) if keys else [], pa.bool_())], [*b.schema.names, "known"])

        return posts.mapInArrow(run, StructType([*posts.schema.fields, StructField("known", BooleanType())]))

    def _count(self, posts: DataFrame) -> DataFrame:
        return posts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("holder"))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Count the documents' lines. Only keys that a filter may have are looked up in the exact tables."""
        new = postings(docs, self.min_chars, id_col, text_col).distinct()
        fresh = None
        if self.tables["posts"]:
            if not self.built:
                self.raw, self.built = make_filters(materialize(self.refs.select("key"), "index-keys"), self.shards, self.filter_bytes), True
            new = materialize(self._known(new), "new-lines")
            old = new.where("known").drop("known").join(self.posts, ["key", "id"], "left_anti")
            new = materialize(old.unionByName(new.where("not known").drop("known")), "added-lines")
            fresh = materialize(new.select("key").distinct().join(self.refs.select("key"), "key", "left_anti"), "fresh-lines") if self.raw is not None else None
        self.version += 1
        added = self._add("posts", new.withColumn("version", F.lit(self.version)))
        self._add("counts", self._count(added).withColumn("touched", F.lit(False)))
        if fresh is not None:
            self._change(fresh, "insert")
        self._compact()

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Take documents back: their references go, and keys without any leave the filters. Writes only what goes with them."""
        if not self.tables["posts"]:
            return
        gone = materialize(columns(ids, id_col).toDF("gone").distinct(), "gone-ids")
        lost = self._count(self.posts.join(gone, F.col("id").eqNullSafe(F.col("gone")), "left_semi"))
        lost = materialize(lost.select("key", (-F.col("n")).alias("n"), F.lit(None).cast(lost.schema["holder"].dataType).alias("holder"), F.lit(True).alias("touched")), "lost-counts")
        until, self.version = self.version, self.version + 1
        self._add("counts", lost)
        self._add("gone", gone.withColumn("until", F.lit(until)))
        if self.raw is not None:
            left = self._read("counts").join(lost.select("key"), "key", "left_semi").groupBy("key").agg(F.sum("n").alias("n"))
            self._change(materialize(left.where("n <= 0").select("key"), "gone-lines"), "delete")
        self._compact()

    def _compact(self) -> None:
        """Write all changes as one, now and then, so that readers open few files."""
        if len(self.tables["counts"]) < COMPACT:
            return
        posts, refs = self.posts.withColumn("version", F.lit(self.version)), self.refs
        self.version += 1
        old, self.tables = self.tables, {"posts": [], "counts": [], "gone": []}
        try:
            self._add("posts", posts)
            self._add("counts", refs.select("key", F.col("n_docs").alias("n"), "holder", F.lit(False).alias("touched")))
        except BaseException:
            self.tables = old
            raise

    def _change(self, keys: DataFrame, how: str) -> None:
        """Insert or delete keys in the filters, a shard at a time in parallel; where a shard is full, all are built again from the exact table."""
        shared, shards = self.spark.sparkContext.broadcast(self.raw), len(self.raw)

        def run(table: pa.Table) -> pa.Table:
            s = table.column("shard")[0].as_py()
            hashes = np.unique(as_hash(table.column("key").to_pylist()))
            raw = shared.value[s]
            made = CuckooFilter(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()) if raw else CuckooFilter(np.zeros((1, SLOTS), np.uint16))
            done = made.insert(hashes) if how == "insert" else made.delete(hashes) is None
            return pa.table({"shard": pa.array([s], pa.int32()), "filter": pa.array([made.buckets.tobytes() if done else None], pa.binary())})

        full = False
        for r in keys.select("key", _shard(shards)).groupBy("shard").applyInArrow(run, "shard int, filter binary").toLocalIterator():
            if r["filter"] is None:
                full = True
            else:
                self.raw[r["shard"]] = bytes(r["filter"])
        if full:
            self.raw = make_filters(materialize(self.refs.select("key"), "index-keys"), self.shards, self.filter_bytes)

    def apply(self, docs: DataFrame, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", exact_bytes: int = EXACT_BYTES) -> DataFrame:
        """``drop_repeated_lines`` with this index's counts."""
        return drop_repeated_lines(docs, self.refs, min_docs, self.min_chars, self.shards, id_col, text_col, self.filter_bytes, exact_bytes)
