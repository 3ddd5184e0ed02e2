"""SimHash near-duplicate groups over a Gray-order hierarchical index.

Fingerprints that differ in at most two of 64 bits agree on at least one of
three bit blocks. Those shared masked patterns are the upper nodes of the
index: every distinct fingerprint is filed under its three (block, pattern)
nodes, and only fingerprints below one node are compared. Below a node they are sorted by
Gray rank, so neighbours differ in few bits, and runs of them form lower nodes
that hold the bits all members share. A search walks down, adds up the
differences to each node's newly shared bits, and leaves a whole group as soon
as the sum is over the limit.

Only distinct fingerprints are indexed and only a spanning forest of each
node's links leaves a task, so copies and dense groups never become pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import columns, materialize, prepare
from .components import connected_components

SEED = 42
#: Bits of the three blocks, from the lowest bit.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: A node with more distinct fingerprints than this is searched by shared midpoints (exact, see ``_midpoint_links``).
NODE_LIMIT = 2048
#: Members of a lowest node, and children of an upper one.
FANOUT = 16
_CHUNK = 1 << 15


def fingerprint_bytes(raw: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a text in UTF-8: majority bits of its shingles' XXH64."""
    words = raw.lower().split()  # bytes: only A-Z changes, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        part = words[at:min(at + _CHUNK, n) + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        m = len(part) - shingle + 1
        h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[:m].tolist(), (ends[shingle - 1:] - 1).tolist(), strict=True)], np.uint64, m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, sha): signed 64-bit fingerprint of every whole text, and its SHA-256, which tells rows with one id apart."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, sha = [], []
            for x in b.column(1):
                raw = (x.as_py() or "").encode()
                fp.append(fingerprint_bytes(raw, shingle))
                sha.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(sha, pa.string())], ["id", "fp", "sha"])

    return columns(docs, id_col, text_col).mapInArrow(run, StructType([StructField("id", kind), StructField("fp", LongType()), StructField("sha", StringType())]))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray order (the inverse Gray code)."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchical index over fingerprints of several upper nodes.

    ``fps`` is sorted by (group, Gray rank). ``levels[0]`` are the fingerprints;
    each further level has one node for ``FANOUT`` of those below, up to a
    single node for a group. A node keeps the bits on which everything below
    agrees; a child's own bits are those that its parent doesn't have.
    """

    def __init__(self, fps: np.ndarray, groups: np.ndarray, fanout: int = FANOUT):
        self.fps = fps
        agree, pattern, group = np.full(len(fps), ~np.uint64(0)), fps, groups
        self.levels = [(agree, pattern)]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while len(group) > len(np.unique(group)):
            start_of = np.concatenate(([True], group[1:] != group[:-1]))
            base = np.maximum.accumulate(np.where(start_of, np.arange(len(group)), 0))
            first = np.flatnonzero((np.arange(len(group)) - base) % fanout == 0)
            ones = np.bitwise_and.reduceat(pattern & agree, first)
            zeros = np.bitwise_and.reduceat(~pattern & agree, first)
            self.children.append((first, np.diff(np.append(first, len(group)))))
            agree, pattern, group = ones | zeros, ones, group[first]
            self.levels.append((agree, pattern))
        self.roots = {int(g): i for i, g in enumerate(group)}
        self.root_of = np.searchsorted(group, groups)

    def pairs(self, max_distance: int, block: int = 1 << 12) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (i, j), i < j, of one group at ``max_distance`` or less, for a block of queries at a time."""
        for at in range(0, len(self.fps), block):
            query = np.arange(at, min(at + block, len(self.fps)))
            node = self.root_of[query]
            agree, pattern = self.levels[-1]
            seen = agree[node]
            diff = np.bitwise_count((self.fps[query] ^ pattern[node]) & seen).astype(np.int64)
            for level in range(len(self.levels) - 1, 0, -1):
                live = diff <= max_distance
                query, node, diff, seen = query[live], node[live], diff[live], seen[live]
                first, count = self.children[level - 1]
                n = count[node]
                parent = np.repeat(np.arange(len(node)), n)
                child = np.repeat(first[node] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                agree, pattern = self.levels[level - 1]
                query, diff, seen = query[parent], diff[parent], seen[parent]
                own = agree[child] & ~seen
                diff = diff + np.bitwise_count((self.fps[query] ^ pattern[child]) & own)
                node, seen = child, seen | own
            hit = (diff <= max_distance) & (query < node)
            yield query[hit], node[hit]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least member of each member's component."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            live = ra != rb
            a, b, ra, rb = a[live], b[live], ra[live], rb[live]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return root


def _index_links(entries: DataFrame, max_distance: int) -> DataFrame:
    """Links (u, v) inside nodes: each member of a linked group to the group's first member."""

    def link(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(fp), group))
        group, fp = group[order], fp[order]
        index = GrayIndex(fp, group)
        root = _forest(len(fp), index.pairs(max_distance))
        child = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[child].view(np.int64)), pa.array(fp[root[child]].view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:  # sorted by node: all but the last node of a batch are whole
            group = np.concatenate((group, b.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            whole = int(np.searchsorted(group, group[-1])) if len(group) else 0
            if whole:
                yield link(group[:whole], fp[:whole])
                group, fp = group[whole:], fp[whole:]
        if len(group):
            yield link(group, fp)

    return entries.repartition("node").sortWithinPartitions("node").mapInArrow(run, "u long, v long")


def _midpoint_links(fps: DataFrame, max_distance: int) -> DataFrame:
    """Links among fingerprints of nodes over the limit, exact and without a search.

    Two of them are at distance 2 or less just when both have some word within
    one bit. So each is filed under itself and its 64 one-bit neighbours; a
    word gets 65 fingerprints at most, however large the group is. For a
    distance of 1 a word links its neighbours only where it is a fingerprint
    itself; different fingerprints have no link at distance 0.
    """
    if max_distance == 0:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where(F.lit(False))
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    near = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    if max_distance == 1:
        return near.where("fp <> word").join(fps.select(F.col("fp").alias("word")), "word").where("fp > word").select(F.col("fp").alias("u"), F.col("word").alias("v"))
    met = near.groupBy("word").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u <> v").select("u", "v")


def links(fps: DataFrame, max_distance: int = 2, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Links (u, v) whose components are those of all pairs at ``max_distance`` or less. ``fps``: distinct, materialised (fp)."""
    if not 0 <= max_distance <= 2:
        raise ValueError("three blocks are complete for a distance of 0 to 2")

    def node(i: int, lo: int, width: int) -> Column:
        part = F.shiftrightunsigned(F.col("fp"), lo).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        return part + F.lit(i << 32).cast("long")

    entries = fps.select("fp", F.explode(F.array(*[node(i, *b) for i, b in enumerate(BLOCKS)])).alias("node"))
    sizes = materialize(entries.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    entries = materialize(entries.join(sizes, "node"), "nodes")
    searched = _index_links(entries.where(F.col("n") <= node_limit).select("node", "fp"), max_distance)
    return searched.unionByName(_midpoint_links(entries.where(F.col("n") > node_limit).select("fp").distinct(), max_distance))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2, id_col: str = "doc_id", text_col: str = "text",
                    node_limit: int = NODE_LIMIT) -> DataFrame:
    """Fingerprint and near-duplicate component of every document.

    Returns one row per input row: (id, fp, sha, component_id, first_sha).
    component_id is the smallest id reachable over links of ``max_distance``
    or fewer differing bits; first_sha is the smallest text digest with that id
    in the component (it tells rows with one id apart).

    A null or empty text, or one without words, has fingerprint 0 and links
    like any other. Fewer words than ``shingle``: the whole sequence is the
    shingle. Null ids get a row too and count only where a component has no
    other id (component_id is null then). Repeated rows and ids each get a
    row; an empty table gives none; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "sha")).alias("first")
    fps = materialize(rows.groupBy("fp").agg(first), "distinct")
    comp = connected_components(links(fps.select("fp"), max_distance, node_limit))
    roots = materialize(fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "roots")
    least = materialize(roots.groupBy("root").agg(F.min("first").alias("first")), "least")
    named = materialize(roots.select("fp", "root").join(least, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.sha").alias("first_sha")), "named")
    return rows.join(named, "fp").select("id", "fp", "sha", "component_id", "first_sha")
