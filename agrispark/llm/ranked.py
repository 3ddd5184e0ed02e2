"""Ranked lexical search: pipelined term partitioning.

The documents are indexed in segments of some thousand; the terms are dealt to
owners, rarest first. Each item sends a bundle of sparse document accumulators
through the owners' stages, one after the other: a cogroup by segment brings
bundles and an owner's postings together, the owner adds the integer
contributions of its terms and passes the bundle on. Accumulators that can't
reach the best of their own segment any more are left behind. The last stage
hands on the best of each segment, of which the best of all are picked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import columns, cut_words, materialize, prepare, text_slices

#: Term owners, so stages that a bundle goes through.
STAGES = 4
#: Documents with a term of some item that a segment holds at most (and the slice that fills it).
SEGMENT_DOCS = 4096
#: Items and bytes of different terms that one pass over the documents looks for; more items take further passes.
BLOCK_ITEMS, BLOCK_BYTES = 1000, 4 << 20

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Block:
    """Some items: their ids and the different terms of each, by number."""

    ids: list = field(default_factory=list)
    terms: list[list[int]] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    size: int = 0


def text_terms(text: str | None) -> set[bytes]:
    """Different terms of one text: runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    data = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    return set(cut_words(data, np.array([0, len(data)]), _TERM)[2].to_pylist())


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_ITEMS, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Items in the order of their ids, read bit by bit; all rows of an id are one item."""
    block, last, own = Block(), None, None

    def close() -> None:
        block.ids.append(last)
        block.terms.append(sorted(block.vocabulary.setdefault(t, len(block.vocabulary)) for t in own))
        block.size = sum(map(len, block.vocabulary))

    for row in columns(items, id_col, text_col).toDF("id", "text").orderBy("id").toLocalIterator():
        if own is None or row["id"] != last:
            if own is not None:
                close()
                if len(block.ids) >= most or block.size >= size:
                    yield block
                    block = Block()
            last, own = row["id"], set()
        own |= text_terms(row["text"])
    if own is not None:
        close()
        yield block


def index_terms(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """Inverted index of the documents for the given terms, in segments, written to the shared folder.

    Rows with a term hold one term's postings in one segment: places (16 bits)
    and counts (32 bits) of the documents, and the largest count. A row with term -1 is the segment
    itself: ids and term counts of its documents with any of the terms, and how
    many documents have a term at all, with how many terms. Each document is in one segment.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sorted(vocabulary, key=vocabulary.get))
    id_type = docs.schema[id_col].dataType
    schema = StructType([StructField("segment", LongType()), StructField("term", IntegerType()), StructField("df", LongType()), StructField("top", LongType()), StructField("places", BinaryType()),
                         StructField("counts", BinaryType()), StructField("lengths", BinaryType()), StructField("ids", ArrayType(id_type)), StructField("documents", LongType()), StructField("terms", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.large_binary())
        width, part, made = max(1, len(known)), TaskContext.get().partitionId(), 0
        ids, lengths, docs_of, terms_of, held = [], [], [], [], 0
        found, total, kind = [], 0, None

        def segment() -> Iterator[pa.RecordBatch]:
            nonlocal made, held, found, total
            number = (part << 32) + made
            places, term, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs_of, terms_of, lengths_of))
            by = np.argsort(term, kind="stable")
            places, term, count = places[by], term[by], count[by]
            start = np.flatnonzero(np.diff(term, prepend=-1))
            cut = np.append(start, len(term))
            p, c = places.astype("<u2"), count.astype("<i4")
            n = len(start)
            none = pa.nulls(n, pa.binary())
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(term[start].astype(np.int32)), pa.array(np.diff(cut)), pa.array(np.maximum.reduceat(count, start)),
                                                  *[pa.array([v[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for v in (p, c)], none,
                                                  pa.nulls(n, pa.list_(kind)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema.names)
            one = pa.nulls(1, pa.int64())
            own = pa.concat_arrays(ids) if ids else pa.array([], kind)
            every = np.concatenate(lengths).astype("<i8") if lengths else np.zeros(0, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([-1], pa.int32()), one, one, pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([every.tobytes()], pa.binary()),
                                              pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([int(sum(found))]), pa.array([total])], schema.names)
            made, held, found, total = made + 1, 0, [], 0
            for x in (ids, lengths, docs_of, terms_of, lengths_of):
                x.clear()

        lengths_of: list[np.ndarray] = []
        for b in batches:
            kind = b.column(0).type
            for first, last, data, offsets in text_slices(b, 1):
                _, at, words = cut_words(_LOWER[data], offsets, _TERM)
                n = np.diff(at)
                found.append(int((n > 0).sum()))
                total += int(n.sum())
                coded = words.dictionary_encode()
                number = pc.fill_null(pc.index_in(coded.dictionary, known), -1).to_numpy()
                term = number[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
                doc = np.repeat(np.arange(len(n)), n)[term >= 0]
                pair, count = np.unique(doc * width + term[term >= 0], return_counts=True)
                hit, back = np.unique(pair // width, return_inverse=True)
                for a in range(0, len(hit), segment_docs):  # documents a .. a + segment_docs of the slice; rarely more than one step
                    z = min(a + segment_docs, len(hit))
                    if held + z - a > segment_docs:
                        yield from segment()
                    own = slice(*np.searchsorted(back, (a, z)))
                    docs_of.append(held + back[own] - a)
                    terms_of.append(pair[own] % width)
                    lengths_of.append(count[own])
                    lengths.append(n[hit[a:z]])
                    ids.append(b.column(0).take(pa.array(first + hit[a:z])))
                    held += z - a
        if found or held:
            yield from segment()

    return materialize(columns(docs, id_col, text_col).mapInArrow(run, schema), "search-index")


def contributions(count: np.ndarray, measure: np.ndarray) -> np.ndarray:
    """What an occurrence count brings in a document of measure m, before the term's weight."""
    count = count.astype(np.int64)
    return 1_000_000_000 * count // (1000 * count + 20 * measure)


def _stage(owner: int, last: bool, k: int, items, weights, owner_of, n_docs: int, n_terms: int):
    """The work of one owner on one segment: ``items`` (broadcast) are the terms of each item."""
    def run(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        term = postings.column("term").to_pylist()
        head = term.index(-1)
        length = np.frombuffer(postings.column("lengths")[head].as_py(), "<i8")
        measure = 100 - 50 + 50 * length * n_docs // n_terms
        w, own, plan = weights.value, owner_of.value, items.value
        least = int(measure.min()) if len(measure) else 0
        gain, most = {}, {}
        for i, t in enumerate(term):
            if t < 0:
                continue
            if own[t] == owner:
                place = np.frombuffer(postings.column("places")[i].as_py(), "<u2")
                count = np.frombuffer(postings.column("counts")[i].as_py(), "<i4")
                gain[t] = place, int(w[t]) * contributions(count, measure[place])
            else:  # a later owner's term: what it can bring at most
                top = np.array([postings.column("top")[i].as_py()])
                most[t] = int(w[t]) * int(contributions(top, np.array([least]))[0])
        carried = {i: (p, s) for i, p, s in zip(*[bundles.column(c).to_pylist() for c in ("item", "places", "scores")])}
        out_item, out_place, out_score = [], [], []
        for item, terms in enumerate(plan):
            mine = [t for t in terms if t in gain]
            before = carried.get(item)
            if before is None and not mine:
                continue
            score = np.zeros(len(length), np.int64)
            if before is not None:
                score[np.frombuffer(before[0], "<u2")] = np.frombuffer(before[1], "<i8")
            for t in mine:
                place, added = gain[t]
                score[place] += added
            live = np.flatnonzero(score)
            if len(live) > k:
                # k documents of the segment have this much already: what can't get as far is out of the race (equals stay)
                bar = int(np.partition(score[live], len(live) - k)[len(live) - k])
                live = live[score[live] + sum(most.get(t, 0) for t in terms) >= bar]
            if len(live):
                out_item.append(item)
                out_place.append(live)
                out_score.append(score[live])
        if not last:
            segment = [postings.column("segment")[0].as_py()] * len(out_item)
            return pa.table({"segment": pa.array(segment, pa.int64()), "item": pa.array(out_item, pa.int32()), "places": pa.array([p.astype("<u2").tobytes() for p in out_place], pa.binary()),
                             "scores": pa.array([s.astype("<i8").tobytes() for s in out_score], pa.binary())})
        ids = postings.column("ids")[head].values
        at = np.concatenate(out_place) if out_place else np.zeros(0, np.int64)
        return pa.table({"item": pa.array(np.repeat(out_item, [len(p) for p in out_place]).astype(np.int32)), "doc": ids.take(pa.array(at)),
                         "score": pa.array(np.concatenate(out_score) if out_score else at, pa.int64())})
    return run


def _search_block(docs: DataFrame, block: Block, item_type, id_col: str, text_col: str, k: int, stages: int, segment_docs: int) -> DataFrame:
    """(item_id, doc_id, score) of each segment's best for the items of a block."""
    spark = docs.sparkSession
    index = index_terms(docs, block.vocabulary, id_col, text_col, segment_docs)
    size = index.where("term = -1").agg(F.sum("documents").alias("n"), F.sum("terms").alias("l")).first()
    n_docs, n_terms = size["n"] or 0, max(size["l"] or 0, 1)
    df = np.zeros(len(block.vocabulary), np.int64)
    for r in index.where("term >= 0").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in df], np.int64)
    # owners in the order of document counts, with about as many postings each
    order = np.argsort(df, kind="stable")
    owner = np.zeros(len(df), np.int32)
    owner[order] = np.minimum((np.cumsum(df[order]) - df[order]) * stages // max(int(df.sum()), 1), stages - 1)
    sc = spark.sparkContext
    shared = sc.broadcast(block.terms), sc.broadcast(weight), sc.broadcast(owner)
    terms = F.broadcast(spark.createDataFrame([(t, int(o)) for t, o in enumerate(owner)] + [(-1, -1)], "term int, owner int"))
    postings = index.join(terms, "term")
    bundles = spark.createDataFrame([], "segment long, item int, places binary, scores binary")
    for s in range(stages):
        last = s == stages - 1
        mine = F.col("owner") == s
        right = postings.where((F.col("owner") >= s) | (F.col("term") < 0)).select(
            "segment", "term", "top", F.when(mine, F.col("places")).alias("places"), F.when(mine, F.col("counts")).alias("counts"), "lengths", *(["ids"] if last else []))
        schema = StructType([StructField("item", IntegerType()), StructField("doc", docs.schema[id_col].dataType), StructField("score", LongType())]) if last else bundles.schema
        # a segment without any of the owner's postings still hands its bundles on, so every segment is in ``right``
        bundles = bundles.groupBy("segment").cogroup(right.groupBy("segment")).applyInArrow(_stage(s, last, k, *shared, n_docs, n_terms), schema)
    names = spark.createDataFrame([(i, v) for i, v in enumerate(block.ids)], StructType([StructField("item", IntegerType()), StructField("item_id", item_type)]))
    return bundles.join(F.broadcast(names), "item").select("item_id", F.col("doc").alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
           stages: int = STAGES, segment_docs: int = SEGMENT_DOCS, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best documents of each item: (item_id, rank, doc_id, score), of all documents and whole texts.

    A null text has no terms. Rows of one item id are one item with the terms
    of all of them; a null item id is an item too. Documents with a null or
    repeated id are ranked like others; equal scores go by ascending id, null
    last, rows of one id in any order. Items without a hit, and an empty table on either side, give no rows.
    Other columns are not read. ``segment_docs`` is at most 65,536.
    """
    spark = prepare(docs.sparkSession)
    item_type = items.schema[item_id].dataType
    out = StructType([StructField("item_id", item_type), StructField("doc_id", docs.schema[id_col].dataType), StructField("score", LongType())])
    found = spark.createDataFrame([], out)
    for block in item_blocks(items, item_id, item_text, block_items, block_bytes):
        found = found.unionByName(_search_block(docs, block, item_type, id_col, text_col, k, stages, segment_docs))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
