import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from agrispark.llm import line_dedup
from helpers import SF, awkward, docs

LINE = "A line that many documents share, long enough to count"


def key(line):
    s = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def slow(rows, least=5, chars=40):
    where = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                where[key(line)].add(i)
    holder = {k: max((x for x in v if x is not None), default=None) for k, v in where.items() if len(v) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in holder or holder[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(((r["id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in df.collect()), key=str)


def shared_rows():
    more = [(100 + i, f"own line {i}\n\t{LINE.upper() if i % 2 else LINE} \r\nÄ {LINE}\nshort\n{LINE}") for i in range(7)]
    return awkward() + more + [(None, LINE), (100, LINE), (100, LINE)]


@pytest.mark.parametrize("room", [(line_dedup.FILTER_BYTES, line_dedup.EXACT_BYTES), (line_dedup.FILTER_BYTES, 0), (0, line_dedup.EXACT_BYTES), (0, 0)])
def test_awkward_rows(spark, room):
    """With filters and table sent out, and where either has no room: the same rows."""
    assert digest(line_dedup.dedup_lines(docs(spark, shared_rows()), filter_bytes=room[0], exact_bytes=room[1])) == slow(shared_rows())


def test_exact_table_tells_keys_with_one_first_half_apart():
    keys = [bytes([a] * 8 + [b] * 8) for a in (1, 2) for b in (5, 3, 4)]
    table = line_dedup.ExactTable(keys, np.arange(6))
    assert [int(table.holders[i]) for i in table.find(keys)] == list(range(6))
    assert (table.find([bytes([1] * 16), bytes([9] * 16), bytes([0] * 16)]) == -1).all()


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert digest(line_dedup.dedup_lines(df)) == slow([(r["doc_id"], r["text"]) for r in df.collect()])


def test_empty_table(spark):
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == []


def test_filter_inserts_finds_and_deletes():
    rng = np.random.default_rng(8)
    keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    made = line_dedup.CuckooFilter.build(keys)
    assert made.contains(keys).all() and (made.buckets > 0).sum() == len(np.unique(keys))
    other = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert made.contains(other).mean() < 0.002
    made.delete(keys[:5000])
    assert made.contains(keys[5000:]).all() and made.contains(keys[:5000]).mean() < 0.01
    assert made.insert(keys[:5000]) and made.contains(keys).all()


def test_index_is_incremental_and_reversible(spark):
    rng = random.Random(2)
    lines = [f"{LINE} number {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.sample(lines, 6))) for i in range(60)]
    index = line_dedup.LineIndex(spark, shards=4)
    for part in (rows[:20], rows[20:45], rows[40:]):  # some come twice
        index.insert(docs(spark, part))
    refs = lambda x: sorted((r["key"].hex(), r["n_docs"], r["holder"]) for r in x.refs.collect())
    whole = line_dedup.LineIndex(spark, shards=4)
    whole.insert(docs(spark, rows))
    assert refs(index) == refs(whole)
    assert digest(index.apply(docs(spark, rows))) == slow(rows)
    index.delete(spark.createDataFrame([(i,) for i in range(45, 60)], "doc_id long"))
    before = line_dedup.LineIndex(spark, shards=4)
    before.insert(docs(spark, rows[:45]))
    assert refs(index) == refs(before)
    assert digest(index.apply(docs(spark, rows[:45]))) == slow(rows[:45])
    index.delete(spark.createDataFrame([(i,) for i in range(45)], "doc_id long"))
    assert refs(index) == []
    index.insert(docs(spark, rows))
    assert refs(index) == refs(whole)


def test_an_insertion_writes_its_own_lines_and_a_deletion_restores_the_earlier_result(spark, monkeypatch):
    import glob
    base = [(i, f"{LINE} a\n{LINE} b {i % 3}\n{LINE} own {i}") for i in range(40)]
    more = [(100 + i, f"{LINE} a\n{LINE} late {i % 2}\n{LINE} b 1") for i in range(9)]
    index = line_dedup.LineIndex(spark, shards=3)
    index.insert(docs(spark, base))
    first = digest(index.apply(docs(spark, base)))
    assert first == slow(base) == digest(line_dedup.dedup_lines(docs(spark, base)))  # the query's own path
    before = set(glob.glob(f"{index.path.removeprefix('file:')}/*/*"))
    index.insert(docs(spark, more))
    new = set(glob.glob(f"{index.path.removeprefix('file:')}/*/*")) - before
    assert spark.read.parquet(*[f for f in new if f.endswith("posts")]).count() == 27 and spark.read.parquet(*[f for f in new if f.endswith("counts")]).count() == 4
    assert digest(index.apply(docs(spark, base + more))) == slow(base + more) != first
    index.delete(spark.createDataFrame([(100 + i,) for i in range(9)], "doc_id long"))
    assert digest(index.apply(docs(spark, base))) == first  # the holders of the kept lines are the earlier ones again
    index.insert(docs(spark, more[:4]))  # withdrawn ids can come back
    assert digest(index.apply(docs(spark, base + more[:4]))) == slow(base + more[:4])
    monkeypatch.setattr(line_dedup, "COMPACT", 2)
    index.delete(spark.createDataFrame([(100,)], "doc_id long"))
    assert {k: len(v) for k, v in index.tables.items()} == {"posts": 1, "counts": 1, "gone": 0}
    assert digest(index.apply(docs(spark, base + more[1:4]))) == slow(base + more[1:4])


def test_filters_that_could_be_too_large_are_not_built(spark, monkeypatch):
    keys = spark.createDataFrame([(bytes([i] * 16),) for i in range(50)], "key binary")
    assert line_dedup.make_filters(keys, 4, limit=50 * line_dedup.KEY_BYTES - 1) is None
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 5)
    made = line_dedup.make_filters(keys, 4)
    assert len(made) == 10 and line_dedup.maybe_known(made, [bytes([i] * 16) for i in range(50)]).all()
