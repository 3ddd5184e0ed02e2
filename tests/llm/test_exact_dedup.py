import hashlib
from collections import defaultdict

import numpy as np
import pytest
from agrispark.llm import exact_dedup
from agrispark.llm.common import keep_rows
from helpers import SF, awkward, docs
from pyspark.sql import functions as F


def slow(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out, done = [], set()
    for i, t in rows:
        ids = groups[t or ""]
        top = max((x for x in ids if x is not None), default=None)
        kept = i == top and t not in done and (t or "") not in done
        if kept:
            done.add(t or "")
        out.append((i, top, len(ids), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def run(df, **options):
    return sorted((tuple(r) for r in exact_dedup.exact_duplicates(df, **options).collect()), key=str)


def test_awkward_rows(spark):
    assert run(docs(spark, awkward())) == slow(awkward())


def test_empty_table(spark):
    assert run(docs(spark, [])) == []


@pytest.mark.parametrize("primes", [exact_dedup.PRIMES, ((3, 2), (2, 1))])
def test_whole_table(spark, primes):
    """Also with fingerprints that nearly always collide: the comparison tells the texts apart."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    df = df.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.rpad(F.col("text"), 40, "x")).otherwise(F.col("text")))
    assert run(df, primes=primes) == slow([(r["doc_id"], r["text"]) for r in df.collect()])


def test_combine_is_the_hash_of_the_whole(monkeypatch):
    poly = exact_dedup.Polynomial(*exact_dedup.PRIMES[0])
    a, b = b"some bytes \x00\x00", b"and more of them"

    def slow_hash(x):
        h = 0
        for c in x:
            h = (h * poly.base + c + 1) % poly.prime
        return h

    one = lambda x: int(exact_dedup.fingerprint_slice([poly], np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0, 0])
    assert one(a + b) == slow_hash(a + b) == poly.combine(one(a), one(b), len(b))
    big = bytes(np.random.default_rng(1).integers(0, 256, 40 * exact_dedup.CHUNK + 77, dtype=np.uint8))
    assert one(big) == poly.combine(one(big[:1_000_003]), one(big[1_000_003:]), len(big) - 1_000_003)


def test_chunk_rows_combine_over_tasks(spark):
    text = bytes(np.random.default_rng(2).integers(0, 256, 200_000, dtype=np.uint8))
    parts = [text[i:i + 50_000] for i in range(0, len(text), 50_000)]
    rows = [(1, len(text) - 50_000 * (i + 1), p) for i, p in enumerate(parts)] + [(2, 0, None)]
    got = {r["doc"]: r for r in exact_dedup.combine_chunks(spark.createDataFrame(rows, "doc long, after long, data binary").repartition(4), ["doc"]).collect()}
    polys = [exact_dedup.Polynomial(*p) for p in exact_dedup.PRIMES]
    want = exact_dedup.fingerprint_slice(polys, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    assert (got[1]["n_bytes"], got[1]["h1"], got[1]["h2"]) == (len(text), *want.tolist())
    assert got[2]["n_bytes"] == 0


def test_keep_rows_keeps_one_of_each(spark):
    df = docs(spark, awkward())
    found = exact_dedup.exact_duplicates(df)
    left = keep_rows(df, found.select("id", F.col("text_sha256").alias("sha"), "kept"))
    assert left.columns == df.columns
    want = sorted(((r[0], r[4]) for r in slow(awkward()) if r[3]), key=str)
    assert sorted(((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in left.collect()), key=str) == want


@pytest.mark.parametrize("primes", [exact_dedup.PRIMES, ((3, 2), (2, 1))])
@pytest.mark.parametrize("huge", [0, 60, 70_000])
def test_texts_whose_chunks_go_to_different_tasks(spark, huge, primes):
    """The same groups whatever counts as huge: all texts, some, or those of several chunks; also where fingerprints collide."""
    long = "a line of some length é\n" * 12_000  # five chunks
    rows = awkward() + [(20, long), (21, long), (22, long + "x"), (23, long[:-1] + "y"), (24, "z" * 131_072), (25, "z" * 131_072)]
    assert run(docs(spark, rows), primes=primes, huge=huge) == slow(rows)


def test_huge_fingerprints_are_those_of_one_task(spark):
    df = docs(spark, [(1, "some text " * 20_000), (2, "ü" * 65_536), (3, "short")])
    one = {r["id"]: (r["n_bytes"], r["h1"], r["h2"]) for r in exact_dedup.fingerprints(df).collect()}
    parts = exact_dedup.combine_chunks(exact_dedup.huge_chunks(df, "text", 100), ["sha", "row"]).collect()
    assert sorted((r["n_bytes"], r["h1"], r["h2"]) for r in parts) == sorted(one[i] for i in (1, 2))
    assert [r["h1"] for r in exact_dedup.fingerprints(df, huge=100).orderBy("id").collect()] == [None, None, one[3][1]]
