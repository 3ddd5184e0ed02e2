import random

import numpy as np
import pytest
import xxhash
from agrispark.llm import simhash
from helpers import SF, awkward, docs


def slow_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows, distance=2):
    """Of each row: fingerprint, smallest id reachable, component."""
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return fps, [least.get(find(i)) for i in range(len(rows))], [find(i) for i in range(len(rows))]


def check(df, rows, **options):
    fps, comp, _ = slow_components(rows)
    got = sorted(((r["id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(df, **options).collect()), key=str)
    assert got == sorted(zip([k for k, _ in rows], fps, comp, strict=True), key=str)


def test_awkward_rows(spark):
    check(docs(spark, awkward()), awkward())


@pytest.mark.parametrize("limit", [simhash.NODE_LIMIT, 3])
def test_whole_table_against_all_pairs(spark, limit):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    check(df, [(r["doc_id"], r["text"]) for r in df.collect()], node_limit=limit)


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("limit", [5000, 4])
def test_links_reach_what_all_pairs_reach(spark, limit, distance):
    """Dense clusters of planted fingerprints: same components as brute force, by the index and by midpoints."""
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4]))) for _ in range(40)}
    fps |= {rng.getrandbits(64) for _ in range(40)}
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    from agrispark.llm.components import connected_components
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance, node_limit=limit)
    made = {r["node"]: r["component"] for r in connected_components(links).collect()}
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= distance:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    assert {x: made.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_index_finds_all_pairs_and_prunes():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for _ in range(8)]]))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    index = simhash.GrayIndex(fps, np.zeros(len(fps), np.int64))
    assert len(index.levels) > 2
    found = {(a, b) for x in index.pairs(2) for a, b in zip(*map(np.ndarray.tolist, x), strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 2}
    assert found == want


def test_gray_rank_inverts_gray_code():
    n = np.arange(4096, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ n >> np.uint64(1)) == n).all()


def test_long_text_in_chunks(monkeypatch):
    words = " ".join(random.Random(1).choice("abcdefgh") * 3 for _ in range(500))
    whole = simhash.fingerprint_bytes(words.encode())
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.fingerprint_bytes(words.encode()) == whole == slow_fingerprint(words)
