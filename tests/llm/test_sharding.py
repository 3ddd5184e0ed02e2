import heapq
import random
import zlib
from collections import defaultdict

from agrispark.llm import sharding
from helpers import SF, awkward, docs


def slow_schedule(sizes, n):
    heap, loads = [(0, s) for s in range(n)], []
    for x in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + x, s))
    loads = sorted(load for load, _ in heap)
    return loads


def test_schedule_equals_one_by_one():
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.choice([1, 2, 3, 50, rng.randint(1, 400)]) for _ in range(rng.randint(0, 300))]
        n = rng.randint(1, 9)
        runs = sorted({(x, sizes.count(x)) for x in sizes}, reverse=True)
        loads, groups = [0] * n, 0
        for size, shard, k in sharding.schedule(runs, n):
            loads[shard] += size * k
            groups += k
        assert groups == len(sizes) and sorted(loads) == slow_schedule(sizes, n)


def check(rows, got, n=8):
    assert sorted(((r["id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    slots, home = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        home[(r["size"], r["text_crc32"])].add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(n))
    assert all(len(x) == 1 for x in home.values())


def test_awkward_rows(spark):
    check(awkward(), sharding.shard_documents(docs(spark, awkward())).collect())


def test_empty_table(spark):
    assert sharding.shard_documents(docs(spark, [])).collect() == []


def test_whole_table_is_balanced(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sharding.shard_documents(df).collect()
    check(rows, got)
    loads, groups = defaultdict(int), defaultdict(int)
    for r in got:
        loads[r["shard"]] += r["size"]
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    best = slow_schedule(groups.values(), 8)
    assert max(loads.values()) <= best[-1] * 1.001 + 16 and min(loads.values()) >= best[0] * 0.999 - 16


def test_one_giant_group_beside_very_many_small_ones():
    import time
    start = time.perf_counter()
    dealt = sharding.schedule([(10**9, 1), (7, 10**9), (1, 10**9)], 8)
    assert time.perf_counter() - start < 1
    loads, n = [0] * 8, 0
    for size, shard, k in dealt:
        loads[shard] += size * k
        n += k
    assert n == 2 * 10**9 + 1 and max(loads) - min(loads) <= 7


def test_unequal_loads_equal_one_by_one_shard_by_shard():
    rng = random.Random(9)
    for _ in range(80):
        n = rng.randint(1, 7)
        runs = sorted({(rng.choice([1, 2, 5, 900, 4000]), rng.randint(1, 200 if _ % 2 else 3)) for _ in range(4)}, reverse=True)
        runs = [r for i, r in enumerate(runs) if r[0] not in {x for x, _ in runs[:i]}]
        heap, want = [(0, s) for s in range(n)], defaultdict(int)
        for size, k in runs:
            for _ in range(k):
                load, s = heapq.heappop(heap)
                heapq.heappush(heap, (load + size, s))
                want[size, s] += 1
        assert {(size, s): k for size, s, k in sharding.schedule(runs, n)} == want
