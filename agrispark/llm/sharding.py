"""Balanced sharding of groups by longest-processing-time scheduling."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, gapless, materialize, prepare

#: Significant bits of a group's size in the schedule: sizes to 16,384 are exact, larger ones within 0.01 %.
#: There are at most 16,384 + 50 * 8,192 such weights, however many groups there are.
WEIGHT_BITS = 14


def level_run(loads: list[int], size: int, n: int) -> list[int]:
    """How many of up to ``n`` groups of one size each shard gets before the order of equal loads matters.

    Dealt one by one, the groups go to the ``n`` smallest of the values load + j *
    size. All of them below a level are dealt at once; the highest level that
    takes no more than ``n`` is found by halving.
    """
    def below(level: int) -> list[int]:
        return [max(0, -((load - level) // size)) for load in loads]

    low, high = min(loads), min(loads) + (n + 1) * size
    while high - low > 1:
        middle = (low + high) // 2
        if sum(below(middle)) <= n:
            low = middle
        else:
            high = middle
    return below(low)


def schedule(classes: Iterable[tuple[int, int]], n_shards: int) -> list[tuple[int, int, int]]:
    """Longest processing time first, a run of groups of one size at a time.

    ``classes``: (size, number of groups), largest size first, sizes over 0. Each group goes
    to the least-loaded shard (the lowest one of those) through a heap. Of a
    run longer than the shards, those below a common level go in one step
    (``level_run``), which is what the heap would do one by one however
    unequal the loads are; the heap deals the few that are left.
    Returns (size, shard, groups) with groups > 0.
    """
    heap = [(0, s) for s in range(n_shards)]
    out = []
    for size, n in classes:
        got = [0] * n_shards
        if n > n_shards:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            got = level_run(loads, size, n)
            heap = [(load + g * size, s) for s, (load, g) in enumerate(zip(loads, got, strict=True))]
            heapq.heapify(heap)
            n -= sum(got)
        for _ in range(n):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            got[s] += 1
        out += [(size, s, g) for s, g in enumerate(got) if g]
    return out


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents to shards of nearly equal bytes; equal texts stay together.

    Returns one row per input row: (id, size, text_crc32, shard, slot). Size
    is the text's bytes in UTF-8 plus one (null: none, as an empty text). Slots
    run from 0 without a gap in each shard. Groups (equal texts by SHA-256) go
    by size, largest first, to the least-loaded shard; only the counts of
    groups per weight, at most some 400,000 rows, come to the driver. A group larger than a
    shard's share stays whole, by this contract. Null and repeated ids are
    rows like others (ties in the slots are between equal rows); an empty
    table gives no rows; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialize(columns(docs, id_col, text_col).toDF("id", "text").select(
        "id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("text_key")), "rows")
    bits = F.greatest(F.ceil(F.log2(F.col("total") + 1)).cast("int") - WEIGHT_BITS, F.lit(0))
    rounded = F.expr("shiftleft(shiftright(total + shiftright(shiftleft(1L, drop), 1), drop), drop)")
    groups = materialize(rows.groupBy("text_key").agg(F.sum("size").alias("total")).withColumn("drop", bits).select("text_key", rounded.alias("weight")), "groups")
    counts = groups.groupBy("weight").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("weight"))
    quota = schedule(((r["weight"], r["n"]) for r in counts.toLocalIterator()), n_shards)
    weights, shards, n = (np.array(x, dtype=np.int64) for x in (zip(*quota, strict=True) if quota else ([], [], [])))
    import pandas as pd
    ends = pd.DataFrame({"weight": weights, "shard": shards, "n": n})
    ends["upto"] = ends.groupby("weight")["n"].cumsum()
    ends["from"] = ends["upto"] - ends["n"]
    deal = spark.createDataFrame(ends[["weight", "shard", "from", "upto"]], "weight long, shard long, `from` long, upto long")
    # a row per weight, so the join is one to one for each group
    deal = materialize(deal.groupBy("weight").agg(F.sort_array(F.collect_list(F.struct("from", "shard"))).alias("parts")), "deal")
    nth = materialize(gapless(groups, ["weight"], ["text_key"], "nth", ("text_key",)), "nth")
    shard = F.element_at(F.filter("parts", lambda p: p["from"] <= F.col("nth")), -1)["shard"]
    homes = materialize(nth.join(deal, "weight").select("text_key", shard.cast("int").alias("shard")), "homes")
    placed = materialize(rows.join(homes, "text_key").select("id", "size", "text_crc32", "shard"), "placed")
    return gapless(placed, ["shard"], ["id", "size", "text_crc32"], "slot", ("id", "text_crc32")).select("id", "size", "text_crc32", "shard", "slot")
