"""Pipelined search: against scoring every document, with few and many segments, stages and blocks."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from agrispark.llm import ranked
from helpers import awkward, docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = StructType([StructField("item_id", LongType()), StructField("text", StringType()), StructField("score", StringType())])


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k):
    bags = [(d, Counter(terms(t))) for d, t in rows]
    bags = [(d, b) for d, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item in {i for i, _ in items}:
        wanted = {t for i, text in items if i == item for t in terms(text)}
        got = []
        for d, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in wanted if t in b)
            if s > 0:
                got.append((-s, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(got)[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, items, k, **how):
    table = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    return sorted(map(tuple, ranked.search(docs(spark, rows), table, k=k, **how).collect()), key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    common = ["the", "of", "And", "ñandú", "x1"]
    words = common * 6 + [f"w{i}" for i in range(60)]
    return [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(40)))) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"segment_docs": 7}, {"stages": 1, "segment_docs": 50}, {"stages": 9, "segment_docs": 16, "block_items": 2}, {"block_bytes": 1}])
def test_equals_scoring_every_document(spark, how):
    rows = corpus(1, 150)
    items = [(0, "the W3 of w4, w5"), (1, "AND ñandú"), (2, "absent"), (3, None), (4, "x1 w9 w9 w10"), (4, "w11"), (None, "the w20"), (5, " ".join(f"w{i}" for i in range(60)))]
    assert found(spark, rows, items, 5, **how) == brute(rows, items, 5)


def test_awkward_documents_and_ties(spark):
    rows = awkward() + [(i, "the same tied text") for i in range(40, 20, -1)]
    items = [(1, "quick text one"), (2, "alpha END ñandú"), (3, "same tied")]
    assert found(spark, rows, items, 10, segment_docs=3) == brute(rows, items, 10)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")], 5) == [] and found(spark, [(1, "a")], [], 5) == [] and found(spark, [(1, None), (2, "..")], [(1, "a")], 5) == []


def test_accumulators_out_of_the_race_stay_behind(spark):
    """Bundles shrink: with k far below the hits of a segment, the last stages carry few accumulators, and the result is whole."""
    rows = corpus(2, 400)
    items = [(0, "the of and w1 w2 w3")]
    assert found(spark, rows, items, 3, segment_docs=400) == brute(rows, items, 3)


def test_the_plan_joins_nothing_crosswise(spark, capsys):
    ranked.search(docs(spark, corpus(3, 20)), spark.createDataFrame([(1, "the", "")], ITEMS)).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan
