import random

import pytest
from agrispark.llm import decontaminate as dc
from helpers import SF, awkward, docs


def distance(pattern, text, anchored=False):
    """(least distance, first end) of the pattern to a stretch of the text, by the plain table."""
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(text, 1):
        new = [j if anchored else 0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, (row[-1], j))
    return best


def edited(rng, text, n):
    for _ in range(n):
        i, c = rng.randrange(len(text)), rng.choice("abcdefgh ")
        text = rng.choice([text[:i] + c + text[i:], text[:i] + text[i + 1:], text[:i] + c + text[i + 1:]])
    return text


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("anchored", [False, True])
def test_myers_equals_the_table(anchored):
    rng = random.Random(6)
    for _ in range(150):
        p, t = "".join(rng.choices("abc", k=rng.randint(1, 70))), "".join(rng.choices("abc", k=rng.randint(0, 90)))
        assert dc.Myers(p).search(t, anchored) == distance(p, t, anchored)


def test_planted_passages_equal_brute_force(spark):
    """Every passage within its budget is found with its least distance, none beyond."""
    rng = random.Random(9)
    items = [(i, words(rng, rng.randint(9, 22)).capitalize() + ".") for i in range(8)]
    rows = []
    for k in range(60):
        p = dc.normalise(items[k % 8][1])
        rows.append((k, f"{words(rng, 15)}, {edited(rng, p, rng.randint(0, int(len(p) * dc.ERRORS) + 3))} {words(rng, 9)}"))
    found = {(r["id"], r["item_id"]): (r["distance"], r["start"], r["end"]) for r in dc.find_benchmark(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for k, t in rows:
        for i, p in items:
            p, t = dc.normalise(p), dc.normalise(t)
            if len(p) >= dc.MIN_CHARS and (d := distance(p, t)[0]) <= int(len(p) * dc.ERRORS):
                want[(k, i)] = d
    assert {k: v[0] for k, v in found.items()} == want and len(want) > 30
    text = dict(rows)
    for (k, i), (d, a, b) in found.items():
        assert distance(dc.normalise(items[i][1]), dc.normalise(text[k][a:b]), True)[0] <= d


def test_case_marks_and_white_space_dont_hide_a_passage(spark):
    item = "Größe und ÄHNLICHES: the-quick brown «fox» jumps over 12 lazy dogs"
    rows = [(1, "x " + item.upper().replace(" ", "\n ") + "!"), (2, "xx" + item + "yy"), (3, item.replace("fox", "cat")), (4, "nothing of it")]
    df = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "short one"), (None, item)], "item_id long, text string")
    got = sorted((r["id"], r["item_id"]) for r in dc.find_benchmark(docs(spark, rows), df).where("item_id IS NOT NULL").collect())
    assert got == [(1, 7), (2, 7), (3, 7)]
    one = next(r for r in dc.find_benchmark(docs(spark, rows), df.where("item_id = 7")).collect() if r["id"] == 2)
    assert rows[1][1][one["start"]:one["end"]] == item


def test_whole_table_blocks_and_clean_rows(spark):
    df, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = sorted(tuple(r) for r in dc.find_benchmark(df, items).collect())
    assert found == sorted(tuple(r) for r in dc.find_benchmark(df, items, block=17).collect())
    texts = {r["item_id"]: r["text"] for r in items.collect()}
    whole = {(r["doc_id"], i) for r in df.collect() for i, t in texts.items() if t in r["text"]}
    assert whole and whole <= {(r[0], r[1]) for r in found}
    left = dc.clean_rows(df, items, block=50)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in df.collect()} - {r[0] for r in found}


def test_awkward_rows(spark):
    items = spark.createDataFrame([("a", awkward()[7][1][:400])], "item_id string, text string")
    df = docs(spark, awkward())
    assert sorted((r["id"], r["item_id"]) for r in dc.find_benchmark(df, items).collect()) == [(6, "a"), (7, "a")]
    left = dc.clean_rows(df, items)
    assert left.count() == len(awkward()) - 2 and left.columns == df.columns
    assert dc.find_benchmark(docs(spark, []), items).collect() == [] and dc.clean_rows(docs(spark, []), items).collect() == []
    none = items.where("false")
    assert dc.find_benchmark(df, none).collect() == [] and dc.clean_rows(df, none).count() == len(awkward())


def test_short_items_are_found_unedited_between_word_bounds(spark):
    items = spark.createDataFrame([(1, "What is 2 + 2?"), (2, "cat"), (3, "中国的首都是什么"), (4, "?!"), (5, "the cat sat on the mat and what is 2 2 all about")], "item_id long, text string")
    rows = [(1, "So: WHAT is\n2 + 2? Four."), (2, "what is 2 22"), (3, "concat, cats"), (4, "concat a Cat"), (5, "请问中国的首都是什么呢"), (6, "the cat sat on the mat and what is 2 2 all abouts"), (7, "?!"), (8, None), (9, "what was 2 2"), (10, "cat")]
    got = {(r["id"], r["item_id"]): (r["distance"], r["budget"], r["start"], r["end"]) for r in dc.find_benchmark(docs(spark, rows), items).collect()}
    assert set(got) == {(1, 1), (4, 2), (5, 3), (6, 1), (6, 2), (6, 5), (10, 2)}
    assert got[(1, 1)] == (0, 0, 4, 17) and got[(4, 2)] == (0, 0, 9, 12) and got[(5, 3)] == (0, 0, 2, 10)
    assert {r["doc_id"] for r in dc.clean_rows(docs(spark, rows), items, block=2).collect()} == {2, 3, 7, 8, 9}


def test_normalised_text_and_its_places_agree_on_every_code_point():
    import sys
    for first in range(0, sys.maxunicode + 1, 4096):
        text = "x ".join(f"a{chr(c)}b {chr(c)}" for c in range(first, min(first + 4096, sys.maxunicode + 1)) if not 0xD800 <= c < 0xE000)
        made, at = dc.places(text)
        assert made == dc.normalise(text) and len(at) == len(made) + 1
        assert all(a <= b for a, b in zip(at, at[1:]))


@pytest.mark.parametrize("lead", ["\u0130", "\u0130 \u0130", "\u0130\u0130\u0130\u0130\u0130 ", "ΟΔΟΣ \u0130x ", "\u00df\ufb01 "])
def test_a_verbatim_passage_comes_back_exactly_behind_letters_that_grow(spark, lead):
    passage = "The quick brown fox jumps over the lazy dog \u0130 and runs away from it"
    text = f"{lead} so, {passage}; end \u0130"
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    r = dc.find_benchmark(docs(spark, [(1, text)]), items).first()
    assert r["distance"] == 0 and text[r["start"]:r["end"]] == passage


def test_long_passages_make_more_blocks(spark):
    items = spark.createDataFrame([(i, f"item {i} " + "x y " * 200) for i in range(9)], "item_id long, text string")
    blocks = list(dc.item_blocks(items, "item_id", "text", 100, chars=2000))
    assert [len(b) for b in blocks] == [2, 2, 2, 2, 1] and [k for b in blocks for k, _ in b] == list(range(9))
    assert [len(b) for b in dc.item_blocks(items, "item_id", "text", 100, chars=10)] == [1] * 9
    assert [len(b) for b in dc.item_blocks(items, "item_id", "text", 4)] == [4, 4, 1]
