"""Suffix-array repetition: against brute force, and every awkward text."""

import random
from collections import Counter

import numpy as np
import pytest

from agrispark.llm import repetition as R
from helpers import LONG, awkward, docs, sort_key


def brute(words, window=5):
    """(covered words, longest repeat at each word) by comparing all places."""
    seen = Counter(tuple(words[i:i + window]) for i in range(len(words) - window + 1))
    covered = {j for i in range(len(words) - window + 1) if seen[tuple(words[i:i + window])] > 1 for j in range(i, i + window)}
    length = [0] * len(words)
    for i in range(len(words)):
        for j in range(i):
            k = 0
            while i + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            length[i], length[j] = max(length[i], k), max(length[j], k)
    return covered, length


def slices(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefgh"])
def test_repeats_of_random_texts(letters):
    rnd = random.Random(len(letters))
    for _ in range(60):
        texts = [" ".join(rnd.choice(letters) for _ in range(rnd.randrange(70))) for _ in range(rnd.randrange(1, 5))]
        texts += [texts[0] + "\n" + texts[0], ""]
        words = R.split_words(*slices(texts))
        found = R.repeats(words)
        for i, t in enumerate(texts):
            covered, length = brute(t.split())
            a, b = words.at[i], words.at[i + 1]
            assert found.length[a:b].tolist() == length
            assert set(np.flatnonzero(found.covered[a:b]).tolist()) == covered
            assert found.longest[i] == max(length, default=0)


def test_suffixes_are_sorted_within_each_text():
    texts = ["b a b a b", "a b a", "", "c"]
    words = R.split_words(*slices(texts))
    sa = R.suffix_array(words.code, words.at).tolist()
    code, ends = words.code.tolist(), words.at.tolist()
    for a, b in zip(ends, ends[1:]):
        assert sa[a:b] == sorted(range(a, b), key=lambda i: code[i:b])


def test_long_common_runs_are_followed_to_their_end():
    half = [str(i) for i in range(5000)]
    words = R.split_words(*slices([" ".join(half + half + ["end"]), "x " * 3000]))
    assert R.repeats(words).longest.tolist() == [5000, 2999]


def test_figures_of_awkward_texts(spark):
    out = {r["id"]: r for r in R.judge(docs(spark, [*awkward(), (20, "# a é\nb $\nb $\n \n \nb $"), (21, " ".join(map(str, range(40)))), (22, "one two three four five " * 2 + " ".join(map(str, range(90))))])).collect() if r["id"] != 9}
    assert (out[20]["n_words"], out[20]["word_chars"], out[20]["n_symbols"], out[20]["n_dup_lines"], out[20]["base_failed"]) == (9, 9, 4, 2, True)
    assert out[21]["kept"] and out[21]["repeat_spans"] == [] and out[21]["covered"] == 0
    assert out[22]["kept"] and [tuple(s) for s in out[22]["repeat_spans"]] == [(0, 10)] and out[22]["n_repeat_words"] == 10 and out[22]["n_repeats"] == 2
    for i in (3, 4, 5):
        assert (out[i]["n_words"], out[i]["n_repeat_words"], out[i]["kept"]) == (0, 0, False)
    assert out[6]["n_words"] == LONG.count(" ") + 1 and out[6]["longest_repeat"] == 80_000 - 4 and not out[6]["kept"]


def test_limits_decide_beside_the_base_rule(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    text = passage + " " + " ".join(f"v{i}" for i in range(1000)) + " " + passage
    row = R.judge(docs(spark, [(1, text)])).first()
    assert not row["base_failed"] and row["longest_repeat"] == 60 and not row["kept"]
    assert R.judge(docs(spark, [(1, text)]), max_longest=60).first()["kept"]
    assert not R.judge(docs(spark, [(1, text)]), max_longest=60, max_covered=0.05).first()["kept"]


def test_rows_order_and_empty_table(spark):
    rows = awkward()
    a = sorted(map(tuple, R.judge(docs(spark, rows)).select("id", "n_words", "n_repeat_words", "kept").collect()), key=sort_key)
    b = sorted(map(tuple, R.judge(docs(spark, rows[::-1])).select("id", "n_words", "n_repeat_words", "kept").collect()), key=sort_key)
    assert a == b and len(a) == len(rows)
    assert R.judge(docs(spark, [])).count() == 0
