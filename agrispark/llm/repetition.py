"""Quality rules: repetition by suffix arrays.

A suffix array over the words of each text and its longest-common-prefix
values give all repeated substrings: the intervals of equal prefixes are the
maximal repeats, each with its length and its places. The union of their spans
is the part of the text that is repeated; limits on its share and on the
longest repeat decide which texts stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from .common import columns, cut_words, prepare, text_slices

#: Words that a repeat needs to count.
WINDOW = 5
MIN_WORDS, MAX_REPEATED = 10, 20
#: Share of a text's word characters that repeats may cover, and words of the longest repeat (of two, the second counts as the copy).
MAX_COVERED, MAX_LONGEST = 0.25, 50
#: Words compared at once for many pairs of places; longer common runs are followed pair by pair.
_TOGETHER = 32

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass
class Words:
    """Words of a slice of texts: where each starts in the bytes, its number (equal words have equal ones), its characters; ``at[i]`` is text i's first."""

    start: np.ndarray
    code: np.ndarray
    chars: np.ndarray
    at: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text of a slice."""
    start, at, flat = cut_words(data, offsets, ~_SPACE)
    if not len(start):
        return Words(start, np.zeros(0, np.int32), start, at)
    ends = np.frombuffer(flat.buffers()[1], np.int64)
    letters = np.frombuffer(flat.buffers()[2], np.uint8)
    chars = np.add.reduceat(((letters & 0xC0) != 0x80).astype(np.int64), ends[:-1])
    return Words(start, flat.dictionary_encode().indices.to_numpy().astype(np.int32), chars, at)


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each run of equal keys in that order as a flag, number of the run's first place)."""
    order = np.argsort(key, kind="stable")
    held = key[order]
    new = np.ones(len(key), bool)
    new[1:] = held[1:] != held[:-1]
    return order, new, np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def suffix_array(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Suffixes of all texts of a slice, text by text and sorted within each (a suffix ends with its text).

    Prefix doubling: suffixes equal in their first h words are sorted by the h
    after them; those that are alone in their group stay where they are.
    """
    n = len(code)
    sizes = np.diff(at)
    text = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    end = np.repeat(at[1:], sizes)
    order, _, first = _ranked(text << 32 | code)
    rank = np.empty(n, np.int64)
    rank[order] = first
    group = np.bincount(first, minlength=n)
    open_, h = np.flatnonzero(group[rank] > 1), 1
    while len(open_):
        after = open_ + h
        inside = after < end[open_]
        follow = np.zeros(len(open_), np.int64)
        follow[inside] = rank[after[inside]] + 1
        # by (rank, what follows): groups keep their places, their members are told apart
        by = np.lexsort((follow, rank[open_]))
        place, old, nxt = open_[by], rank[open_][by], follow[by]
        new_group = np.ones(len(by), bool)
        new_group[1:] = old[1:] != old[:-1]
        new = new_group.copy()
        new[1:] |= nxt[1:] != nxt[:-1]
        i = np.arange(len(by))
        rank[place] = old + np.maximum.accumulate(np.where(new, i, 0)) - np.maximum.accumulate(np.where(new_group, i, 0))
        run = np.flatnonzero(new)
        alone = np.repeat(np.diff(np.append(run, len(by))) == 1, np.diff(np.append(run, len(by))))
        open_, h = np.sort(place[~alone]), 2 * h
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes


def _follow(code: np.ndarray, i: int, j: int, most: int) -> int:
    """Words that the runs from i and j have in common, at most ``most``: steps of doubled length up to the first difference."""
    seen, step = 0, _TOGETHER
    while seen < most:
        step = min(step, most - seen)
        differ = code[i + seen:i + seen + step] != code[j + seen:j + seen + step]
        if differ.any():
            return seen + int(differ.argmax())
        seen, step = seen + step, 2 * step
    return seen


def common_prefixes(code: np.ndarray, at: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in the array (0 for a text's first).

    In the order of the text such a value is the one before less one, unless
    the words before the two places differ; only those are compared word by
    word, which adds up to n log n words at most.
    """
    n = len(code)
    sizes = np.diff(at)
    end = np.repeat(at[1:], sizes)
    before = np.full(n, -1, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    begin = np.repeat(at[:-1], sizes)
    before[before < begin] = -1  # another text's
    has = before >= 0
    left = has.copy()
    place = np.arange(n)
    inner = has & (place > begin) & (before > begin)
    left[inner] = code[place[inner] - 1] != code[before[inner] - 1]
    own = np.flatnonzero(left)  # to compare; all others follow from the place before
    other = before[own]
    most = np.minimum(end[own] - own, end[own] - other)
    got = np.zeros(len(own), np.int64)
    going = np.arange(len(own))
    for k in range(_TOGETHER):
        going = going[most[going] > k]
        going = going[code[own[going] + k] == code[other[going] + k]]
        got[going] = k + 1
    for g in going[most[going] > _TOGETHER].tolist():
        got[g] = _TOGETHER + _follow(code, int(own[g]) + _TOGETHER, int(other[g]) + _TOGETHER, int(most[g]) - _TOGETHER)
    # a value carries on, one less at each place, from the last compared one
    from_ = np.full(n, -1, np.int64)
    from_[own] = own
    from_ = np.maximum.accumulate(from_)
    value = np.zeros(n, np.int64)
    value[own] = got
    plcp = np.where(has, value[from_] - (place - from_), 0)
    return plcp[suffixes]


@dataclass
class Repeats:
    """Per word of a slice: ``length[i]``, words of the longest repeat that starts at i; ``maximal[i]``: it can't be
    extended to the left; ``covered[i]``: it lies in a repeat of ``window`` words or more. ``longest`` is per text."""

    length: np.ndarray
    maximal: np.ndarray
    covered: np.ndarray
    longest: np.ndarray


def repeats(words: Words, window: int = WINDOW) -> Repeats:
    """Repeated substrings of each text, from its suffix array.

    The LCP interval that holds a suffix with the greatest common prefix is
    the longest repeat at its place: the larger of the two neighbouring
    values. The spans of these intervals cover the same words as those of all
    intervals, since every other interval's prefix lies within.
    """
    n, sizes = len(words.code), np.diff(words.at)
    length = np.zeros(n, np.int64)
    if n:
        sa = suffix_array(words.code, words.at)
        lcp = common_prefixes(words.code, words.at, sa)
        length[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    counted = length >= window
    # a place whose repeat is the tail of the repeat one word before is no maximal one
    tail = np.zeros(n, bool)
    tail[1:] = length[:-1] == length[1:] + 1
    first = words.at[:-1][sizes > 0]
    tail[first] = False
    place = np.arange(n)
    reach = np.maximum.accumulate(np.where(counted, place + length, 0)) if n else length  # no repeat reaches beyond its text
    covered = reach > place
    longest = np.zeros(len(sizes), np.int64)
    if n:
        longest[sizes > 0] = np.maximum.reduceat(length, first)
    return Repeats(length, counted & ~tail, covered, longest)


def spans(covered: np.ndarray) -> np.ndarray:
    """(first, last + 1) of each run of covered words."""
    edge = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)), axis=1)


def duplicate_lines(text: bytes) -> int:
    """Lines that hold a word and equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED,
          max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Repetition figures of every whole text and whether it stays; a row for each input row.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (words in the union of all repeats of ``window`` words or more), base_failed
    (under ``min_words`` words, or more than ``max_repeated`` percent of them
    repeated), n_repeats (places of maximal repeats), repeat_spans (the union, as first word
    and last + 1), longest_repeat (words), covered (share of the word
    characters in the union), and kept: not base_failed, covered at most
    ``max_covered`` and longest_repeat at most ``max_longest``.

    A null text counts as empty: no words, so it fails. Null and repeated ids
    are rows like others; an empty table gives none; other columns are not read.
    A text is worked on in one task, with about 100 bytes a word.
    """
    prepare(docs.sparkSession)
    span = StructType([StructField("first", LongType()), StructField("end", LongType())])
    schema = StructType([StructField("id", docs.schema[id_col].dataType),
                         *[StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], StructField("base_failed", BooleanType()),
                         StructField("n_repeats", LongType()), StructField("repeat_spans", ArrayType(span)), StructField("longest_repeat", LongType()),
                         StructField("covered", DoubleType()), StructField("kept", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in text_slices(b, 1):
                words = split_words(data, offsets)
                found = repeats(words, window)
                n, chars = np.diff(words.at), _sums(words.chars, words.at)
                repeated = _sums(found.covered, words.at)
                share = _sums(np.where(found.covered, words.chars, 0), words.at) / np.maximum(chars, 1)
                symbols = _sums(_SYMBOL[data], offsets)
                raw = data.tobytes()
                dups = [duplicate_lines(raw[offsets[i]:offsets[i + 1]]) for i in range(last - first)]
                failed = (n < min_words) | (100 * repeated > max_repeated * n)
                kept = ~failed & (share <= max_covered) & (found.longest <= max_longest)
                own = [spans(found.covered[words.at[i]:words.at[i + 1]]) for i in range(last - first)]
                ends = np.cumsum([0, *map(len, own)], dtype=np.int32)
                flat = np.concatenate(own) if own else np.zeros((0, 2), np.int64)
                union = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["first", "end"]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), *[pa.array(np.asarray(v, np.int64)) for v in (n, chars, symbols, dups, repeated)], pa.array(failed),
                                                  pa.array(_sums(found.maximal, words.at)), union, pa.array(found.longest), pa.array(share), pa.array(kept)], schema.names)

    return columns(docs, id_col, text_col).mapInArrow(run, schema)
