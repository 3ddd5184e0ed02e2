"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur with up to k edits. Cut into k + 1 pieces,
at least one piece is then found unchanged. One automaton finds all pieces of
all items; each hit fixes where the item would lie, and Myers' bit-parallel
distance decides on that window. A short item has no edits and must stand
between word bounds.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from .common import columns, prepare

#: Edits allowed for each character of an item (pieces have about 1 / ERRORS characters).
ERRORS = 0.1
#: Items with fewer characters (normalised) are found unedited and as whole words only: with edits, or inside words, they occur in clean text.
MIN_CHARS = 32
#: Items and characters of one pass over the documents: the bound on what is broadcast at a time (a longer item is a block of its own).
BLOCK, BLOCK_CHARS = 20_000, 8 << 20
_RUNS, _ODD = re.compile(r"[\W_]+"), re.compile(r"[^\x00-\x7f\w]")
#: Scripts written without spaces: their characters bound a word wherever they stand.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_ASCII = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Length of the runs that a window must share with an item before its distance is worked out.
GRAM = 4


def normalise(text: str) -> str:
    """Lower case, and runs of other characters than letters and digits as one space."""
    low = text.lower()
    if low.isascii() or not _ODD.search(low):  # only ASCII characters to replace
        return b" ".join(low.encode().translate(_ASCII).split()).decode()
    return _RUNS.sub(" ", low).strip()


def places(text: str) -> tuple[str, list[int]]:
    """``normalise(text)`` and the place in ``text`` of each of its characters and of its end.

    Both come from the lower-cased text, in which one letter can be two
    characters, of which the second can be one that parts words.
    """
    low = text.lower()
    origin = range(len(text)) if len(low) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
    out, at = [], []
    for m in re.finditer(r"[^\W_]+", low):
        if out:
            at.append(origin[m.start() - 1])
        out.append(m[0])
        at += origin[m.start():m.end()]
    return " ".join(out), [*at, (at[-1] + 1) if at else 0]


class Myers:
    """Least edit distance of a pattern to any stretch of a text, a bit per pattern character."""

    def __init__(self, pattern: str):
        self.m, self.masks = len(pattern), defaultdict(int)
        for i, c in enumerate(pattern):
            self.masks[c] |= 1 << i
        self.masks = dict(self.masks)

    def search(self, text: str, anchored: bool = False) -> tuple[int, int]:
        """(distance, end): the least distance and the first end with it. Anchored: the stretch starts with the text."""
        full, top, get = (1 << self.m) - 1, 1 << (self.m - 1), self.masks.get
        pv, mv, score, best, end = full, 0, self.m, self.m, 0
        carry = 1 if anchored else 0
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 | carry
            mh <<= 1
            pv = (mh | ~(xv | ph)) & full
            mv = ph & xv & full
            if score < best:
                best, end = score, j + 1
        return best, end


def pieces(pattern: str, budget: int) -> list[tuple[int, str]]:
    """(start, piece): the pattern in budget + 1 pieces of nearly equal length."""
    n = budget + 1
    cuts = [len(pattern) * i // n for i in range(n + 1)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def bound(text: str, at: int) -> bool:
    """Whether no word goes on over this place of a normalised text."""
    return not 0 < at < len(text) or any(c == " " or _UNSPACED.match(c) for c in text[at - 1:at + 1])


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[object, str]], errors: float, min_chars: int = MIN_CHARS):
        self.items = [(k, p, int(len(p) * errors) if len(p) >= min_chars else 0) for k, p in items]
        self.min_chars = min_chars
        self.machine = ahocorasick.Automaton()
        filed = defaultdict(list)
        for i, (_, p, budget) in enumerate(self.items):
            for start, piece in pieces(p, budget):
                filed[piece].append((i, start, len(piece)))
        for piece, where in filed.items():
            self.machine.add_word(piece, where)
        self.machine.make_automaton()
        self.made: dict[int, tuple[Myers, list[str]]] = {}

    def _near(self, i: int, window: str) -> tuple[int, int] | None:
        """``Myers.search`` in a window, unless too few of the item's side-by-side runs of ``GRAM`` characters are in it: each edit changes at most one."""
        _, p, k = self.items[i]
        if i not in self.made:
            self.made[i] = Myers(p), [p[j:j + GRAM] for j in range(0, len(p) - GRAM + 1, GRAM)]
        machine, grams = self.made[i]
        if sum(map(window.__contains__, grams)) < len(grams) - k:
            return None
        return machine.search(window)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) in the normalised text: the best place of each item within its budget; of a short one the first."""
        spans, short = defaultdict(list), {}
        for last, where in self.machine.iter(text) if self.items else ():
            for i, start, length in where:
                _, p, k = self.items[i]
                begin = last + 1 - length - start
                if len(p) < self.min_chars:
                    if i not in short and bound(text, begin) and bound(text, last + 1):
                        short[i] = begin
                    continue
                spans[i].append((max(0, begin - k), min(len(text), begin + len(p) + k)))
        out = [(i, 0, begin, begin + len(self.items[i][1])) for i, begin in short.items()]
        for i, windows in spans.items():
            _, p, k = self.items[i]
            best = (k + 1, 0)
            windows.sort()
            merged: list[list[int]] = []
            for a, b in windows:  # windows that overlap are searched once
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                if got := self._near(i, text[a:b]):
                    best = min(best, (got[0], a + got[1]))
            if best[0] <= k:
                d, end = best
                back, length = Myers(p[::-1]).search(text[max(0, end - len(p) - k):end][::-1], anchored=True)
                out.append((i, d, end - length, end))
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block: int, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The items, normalised, a block at a time; those without a letter or digit and null ones are left out."""
    part: list[tuple[object, str]] = []
    size = 0
    for r in columns(items, id_col, text_col).toLocalIterator():
        if not (p := normalise(r[1] or "")):
            continue
        if part and (len(part) == block or size + len(p) > chars):
            yield part
            part, size = [], 0
        part.append((r[0], p))
        size += len(p)
    if part:
        yield part


def find_benchmark(docs: DataFrame, items: DataFrame, errors: float = ERRORS, min_chars: int = MIN_CHARS, block: int = BLOCK,
                   id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Benchmark items found in documents: (id, item_id, distance, budget, start, end).

    A row per input row and item that occurs in its whole text with at most
    ``int(errors * length)`` edits (both normalised: lower case, runs of non-letters and non-digits
    as one space), with the least distance and the stretch of the
    original text where it is found. An item shorter than ``min_chars`` has budget 0 and must
    stand between word bounds. Clean documents have no row. Items go out in blocks of ``block`` items or
    ``BLOCK_CHARS`` characters; more items mean more passes, not a larger broadcast. A null text or item matches
    nothing, nor does an item without a letter or digit; null and repeated ids
    keep their rows; an empty table gives none; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_col].dataType
    schema = StructType([StructField("id", kind), StructField("item_id", item_kind), *[StructField(n, LongType()) for n in ("distance", "budget", "start", "end")]])
    out = None
    for part in item_blocks(items, item_col, item_text_col, block):
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, errors, min_chars)
            for b in batches:
                rows, cols = [], [[] for _ in range(5)]
                for i, x in enumerate(b.column(1)):
                    text = x.as_py() or ""
                    found = matcher.find(normalise(text))
                    at = places(text)[1] if found else []
                    for item, d, a, e in found:
                        rows.append(i)
                        key, _, budget = matcher.items[item]
                        for c, v in zip(cols, (key, d, budget, at[a], at[e - 1] + 1), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, None if c else pa.int64()) for c in cols]], schema.names).cast(pa.schema([b.schema.field(0).with_name("id"), *[pa.field(f.name, pa.int64() if f.name != "item_id" else _arrow(item_kind)) for f in schema.fields[1:]]]))

        found = columns(docs, id_col, text_col).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def clean_rows(docs: DataFrame, items: DataFrame, errors: float = ERRORS, min_chars: int = MIN_CHARS, block: int = BLOCK,
               text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item is found (as by ``find_benchmark``). Nothing is shuffled."""
    spark = prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    for part in item_blocks(items, item_col, item_text_col, block):
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, errors, min_chars)
            for b in batches:
                yield b.filter(pa.array([not matcher.find(normalise(x.as_py() or "")) for x in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
