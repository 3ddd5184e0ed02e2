"""License scan: Aho-Corasick over words, shunting-yard over licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from .common import columns, prepare

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notices (words only, as the scan sees them), their labels and how sure they are.
NOTICES = {
    "permission is hereby granted free of charge": ("mit", 0.95),
    "licensed under the apache license": ("apache", 0.95),
    "apache license version 2 0": ("apache-2.0", 0.95),
    "gnu general public license": ("gpl", 0.95),
    "gnu general public license version 2": ("gpl-2.0", 0.95),
    "gnu general public license version 3": ("gpl-3.0", 0.95),
    "gnu lesser general public license": ("lgpl", 0.95),
    "gnu affero general public license": ("agpl", 0.95),
    "mozilla public license": ("mpl", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.95),
    "bsd license": ("bsd", 0.8),
    "isc license": ("isc", 0.8),
    "cc by": ("cc-by", 0.7),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "creative commons attribution": ("cc-by", 0.9),
    "cc0": ("cc0", 0.9),
    "all rights reserved": ("proprietary", 0.6),
}
#: Licences that a text may be under to count as permissive, unless the caller names others.
PERMISSIVE = ("0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc0-1.0", "isc", "mit", "unlicense", "zlib")
TAG = "spdx license identifier"
#: The tag as it stands in a text; its expression ends with the line or where the next tag starts.
TAG_TEXT = re.compile(r"(?ai)spdx[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+license[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+identifier[ \t]*:?[ \t]*")
LINE = re.compile(r"[^\n\r]*")
BASE_SCORE, TAG_SCORE = 0.8, 1.0
#: Order of binding in licence expressions, loosest first.
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
OPERAND = re.compile(r"[a-z0-9][a-z0-9.:-]*\+?")
#: Other bytes than digits, letters and those of non-ASCII characters part words; A-Z becomes lower case.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
STEP = 1 << 22


def postfix(expression: str) -> list[str]:
    """Licence expression in postfix order, by the shunting-yard method. ValueError if it isn't well formed."""
    out: list[str] = []
    stack: list[str] = []
    want_operand = True
    for token in re.findall(r"[()]|[^\s()]+", expression.lower()):
        if token == "(":
            if not want_operand:
                raise ValueError(expression)
            stack.append(token)
        elif token == ")":
            if want_operand:
                raise ValueError(expression)
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError(expression)
            stack.pop()
        elif token in PRECEDENCE:
            if want_operand:
                raise ValueError(expression)
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            want_operand = True
        else:
            if not want_operand or not OPERAND.fullmatch(token):
                raise ValueError(expression)
            out.append(token)
            want_operand = False
    while stack:
        if stack[-1] == "(":
            raise ValueError(expression)
        out.append(stack.pop())
    if want_operand:
        raise ValueError(expression)
    return out


def evaluate(tokens: list[str], allowed) -> bool:
    """Whether the licences that ``allowed`` accepts satisfy the expression; ``a with b`` needs only its licence accepted."""
    stack: list[bool] = []
    for t in tokens:
        if t in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            stack.append(a if t == "with" else a and b if t == "and" else a or b)
        else:
            stack.append(bool(allowed(t)))
    return stack[0]


def licences(tokens: list[str]) -> set[str]:
    """Licences an expression names; an exception after ``with`` is joined to its licence."""
    stack: list[set[str]] = []
    for t in tokens:
        if t in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            if t == "with":
                stack.append({f"{x} with {y}" for x in a for y in b})
            else:  # the larger set takes the other in, so a long expression isn't copied for each operator
                more, fewer = (a, b) if len(a) >= len(b) else (b, a)
                more |= fewer
                stack.append(more)
        else:
            stack.append({t})
    return stack[0]


def tag_expression(line: str) -> tuple[set[str], list[str]] | None:
    """Licences and postfix form of the longest well-formed expression at the start of the text behind a tag."""
    tokens: list[str] = []
    whole, depth, want_operand = 0, 0, True
    for m in re.finditer(r"[()]|[A-Za-z0-9][A-Za-z0-9.:-]*\+?|\S", line):
        token = m[0].lower()
        operand = token not in ("(", ")") and token not in PRECEDENCE
        if want_operand != (operand or token == "(") or token == ")" and not depth or operand and not OPERAND.fullmatch(token):
            break  # no well-formed expression goes on like this
        depth += (token == "(") - (token == ")")
        want_operand = token == "(" or token in PRECEDENCE
        tokens.append(token)
        if not depth and not want_operand and token.rstrip(".") not in PRECEDENCE:
            whole = len(tokens)
    if not whole:
        return None
    made = postfix(" ".join(tokens[:whole]).rstrip("."))
    return licences(made), made


def automaton():
    made = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        made.add_word(f" {phrase} ", (phrase, len(phrase.split())))
    made.make_automaton()
    return made


LONGEST = max(len(p.split()) for p in (*BASE, *NOTICES, TAG))


def scan_text(text: str, machine) -> tuple[int, list[tuple[int, str]]]:
    """Number of words, and (first word, phrase) of every place of a phrase; a long text goes in steps."""
    raw = text.encode().translate(WORDS)
    n, at, carry, found = 0, 0, [], []
    while at < len(raw):
        end = len(raw) if at + STEP >= len(raw) else raw.rfind(b" ", at, at + STEP)
        if end < at:  # one word longer than a step
            end = raw.find(b" ", at)
            end = len(raw) if end < 0 else end
        words = raw[at:end].split()
        at = end + 1
        before = n - len(carry)
        line = f" {b' '.join(carry + words).decode('latin-1')} "
        seen = ended = 0  # a hit's last word is the one before its last space; spaces are counted on from the hit before
        for last, (phrase, size) in machine.iter(line):
            ended += line.count(" ", seen, last)
            seen, start = last, ended - size
            if start + size > len(carry):
                found.append((before + start, phrase))
        n += len(words)
        carry = (carry + words)[-LONGEST:]
    return n, found


def scan(text: str, machine, accepted=PERMISSIVE) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, satisfied) of one text.

    ``satisfied``: whether the accepted licences satisfy the expression of every tag (a licence "or
    later" counts as its own); None without an expression.
    """
    n, found = scan_text(text, machine)
    if not found:
        return n, 0, None, None, "", "", 0.0, [], None
    base = sorted({(at, p) for at, p in found if p in BASE})
    base_labels = {BASE[p] for _, p in base}
    labels, score, expressions, satisfied = set(base_labels), BASE_SCORE if base else 0.0, [], None
    for _, p in found:
        if p in NOTICES:
            labels.add(NOTICES[p][0])
            score = max(score, NOTICES[p][1])
    if any(p == TAG for _, p in found):
        tags = list(TAG_TEXT.finditer(text))
        for m, following in zip(tags, [*(t.start() for t in tags[1:]), len(text)], strict=True):
            if made := tag_expression(LINE.match(text, m.end(), following)[0]):
                labels |= made[0]
                expressions.append(" ".join(made[1]))
                score = TAG_SCORE
                satisfied = satisfied is not False and evaluate(made[1], lambda name: name.removesuffix("+") in accepted)
    starts = [at for at, _ in base]
    return n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, expressions, satisfied


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accepted: Iterable[str] = PERMISSIVE) -> DataFrame:
    """License findings of every whole text, a row for each input row.

    (id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    expressions, satisfied). n_base counts all places of base phrases, first_word and
    last_word are their least and greatest start (words from 0; null without
    any). labels adds those of other notices and of identifier tags;
    expressions (joined by newlines) are the tags' expressions in postfix order;
    satisfied tells whether the ``accepted`` licences (lower case) are enough for
    every one of them, so ``a or b`` needs one and ``a and b`` both (null without a tag). score is
    the surest finding's: tag 1, notice 0.6 to 0.95, base phrase 0.8, none 0.
    A null or empty text has no words; null and repeated ids are rows like
    others; an empty table gives none; other columns are not read. A narrow
    step: nothing is shuffled.
    """
    prepare(docs.sparkSession)
    schema = StructType([StructField("id", docs.schema[id_col].dataType), *[StructField(n, LongType()) for n in ("n_words", "n_base", "first_word", "last_word")],
                         StructField("base_labels", StringType()), StructField("labels", StringType()), StructField("score", DoubleType()), StructField("expressions", StringType()), StructField("satisfied", BooleanType())])
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_()]
    known = frozenset(accepted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for b in batches:
            rows = [(*(r := scan(x.as_py() or "", machine, known))[:7], "\n".join(r[7]), r[8]) for x in b.column(1)]
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], schema.names)

    return columns(docs, id_col, text_col).mapInArrow(run, schema)
