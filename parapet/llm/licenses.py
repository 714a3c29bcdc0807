"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags in the word
sequence of each text; the expression behind a tag is parsed by a shunting yard and evaluated.

One pass over the documents, without a shuffle.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from parapet.llm.common import map_batches
from parapet.llm.words import ALNUM

#: The base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Further notice phrases, as words.
NOTICE_PHRASES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "proprietary",
}

#: Words of a tag that introduces an expression.
TAG_PHRASE = "spdx license identifier"

#: Label prefix of an identifier, and how much the license restricts use (0 free, 1 not usable).
RESTRICTION = {
    "mit": 0.0, "apache": 0.1, "bsd": 0.0, "isc": 0.0, "cc0": 0.0, "unlicense": 0.0, "cc-by-nc": 0.9, "cc-by-sa": 0.5,
    "cc-by-nd": 0.9, "cc-by": 0.1, "mpl": 0.4, "lgpl": 0.5, "agpl": 0.9, "gpl": 0.7, "proprietary": 1.0,
}
UNKNOWN = 0.6
EXCEPTION_FACTOR = 0.5

_TABLE = bytes(((c + 32 if 65 <= c <= 90 else c) if ALNUM[c] else 32) for c in range(256))
_TAG = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\n]*)", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: in an expression an identifier is known or has a digit or a capital; other words are free text behind it
_NAMED = re.compile(r"[A-Z0-9]")
_NO_NAME = ("not",)


def restriction(identifier: str) -> float:
    """Restriction of a license identifier, by the longest known prefix."""
    name = identifier.lower()
    known = [k for k in RESTRICTION if name.startswith(k)]
    return RESTRICTION[max(known, key=len)] if known else UNKNOWN


def _is_name(tok: str) -> bool:
    low = tok.lower()
    return low not in _NO_NAME and (any(low.startswith(k) for k in RESTRICTION) or _NAMED.search(tok) is not None)


def postfix(expression: str) -> list[str]:
    """Shunting yard: operands and operators of a license expression in postfix order.

    WITH binds closest, then AND, then OR. Tokens that cannot follow end the expression, a missing
    closing bracket is taken as given, so free text behind a tag never raises.
    """
    out: list[str] = []
    ops: list[str] = []
    operand = False
    for tok in _TOKEN.findall(expression):
        low = tok.lower()
        if tok == "(" and not operand:
            ops.append(tok)
        elif tok == ")" and operand and "(" in ops:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif low in _PRECEDENCE and operand:
            while ops and ops[-1] != "(" and _PRECEDENCE[ops[-1]] >= _PRECEDENCE[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = False
        elif low not in _PRECEDENCE and tok not in "()" and not operand and _is_name(tok):
            out.append(tok)
            operand = True
        else:
            break
    if not operand and ops:  # an operator or bracket without its right side
        while ops and ops[-1] == "(":
            ops.pop()
        if ops:
            ops.pop()
    out += [o for o in reversed(ops) if o != "("]
    return out


def evaluate(expression: str) -> tuple[list[str], float] | None:
    """Identifiers of an expression and its restriction: OR takes the freer side, AND the stricter,
    WITH halves the restriction of its license. None if no identifier is found."""
    stack: list[tuple[list[str], float]] = []
    for tok in postfix(expression):
        if tok in _PRECEDENCE and len(stack) >= 2:
            (bn, bv), (an, av) = stack.pop(), stack.pop()
            if tok == "with":
                stack.append((an, av * EXCEPTION_FACTOR))
            else:
                stack.append((an + bn, min(av, bv) if tok == "or" else max(av, bv)))
        elif tok not in _PRECEDENCE:
            stack.append(([tok.lower()], restriction(tok)))
    return (sorted({n for ns, _ in stack for n in ns}), max(v for _, v in stack)) if stack else None


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """Patterns stand between spaces, so that only whole words match."""
    a = ahocorasick.Automaton()
    for phrases, base in ((NOTICE_PHRASES, False), (BASE_PHRASES, True)):
        for phrase, label in phrases.items():
            a.add_word(f" {phrase} ", (len(phrase), label, base))
    a.add_word(f" {TAG_PHRASE} ", (len(TAG_PHRASE), None, False))
    a.make_automaton()
    return a


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0
    line = b"".join([b" ", b" ".join(words), b" "]).decode("utf-8", "surrogatepass")
    places: list[int] = []
    base: set[str] = set()
    noticed: set[str] = set()
    named: set[str] = set()
    score, tagged = 0.0, False
    for end, (length, label, is_base) in automaton().iter(line):
        if label is None:
            tagged = True
        elif is_base:
            places.append(end - length)
            base.add(label)
        else:
            noticed.add(label)
    if tagged:
        for m in _TAG.finditer(text):
            if value := evaluate(m[1]):
                named.update(value[0])
                score = max(score, value[1])
    if not (places or noticed or named):
        return len(words), 0, None, None, "", "", 0.0
    score = max([score, *(restriction(x) for x in base | noticed)])
    first, last = (line.count(" ", 0, p) - 1 for p in (min(places), max(places))) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | noticed | named)), score


SCAN_SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored).

    ``score`` is the restriction of the strictest notice or tag, 0 without one. A null or empty text
    has no words and no labels (empty strings, null places); a null doc_id stays null; repeated rows
    give repeated results; no rows give no rows.
    """

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan_text(t.as_py()) for t in b.column("text")]
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return map_batches(docs.select("doc_id", "text"), fn, SCAN_SCHEMA)
