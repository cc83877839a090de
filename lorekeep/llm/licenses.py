"""Licence scans: tags, notice phrases and licence expressions in whole texts.

Method. A text is lower-cased (A-Z) and cut into words; an Aho-Corasick automaton walks the
words once and reports every notice phrase and every identifier tag, and where. What follows a tag
and its colon, or equals sign, on the line is a licence expression: a shunting-yard parser puts it
into postfix order and evaluates and/or/with over permissiveness (or: the better, and: the worse
side; with: an exception lifts a copyleft licence to half). The score is the least permissiveness of all that was found, 0 if
nothing was.

Defined results: null text is empty (no words, no labels, score 0); every row gives a row;
expressions that don't parse add no label, but operators at the end of a line that lack a right side
are left out; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import texts
from .decontaminate import raw_text
from .words import ALNUM_SPACES

BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAGS = ("spdx license identifier", "license expression")
#: Label and permissiveness of a licence by the start of its identifier; the longest start counts.
FAMILIES = {
    "0bsd": ("bsd", 1.0), "agpl": ("agpl", 0.0), "apache": ("apache", 1.0), "bsd": ("bsd", 1.0), "bsl": ("bsl", 1.0), "cc-by": ("cc-by", 0.75), "cc-by-nc": ("cc-by-nc", 0.0),
    "cc0": ("cc0", 1.0), "epl": ("epl", 0.5), "gpl": ("gpl", 0.0), "isc": ("isc", 1.0), "lgpl": ("lgpl", 0.5), "mit": ("mit", 1.0), "mpl": ("mpl", 0.5), "unlicense": ("public-domain", 1.0),
}
OF_LABEL = {label: value for label, value in FAMILIES.values()} | {"reserved": 0.0}
_OPERATORS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_AFTER_TAG = re.compile(rb"[\"']?[ \t]*[:=][ \t]*([^\r\n]*)")
_WORD = re.compile(rb"[^ ]+")


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: identifiers and operators in postfix order; ValueError if it doesn't parse."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether one must come next
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _OPERATORS:
            if operand:
                raise ValueError("operator without a left side")
            while stack and stack[-1] != "(" and _OPERATORS[stack[-1]] >= _OPERATORS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif token == "(":
            if not operand:
                break  # prose after the expression
            stack.append(token)
        elif token == ")":
            if operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if not operand:
                break
            out.append(low)
            operand = False
    while operand and out and stack and stack[-1] != "(":
        stack.pop()  # an operator that the line's end cuts off
        operand = bool(stack) and stack[-1] == "("
    if operand or "(" in stack:
        raise ValueError("expression isn't complete")
    return out + stack[::-1]


def family(identifier: str) -> tuple[str, float] | None:
    starts = [k for k in FAMILIES if identifier == k or identifier.startswith((k + "-", k + "+", k + "."))]
    return FAMILIES[max(starts, key=len)] if starts else None


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """(labels, permissiveness) of an expression, or None if it doesn't parse or names no known licence."""
    try:
        postfix = to_postfix(expression)
    except ValueError:
        return None
    stack: list[tuple[set[str], float | None]] = []
    for token in postfix:
        if token not in _OPERATORS:
            known = family(token)
            stack.append(({known[0]}, known[1]) if known else (set(), None))
            continue
        (right_labels, right), (left_labels, left) = stack.pop(), stack.pop()
        both = [x for x in (left, right) if x is not None]
        if token == "with":
            stack.append((left_labels, None if left is None else max(left, 0.5)))
        else:
            stack.append((left_labels | right_labels, (max if token == "or" else min)(both) if both else None))
    labels, value = stack[0]
    return (labels, value) if labels and value is not None else None


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICE_PHRASES, *TAGS}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(raw: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    spaced = raw.translate(ALNUM_SPACES)
    own = spaced.split()
    line = f" {b' '.join(own).decode('utf-8', 'replace')} "
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    tags: list[int] = []
    gaps = None
    for last, phrase in automaton().iter(line):
        if gaps is None and (phrase in TAGS or phrase in BASE_PHRASES):
            gaps = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 32)
        if phrase in TAGS:
            tags.append(int(np.searchsorted(gaps, last)) - 1)  # its last word
        if phrase in BASE_PHRASES:
            starts.append(int(np.searchsorted(gaps, last - len(phrase) - 1)))
            base.add(BASE_PHRASES[phrase])
        if phrase in NOTICE_PHRASES:
            labels.add(NOTICE_PHRASES[phrase])
    labels |= base
    values = [OF_LABEL[x] for x in labels if x in OF_LABEL]
    ends = [m.end() for m in _WORD.finditer(spaced)] if tags else []
    for k in tags:
        told = _AFTER_TAG.match(raw, ends[k])
        if told and (result := evaluate(told[1].decode("utf-8", "replace"))):
            labels |= result[0]
            values.append(result[1])
    return (len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(values, default=0.0))


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan(documents: DataFrame) -> DataFrame:
    """One row for each document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [scan_text(raw_text(text)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t.type) for i, t in enumerate(list(_OUT_ARROW)[1:]))], schema=_OUT_ARROW)

    return texts(documents).mapInArrow(run, _OUT)
