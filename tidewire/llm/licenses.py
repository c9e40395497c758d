"""License scans: notice phrases and identifier tags by Aho-Corasick, license expressions by a shunting yard.

A text is scanned as its words, so that case, punctuation and line breaks inside a notice do not matter. Where the
scan meets an identifier tag, the rest of that line is read as an expression of ``and``, ``or`` and ``with``. It is
evaluated to the strictest obligation it leaves: of alternatives the mildest counts, of parts that hold together the
strictest, and an exception makes a strong copyleft a weak one.
"""
from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks, byte_table, word_runs

# The phrases of the contract and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Further phrases of common notices and the license they stand for.
NOTICES = {
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "zlib license": "zlib",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc0": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "proprietary",
}

# Tags that an expression follows.
TAGS = ("spdx license identifier", "license expression")

# Obligations from mild to strict. An identifier belongs to the longest family that it equals or goes on
# from with a hyphen or plus.
STRICTNESS = {
    "unlicense": 0, "cc0": 0, "0bsd": 0,
    "mit": 1, "bsd": 1, "apache": 1, "isc": 1, "zlib": 1, "bsl": 1, "cc-by": 1,
    "lgpl": 2, "mpl": 2, "epl": 2, "cc-by-sa": 2,
    "gpl": 3, "agpl": 3,
    "cc-by-nc": 4, "cc-by-nd": 4, "cc-by-nc-sa": 4, "cc-by-nc-nd": 4, "proprietary": 4, "other": 4,
}
WEAK, STRONG = 2, 3

#: how sure a tag and a phrase make of their label
TAG_WEIGHT, PHRASE_WEIGHT = 0.95, 0.8

WORD_BYTES = byte_table(lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
TOKEN = re.compile(rb"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")
LINE_END = re.compile(rb"[\r\n]")
BINDING = {"with": 3, "and": 2, "or": 1}

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, strictness int, expressions array<string>")


@lru_cache(1)
def _automaton():
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *TAGS}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


LONGEST = max(len(p.split()) for p in (*BASE, *NOTICES, *TAGS))


def family(identifier: str) -> str:
    """The label of a license identifier; ``other`` for those that are not known."""
    best = ""
    for name in STRICTNESS:
        rest = identifier[len(name):]
        if identifier.startswith(name) and (not rest or rest[0] in "-+") and len(name) > len(best):
            best = name
    return best or "other"


class Yard:
    """One expression: operands and operators are moved to postfix order and evaluated as they come off."""

    def __init__(self):
        self.values, self.operators, self.labels, self.postfix = [], [], [], []

    def _apply(self):
        operator = self.operators.pop()
        self.postfix.append(operator)
        right, left = self.values.pop(), self.values.pop()
        if operator == "with":
            left = WEAK if left == STRONG else left
        else:
            left = max(left, right) if operator == "and" else min(left, right)
        self.values.append(left)

    def _unwind(self, binding: int):
        while self.operators and BINDING.get(self.operators[-1], 0) >= binding:
            self._apply()

    def read(self, tokens) -> tuple[int, str, list[str]] | None:
        """(strictness, postfix form, labels) of all ``tokens``, or None if they are no expression."""
        operand = False  # whether one stands to the left
        exception = False
        for token in tokens:
            if token in BINDING:
                if not operand:
                    return None
                self._unwind(BINDING[token])
                self.operators.append(token)
                operand, exception = False, token == "with"
            elif token == "(":
                if operand or exception:
                    return None
                self.operators.append(token)
            elif token == ")":
                if not operand:
                    return None
                self._unwind(1)
                if not self.operators:
                    return None
                self.operators.pop()
            else:
                if operand:
                    return None
                self.postfix.append(token)
                if not exception:
                    self.labels.append(family(token))
                self.values.append(0 if exception else STRICTNESS[self.labels[-1]])
                operand, exception = True, False
        if not operand:
            return None
        self._unwind(1)
        return None if self.operators else (self.values[0], " ".join(self.postfix), self.labels)


def expression(line: bytes) -> tuple[int, str, list[str]] | None:
    """The expression at the start of a lower-cased ``line``; what follows it, such as a comment's end, is left out.

    It ends where no token follows, or before an operand without an operator to its left. Without an
    identifier, with an operator that lacks one or with open parentheses there is none.
    """
    tokens, at, operand = [], 0, False
    while (m := TOKEN.match(line, at)) is not None:
        token = m[1].decode()
        if operand and token not in BINDING and token != ")":
            break
        operand = token not in BINDING and token != "("
        tokens.append(token)
        at = m.end()
    return Yard().read(tokens)


def _tagged(raw: bytes, start: int, word: int) -> bytes | None:
    """The rest of the line behind the tag whose last word is the ``word``-th from byte ``start``, if a colon follows."""
    end = next(islice(WORD.finditer(raw, start), word, None)).end()
    if raw[end:end + 1] != b":":
        return None
    stop = LINE_END.search(raw, end)
    return raw[end + 1:stop.start() if stop else len(raw)]


def _hits(words: list[bytes], seen: int):
    """(first word, phrase) of the phrases in ``words`` that end behind the first ``seen`` words, by place."""
    text = f" {b' '.join(words).decode()} "
    found = sorted((end - len(phrase) - 1, phrase) for end, phrase in _automaton().iter(text))
    at = word = 0
    for place, phrase in found:
        word += text.count(" ", at, place)
        at = place
        if word + phrase.count(" ") + 1 > seen:
            yield word, phrase


def scan(text: str | None) -> tuple:
    """The columns of one text but for doc_id."""
    raw = (text or "").encode().lower()
    n_words, base, labels, sure, values, forms = 0, [], set(), {}, [], []
    notices, tail = [], []
    for start, words in word_runs(raw, WORD_BYTES):
        first = n_words - len(tail)
        for word, phrase in _hits(tail + words, len(tail)):
            if phrase in BASE:
                base.append((first + word, phrase))
            if phrase in TAGS:
                last = word + phrase.count(" ") - len(tail)
                line = _tagged(raw, start, last)
                found = line and expression(line)
                if found:
                    values.append(found[0])
                    forms.append(found[1])
                    labels.update(found[2])
                    sure.update((("tag", label), TAG_WEIGHT) for label in found[2])
            if phrase in NOTICES:
                notices.append((first + word, first + word + phrase.count(" ") + 1, NOTICES[phrase]))
        n_words += len(words)
        tail = (tail + words)[-(LONGEST - 1):]
    for _, phrase in base:
        notices.append((None, None, BASE[phrase]))
    reach = {}
    for a, b, _ in notices:
        if a is not None:
            reach[a] = max(reach.get(a, b), b)
    for a, b, label in notices:
        # a phrase that a longer one goes on from says less than that
        if a is None or reach[a] == b:
            labels.add(label)
            sure["phrase", label] = PHRASE_WEIGHT
            values.append(STRICTNESS[label])
    doubt = 1.0
    for weight in sure.values():
        doubt *= 1 - weight
    places = [a for a, _ in base]
    return (n_words, len(base), min(places, default=None), max(places, default=None),
            ",".join(sorted({BASE[p] for _, p in base})), ",".join(sorted(labels)), round(1 - doubt, 6),
            max(values, default=None), forms)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for every row of ``docs`` with the columns of ``SCHEMA``.

    Words are runs of ASCII letters and digits and of characters beyond ASCII; A-Z are lower-cased. ``n_base`` counts
    the places of the phrases of ``BASE``, ``first_word`` and ``last_word`` are their smallest and largest start (null if
    there are none), ``labels`` adds those of ``NOTICES`` and of tag expressions. ``score`` grows with the number of
    distinct labels found by tags and by phrases; ``strictness`` is the strictest obligation found, null if none;
    ``expressions`` are in postfix order. A malformed expression counts as no tag. Null and empty texts have no
    words, no labels and score 0. A very long text is scanned in slices of its words; repeated doc_ids give a row
    each, a null one stays null. Other columns do not matter.
    """
    def run(batches):
        for b in blocks(batches):
            rows = [scan(t) for t in b.column("text").to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
