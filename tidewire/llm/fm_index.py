"""Substring dedup by a compressed FM-index per shard.

A shard is the text of its stretches, each followed by a mark. Its Burrows-Wheeler transform is kept
in a wavelet matrix: per bit of a symbol one packed bit vector with a count per 64 bits. Stretches
stream through it from their last word to the first by backward search, all stretches of a shard in
step; after each word the interval of suffixes is widened to those that agree in the first ``width``
words, which keeps the matching statistic at the threshold.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks, flat, word_spans
from .passages import covered, found_rows, merged_runs, repeated_places, shards, span_lists

WIDTH = 50
GRAM = 12
#: symbol bytes of a shard
SHARD_BYTES = 8 << 20


def suffix_ranks(text: np.ndarray, width: int):
    """Suffix array by doubling, and which neighbours in it agree in ``width`` symbols."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    h, same = 1, None
    while True:
        follow = np.zeros(n, np.int64)
        follow[:max(0, n - h)] = rank[h:] + 1
        if h <= width < 2 * h:
            tail = np.zeros(n, np.int64)
            tail[:max(0, n - (width - h))] = rank[width - h:] + 1
            same = (rank, tail)
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(key[1:] != key[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = new
        h *= 2
        if h > width and same is not None and (h >= 2 * width or new[-1] == n - 1):
            break
    agree = np.zeros(n, bool)
    agree[1:] = np.all([x[order[1:]] == x[order[:-1]] for x in same], axis=0)
    return order, agree


class WaveletMatrix:
    """rank(symbol, i): how often ``symbol`` stands before place ``i``, for arrays of both."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1
            packed = np.zeros(-(-(self.n + 64) // 64) * 8, np.uint8)
            bits = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[:len(bits)] = bits
            words = packed.view(np.uint64)
            counts = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:], dtype=np.int32)
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(int(self.n - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        part = self.words[level][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.counts[level][word] + np.bitwise_count(part)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(i), i
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            a, b = self._ones(k, low), self._ones(k, high)
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low


class FMIndex:
    """Index of a text of numbers from 1; 0 marks the ends of its parts."""

    def __init__(self, text: np.ndarray, width: int):
        order, agree = suffix_ranks(text, width)
        self.order = order
        self.group = np.cumsum(~agree) - 1
        self.starts = np.append(np.flatnonzero(~agree), len(text))
        self.before = np.searchsorted(np.sort(text), np.arange(text.max() + 2))
        self.last = WaveletMatrix(text[order - 1])

    def step(self, symbol, low, high, whole):
        """Intervals of symbol + string for intervals of strings; ``whole`` ones have at least
        ``width`` symbols and are widened. Every stretch is part of the text, so none is empty."""
        low = self.before[symbol] + self.last.rank(symbol, low)
        high = self.before[symbol] + self.last.rank(symbol, high)
        if not whole:
            return low, high
        return self.starts[self.group[low]], self.starts[self.group[low] + 1]


def _search(rows: pa.Table, width: int) -> pa.RecordBatch:
    """First documents of the windows of all stretches of a shard."""
    symbols = np.frombuffer(b"".join(rows.column("symbols").to_pylist()), np.uint64)
    docs = rows.column("doc_id").to_numpy()
    length = rows.column("n").to_numpy().astype(np.int64) + width - 1
    ends = np.cumsum(length)
    number = np.unique(symbols, return_inverse=True)[1] + 1
    # each stretch is followed by a 0
    text = np.zeros(len(number) + len(ends), np.int64)
    text[np.arange(len(number)) + np.repeat(np.arange(len(ends)), length)] = number
    index = FMIndex(text, width)
    owner = np.repeat(np.arange(len(ends)), length + 1)
    lowest = np.minimum.reduceat(docs[owner[index.order]], index.starts[:-1])

    low = np.zeros(len(ends), np.int64)
    high = np.full(len(ends), len(text), np.int64)
    by_size = np.argsort(-length, kind="stable")
    sizes = -length[by_size]
    out = []
    for step in range(1, int(length.max()) + 1):
        live = by_size[:np.searchsorted(sizes, -step, "right")]
        low[live], high[live] = index.step(number[ends[live] - step], low[live], high[live], step >= width)
        if step >= width:
            out.append((live, length[live] - step, lowest[index.group[low[live]]]))
    owner, at, doc = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((at, owner))
    owner, at, doc = owner[order], at[order], doc[order]
    begin, end = merged_runs(owner, at, doc, at, moving=False)
    own = doc[begin] == docs[owner[begin]]
    return found_rows(rows, owner[begin], at[begin], at[end - 1] + 1, doc[begin], np.zeros_like(begin), own)


def _index(width):
    def run(batches):
        for rows in shards(batches, SHARD_BYTES):
            yield _search(rows, width)
    return run


def repeated_passages(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, spans): word ranges [begin, end) of windows that also start in a smaller doc_id."""
    return span_lists(repeated_places(docs, "word", width, gram, _index(width), F.expr("first_doc < doc_id"), True))


def _kept(batches):
    for b in blocks(batches):
        data, offsets = flat(b.column("text"))
        starts, ends, words = word_spans(data, offsets)
        raw = data.tobytes()
        n, gone, kept, digest = np.diff(words), [], [], []
        for i, spans in enumerate(b.column("spans").to_pylist()):
            a, z = words[i], words[i + 1]
            keep = np.ones(z - a, bool)
            if spans:
                keep = ~covered(np.array([s["begin"] for s in spans]), np.array([s["end"] for s in spans]), z - a)
            text = b" ".join([raw[x:y] for x, y in zip(starts[a:z][keep].tolist(), ends[a:z][keep].tolist())])
            gone.append(int((~keep).sum()))
            kept.append(text.decode())
            digest.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n), pa.array(gone, pa.int64()), pa.array(kept, pa.string()),
             pa.array(digest, pa.string())],
            names=["doc_id", "n_words", "n_removed", "text", "kept_sha256"])


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, text, kept_sha256: the words no repeated window covers.

    Null and empty texts have no words and the digest of an empty string; texts shorter than a
    window lose nothing. Of equal windows those in the smallest doc_id stay, all of them if it holds
    several. Rows without a doc_id are dropped; a doc_id must be unique. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    spans = repeated_passages(docs, width, gram)
    return docs.join(spans.hint("shuffle_hash"), "doc_id", "left").mapInArrow(
        _kept, "doc_id long, n_words long, n_removed long, text string, kept_sha256 string")
