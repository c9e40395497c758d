"""Token counts of a byte-level BPE tokenizer without encoding whole texts.

A text is cut at special tokens and by the tokenizer's own pattern; its count is the sum of the lengths of
its pre-tokens. Lengths come from two tiers: a table of the vocabulary's own pre-tokens, bounded by
the vocabulary and broadcast, and a cache of each worker, filled by encoding what was missed. No
pre-token is shuffled.
"""
from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .common import blocks

#: The split pattern of the tokenizer (fixed value of its format).
PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
LIMIT = 1024
#: pre-tokens that a worker remembers; a full cache starts anew
CACHED = 400_000

_caches: dict[str, tuple] = {}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def frequent_lengths(path: str) -> dict[str, int]:
    """Lengths of the vocabulary entries that are pre-tokens by themselves."""
    tokenizer = load(path)
    whole = regex.compile(PATTERN).fullmatch
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ids = sorted(tokenizer.get_vocab().values())
    words = {w for w in tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
             if w and w not in special and "�" not in w and whole(w)}
    words = sorted(words)
    return dict(zip(words, (len(e.ids) for e in tokenizer.encode_batch(words, add_special_tokens=False))))


class Counter:
    """Counts tokens of texts with the shared table and a cache of its own."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.tokenizer = load(path)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()),
                       key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.cut = regex.compile(PATTERN).findall
        self.frequent = frequent
        self.cache = dict(frequent)

    def __call__(self, texts: list[str | None]) -> list[int]:
        cut, parts, extra, unknown = self.cut, [], [], set()
        for text in texts:
            n = 0
            if not text:
                words = []
            elif self.special is not None and self.special.search(text):
                segments = self.special.split(text)
                n = len(segments) - 1
                words = [w for s in segments for w in cut(s)]
            else:
                words = cut(text)
            parts.append(words)
            extra.append(n)
            unknown.update(words)
        unknown.difference_update(self.cache)
        if unknown:
            if len(self.cache) + len(unknown) > CACHED + len(self.frequent):
                self.cache = dict(self.frequent)
                unknown = {w for words in parts for w in words if w not in self.cache}
            missed = list(unknown)
            self.cache.update(zip(missed, (len(e.ids) for e in self.tokenizer.encode_batch(
                missed, add_special_tokens=False))))
        length = self.cache.__getitem__
        return [sum(map(length, words)) + n for words, n in zip(parts, extra)]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for the tokenizer file ``tokenizer``.

    Null and empty texts have no tokens. Special tokens written in a text count as one token, as the
    library does by default; none are added. Every row of the input gives one row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(tokenizer))

    def run(batches):
        if tokenizer not in _caches:
            _caches[tokenizer] = (Counter(tokenizer, shared.value),)
        count = _caches[tokenizer][0]
        for b in blocks(batches):
            n = pa.array(count(b.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64()), n,
                 pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
