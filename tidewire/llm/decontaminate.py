"""Benchmark decontamination: approximate matches of test items by the pigeonhole principle.

An item of m characters may differ in e = floor(RATE * m) edits. Cut into e + 1 pieces, at least one of
them stands unchanged in every text that holds the item with at most e edits. All pieces are searched
at once (Aho-Corasick); around each hit Myers' bit-parallel edit distance decides. Texts and items are
compared lower-cased, with runs of white space as one space.
"""
from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks

RATE = 0.05
#: item characters that are broadcast at once; more items go through the texts in further rounds
ROUND_CHARS = 8 << 20


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length with their places."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:z]) for a, z in zip(cuts, cuts[1:])]


def best_distance(pattern: str, text: str) -> int:
    """Smallest edit distance of ``pattern`` to any part of ``text`` (Myers, one wide bit vector)."""
    m = len(pattern)
    full, last = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | (1 << i)
    plus, minus, score = full, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | minus
        eq = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(eq | plus))
        down = plus & eq
        if up & last:
            score += 1
        if down & last:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        best = min(best, score)
    return best


class Matcher:
    """Items with their pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = {}
        where: dict[str, list] = {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            errors = int(rate * len(text))
            self.items[item_id] = (text, errors)
            for at, piece in pieces(text, errors):
                where.setdefault(piece, []).append((item_id, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[int]:
        """Ids of the items that ``text`` holds within their edits."""
        text = normal(text)
        found, tried = set(), set()
        if not text or not self.items:
            return []
        for end, (size, places) in self.automaton.iter(text):
            for item_id, at in places:
                begin = end - size + 1 - at
                if item_id in found or (item_id, begin) in tried:
                    continue
                tried.add((item_id, begin))
                item, errors = self.items[item_id]
                part = text[max(0, begin - errors):begin + len(item) + errors]
                if errors == 0 or best_distance(item, part) <= errors:
                    if errors or item in part:
                        found.add(item_id)
        return sorted(found)


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_ids (sorted), n_items, contaminated for ``docs`` against ``items`` (item_id, text).

    Items without text match nothing, and so do null and empty texts. Items are broadcast in rounds of
    about ROUND_CHARS characters, each of which goes over all texts; the usual benchmark is one round.
    Rows without a doc_id are dropped; a doc_id must be unique. A repeated item_id counts as one item
    with its smallest text.
    """
    items = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    rounds = -(-size // ROUND_CHARS) or 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    out = None
    for i in range(rounds):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == i)
        found = _one_round(docs, sorted(map(tuple, part.collect())), rate)
        out = found if out is None else out.union(found)
    if rounds > 1:
        out = out.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
    return out.select("doc_id", "item_ids", F.size("item_ids").cast("long").alias("n_items"),
                      (F.size("item_ids") > 0).alias("contaminated"))


def _one_round(docs: DataFrame, items: list, rate: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        match = Matcher(shared.value, rate)
        for b in blocks(batches):
            ids = [match(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))],
                                             names=["doc_id", "item_ids"])

    return docs.mapInArrow(run, "doc_id long, item_ids array<long>")
