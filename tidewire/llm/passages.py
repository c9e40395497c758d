"""Routing of repeated windows to index shards.

A window is ``width`` consecutive symbols (bytes or words) of one document. Each window picks an
anchor: the run of ``gram`` symbols in it with the smallest fingerprint, the leftmost of equals. Equal
windows pick equal anchors, so windows that repeat are found among occurrences of one anchor.
Consecutive windows with the same anchor occurrence form a stretch. Only stretches whose anchor
occurs again go on; equal stretches are kept once, with the place where they stand first, and are
dealt out by anchor to shards that an index (suffix array, FM-index) works through. What a shard
finds, the first place of each window, goes back to all occurrences of the stretch by a join.

Hot anchors: a passage that many documents share, with other text around each copy, would bring one
distinct stretch per copy to one anchor. A bounded sample of documents (``SAMPLE``) shows such anchors and
the grams around them; every window prefers a gram outside that list, so windows over a passage's edge
go by the text beside it. Equal windows hold equal grams, so they still meet, whatever the list is. What
repeats as a whole stays with one anchor, as equal stretches: rows of an anchor frequent in the sample are
dealt out by document and place, merged there, and the firsts of the deals merged again. The sample steers
only where rows go; results do not depend on it.

Anchors keep the leading 40 bits of a fingerprint: they only bring rows together, and windows are told apart by
their symbols. A stretch's own fingerprint is whole.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BLOCK_BYTES, BYTE_CODES, MULTIPLIER, SpanHash, blocks, flat, mix, staged, word_codes

#: start and number of windows of a stretch share one number; a stretch has fewer windows than this
MOST_BITS = 12
#: documents looked at for hot anchors, picked by a hash of their id
SAMPLE = 4096
#: distinct stretches of a gram in the sample from which windows avoid it
CROWDED = 8
#: stretches of an anchor in the sample from which its rows are dealt out
FREQUENT = 32
#: deals of a frequent anchor
DEALS = 256
#: grams and anchors of either list, the most crowded first
LISTED = 1 << 17
#: bits of a gram's fingerprint that anchors keep; the rest is zero, which makes rows of stretches smaller when shuffled
LEADING = np.uint64((1 << 64) - (1 << 24))
RUNS = "doc_id long not null, anchor long not null, stretch long not null, at long not null, deal int not null"
STRETCHES = "anchor long, stretch long, doc_id long, start long, n int, symbols binary, deals array<int>"
FOUND = ("anchor long not null, stretch long not null, at int not null, until int not null, "
         "first_doc long not null, first_start long not null, deals array<int>")

#: unit -> codes and offsets of all texts of a column
UNITS: dict[str, Callable] = {
    "byte": lambda texts: (lambda data, at: (BYTE_CODES[data], at))(*flat(texts)),
    "word": lambda texts: word_codes(*flat(texts)),
}


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values."""
    n = len(values) - width + 1
    full = -(-len(values) // width) * width
    padded = np.full(full, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    rows = padded.reshape(-1, width)
    up = np.minimum.accumulate(rows, axis=1).ravel()
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1:width - 1 + n])


@dataclass
class Hot:
    """Fingerprints of grams that windows avoid and of anchors whose rows are dealt out; at most ``LISTED`` each."""
    crowded: np.ndarray
    frequent: np.ndarray


NOTHING_HOT = Hot(np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def listed(marks: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which fingerprints stand in the list ``known``."""
    if not len(known):
        return np.zeros(len(marks), bool)
    # a table of leading bits tells most of the others apart
    leading = np.zeros(1 << 22, bool)
    leading[known >> np.uint64(42)] = True
    out = leading[marks >> np.uint64(42)]
    out[out] = np.isin(marks[out], known)
    return out


def stretches(codes: np.ndarray, offsets: np.ndarray, width: int, gram: int, crowded=NOTHING_HOT.crowded):
    """text index, anchor, stretch fingerprint, start and number of windows of every stretch."""
    none = np.zeros(0, np.int64)
    if len(codes) < width:
        return none, none, none, none, none
    spans = SpanHash(codes)
    grams = len(codes) - gram + 1
    marks = spans(slice(0, grams), slice(gram, gram + grams))
    marks &= LEADING
    # crowded grams last, then by fingerprint, then by place: the leftmost of equal marks is the smallest
    low = np.uint64(max(20, int(len(codes)).bit_length()))
    key = marks >> (low + np.uint64(1))
    key <<= low
    key |= np.arange(grams, dtype=np.uint64)
    if len(crowded):
        key |= listed(marks, crowded).astype(np.uint64) << np.uint64(63)
    chosen = sliding_minimum(key, width - gram + 1)
    chosen &= np.uint64((1 << int(low)) - 1)
    chosen = chosen.view(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(chosen)]
    inside = np.arange(len(chosen)) + width <= offsets[text + 1]
    change = np.ones(len(chosen), bool)
    change[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    # a stretch ends at the next change or where the windows of its text end
    begin = np.flatnonzero(change)
    stop, fits = np.append(begin[1:], len(chosen)), inside[begin]
    begin, stop = begin[fits], stop[fits]
    stop = np.minimum(stop, offsets[text[begin] + 1] - width + 1)
    n = stop - begin
    anchor = marks[chosen[begin]]
    stretch = spans(begin, stop + width - 1) ^ (chosen[begin] - begin).astype(np.uint64)
    return text[begin], anchor.view(np.int64), stretch.view(np.int64), begin - offsets[text[begin]], n


def _runs(unit, width, gram, hot):
    def run(batches):
        for b in blocks(batches, limit=BLOCK_BYTES // 2):
            codes, offsets = UNITS[unit](b.column("text"))
            text, anchor, stretch, start, n = stretches(codes, offsets, width, gram, hot.value.crowded)
            doc = b.column("doc_id").to_numpy()[text]
            key = doc.view(np.uint64) + start.astype(np.uint64) * MULTIPLIER
            deal = (mix(key) % np.uint64(DEALS)).astype(np.int32) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(anchor), pa.array(stretch), pa.array(start << MOST_BITS | n),
                 pa.array(np.where(listed(anchor.view(np.uint64), hot.value.frequent), deal, 0), pa.int32())],
                names=["doc_id", "anchor", "stretch", "at", "deal"])
    return run


def _grams_beside(unit, width, gram):
    """(gram, n): how many of the stretches ``at`` of a block's texts hold a gram."""
    def run(batches):
        for b in blocks(batches):
            codes, offsets = UNITS[unit](b.column("text"))
            wanted = b.column("at")
            text = np.repeat(np.arange(b.num_rows), wanted.value_lengths().to_numpy(False))
            at = wanted.flatten().to_numpy()
            begin, size = offsets[text] + (at >> MOST_BITS), (at & ((1 << MOST_BITS) - 1)) + width - gram
            # of two rows with one doc_id only the text that the stretch is from surely reaches so far
            inside = begin + size + gram - 1 <= offsets[text + 1]
            begin, size = begin[inside], size[inside]
            row = np.repeat(np.arange(len(begin)), size)
            place = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            found = SpanHash(codes)(place, place + gram) & LEADING
            # a gram counts once a stretch
            order = np.lexsort((found, row))
            found, row = found[order], row[order]
            once = np.ones(len(found), bool)
            once[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
            grams, n = np.unique(found[once], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])
    return run


def grams_beside(sample: DataFrame, firsts: DataFrame, sizes: DataFrame, unit: str, width: int, gram: int) -> DataFrame:
    """gram, n: in how many distinct stretches of crowded anchors a gram stands, as parts to add up.

    Every stretch of ``firsts`` is looked at in one place only, so that copies of a text give no rows of their own.
    """
    crowded = F.broadcast(sizes.where(F.col("n") >= CROWDED).select("anchor"))
    places = firsts.join(crowded, "anchor", "left_semi").groupBy(F.col("f.doc_id").alias("doc_id")).agg(
        F.collect_list("f.at").alias("at"))
    return sample.join(places, "doc_id").mapInArrow(_grams_beside(unit, width, gram), "gram long, n long")


def hot_anchors(docs: DataFrame, unit: str, width: int, gram: int) -> Hot:
    """What a sample of about ``SAMPLE`` documents shows as crowded grams and frequent anchors."""
    spark = docs.sparkSession
    n = docs.count()
    if not n:
        return NOTHING_HOT
    sample = staged(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < SAMPLE), "sample")

    def most(rows: DataFrame, key: str, least: int) -> np.ndarray:
        top = rows.where(F.col("n") >= least).orderBy(F.desc("n"), key).limit(LISTED)
        return np.unique(np.array([r[0] for r in top.select(key).collect()], np.int64).view(np.uint64))

    plain = sample.mapInArrow(_runs(unit, width, gram, spark.sparkContext.broadcast(NOTHING_HOT)), RUNS)
    firsts = staged(plain.groupBy("anchor", "stretch").agg(F.min(F.struct("doc_id", "at")).alias("f")), "stretches")
    sizes = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    crowded = most(sizes, "anchor", CROWDED)
    if len(crowded):
        beside = grams_beside(sample, firsts, sizes, unit, width, gram)
        crowded = np.union1d(crowded, most(beside.groupBy("gram").agg(F.sum("n").alias("n")), "gram", CROWDED))
    avoiding = spark.sparkContext.broadcast(Hot(crowded, NOTHING_HOT.frequent))
    # two documents: such an anchor surely occurs again, in every reading
    rows = sample.mapInArrow(_runs(unit, width, gram, avoiding), RUNS).groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    return Hot(crowded, most(rows.where("low < high"), "anchor", FREQUENT))


def _cut(unit, width):
    """Symbols of the wanted stretches of each document."""
    def run(batches):
        for b in blocks(batches):
            if unit == "byte":
                symbols, offsets = flat(b.column("text"))
            else:
                symbols, offsets = word_codes(*flat(b.column("text")))
            wanted = b.column("wanted")
            doc = np.repeat(np.arange(b.num_rows), wanted.value_lengths().to_numpy(False))
            each = wanted.flatten()
            at = each.field("at").to_numpy()
            start, n = at >> MOST_BITS, at & ((1 << MOST_BITS) - 1)
            begin = offsets[doc] + start
            data, size = symbols.tobytes(), symbols.itemsize
            cut = [data[size * x:size * y]
                   for x, y in zip(begin.tolist(), (begin + n + width - 1).tolist())]
            yield pa.RecordBatch.from_arrays(
                [each.field("anchor"), each.field("stretch"), b.column("doc_id").take(pa.array(doc)),
                 pa.array(start), pa.array(n.astype(np.int32)), pa.array(cut, pa.binary()), each.field("deals")],
                names=["anchor", "stretch", "doc_id", "start", "n", "symbols", "deals"])
    return run


def repeated_places(docs: DataFrame, unit: str, width: int, gram: int, index: Callable,
                    earlier: Column, across: bool) -> DataFrame:
    """(doc_id, begin, end) in symbols, of stretches of windows that stand somewhere earlier.

    ``index`` maps record batches of STRETCHES, one partition being a shard, to FOUND (``deals`` is null
    for a stretch that stands once and holds 0 for one that is not dealt out): for windows
    ``at <= i < until`` of a stretch the place where the same window stands first, ``first_start``
    moving with ``i``. ``earlier`` compares that with the occurrence (doc_id, start) of window ``at``. With ``across``
    an anchor must stand in two documents.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs, unit, width, gram))
    # one exchange by anchor and deal serves all uses of the rows. One sort per use: the frames, the firsts and
    # the join back go by the same order. Filters stand on the frames' columns, so that none gets below the
    # exchange and gives it a second form
    runs = docs.mapInArrow(_runs(unit, width, gram, hot), RUNS).repartition("anchor", "deal")
    group = Window.partitionBy("anchor", "deal").orderBy("stretch").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    again = F.min("doc_id").over(group) < F.max("doc_id").over(group) if across else F.count(F.lit(1)).over(group) > 1
    seen = runs.select("*", again.alias("again"), F.max("deal").over(group).alias("dealt")).where("again or dealt > 0")
    parts = seen.groupBy("anchor", "deal", "stretch").agg(
        F.min(F.struct("doc_id", "at")).alias("f"), F.max("dealt").alias("dealt"), F.count(F.lit(1)).alias("n"))
    first = parts.where("dealt = 0").select("anchor", "stretch", "f", F.when(F.col("n") > 1, F.array("deal")).alias("deals")).union(
        parts.where("dealt > 0").groupBy("anchor", "stretch").agg(
            F.min("f").alias("f"), F.collect_set("deal").alias("deals")))
    wanted = first.groupBy(F.col("f.doc_id").alias("doc_id")).agg(
        F.collect_list(F.struct("anchor", "stretch", "f.at", "deals")).alias("wanted"))
    cut = docs.join(wanted, "doc_id").mapInArrow(_cut(unit, width), STRETCHES)
    found = cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(index, FOUND)
    # what is found for a dealt stretch goes to the deals that hold it, where its rows lie already
    found = found.withColumnRenamed("at", "from").withColumn("deal", F.explode(F.coalesce("deals", F.array(F.lit(0))))).drop("deals").repartition(
        "anchor", "deal")
    start = F.shiftright("at", MOST_BITS)
    return seen.join(found, ["anchor", "deal", "stretch"]).withColumn("start", start + F.col("from")).where(earlier).select(
        "doc_id", F.col("start").alias("begin"),
        (start + F.col("until") + width - 1).alias("end"))


def shards(batches, limit: int):
    """Tables of whole anchors of a partition sorted by anchor, of about ``limit`` symbol bytes."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        anchor = b.column("anchor").to_numpy()
        if held and size >= limit:
            # what is held ends where the anchor changes
            cut = int(np.searchsorted(anchor, held[-1].column("anchor")[-1].as_py(), "right"))
            held.append(b.slice(0, cut))
            if cut < b.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [b.slice(cut)], 0
        else:
            held.append(b)
        size += held[-1].column("symbols").nbytes
    if held:
        yield pa.Table.from_batches(held)


def merged_runs(stretch_of: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray, moving: bool):
    """Ends of runs of windows of one stretch whose first place is in one document and moves along."""
    step = np.ones(len(at), bool)
    step[1:] = (stretch_of[1:] != stretch_of[:-1]) | (doc[1:] != doc[:-1])
    if moving:
        step[1:] |= start[1:] != start[:-1] + 1
    begin = np.flatnonzero(step)
    return begin, np.append(begin[1:], len(at))


def found_rows(rows: pa.Table, stretch_of, at, until, doc, start, own) -> pa.RecordBatch:
    """A batch of FOUND for stretches given by their row.

    ``own`` marks windows whose first place is the row's own; no other row asks for those of a stretch without deals.
    """
    asked = ~own | rows.column("deals").is_valid().to_numpy()[stretch_of]
    stretch_of, at, until, doc, start = (x[asked] for x in (stretch_of, at, until, doc, start))
    anchor, stretch, deals = (rows.column(c).combine_chunks().take(pa.array(stretch_of))
                              for c in ("anchor", "stretch", "deals"))
    return pa.RecordBatch.from_arrays(
        [anchor, stretch, pa.array(at.astype(np.int32)), pa.array(until.astype(np.int32)),
         pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int64)), deals],
        names=["anchor", "stretch", "at", "until", "first_doc", "first_start", "deals"])


def span_lists(places: DataFrame) -> DataFrame:
    """(doc_id, spans) of ``repeated_places``: the distinct spans of each document.

    A span travels as one number, its begin and its length, which is below that of a longest stretch.
    """
    bits = MOST_BITS + 8
    packed = F.shiftleft("begin", bits).bitwiseOR(F.col("end") - F.col("begin"))
    lists = places.groupBy("doc_id").agg(F.collect_set(packed).alias("packed"))
    begin, length = lambda x: F.shiftright(x, bits), lambda x: x.bitwiseAND(F.lit((1 << bits) - 1))
    return lists.select("doc_id", F.transform("packed", lambda x: F.struct(
        begin(x).alias("begin"), (begin(x) + length(x)).alias("end"))).alias("spans"))


def covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0
