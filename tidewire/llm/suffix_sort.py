"""Substring dedup by external induced sorting.

The suffixes of a shard are sorted by induction: suffixes that start a descent-to-ascent turn (seeds)
are ordered first, all others follow from the order of the suffix one symbol later. What an earlier
suffix induces is a tuple (symbol, place, common prefix with the tuple queued before it) in a priority
queue by symbol. Tuples of one symbol arrive in their final order, so the queue is one list per symbol
that spills to a file; a bucket is worked through block by block with numpy. Seeds are ordered by
naming the strings between them (a first induction) and recursion on the names, whose alphabet is
too large for one list per symbol: there tuples (name, rank of what follows) are sorted in rounds.

Common prefixes are capped at the window width. Between two tuples queued for one symbol the value is
one more than the smallest value between their successors.
"""
from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import blocks, flat
from .passages import covered, found_rows, repeated_places, shards, span_lists

WIDTH = 100
GRAM = 24
#: symbol bytes of a shard, and tuples of a queue that stay in memory
SHARD_BYTES = 2 << 20
HELD = 1 << 20


class BucketQueue:
    """Tuples (place, common prefix) by symbol, first in first out; what exceeds HELD goes to disk."""

    def __init__(self, folder: str, symbols: int = 256, held: int = HELD):
        self.file = tempfile.TemporaryFile(dir=folder)
        self.blocks = [[] for _ in range(symbols)]
        self.limit, self.held = held, 0

    def push(self, symbol: int, place: np.ndarray, common: np.ndarray) -> None:
        self.blocks[symbol].append((place, common))
        self.held += len(place)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file.seek(0, 2)
        for bucket in self.blocks:
            fresh = [b for b in bucket if not isinstance(b[0], int)]
            if fresh:
                # blocks in memory always stand behind those on disk
                at, n = self.file.tell(), sum(len(b[0]) for b in fresh)
                np.concatenate([b[0] for b in fresh]).tofile(self.file)
                np.concatenate([b[1] for b in fresh]).tofile(self.file)
                bucket[len(bucket) - len(fresh):] = [(at, n)]
        self.held = 0

    def _load(self, block):
        if not isinstance(block[0], int):
            return block
        at, n = block
        self.file.seek(at)
        return np.fromfile(self.file, np.int64, n), np.fromfile(self.file, np.uint8, n)

    def pop(self, symbol: int):
        """The tuples queued so far, or None."""
        bucket = self.blocks[symbol]
        if not bucket:
            return None
        if isinstance(bucket[0][0], int):
            return self._load(bucket.pop(0))
        self.blocks[symbol] = []
        self.held -= sum(len(b[0]) for b in bucket)
        return tuple(np.concatenate(x) for x in zip(*bucket))

    def read(self, symbol: int, backwards: bool = False):
        for block in self.blocks[symbol][::-1] if backwards else self.blocks[symbol]:
            place, common = self._load(block)
            yield (place[::-1], common[::-1]) if backwards else (place, common)

    def close(self) -> None:
        self.file.close()


def ascending(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is not."""
    n = len(text)
    place = np.arange(n)
    place[:-1][text[:-1] == text[1:]] = n
    place = np.minimum.accumulate(place[::-1])[::-1]
    up = np.zeros(n, bool)
    up[:-1] = text[:-1] < text[1:]
    return up[np.minimum(place, n - 1)]


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Equal leading symbols of suffixes a and b, at most ``cap``; ``text`` is padded by cap + 8."""
    wide = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    out = np.full(len(a), cap, np.int64)
    live = np.arange(len(a))
    for at in range(0, cap, 8):
        x = wide[a + at] ^ wide[b + at]
        same = x == 0
        x = x[~same]
        low = x & (~x + np.uint64(1))
        out[live[~same]] = np.minimum(cap, at + (np.bitwise_count(low - np.uint64(1)) >> 3))
        live, a, b = live[same], a[same], b[same]
        if not len(live):
            break
    return out


def agree(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings of ``size`` symbols at a and b are equal; ``text`` is padded by 8 or more."""
    wide = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    out = np.ones(len(a), bool)
    live, at = np.arange(len(a)), 0
    while len(live):
        left = size[live] - at
        # symbols behind the string are shifted out
        beyond = (np.maximum(8 - left, 0) << 3).astype(np.uint64)
        out[live] = (wide[a[live] + at] ^ wide[b[live] + at]) << beyond == 0
        live, at = live[out[live] & (left > 8)], at + 8
    return out


class _Pass:
    """Deals predecessors of sorted suffixes to a queue, with the common prefixes between them."""

    def __init__(self, text, up, queue, rising: bool, cap: int):
        self.text, self.up, self.queue, self.rising, self.cap = text, up, queue, rising, cap
        # smallest value since the last tuple of a symbol; none yet: its first has no neighbour
        self.since = np.full(256, -1, np.int64)

    def feed(self, place: np.ndarray, common: np.ndarray) -> None:
        before = place - 1
        fits = np.flatnonzero((before >= 0) & (self.up[before] == self.rising))
        symbol = self.text[before[fits]]
        order = np.argsort(symbol, kind="stable")
        counts = np.bincount(symbol, minlength=256)
        at = 0
        seen = np.flatnonzero(counts)
        if not self.cap:
            moved, nothing = before[fits[order]], np.zeros(len(fits), np.uint8)
            for s in seen:
                self.queue.push(int(s), moved[at:at + counts[s]], nothing[at:at + counts[s]])
                at += counts[s]
            return
        whole = int(common.min()) if len(common) else self.cap
        first = self.since.copy()
        np.minimum(self.since, whole, out=self.since)
        for s in seen:
            pick = fits[order[at:at + counts[s]]]
            at += counts[s]
            # the smallest value from behind the previous pick up to this one
            edges = np.empty(len(pick) + 1, np.int64)
            edges[0], edges[1:] = 0, pick + 1
            if edges[-1] == len(common):
                low = np.minimum.reduceat(common, edges[:-1])
                self.since[s] = self.cap
            else:
                low = np.minimum.reduceat(common, edges)
                self.since[s] = low[-1]
                low = low[:-1]
            low = low.astype(np.int64)
            low[0] = min(low[0], first[s])
            self.queue.push(int(s), before[pick], np.minimum(low + 1, self.cap).astype(np.uint8))


def induced(text: np.ndarray, n: int, up: np.ndarray, seeds: np.ndarray, folder: str, cap: int):
    """(place, common prefix with the one before) of all suffixes in order, block by block.

    ``seeds`` are the turns in order; ``text`` is padded. With ``cap`` 0 no common prefixes are carried.
    """
    symbol = text[seeds]
    common = np.zeros(len(seeds), np.uint8)
    if len(seeds) > 1:
        common[1:] = common_prefix(text, seeds[:-1], seeds[1:], cap)
    bounds = np.searchsorted(symbol, np.arange(257))
    falls, fall_list = BucketQueue(folder), BucketQueue(folder)
    deal = _Pass(text, up, falls, False, cap)
    deal.feed(np.array([n]), np.zeros(1, np.uint8))
    for s in range(256):
        last = None
        while (block := falls.pop(s)) is not None:
            fall_list.push(s, *block)
            deal.feed(*block)
            last = block[0][-1:]
        a, z = bounds[s], bounds[s + 1]
        if a < z:
            values = common[a:z].copy()
            values[0] = 0 if last is None else common_prefix(text, last, seeds[a:a + 1], cap)[0]
            deal.feed(seeds[a:z], values)
    falls.close()
    rises, rise_list = BucketQueue(folder), BucketQueue(folder)
    deal = _Pass(text, up, rises, True, cap)
    for s in range(255, -1, -1):
        last = None
        while (block := rises.pop(s)) is not None:
            rise_list.push(s, *block)
            deal.feed(*block)
            last = block[0][-1:]
        below = None
        for place, shared in fall_list.read(s, backwards=True):
            # values are with the neighbour below; going down they belong to the next one
            values = np.empty_like(shared)
            values[1:] = shared[:-1]
            if below is None:
                values[0] = 0 if last is None else common_prefix(text, last, place[:1], cap)[0]
            else:
                values[0] = below
            below = shared[-1]
            deal.feed(place, values)
    rises.close()
    for s in range(256):
        last = None
        for place, shared in fall_list.read(s):
            shared = shared.copy()
            if last is None:
                shared[0] = 0
            yield place, shared
            last = place[-1:]
        above = None
        for place, shared in rise_list.read(s, backwards=True):
            values = np.empty_like(shared)
            values[1:] = shared[:-1]
            if above is not None:
                values[0] = above
            else:
                values[0] = 0 if last is None else common_prefix(text, last, place[:1], cap)[0]
            above = shared[-1]
            yield place, values
    fall_list.close()
    rise_list.close()


def seed_order(text: np.ndarray, n: int, up: np.ndarray, ends: np.ndarray, folder: str, cap: int):
    """Turns in suffix order. ``ends`` are the places of the marks between stretches."""
    turn = np.zeros(n + 1, bool)
    turn[1:n] = up[1:] & ~up[:-1]
    seeds = np.flatnonzero(turn)
    if len(seeds) < 2:
        return seeds
    by_symbol = seeds[np.argsort(text[seeds], kind="stable")]
    order = np.concatenate([p[turn[p]] for p, _ in induced(text, n, up, by_symbol, folder, 0)])
    del turn
    index = np.empty(n, np.int64)
    index[seeds] = np.arange(len(seeds))
    at = index[order]
    del order, index
    # names of the strings from turn to turn; one that holds a mark is like no other
    stop = np.append(seeds[1:], n - 1) + 1
    marked = np.searchsorted(ends, stop) > np.searchsorted(ends, seeds)
    marked[-1] = True
    size = (stop - seeds)[at]
    del stop
    alike = np.flatnonzero(size[1:] == size[:-1])
    # two strings are one name if they agree as far as windows reach
    alike = alike[agree(text, seeds[at[alike]], seeds[at[alike + 1]], np.minimum(size[alike], cap))]
    new = np.ones(len(at), bool)
    new[alike + 1] = False
    del size, alike
    if (~new[1:] & (marked[at[1:]] != marked[at[:-1]])).any():
        # where texts hold the byte of the mark, strings with a mark must not part others that are equal
        at = at[np.argsort((np.cumsum(new) << 1) + marked[at], kind="stable")]
    new |= marked[at]
    name = np.empty(len(seeds), np.int64)
    name[at] = np.cumsum(new) - 1
    del at, new, marked
    return seeds[ordered_names(name, seeds, cap)]


def ordered_names(name: np.ndarray, place: np.ndarray, cap: int) -> np.ndarray:
    """Suffix order of a string of names, by tuples of ranks ``h`` names apart in rounds.

    ``place`` says where each name begins. Suffixes that agree for ``cap`` symbols stand together in any order.
    """
    m, h = len(name), 1
    order = np.argsort(name, kind="stable")
    # ranks count the suffixes below a group, so that groups split in place
    sizes = np.bincount(name)
    rank = (np.cumsum(sizes) - sizes)[name]
    open_ = np.flatnonzero(sizes[name[order]] > 1)
    while True:
        live = order[open_]
        reach = live + h
        # equal names are of one length, so a group goes on or ends as a whole
        short = (reach >= m) | (place[np.minimum(reach, m - 1)] - place[live] < cap)
        open_, live, reach = open_[short], live[short], reach[short]
        if not len(open_):
            return order
        key = rank[live] * (m + 1)
        inside = reach < m
        key[inside] += rank[reach[inside]] + 1
        by_key = np.argsort(key)
        live, key = live[by_key], key[by_key]
        order[open_] = live
        fresh = np.ones(len(key) + 1, bool)
        fresh[1:-1] = key[1:] != key[:-1]
        rank[live] = open_[np.maximum.accumulate(np.where(fresh[:-1], np.arange(len(key)), 0))]
        open_ = open_[~(fresh[:-1] & fresh[1:])]
        h *= 2


def sorted_suffixes(text: np.ndarray, ends: np.ndarray, folder: str, cap: int):
    """Blocks (place, common prefix with the suffix before, at most cap) of all suffixes in order.

    Suffixes that agree up to a mark (0) stand together in any order.
    """
    n = len(text)
    padded = np.zeros(n + cap + 16, np.uint8)
    padded[:n] = text
    up = np.append(ascending(text), False)
    yield from induced(padded, n, up, seed_order(padded, n, up[:n], ends, folder, cap), folder, cap)


def _search(rows: pa.Table, width: int) -> pa.RecordBatch:
    """First places of the windows of all stretches of a shard."""
    n = rows.column("n").to_numpy().astype(np.int64)
    length = n + width - 1
    ends = np.cumsum(length + 1) - 1
    begin = ends - length
    text = np.frombuffer(b"\0".join(rows.column("symbols").to_pylist()) + b"\0", np.uint8)
    docs, number = np.unique(rows.column("doc_id").to_numpy(), return_inverse=True)
    key = (number.astype(np.int64) << 32) + rows.column("start").to_numpy()
    owner = np.repeat(np.arange(len(n), dtype=np.int32), length + 1)
    best = np.arange(len(text))
    window = best < (begin + n)[owner]
    # a run of U+0000 can equal one across a mark, which is no window and must not count as earlier
    best += (key - begin)[owner]
    best[~window] = np.iinfo(np.int64).max
    with tempfile.TemporaryDirectory() as folder:
        held, low = [], 0
        for place, common in sorted_suffixes(text, ends, folder, width):
            keep = common >= width
            cuts = np.flatnonzero(~keep)
            if not len(cuts):
                held.append(place)
                low = min(low, int(best[place].min())) if len(held) > 1 else int(best[place].min())
                continue
            if cuts[0]:
                held.append(place[:cuts[0]])
            _settle(best, held)
            held = [place[cuts[-1]:]]
            inner = place[cuts[0]:cuts[-1]]
            if len(inner):
                starts = cuts[:-1] - cuts[0]
                values = np.minimum.reduceat(best[inner], starts)
                best[inner] = np.repeat(values, np.diff(np.append(starts, len(inner))))
        _settle(best, held)
    place = np.flatnonzero(window)
    owner, best = owner[place], best[place]
    # runs of windows of one stretch whose first place moves along
    step = np.ones(len(place), bool)
    step[1:] = (owner[1:] != owner[:-1]) | (best[1:] != best[:-1] + 1)
    a = np.flatnonzero(step)
    at, until = place[a], place[np.append(a[1:], len(place)) - 1] + 1
    owner, best = owner[a], best[a]
    at, until = at - begin[owner], until - begin[owner]
    return found_rows(rows, owner, at, until, docs[best >> 32], best & 0xFFFFFFFF, best == key[owner] + at)


def _settle(best: np.ndarray, held: list) -> None:
    if held:
        places = np.concatenate(held)
        best[places] = best[places].min()


def _index(width):
    def run(batches):
        # finer batches: a shard stays near its limit
        for rows in shards(blocks(batches, "symbols", SHARD_BYTES // 8), SHARD_BYTES):
            yield _search(rows, width)
    return run


def repeated_strings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, spans): byte ranges [begin, end) covered by windows that also start earlier."""
    earlier = F.expr("first_doc < doc_id or (first_doc = doc_id and first_start < start)")
    return span_lists(repeated_places(docs, "byte", width, gram, _index(width), earlier, False))


def _kept(batches):
    for b in blocks(batches):
        data, offsets = flat(b.column("text"))
        spans = b.column("spans")
        each = spans.flatten()
        base = np.repeat(offsets[:-1], pc.fill_null(pc.list_value_length(spans), 0).to_numpy(False))
        # no span leaves its text, so all texts of a block are covered at once
        cut = covered(base + each.field("begin").to_numpy(), base + each.field("end").to_numpy(), len(data))
        run = cut.copy()
        run[1:] &= ~cut[:-1]
        firsts = offsets[:-1][offsets[1:] > offsets[:-1]]
        run[firsts] = cut[firsts]
        runs = np.diff(np.searchsorted(np.flatnonzero(run), offsets))
        gone = np.searchsorted(np.flatnonzero(cut), offsets)
        raw, bounds = data[~cut].tobytes(), (offsets - gone).astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
        view, ends = memoryview(raw), bounds.tolist()
        digest = [hashlib.sha256(view[x:y]).hexdigest() for x, y in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(gone), pa.int64()),
             pa.array(runs, pa.int64()), kept, pa.array(digest, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256.

    Bytes covered by a ``width``-byte string that also starts earlier are removed; strings are judged
    on the input and overlap freely. Null texts are empty; texts shorter than ``width`` stay whole.
    What is kept can end inside a character, so it is binary. Rows without a doc_id are dropped; a
    doc_id must be unique. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    spans = repeated_strings(docs, width, gram)
    return docs.join(spans.hint("shuffle_hash"), "doc_id", "left").mapInArrow(
        _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
