"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding.

Pieces and scores come from a SentencePiece model file; a path's score is the sum of the scores of its
pieces (a BPE model's scores are its negative merge ranks and are used as they stand). A character
no piece covers falls back to its bytes at a score below every piece. Spaces become markers and one
marker is put in front. As no piece goes from another character to a marker, a text falls apart at
markers that follow other characters; distinct parts of a block of texts are encoded once.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BYTE_CODES, SpanHash, blocks, flat

MARK = "▁".encode()
#: how far below the lowest piece a character in bytes scores
FALLBACK = 10.0
#: bases looked at together when a node is placed
SEARCH = 2048
#: text bytes encoded at once; longer texts are cut where parts begin
ENCODED = 1 << 18
#: scores at or below this are flags of the file (runs of spaces); they count as its lowest score
FLAG = -1e8


@dataclass
class Trie:
    """Double array: from state s by byte b to base[s] + b, if check there is s."""
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray


@dataclass
class Vocabulary:
    trie: Trie
    scores: np.ndarray
    bytes_of: list[bytes]
    byte_ids: np.ndarray
    longest: int
    fallback: float


def build_trie(words: list[tuple[bytes, int]]) -> Trie:
    """Places the children of each node at the first base where all of them fit."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for word, number in words:
        node = 0
        for b in word:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][b]
        ends[node] = number
    size = len(children) * 3 + 4 * SEARCH
    base, check, piece = (np.full(size, v, np.int32) for v in (0, -1, -1))
    free = np.ones(size, bool)
    free[0] = False
    place = {0: 0}
    first = 1
    for node in range(len(children)):
        kids = sorted(children[node])
        at = place[node]
        piece[at] = ends[node]
        if not kids:
            continue
        while not free[first]:
            first += 1
        spot = max(1, first - kids[0])
        while True:
            fits = free[spot + kids[0]:spot + kids[0] + SEARCH].copy()
            for b in kids[1:]:
                fits &= free[spot + b:spot + b + SEARCH]
            if fits.any():
                spot += int(fits.argmax())
                break
            spot += SEARCH
        base[at] = spot
        for b in kids:
            free[spot + b] = False
            check[spot + b] = at
            place[children[node][b]] = spot + b
    return Trie(base, check, piece)


def load(path: str) -> Vocabulary:
    """The pieces of a SentencePiece model file, as large as the file's vocabulary."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    scores = np.array([model.get_score(i) for i in range(n)])
    byte_ids = np.full(256, -1, np.int32)
    bytes_of, words = [], []
    for i in range(n):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            bytes_of.append(bytes([int(name[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            bytes_of.append(b"")
        else:
            raw = name.encode()
            if MARK in raw.lstrip(MARK):
                raise ValueError(f"piece {i} goes over a space")
            bytes_of.append(raw.replace(MARK, b" "))
            if not model.is_unused(i):
                words.append((raw, i))
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    low = min(scores[i] for _, i in words if scores[i] > FLAG)
    scores = np.maximum(scores, low)
    return Vocabulary(build_trie(words), scores, bytes_of, byte_ids, max(len(w) for w, _ in words),
                      float(low) - FALLBACK)


def viterbi(data: np.ndarray, offsets: np.ndarray, v: Vocabulary):
    """Piece ids of the best path of every part, and their offsets.

    Of equal scores the path whose last piece is longest wins. All parts are matched against the trie
    at once, then filled place by place in step.
    """
    n = len(data)
    parts = len(offsets) - 1
    owner = np.repeat(np.arange(parts), np.diff(offsets))
    stop = offsets[owner + 1]
    lead = (data & 0xC0) != 0x80
    size = np.select([data < 0x80, data < 0xE0, data < 0xF0], [1, 2, 3], 4)
    chars = np.flatnonzero(lead)
    starts, lengths, ids = [], [], []
    at, state = chars, np.zeros(len(chars), np.int64)
    for depth in range(v.longest):
        inside = at + depth < stop[at]
        at, state = at[inside], state[inside]
        if not len(at):
            break
        to = v.trie.base[state] + data[at + depth]
        fits = (v.trie.check[to] == state) & (v.trie.base[state] > 0)
        at, state = at[fits], to[fits].astype(np.int64)
        piece = v.trie.piece[state]
        found = piece >= 0
        starts.append(at[found])
        lengths.append(np.full(int(found.sum()), depth + 1))
        ids.append(piece[found])
    starts.append(chars)
    lengths.append(np.minimum(size[chars], stop[chars] - chars))
    ids.append(np.full(len(chars), -1, np.int32))
    start, length, piece = (np.concatenate(x) for x in (starts, lengths, ids))
    score = np.where(piece >= 0, v.scores[piece], v.fallback)
    end = start + length
    part = owner[start]
    depth = end - offsets[part]
    # by place, part and falling length, pieces before fallback
    order = np.lexsort((piece < 0, -length, part, depth))
    start, length, piece, score, end, part, depth = (
        x[order] for x in (start, length, piece, score, end, part, depth))
    best = np.full(n + parts + 1, -np.inf)
    shift = part  # each part has one more place than bytes
    best[offsets[:-1] + np.arange(parts)] = 0.0
    chosen = np.full(n + parts + 1, -1, np.int64)
    head = np.ones(len(end), bool)
    head[1:] = (end[1:] != end[:-1])
    heads = np.flatnonzero(head)
    bounds = np.searchsorted(depth, np.arange(1, int(depth.max(initial=0)) + 2))
    head_bounds = np.searchsorted(heads, bounds)
    for k in range(len(bounds) - 1):
        a, z = bounds[k], bounds[k + 1]
        if a == z:
            continue
        h = heads[head_bounds[k]:head_bounds[k + 1]] - a
        value = best[start[a:z] + shift[a:z]] + score[a:z]
        top = np.maximum.reduceat(value, h)
        reps = np.diff(np.append(h, z - a))
        first = np.flatnonzero(value == np.repeat(top, reps))
        group = np.searchsorted(h, first, "right") - 1
        keep = np.append(True, group[1:] != group[:-1])
        first = first[keep] + a
        cell = end[first] + shift[first]
        best[cell] = value[first - a]
        chosen[cell] = first
    # walk back all parts in step
    live = np.flatnonzero(np.diff(offsets) > 0)
    cell_end = offsets[1:].copy()
    picked_part, picked = [], []
    while len(live):
        match = chosen[cell_end[live] + live]
        picked_part.append(live)
        picked.append(match)
        cell_end[live] = start[match]
        live = live[cell_end[live] > offsets[live]]
    if not picked:
        return np.zeros(0, np.int32), np.zeros(parts + 1, np.int64)
    match, of = np.concatenate(picked), np.concatenate(picked_part)
    order = np.lexsort((start[match], of))
    match, of = match[order], of[order]
    # pieces as they are, fallbacks as one id per byte
    count = np.where(piece[match] >= 0, 1, length[match])
    where = np.repeat(np.arange(len(match)), count)
    inner = np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count)
    whole = piece[match][where]
    out = np.where(whole >= 0, whole, v.byte_ids[data[np.minimum(start[match][where] + inner, n - 1)]])
    total = np.zeros(parts + 1, np.int64)
    np.cumsum(np.bincount(of, weights=count, minlength=parts).astype(np.int64), out=total[1:])
    return out.astype(np.int32), total


def marked(texts: list[str | None]) -> pa.Array:
    """Texts with markers for spaces and one in front; empty ones stay empty."""
    return pa.array(["▁" + t.replace(" ", "▁") if t else "" for t in texts], pa.string())


def encode(texts: list[str | None], v: Vocabulary):
    """Ids of all texts in a row, and offsets."""
    data, offsets = flat(marked(texts))
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    # parts begin at a text and at a marker behind another character
    mark = np.zeros(len(data), bool)
    mark[:-2] = (data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])
    begin = mark.copy()
    begin[3:] &= ~mark[:-3]
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    begin = np.flatnonzero(begin)
    end = np.append(begin[1:], len(data))
    code = SpanHash(BYTE_CODES[data])(begin, end)
    _, first, part = np.unique(code, return_index=True, return_inverse=True)
    size = (end - begin)[first]
    at = np.zeros(len(first) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    take = np.repeat(begin[first] - at[:-1], size) + np.arange(at[-1])
    ids, ends = viterbi(data[take], at, v)
    count = np.diff(ends)[part]
    total = np.zeros(len(part) + 1, np.int64)
    np.cumsum(count, out=total[1:])
    out = ids[np.repeat(ends[:-1][part] - total[:-1], count) + np.arange(total[-1])]
    return out, total[np.searchsorted(begin, offsets)]


def cut(text: str, limit: int = ENCODED) -> list[str]:
    """Slices of about ``limit`` characters that encode as the text does when joined by one space.

    A slice ends before a space behind another character, where a part begins; without such a space
    the text stays whole. The marker in front of a slice stands for the space.
    """
    out, at = [], 0
    while len(text) - at > limit:
        to = text.find(" ", at + limit, len(text) - 1)
        while to > 0 and text[to - 1] in " ▁":
            to = text.find(" ", to + 1, len(text) - 1)
        if to < 0:
            break
        out.append(text[at:to])
        at = to + 1
    return [*out, text[at:]]


def both_ways(texts: list[str | None], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Ids of all texts in a row, offsets, and the decoded texts; a long text slice by slice."""
    if len(texts) != 1 or not texts[0]:
        ids, offsets = encode(texts, v)
        return ids, offsets, decode(ids, offsets, v)
    ids, decoded = [], []
    for piece in cut(texts[0]):
        some, offsets = encode([piece], v)
        ids.append(some)
        decoded += decode(some, offsets, v)
    ids = np.concatenate(ids)
    return ids, np.array([0, len(ids)]), [" ".join(decoded)]


def decode(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> list[str]:
    """Texts of id sequences: bytes of the pieces, markers as spaces, the one in front taken off."""
    size = np.array([len(b) for b in v.bytes_of], np.int64)
    starts = np.cumsum(size) - size
    all_bytes = np.frombuffer(b"".join(v.bytes_of), np.uint8)
    count = size[ids]
    total = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(count, out=total[1:])
    raw = all_bytes[np.repeat(starts[ids] - total[:-1], count) + np.arange(total[-1])].tobytes()
    out = []
    for a, z in zip(total[offsets[:-1]].tolist(), total[offsets[1:]].tolist()):
        text = raw[a:z].decode("utf-8", "replace")
        out.append(text[1:] if text.startswith(" ") else text)
    return out


def tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_bytes, tokens, n_byte_tokens, decoded, round_trip for the SentencePiece file ``model``.

    Null and empty texts have no tokens and decode to an empty text. ``round_trip`` tells
    whether decoding gives the text back, but for markers that stood in it and become spaces. Every row of the input gives one row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches):
        v = shared.value
        is_byte = np.zeros(len(v.scores), bool)
        is_byte[v.byte_ids] = True
        for b in blocks(batches, limit=ENCODED):
            texts = b.column("text").to_pylist()
            ids, offsets, decoded = both_ways(texts, v)
            fallback = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(is_byte[ids], out=fallback[1:])
            same = [d == (t or "").replace("▁", " ") for d, t in zip(decoded, texts)]
            n_bytes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_bytes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                 pa.array(fallback[offsets[1:]] - fallback[offsets[:-1]]),
                 pa.array(decoded, pa.string()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_bytes", "tokens", "n_byte_tokens", "decoded", "round_trip"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(
        run, "doc_id long, n_bytes long, tokens array<int>, n_byte_tokens long, decoded string, "
             "round_trip boolean")


