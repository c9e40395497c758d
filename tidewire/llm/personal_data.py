"""Personal data by patterns and a linear-chain conditional random field over word shapes.

The patterns give base spans. The field finds what they miss: numbers without a plus or a check digit, addresses with
words for their marks, spaced parts, secrets behind a key word. It labels words from their shape, ends and length and
from the words around; it is trained from a small labelled table of written-out forms (``FORMS``) among made-up
words, by gradient ascent on the likelihood, and decoded by Viterbi in numpy for all words of a batch. Its spans are
added where they meet no base span and the kind's check, wider than the pattern, holds.
"""
from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BYTE_CODES, SpanHash, blocks, flat, word_spans

KINDS = ("email", "ip", "card", "phone", "secret")
#: rows of the labelled table per form, and words around a form
COPIES = 12
AROUND = 3
ROUNDS = 80
#: words a chain reaches on each side of a word that may belong to a span
REACH = 3

# The labelled table: kind and form. In a form d is a digit, n a number up to 255, h a hexadecimal digit, w a word of
# letters, {16} repeats what stands before it; other characters stand for themselves, capital letters for small ones.
# ``none`` marks look-alikes that are no personal data. Only the part in < > is the span.
FORMS = [
    ("email", "<w.dd@w.w>"), ("email", "<w@w.w>"), ("email", "<w AT w DOT w>"), ("email", "<w.w AT w DOT w>"),
    ("email", "<w (AT) w (DOT) w>"), ("email", "<w [AT] w [DOT] w>"), ("email", "<wd [AT] w.w>"), ("email", "<w AT w DOT w DOT w>"),
    ("email", "<w (AT) w.w>"), ("email", "<w @ w . w>"), ("email", "<w_w @ w.w>"), ("email", "MAIL <wdd AT w DOT w>"),
    ("ip", "<n.n.n.n>"), ("ip", "<n . n . n . n>"), ("ip", "<n. n. n. n>"), ("ip", "<n .n .n .n>"), ("ip", "HOST <n . n . n . n>"),
    ("ip", "<n[.]n[.]n[.]n>"), ("ip", "<n(.)n(.)n(.)n>"),
    ("card", "<d{16}>"), ("card", "<d{16}>%%%"), ("card", "<d{16}>."), ("card", "<dddd dddd dddd dddd>"),
    ("card", "<dddd-dddd-dddd-dddd>"), ("card", "<dddd.dddd.dddd.dddd>"), ("card", "CARD <d{16}>"), ("card", "<d{16}>,"),
    ("card", "CARD <dddd dddddd ddddd>"), ("card", "<dddd/dddd/dddd/dddd>"),
    ("phone", "<+d (ddd) ddd-dddd>"), ("phone", "<(ddd) ddd-dddd>"), ("phone", "<ddd-ddd-dddd>"), ("phone", "<ddd ddd dddd>"),
    ("phone", "TEL <dddddddddd>"), ("phone", "PHONE: <ddd.ddd.dddd>"), ("phone", "CALL <ddd ddd dddd>"), ("phone", "TEL. <dd dd dd dd dd>"),
    ("phone", "<(ddd)ddd-dddd>"), ("phone", "<(ddd) ddd dddd>,"), ("phone", "<ddd-ddd-dddd>."), ("phone", "<00dd ddd ddd dddd>"),
    ("secret", 'TOKEN = "<h{40}>"'), ("secret", 'TOKEN = "<h{32}>"###'), ("secret", 'KEY = "<h{40}>"'), ("secret", "TOKEN = <h{40}>"),
    ("secret", 'PASSWORD = "<wdwdwdwdwdwd>"'), ("secret", 'SECRET = "<h{32}>"'), ("secret", "TOKEN: <h{32}>"), ("secret", "KEY: <h{40}>"),
    ("secret", 'API_KEY = "<h{40}>"'), ("secret", "PASSWORD: <wddwddwddwdd>"), ("secret", 'TOKEN="<h{40}>"'), ("secret", "SECRET=<h{32}>"),
    ("none", "dddd"), ("none", "dd"), ("none", "d"), ("none", "ddd"), ("none", "dd.dd.dddd"), ("none", "dddd-dd-dd"),
    ("none", "dd:dd"), ("none", "dd:dd:dd"), ("none", "d.d.d"), ("none", "VERSION d.dd.d"), ("none", "$ddd.dd"), ("none", "d,ddd,ddd"),
    ("none", "ddd.dd"), ("none", "d{12}"), ("none", "### d{15}"), ("none", "d{9}"), ("none", "ORDER d{12}"), ("none", "NO. d{10}"),
    ("none", "d{20}"), ("none", "d{14}"), ("none", "d{13}"), ("none", "d{17}"), ("none", "PAGE dd OF ddd"), ("none", "w = dd"),
    ("none", "h{40}"), ("none", "h{32}"), ("none", "COMMIT h{40}"), ("none", "#hhhhhh"), ("none", 'w = "w"'), ("none", "KEY = dd"),
    ("none", "w AT w"), ("none", "w AT w w"), ("none", "DOT w"), ("none", "w DOT w"), ("none", "AT dd:dd"), ("none", "(AT) w w"),
    ("none", "dd dd dd"), ("none", "ddd dd ddd"), ("none", "dddd dddd"), ("none", "dd-dd"), ("none", "dd / dd"), ("none", "dd %"),
    ("none", "(dd)"), ("none", "(dddd)"), ("none", "w@w"), ("none", "@w"), ("none", "d.dd"), ("none", "dd . dd"), ("none", "n . w"),
    ("none", "ISBN ddd-d-dd-d{6}-d"), ("none", "TOKEN w"), ("none", "PASSWORD w w"), ("none", "dddd dd dd"), ("none", "w.w.w"),
    ("none", "d{16}d{16}"), ("none", "TEL w"), ("none", "ddd ddd"), ("none", "dd ddd ddd"), ("none", "d ddd ddd ddd"),
]

# fixed values: the patterns of the base spans
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, text: str) -> bool:
    if kind == "email":
        return text.count("@") == 1
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(
            p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    n = digits_of(text)
    return 13 <= len(n) <= 19 and luhn(n) if kind == "card" else 9 <= len(n) <= 15


MARKS = re.compile(r"\s*(?:\s[\[(]?at[\])]?\s|[\[(]at[\])]|@)\s*")
DOTS = re.compile(r"\s*(?:\s[\[(]?dot[\])]?\s|[\[(]dot[\])]|\[\.\]|\(\.\)|\.)\s*")
SECRET = re.compile(r"[A-Za-z0-9_+/=.-]{12,256}")
GROUPS = re.compile(r"[+]?[(]?[0-9]+(?:[ ().\u00a0-]+[0-9]+)*")


def plausible(kind: str, text: str) -> bool:
    """Whether a span of the field may be added: wider than ``valid``."""
    if kind == "email":
        parts = MARKS.split(text.lower())
        host = DOTS.split(parts[-1])
        return len(parts) == 2 and bool(re.fullmatch(r"[a-z0-9._%+ -]+", DOTS.sub(".", parts[0]))) and len(host) > 1 \
            and all(re.fullmatch(r"[a-z0-9-]+", h) for h in host)
    if kind == "ip":
        return valid("ip", DOTS.sub(".", text))
    if kind == "secret":
        return bool(SECRET.fullmatch(text)) and any(c.isdigit() for c in text) and any(c.isalpha() for c in text)
    n = digits_of(text)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9](?:[ ./-]?[0-9])+", text)) and (len(n) == 16 or valid("card", text))
    return 9 <= len(n) <= 15 and bool(GROUPS.fullmatch(text))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind and start; each pattern is found in linear time."""
    out = []
    if not text:
        return out
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            done = m.end()
            out.append((0, begin, done))
        at = text.find("@", max(at + 1, done))
    if "." in text:
        for m in CHAIN.finditer(text):
            if m.group().count(".") < 3:
                continue
            begin, parts = m.start(), m.group().split(".")
            for i in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[i:i + 4])) + 3
                if valid("ip", text[begin:begin + size]):
                    out.append((1, begin, begin + size))
                begin += size + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and valid("card", m.group()):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if valid("phone", m.group()):
                out.append((3, m.start(), m.end()))
    return out


_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 88, 120, 120, 100
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: the words that stand for the marks of an address, as they are compared
_SPELLED = [b"dot", b"(dot)", b"[dot]", b"(at)", b"[at]"]


def shape_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, loose: bool = False) -> np.ndarray:
    """A code of each word's shape: letters by case with runs as one, digits singly or in runs too, the rest as is."""
    kind = _CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == 100) & (not loose))
    keep[starts] = True
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return SpanHash(BYTE_CODES[kind[keep]])(place[starts], place[ends])


#: what a feature looks at: one of the codes of ``word_features``, and the word's place from the labelled one
SHAPE, LOOSE, WORD, HEAD, TAIL, SIZE = range(6)
FEATURES = [(SHAPE, 0), (LOOSE, 0), (WORD, 0), (HEAD, 0), (TAIL, 0), (SIZE, 0), (SHAPE, -1), (SHAPE, 1), (WORD, -1), (WORD, 1),
            (WORD, -2), (LOOSE, -2), (LOOSE, 2), (WORD, 2)]


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Six codes of every word, one column each."""
    spans = SpanHash(BYTE_CODES[_SMALL[data]])
    size = ends - starts
    return np.stack([shape_codes(data, starts, ends), shape_codes(data, starts, ends, True), spans(starts, ends),
                     spans(starts, starts + np.minimum(size, 2)), spans(ends - np.minimum(size, 2), ends),
                     np.minimum(size, 48).astype(np.uint64)], 1)


def near_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray):
    """Places of the words within ``REACH`` of one that holds a digit, @ or = or spells a mark; only these may be labelled."""
    told = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_DIGIT[data] | (data == 64) | (data == 61), out=told[1:])
    hit = told[ends] > told[starts]
    spelled = np.flatnonzero((ends - starts >= 3) & (ends - starts <= 5) & ((data[starts] == 40) | (data[starts] == 91) | ((
        _SMALL[data[starts]] == 100) & (ends - starts == 3)))) if len(starts) else []
    for k in spelled:
        hit[k] |= bytes(_SMALL[data[starts[k]:ends[k]]]) in _SPELLED
    near = np.zeros(len(starts) + 1, np.int64)
    at = np.flatnonzero(hit)
    text = np.searchsorted(words, at, "right") - 1
    np.add.at(near, np.maximum(at - REACH, words[text]), 1)
    np.add.at(near, np.minimum(at + REACH + 1, words[text + 1]), -1)
    return np.flatnonzero(np.cumsum(near)[:-1] > 0)


def shaped(texts: pa.Array):
    """Bytes, word starts and ends in bytes, word offsets, and code point starts and ends within their texts."""
    data, offsets = flat(texts)
    starts, ends, words = word_spans(data, offsets)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    base = np.repeat(points[offsets[:-1]], np.diff(words))
    return data, starts, ends, words, points[starts] - base, points[ends] - base


def around(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Codes of every feature of the words ``place``, 0 beyond their text; only words that are looked at are coded."""
    text = np.searchsorted(words, place, "right") - 1
    steps = sorted({s for _, s in FEATURES})
    wide = np.unique(np.clip((place[:, None] + steps).ravel(), 0, len(starts) - 1))
    size = ends[wide] - starts[wide]
    to = np.cumsum(size)
    own = data[np.arange(to[-1]) + np.repeat(starts[wide] - (to - size), size)]
    codes = word_features(own, to - size, to)
    out = np.zeros((len(place), len(FEATURES)), np.uint64)
    for j, (code, step) in enumerate(FEATURES):
        at = place + step
        inside = (at >= words[text]) & (at < words[text + 1])
        out[inside, j] = codes[np.searchsorted(wide, at[inside]), code]
    return out


@dataclass
class Field:
    """Weights by feature code and label, and between labels; label 0 is outside."""
    known: list[np.ndarray]
    weights: list[np.ndarray]
    moves: np.ndarray

    def numbers(self, features: np.ndarray) -> np.ndarray:
        """Rows of the weights, 0 for an unknown code."""
        out = np.zeros(features.shape, np.int64)
        for j, known in enumerate(self.known):
            at = np.minimum(np.searchsorted(known, features[:, j]), len(known) - 1)
            out[:, j] = np.where(known[at] == features[:, j], at + 1, 0)
        return out

    def emissions(self, numbers: np.ndarray) -> np.ndarray:
        return sum(w[numbers[:, j]] for j, w in enumerate(self.weights))


def labelled_rows(seed: int, copies: int = COPIES):
    """(text, spans) for every form, among made-up words; spans are (kind, start, end)."""
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice("aeiounrstldmckpgbhvz\u00e9\u00fc") for _ in range(rng.choice((2, 3, 4, 5, 6, 7, 9, 11))))

    def written(form):
        form = re.sub(r"(.)\{(\d+)\}", lambda m: m[1] * int(m[2]), form)
        out = []
        for c in form:
            out.append(rng.choice("0123456789") if c == "d" else str(rng.randrange(256)) if c == "n" else rng.choice(
                "0123456789abcdef") if c == "h" else "".join(rng.choice("aeiounrstldmckpgbhv") for _ in range(
                    rng.randint(2, 7))) if c == "w" else c.lower())
        return "".join(out)

    def around_():
        return [word() + rng.choice(("", "", "", "", ",", ".", "***", "###")) for _ in range(rng.randint(0, AROUND))]

    for kind, form in FORMS:
        for _ in range(copies):
            text = " ".join([*around_(), "\x00", *around_()])
            at = text.index("\x00")
            body = written(form)
            spans = []
            if kind != "none":
                first, last = body.index("<"), body.index(">")
                body = body[:first] + body[first + 1:last] + body[last + 1:]
                spans = [(KINDS.index(kind), at + first, at + last - 1)]
            yield text[:at] + body + text[at + 1:], spans


def labelled_chains(rows):
    """Features and labels of the chains of labelled rows."""
    texts, spans = zip(*rows)
    data, starts, ends, words, first, last = shaped(pa.array(texts, pa.string()))
    features = around(data, starts, ends, words, np.arange(len(starts)))
    may = np.zeros(len(starts), bool)
    may[near_marks(data, starts, ends, words)] = True
    out = []
    for i, mine in enumerate(spans):
        a, z = words[i], words[i + 1]
        label = np.zeros(z - a, np.int64)
        for kind, begin, end in mine:
            label[(last[a:z] > begin) & (first[a:z] < end)] = kind + 1
        out.append((features[a:z][may[a:z]], label[may[a:z]]))
    return [c for c in out if len(c[1])]


def train(chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS) -> Field:
    """A field from chains (features, labels): AdaGrad on the likelihood."""
    labels = 1 + len(KINDS)
    every = np.concatenate([f for f, _ in chains])
    known = []
    for j in range(len(FEATURES)):
        found, n = np.unique(every[:, j], return_counts=True)
        # codes seen once, such as made-up words, say nothing
        known.append(found[n > 2] if (n > 2).any() else found[:1])
    field = Field(known, [np.zeros((len(k) + 1, labels)) for k in known], np.zeros((labels, labels)))
    longest, count = max(len(y) for _, y in chains), len(chains)
    x = np.zeros((count, longest, len(FEATURES)), np.int64)
    y = np.zeros((count, longest), np.int64)
    live = np.zeros((count, longest), bool)
    for i, (f, lab) in enumerate(chains):
        x[i, :len(lab)] = field.numbers(f)
        y[i, :len(lab)] = lab
        live[i, :len(lab)] = True
    pair = live[:, 1:]
    seen_w, seen_m = [np.full_like(w, 1e-6) for w in field.weights], np.full_like(field.moves, 1e-6)
    one = np.eye(labels)
    for _ in range(rounds):
        e = sum(w[x[..., j]] for j, w in enumerate(field.weights))
        fore = np.zeros((count, longest, labels))
        back = np.zeros_like(fore)
        fore[:, 0] = e[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(fore[:, t - 1, :, None] + field.moves, axis=1) + e[:, t]
            fore[:, t] = np.where(live[:, t, None], step, fore[:, t - 1])
        total = np.logaddexp.reduce(fore[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(field.moves + (e[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(live[:, t + 1, None], step, 0)
        share = np.exp(fore + back - total[:, None, None]) * live[..., None]
        gap = (one[y] * live[..., None] - share) / count
        for j, w in enumerate(field.weights):
            slope = -1e-4 * w
            np.add.at(slope, x[..., j][live], gap[live])
            slope[0] = 0.0
            seen_w[j] += slope ** 2
            w += 0.3 * slope / np.sqrt(seen_w[j])
        both = np.exp(fore[:, :-1, :, None] + field.moves + (e + back)[:, 1:, None, :] - total[:, None, None, None])
        wanted = one[y[:, :-1]][..., :, None] * one[y[:, 1:]][..., None, :]
        slope = ((wanted - both) * pair[..., None, None]).sum(axis=(0, 1)) / count
        seen_m += slope ** 2
        field.moves += 0.3 * slope / np.sqrt(seen_m)
    return field


def fit(seed: int = 1) -> Field:
    """The field of the labelled table."""
    return train(labelled_chains(labelled_rows(seed)))


def decode(field: Field, e: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Best labels of the words of chains that start at ``heads`` (rows of the emissions ``e``), all chains in step."""
    label = np.zeros(len(e), np.int64)
    if not len(e):
        return label
    size = np.diff(np.append(heads, len(e)))
    order = np.argsort(-size, kind="stable")
    first, size = heads[order], size[order]
    score = e[first].copy()
    came = []
    for t in range(1, int(size[0])):
        n = np.searchsorted(-size, -t, "left")
        step = score[:n, :, None] + field.moves
        came.append(step.argmax(axis=1).astype(np.int8))
        score[:n] = step.max(axis=1) + e[first[:n] + t]
    best = score.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        n = np.searchsorted(-size, -t, "left")
        label[first[:n] + t] = best[:n]
        if t:
            best[:n] = came[t - 1][np.arange(n), best[:n]]
    return label


def labelled(field: Field, texts: pa.Array):
    """(text number, kind, start, end) of the runs of equal labels, in code points, by text and place."""
    data, starts, ends, words, first, last = shaped(texts)
    place = near_marks(data, starts, ends, words)
    if not len(place):
        return []
    text = np.searchsorted(words, place, "right") - 1
    numbers = field.numbers(around(data, starts, ends, words, place))
    head = np.ones(len(place), bool)
    head[1:] = (np.diff(place) > 1) | (np.diff(text) > 0)
    label = decode(field, field.emissions(numbers), np.flatnonzero(head))
    out, at = [], 0
    hits = np.flatnonzero(label)
    while at < len(hits):
        to = at
        while to + 1 < len(hits) and hits[to + 1] == hits[to] + 1 and not head[hits[to + 1]] \
                and label[hits[to + 1]] == label[hits[at]]:
            to += 1
        a, b = place[hits[at]], place[hits[to]]
        out.append((int(text[hits[at]]), int(label[hits[at]]) - 1, int(first[a]), int(last[b])))
        at = to + 1
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in spans)


def _trimmed(kind: int, text: str, begin: int, end: int) -> tuple[int, int]:
    """The span without the marks that stand around it; a phone number keeps its plus and bracket."""
    keep = "+(" if KINDS[kind] == "phone" else ""
    if KINDS[kind] == "secret" and (mark := max(text.rfind("=", begin, end - 8), text.rfind(":", begin, end - 8))) >= 0:
        begin = mark + 1
    while begin < end and not text[begin].isalnum() and text[begin] not in keep:
        begin += 1
    while begin < end and not text[end - 1].isalnum():
        end -= 1
    return begin, end


def all_spans(field: Field, texts: pa.Array) -> list[tuple[list, list]]:
    """Base spans and all spans of every text."""
    plain = texts.to_pylist()
    base = [base_spans(t) for t in plain]
    more = [[] for _ in plain]
    for i, kind, begin, end in labelled(field, texts):
        begin, end = _trimmed(kind, plain[i], begin, end)
        if begin < end and all(end <= x or begin >= y for _, x, y in base[i]) \
                and plausible(KINDS[kind], plain[i][begin:end]):
            more[i].append((kind, begin, end))
    return [(b, sorted(b + m)) for b, m in zip(base, more)]


def personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans, n_secret, n_spans.

    Spans are kind:start:end in code points, by kind and start. Counts are of all spans, those of the field
    included. Null and empty texts have none; a text of any length is read whole. Every row of the input gives one
    row, a null doc_id stays null; columns other than doc_id and text do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for b in blocks(batches):
            column = b.column("text")
            found = all_spans(shared.value, column) if b.num_rows else []
            counts = [pa.array([sum(k == j for k, _, _ in s) for _, s in found], pa.int64()) for j in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts[:4], pa.array([_joined(s) for s, _ in found], pa.string()),
                 pa.array([_joined(s) for _, s in found], pa.string()), counts[4],
                 pa.array([len(s) for _, s in found], pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_spans", "spans", "n_secret", "n_spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                "base_spans string, spans string, n_secret long, n_spans long")
