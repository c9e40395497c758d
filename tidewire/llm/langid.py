"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed letter trigrams (of UTF-8 bytes, other ASCII characters count
as a space), normalised to length one. Each language has a few centroids, clustered by cosine from a
bounded sample of labelled texts; document frequencies are taken over all labelled texts. A text gets
the language of the nearest centroid and is rejected when it is farther from it than labelled texts
of the same length: every centroid has its own limit for every power of two of trigrams, learned from
pieces of labelled texts that no centroid was clustered from.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import MULTIPLIER, blocks, flat

#: vector length, a power of two
SLOTS = 32768
#: labelled texts of a language that centroids are clustered from, and as many that limits are learned
#: from (bound of the training sample)
SAMPLE = 400
CENTROIDS = 3
ROUNDS = 10
#: share of pieces of labelled texts that may lie outside a centroid's limit
FAR = 0.01
#: a text is rejected below this share of the limit, which few pieces tell only roughly
MARGIN = 0.8
#: a language with fewer texts takes its limits from the texts it is clustered from
APART = 20
#: limits are kept for 1, 2, 4 ... trigrams
LENGTHS = 17
UNKNOWN = "und"
#: texts whose counts are held at once
ROWS = 64

LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint64)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_SHIFT = np.uint64(64 - SLOTS.bit_length() + 1)


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    #: similarity that a text must reach, per centroid and power of two of trigrams
    limits: np.ndarray


def counts(texts: pa.Array) -> np.ndarray:
    """Trigram counts, one row per text."""
    data, offsets = flat(texts)
    n = len(offsets) - 1
    out = np.zeros((n, SLOTS), np.float32)
    if len(data) < 3:
        return out
    code = _FOLD[data]
    code = (code[:-2] << np.uint64(16)) | (code[1:-1] << np.uint64(8)) | code[2:]
    slot = ((code * MULTIPLIER) >> _SHIFT).astype(np.int64)
    blank = code == 0x202020
    for i in range(n):
        a, z = offsets[i], offsets[i + 1] - 2
        if z > a:
            out[i] = np.bincount(slot[a:z][~blank[a:z]], minlength=SLOTS)
    return out


def vectors(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and numbers of trigrams."""
    x = counts(texts)
    n = x.sum(axis=1)
    np.log1p(x, out=x)
    x *= idf
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.where(size > 0, size, 1)
    return x, n


def _pieces(batches):
    for b in blocks(batches):
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _frequencies(batches):
    total = np.zeros(SLOTS, np.int64)
    n = 0
    for b in _pieces(batches):
        total += (counts(b.column("text")) > 0).sum(axis=0)
        n += b.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, SLOTS)), pa.array(np.append(n, total))],
                                     names=["slot", "n"])


def clustered(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by spherical k-means, started from texts at even ranks of similarity to the mean."""
    order = np.argsort(x @ x.mean(axis=0), kind="stable")
    k = min(k, len(x))
    c = x[order[[(2 * j + 1) * len(x) // (2 * k) for j in range(k)]]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _cuttings(texts: list[str]) -> list[str]:
    """The texts and pieces of 3, 4, 8, 16 ... characters of each, from a word's start where one is near."""
    rng = np.random.default_rng(0)
    out = list(texts)
    each = max(2, SAMPLE // len(texts))
    for text in texts:
        size = 3
        while size < len(text):
            for at in rng.integers(0, len(text) - size + 1, each).tolist():
                space = text.find(" ", at, at + 32)
                at = space + 1 if 0 <= space and space + 1 + size <= len(text) else at
                out.append(text[at:at + size])
            size = size * 2 if size > 3 else 4
    return out


def limits(texts: list[str], idf: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Per centroid and power of two of trigrams, the similarity that all but FAR of the pieces reach."""
    cut = pa.array(_cuttings(texts), pa.string())
    near, similar, length = [], [], []
    for at in range(0, len(cut), ROWS):
        x, n = vectors(cut.slice(at, ROWS), idf)
        y = (x @ c.T)[n > 0]
        near.append(y.argmax(axis=1))
        similar.append(y.max(axis=1))
        length.append(np.rint(np.log2(n[n > 0])).astype(int).clip(0, LENGTHS - 1))
    near, similar, length = map(np.concatenate, (near, similar, length))
    out = np.full((len(c), LENGTHS), np.nan)
    for j in range(len(c)):
        for b in range(LENGTHS):
            mine = similar[(near == j) & (length == b)]
            if len(mine) * FAR < 1:
                # few pieces of one centroid do not tell the share: those of the language
                mine = similar[length == b]
            if not len(mine):
                # a length not met goes by the next shorter one
                mine = out[j, max(b - 1, 0):b]
            out[j, b] = np.quantile(mine, FAR, method="lower") if len(mine) else 0.0
    return out


def _centroids(idf, k):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        texts = rows.column("text").to_pylist()
        learn, judge = (texts[::2], texts[1::2]) if len(texts) >= APART else (texts, texts)
        learn = pa.array(learn, pa.string())
        x = np.concatenate([vectors(learn.slice(at, ROWS), idf)[0] for at in range(0, len(learn), ROWS)])
        c = clustered(x[np.linalg.norm(x, axis=1) > 0], k)
        limit = limits(judge, idf, c) * MARGIN
        return pa.table({"language": pa.array([rows.column("language")[0].as_py()] * len(c), pa.string()),
                         "part": pa.array(range(len(c)), pa.int32()),
                         "centroid": pa.array([v.astype(np.float32).tobytes() for v in c], pa.binary()),
                         "limits": pa.array(limit.tolist(), pa.list_(pa.float64()))})
    return run


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """A model from the labelled rows of ``docs`` (doc_id, text, lang).

    Rows without language, letters or a trigram are left out; without any row left the model knows no language
    and every text is ``und``. ``sample`` bounds the texts of a language that are
    clustered and those that limits are learned from (chosen by a hash of doc_id); the model's size is
    set by the number of languages.
    """
    docs = docs.select("doc_id", "text", F.col("lang").alias("language")) \
        .where(F.col("language").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") >= 3))
    rows = docs.select("text").mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n"))
    df = dict(rows.collect())
    n = df.pop(-1, 0)
    if not n:
        return Model(np.ones(SLOTS, np.float32), [UNKNOWN], np.zeros((1, SLOTS), np.float32),
                     np.ones((1, LENGTHS)))
    idf = np.log((1 + n) / (1 + np.array([df.get(i, 0) for i in range(SLOTS)]))).astype(np.float32) + 1
    share = docs.groupBy("language").agg((F.lit(2.0 * sample) / F.count(F.lit(1))).alias("share"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = docs.join(F.broadcast(share), "language").where(place < F.col("share"))
    found = picked.select("doc_id", "text", "language").groupBy("language").applyInArrow(
        _centroids(idf, centroids), "language string, part int, centroid binary, limits array<double>") \
        .orderBy("language", "part").collect()
    return Model(idf, [r.language for r in found],
                 np.stack([np.frombuffer(r.centroid, np.float32) for r in found]),
                 np.array([r.limits for r in found]))


def _has_letter(text) -> bool:
    return bool(text) and LETTER.search(text) is not None


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` and lang_pred, score, accepted.

    A null text or one without letters is ``und`` with score 0 and not accepted. Score is the cosine
    to the nearest centroid, of equally near ones the first by language; ``accepted`` tells whether it reaches that
    centroid's limit for the text's number of trigrams (between two powers of two by its logarithm). Columns of
    ``docs`` that have an added name give way to it; others pass through unchanged, repeated rows give a row each.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in _pieces(batches):
            x, n = vectors(b.column("text"), m.idf)
            similar = x @ m.centroids.T
            near = similar.argmax(axis=1)
            score = np.clip(similar[np.arange(len(near)), near].astype(float), 0, 1)
            letters = np.array([_has_letter(t) for t in b.column("text").to_pylist()])
            score[~letters] = 0
            place = np.log2(n.clip(1, 1 << LENGTHS - 1))
            low = place.astype(int)
            share = place - low
            limit = (1 - share) * m.limits[near, low] + share * m.limits[near, np.minimum(low + 1, LENGTHS - 1)]
            accepted = letters & (score > 0) & (score >= limit)
            names = [m.languages[i] if ok else UNKNOWN for i, ok in zip(near, letters)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(names, pa.string()), pa.array(score), pa.array(accepted)],
                names=[*b.schema.names, "lang_pred", "score", "accepted"])

    added = T.StructType().add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + added.fields))


def held_out(column="doc_id"):
    return F.crc32(F.col(column).cast("string")) % 5 == 0
