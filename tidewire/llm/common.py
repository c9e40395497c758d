"""Shared steps: tables, staged tables, flat views of Arrow columns, connected components."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import work_dir

#: text bytes that a task holds in numpy arrays at once; one longer text is a block of its own
BLOCK_BYTES = 2 << 20

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later steps see the same rows, no lineage."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps)
    return have[:n]


class SpanHash:
    """64-bit fingerprints of any spans of one array of 64-bit codes."""

    BASE = 0xD1342543DE82EF95

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * _power_table("up", self.BASE, n), out=self.sums[1:])
        self.down = _power_table("down", pow(self.BASE, -1, 1 << 64), n + 1)

    def __call__(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(batches, column: str = "text", limit: int = BLOCK_BYTES):
    """Cut record batches into slices of at most ``limit`` text bytes, or one text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def byte_table(kept) -> bytes:
    """A translation of bytes: A-Z to a-z, bytes for which ``kept`` holds to themselves, others to a space."""
    lower = [c + 32 if 65 <= c <= 90 else c for c in range(256)]
    return bytes(c if kept(c) else 32 for c in lower)


def word_runs(raw: bytes, table: bytes, limit: int = BLOCK_BYTES):
    """(start, words) of consecutive slices of ``raw``: its byte place and the words it holds.

    ``table`` maps every byte outside a word to a space. A slice has at least ``limit`` bytes, but for the
    last, and ends where a word ends, so that only one slice of words is held at a time.
    """
    parts, start = [], 0
    for at in range(0, len(raw), limit):
        part = raw[at:at + limit].translate(table)
        cut = part.rfind(b" ") + 1
        if cut == 0:
            parts.append(part)
            continue
        yield start, b"".join([*parts, part[:cut]]).split()
        parts, start = [part[cut:]], at + cut
    words = b"".join(parts).split()
    if words:
        yield start, words


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """Byte starts and ends of the words of all texts, and word offsets per text."""
    space = SPACE[data]
    firsts = offsets[:-1][offsets[1:] > offsets[:-1]]
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    before[firsts] = True
    starts = np.flatnonzero(before & ~space)
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    after[firsts[firsts > 0] - 1] = True
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, offsets: np.ndarray):
    """One 64-bit code per word, and word offsets per text."""
    starts, ends, words = word_spans(data, offsets)
    return SpanHash(BYTE_CODES[data])(starts, ends), words


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable from every id of ``edges`` (a, b).

    Alternating large-star and small-star steps; a step replaces edges by as many or fewer, so a
    large group never becomes pairs. Every round is written to the shared folder. Ids that stand
    in no edge are not returned.
    """
    link = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")) \
        .where("u <> v").distinct()
    link = staged(link, "links")
    seen = None
    while True:
        both = link.union(link.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").where("v <> m").toDF("u", "v") \
            .union(low.select("u", F.col("m").alias("v"))).distinct()
        link = staged(small, "links")
        now = link.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return link.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id") \
        .union(link.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
