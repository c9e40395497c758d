"""Near-duplicate documents by minhash with tensored bands, links confirmed on full sets.

Two collections of COLLECTION half keys, each made of ROWS minhash values, give COLLECTION squared
tables: table (i, j) is keyed by half key i of the first collection and j of the second. The number
of minhash values grows with 2 * COLLECTION, the number of tables with its square. A pair of
similarity s shares a table with probability (1 - (1 - s ** ROWS) ** COLLECTION) ** 2: 0.9995 at
0.75 and 0.99993 at 0.8.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import MULTIPLIER, blocks, components, flat, mix, staged, word_codes

WORDS = 5
ROWS = 2
COLLECTION = 10
#: hub rounds before what is left is compared pair by pair, the first on table buckets
HUB_ROUNDS = 2
#: shingle counters that give the order from rare to common, by leading bits
COUNTER_BITS = 18
#: members of one hub that a task compares at once
HUB_SHARE = 400

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit codes of the shingles of every text, with offsets."""
    data, offsets = flat(texts)
    codes, at = word_codes(_LOWER[data], offsets)
    n = np.diff(at)
    length = np.full(len(codes), WORDS)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    length[at[short]] = n[short]
    h = mix(length.astype(np.uint64) * MULTIPLIER)
    for j in range(WORDS):
        follow = np.zeros(len(codes), np.uint64)
        follow[:len(codes) - j] = codes[j:]
        h = np.where(length > j, mix((h ^ follow) * MULTIPLIER), h)
    sets = []
    for a, k in zip(at[:-1], n):
        sets.append(np.unique(h[a:a + max(k - WORDS + 1, min(k, 1))]))
    ends = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=ends[1:])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), ends


def half_keys(values: np.ndarray, ends: np.ndarray, collection: int, rows: int) -> np.ndarray:
    """One row per non-empty set, 2 * collection half keys each."""
    starts = ends[:-1][np.diff(ends) > 0]
    seeds = mix(np.arange(1, 2 * collection * rows + 1, dtype=np.uint64) * MULTIPLIER) | np.uint64(1)
    keys = np.zeros((len(starts), 2 * collection), np.uint64)
    if not len(starts):
        return keys
    for i, seed in enumerate(seeds):
        v = (values ^ seed) * seed
        v ^= v >> np.uint64(32)
        v *= MULTIPLIER
        key = keys[:, i // rows]
        key[:] = mix((key ^ np.minimum.reduceat(v, starts)) * MULTIPLIER)
    return keys


def _signatures(collection, rows):
    def run(batches):
        for b in blocks(batches):
            values, ends = shingle_sets(b.column("text"))
            n = np.diff(ends)
            keys = np.zeros((len(n), 2 * collection), np.uint64)
            keys[n > 0] = half_keys(values, ends, collection, rows)
            total = np.zeros((2, len(values) + 1), np.uint64)
            np.cumsum(mix(values * MULTIPLIER), out=total[0, 1:])
            np.cumsum(mix(values ^ MULTIPLIER), out=total[1, 1:])
            marks = (total[:, ends[1:]] - total[:, ends[:-1]]).view(np.int64)
            flat_keys = keys.view(np.int64).ravel()
            at = np.arange(0, flat_keys.size + 1, 2 * collection, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(marks[0]),
                 pa.array(marks[1]), pa.ListArray.from_arrays(pa.array(at), pa.array(flat_keys))],
                names=["doc_id", "n_shingles", "mark1", "mark2", "keys"])
    return run


def _sets(batches):
    for b in blocks(batches):
        values, ends = shingle_sets(b.column("text"))
        data = values.tobytes()
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), pa.array(np.diff(ends)),
             pa.array([data[8 * x:8 * y] for x, y in zip(ends[:-1], ends[1:])], pa.binary())],
            names=["doc_id", "n", "shingles"])


def _tally(batches):
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    for b in blocks(batches, "shingles"):
        values = np.frombuffer(flat(b.column("shingles"))[0].tobytes(), np.uint64)
        counts += np.bincount((values >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(counts))
    slot = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot])], names=["slot", "n"])


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(cell, doc_id, at, short): the rarest shingles of each set with their ranks, enough to meet every similar set.

    Shingles stand in one order for all sets, rare ones first. Sets of similarity ``percent`` share one
    among the first n - ceil(percent n / 100) + 1 of the larger and the first
    n - ceil(2 percent n / (100 + percent)) + 1 of the smaller set; ``short`` marks the latter. Counters
    only set the order: shingles that share a counter cost candidates, not links.
    """
    tally = sets.mapInArrow(_tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    counts[tally.column("slot").to_numpy()] = tally.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        common = shared.value
        for b in blocks(batches, "shingles"):
            first, length, short, at = [], [], [], []
            for x in b.column("shingles").to_pylist():
                values = np.frombuffer(x, np.uint64)
                n = len(values)
                order = np.lexsort((values, common[(values >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))
                first.append(values[order[:n + percent * n // -100 + 1]])
                length.append(len(first[-1]))
                at.append(np.arange(length[-1]))
                short.append(at[-1] < n + 2 * percent * n // -(100 + percent) + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(first).view(np.int64)),
                 pa.array(np.repeat(b.column("doc_id").to_numpy(), length)), pa.array(np.concatenate(at)),
                 pa.array(np.concatenate(short))],
                names=["cell", "doc_id", "at", "short"])

    return sets.mapInArrow(run, "cell long, doc_id long, at long, short boolean")


def _confirm(percent):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids = rows.column("doc_id").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        at = ids.index(key[0].as_py())
        hub, found = sets[at], []
        for i, other in zip(ids, sets):
            if i == ids[at]:
                continue
            place = np.searchsorted(hub, other)
            place[place == len(hub)] = 0
            both = int((hub[place] == other).sum()) if len(hub) else 0
            if 100 * both >= percent * (len(hub) + len(other) - both) and both:
                found.append(i)
        return pa.table({"a": pa.array([ids[at]] * len(found), pa.int64()),
                         "b": pa.array(found, pa.int64())})
    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, doc_id) whose full sets are similar enough, as links (a, b).

    Members of a hub are dealt out in shares, so that no task holds a large group.
    """
    n = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    shares = n.select("hub", F.ceil(F.col("n") / HUB_SHARE).cast("int").alias("shares"))
    member = pairs.join(shares, "hub").select(
        "hub", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int").alias("share"), "doc_id")
    hubs = member.select("hub", "share").distinct().withColumn("doc_id", F.col("hub"))
    rows = member.unionByName(hubs).join(sets.hint("merge"), "doc_id")
    return rows.groupBy("hub", "share").applyInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, collection: int = COLLECTION,
                    rows: int = ROWS, hub_rounds: int = HUB_ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for ``docs`` (doc_id, text).

    Documents with equal sets form a class; classes are compared through a representative. In a
    table bucket every member is compared with one hub; a member already joined to the hub's
    component is left out. Documents whose buckets still hold several components then meet in
    smaller buckets, by their rarest shingles (``rare_shingles``), again with one hub per round; after
    the rounds every pair of such a bucket whose components still differ is compared, so that no
    candidate is lost. Null or empty texts have an empty set
    and stand alone; a null doc_id is not accepted (rows are dropped). Repeated doc_ids count as
    one document whose rows must be equal.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    sig = staged(docs.mapInArrow(
        _signatures(collection, rows),
        "doc_id long, n_shingles long, mark1 long, mark2 long, keys array<long>"), "signatures")
    full = sig.where("n_shingles > 0")
    classes = full.groupBy("mark1", "mark2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    same = full.select("doc_id", "mark1", "mark2", "n_shingles") \
        .join(classes, ["mark1", "mark2", "n_shingles"])
    same = staged(same.select("doc_id", "rep").distinct(), "classes")
    reps = full.join(same.where("doc_id = rep").select("doc_id"), "doc_id").select("doc_id", "keys") \
        .dropDuplicates(["doc_id"])

    half = reps.select("doc_id", F.posexplode("keys").alias("i", "key"))
    shared = half.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    half = half.join(shared.hint("merge"), ["i", "key"]).groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("i") < collection, F.struct("i", "key"))).alias("first"),
        F.collect_list(F.when(F.col("i") >= collection, F.struct("i", "key"))).alias("second"))
    cells = half.select("doc_id", F.explode("first").alias("x"), "second") \
        .select("doc_id", "x", F.explode("second").alias("y")) \
        .select("doc_id", F.xxhash64("x.i", "y.i", "x.key", "y.key").alias("cell"))
    size = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"),
                                     F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("who")) \
        .where("n > 1")
    # tables that hold the same documents are one bucket
    size = size.groupBy("n", "who").agg(F.min("cell").alias("cell"))
    cells = staged(cells.join(size.select("cell").hint("merge"), "cell"), "cells")

    involved = cells.select("doc_id").distinct()
    # joins are merges at every size: broadcasts of small sides would end as the input grows
    sets = staged(docs.join(involved.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
                  .mapInArrow(_sets, "doc_id long, n long, shingles binary"), "sets")
    links, buckets = None, cells
    label = sets.select("doc_id", F.col("doc_id").alias("root"), "n")
    for turn in range(hub_rounds + 1):
        placed = _mixed(buckets, label, turn)
        if turn == 1:
            left = sets.join(placed.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
            buckets = staged(rare_shingles(staged(left, "left"), percent), "rare")
            placed = _mixed(buckets, label, turn)
        if turn < hub_rounds:
            pairs = placed.where("root <> hub.root").where(_sizes_fit("n", "hub.n", percent))
            # one hub for each document: most groups are joined by it
            pairs = pairs.groupBy("doc_id").agg(F.min("hub.doc_id").alias("hub")).select("hub", "doc_id")
        else:
            pairs = _across(placed, percent).distinct()
        pairs = staged(pairs, "pairs")
        if pairs.isEmpty():
            continue
        found = staged(confirmed(pairs, sets, percent), "found")
        links = found if links is None else links.union(found)
        roots = components(links).withColumnRenamed("id", "doc_id")
        label = staged(label.select("doc_id", "n").join(roots, "doc_id", "left").select(
            "doc_id", F.coalesce("root", "doc_id").alias("root"), "n"), "roots")
    # a class takes the root of its representative; roots are representatives, so smallest ids
    out = sig.select("doc_id", "n_shingles").distinct().join(same, "doc_id", "left")
    out = out.join(label.withColumnRenamed("doc_id", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles",
                      F.coalesce("root", "rep", "doc_id").alias("component_id")) \
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _mixed(buckets: DataFrame, label: DataFrame, turn: int) -> DataFrame:
    """Members of buckets that hold several components, with a hub of the bucket."""
    placed = buckets.join(label.hint("merge"), "doc_id")
    ends = placed.groupBy("cell").agg(
        F.min("root").alias("low"), F.max("root").alias("high"),
        F.min_by(F.struct("doc_id", "root", "n"), F.xxhash64("doc_id", F.lit(turn))
                 if turn else F.col("doc_id")).alias("hub")).where("low <> high")
    return placed.join(ends.select("cell", "hub").hint("merge"), "cell")


def _across(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket whose components differ, the smaller set first, through the components of the bucket.

    At the rarest shingle that two sets share, what follows in either bounds what they share in all:
    ``reach`` is the largest partner that a set can have in the bucket. Components whose sizes and
    reaches exclude each other are not opened.
    """
    reach = F.expr(f"({100 + percent} * (n - at) - {percent} * n) div {percent}")
    member = placed.select("cell", "root", "doc_id", "n", "short", reach.alias("reach"))
    parts = member.groupBy("cell", "root").agg(
        F.min(F.when(F.col("short"), F.col("n"))).alias("least"),
        F.max(F.when(F.col("short"), F.col("reach"))).alias("most"),
        F.min("n").alias("other_least"), F.max("reach").alias("other_most"))
    one = parts.select("cell", "root", "least", "most").where("least is not null") \
        .join(parts.select("cell", F.col("root").alias("other"), "other_least", "other_most"), "cell") \
        .where("root <> other and least <= other_most and other_least <= most")
    small = member.where("short").toDF("cell", "root", "hub", "hub_n", "hub_short", "hub_reach")
    left = one.join(small, ["cell", "root"]).where("hub_n <= other_most and other_least <= hub_reach")
    return left.join(member.withColumnRenamed("root", "other"), ["cell", "other"]) \
        .where("hub_n < n or hub_n = n and (hub < doc_id or not short)") \
        .where("n <= hub_reach and hub_n <= reach").select("hub", "doc_id")
