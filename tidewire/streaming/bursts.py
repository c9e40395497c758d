"""Live burst flags that late rows correct.

The addresses of a role are dealt to buckets by hash. A state holds the rows of one bucket and time block, with those of
the last window length of the block before as context, so that a busy address spreads over many states and a batch
makes few calls, each over arrays. A row that arrives late changes the flags of rows after it; these are given out again
with a higher version.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .frames import ROCKSDB

OUTPUT = "id bigint, role string, burst int, version bigint"
#: states that rows without an address or time are dealt to
IDLE = 256
#: states that the addresses of a role and block are dealt to
BUCKETS = 16


class BurstProcessor(StatefulProcessor):
    """Times of a block's rows by address and time, with their ids and the flags last given out (-1 for none)."""

    def __init__(self, width: int, block: int, limits: dict[str, int]):
        self.width, self.block, self.limits = width, block, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "names array<string>, who binary, us binary, ids binary, own binary, flags binary")

    def handleInputRows(self, key, rows, timerValues):
        role, _, block = key
        new = pd.concat(list(rows))
        if block < 0:
            yield pd.DataFrame({"id": new["id"], "role": role, "burst": 0, "version": 1})
            return
        parts = [new["us"].to_numpy(np.int64), new["id"].to_numpy(np.int64), new["own"].to_numpy(bool),
                 np.full(len(new), -1, np.int8)]
        addr = new["addr"].to_numpy(object)
        if self.seen.exists():
            kinds = np.int64, np.int64, bool, np.int8
            names, who, *old = self.seen.get()
            place = pd.factorize(np.concatenate([np.array(list(names), object), addr]))
            who = np.concatenate([np.frombuffer(bytes(who), np.int64), place[0][len(names):]])
            names = place[1]
            parts = [np.concatenate([np.frombuffer(bytes(o), kind), p]) for o, kind, p in zip(old, kinds, parts)]
        else:
            who, names = pd.factorize(addr)
            # nothing can change once every row of the block and of the window behind it has passed
            self.handle.registerTimer(((int(block) + 2) * self.block + self.width) // 1000)
        order = np.lexsort((parts[0], who))
        who = who[order].astype(np.int64)
        us, ids, own, flags = (p[order] for p in parts)
        # one axis for all addresses, with more than a window between them
        axis = us - (int(block) * self.block - self.width) + who * (self.block + 2 * self.width + 2)
        counts = np.searchsorted(axis, axis, "right") - np.searchsorted(axis, axis - self.width, "left")
        now = (counts > self.limits[role]).astype(np.int8)
        changed = own & (now != flags)
        self.seen.update((list(names), who.tobytes(), us.tobytes(), ids.tobytes(), own.tobytes(), now.tobytes()))
        yield pd.DataFrame({"id": ids[changed], "role": role, "burst": now[changed].astype(np.int32), "version": len(us)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def burst_updates(stream: DataFrame, window_s: int = 180, sender_limit: int = 30, recipient_limit: int = 15,
                  late: str = "1 hour", block_s: int | None = None) -> DataFrame:
    """(id, role, burst, version) for every row and role, again with a higher version whenever the flag changes.

    A row is a burst when more than the limit of its address's rows lie in the window that ends at it, as in the
    batch job; rows may come in any order within ``late``. Rows without an address or time are no bursts.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    width, block = window_s * 1_000_000, (block_s or 4 * window_s) * 1_000_000
    if block < width:
        raise ValueError("a time block must be at least one window long")
    roles = F.explode(F.array(F.struct(F.lit("s").alias("role"), F.col("source_addr").alias("addr")),
                              F.struct(F.lit("r").alias("role"), F.col("dest_addr").alias("addr"))))
    rows = stream.withWatermark("timestamp", late).select(
        F.col("id").cast("bigint").alias("id"), "timestamp", F.unix_micros("timestamp").alias("us"), roles.alias("e"))
    idle = F.col("us").isNull() | (F.length(F.coalesce("e.addr", F.lit(""))) == 0)
    own = F.expr(f"(us - pmod(us, {block})) div {block}")
    blocks = F.when(idle, F.array(-1 - F.pmod(F.xxhash64("id"), F.lit(IDLE)))).when(
        F.col("us") + width >= (own + 1) * block, F.array(own, own + 1)).otherwise(F.array(own))
    bucket = F.when(idle, F.lit(0)).otherwise(F.pmod(F.xxhash64("e.addr"), F.lit(BUCKETS))).cast("int")
    rows = rows.select("id", "timestamp", "us", "e.role", F.when(idle, "").otherwise(F.col("e.addr")).alias("addr"),
                       bucket.alias("bucket"), F.coalesce(own, F.lit(-1)).alias("_own"), F.explode(blocks).alias("block"))
    rows = rows.withColumn("own", F.col("block") == F.col("_own")).drop("_own")
    return rows.groupBy("role", "bucket", "block").transformWithStateInPandas(
        statefulProcessor=BurstProcessor(width, block, {"s": sender_limit, "r": recipient_limit}),
        outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")


def latest_flags(updates: DataFrame) -> DataFrame:
    """One row per id with ``sender_burst`` and ``recipient_burst``: the flags of the highest version."""
    pick = lambda r: F.max_by(F.when(F.col("role") == r, F.col("burst")), F.when(
        F.col("role") == r, F.col("version")))
    return updates.groupBy("id").agg(pick("s").alias("sender_burst"), pick("r").alias("recipient_burst"))
