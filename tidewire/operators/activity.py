"""Per-address behaviour: how often an address occurs and whether it sends in bursts.

Both roles (sender, recipient) go through one narrow table of (id, role, address, time), so message
text is never shuffled here. A bulk sender may own a large share of all rows, therefore

* counts are pre-aggregated and attached without moving all rows of one address to one task, and
* the burst window is partitioned by address *and* time block; rows of the last window length of a
  block are repeated in the next block as context, which keeps the result exact.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SALTS = 4096
HOT_SHARE = 1000


def attach_count(df: DataFrame, keys: list[str], out: str, spread: str) -> DataFrame:
    """Attach the number of rows that share ``keys`` to every row.

    Keys with at least 1/1000 of all rows number at most 1000, so their counts are broadcast.
    The remaining counts are joined by key; rows already served carry a salt derived from
    ``spread`` and scatter over the tasks of that join.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    hot = counts.where(F.col("_n") * HOT_SHARE >= total).withColumnRenamed("_n", "_hot")
    cold = (counts.where(F.col("_n") * HOT_SHARE < total).withColumnRenamed("_n", "_cold")
            .withColumn("_salt", F.lit(0)))
    hot = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], "_hot")
    cold = cold.select(*[F.col(k).alias(f"_c_{k}") for k in keys], "_salt", "_cold")
    on_hot = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
    marked = (df.join(F.broadcast(hot), on_hot, "left")
              .withColumn("_mine", F.when(F.col("_hot").isNull(), 0).otherwise(
                  F.pmod(F.xxhash64(spread), F.lit(SALTS)) + 1).cast("int")))
    on_cold = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys]
    joined = marked.join(cold, on_cold + [F.col("_mine") == F.col("_salt")], "left")
    return (joined.withColumn(out, F.coalesce("_hot", "_cold"))
            .drop("_hot", "_cold", "_salt", "_mine", *[f"_h_{k}" for k in keys],
                  *[f"_c_{k}" for k in keys]))


def address_rows(df: DataFrame, id="id", ts="timestamp", source="source_addr",
                 dest="dest_addr") -> DataFrame:
    """Two narrow rows per message: (id, role, address, time in microseconds)."""
    role = F.explode(F.array(
        F.struct(F.lit("s").alias("role"), F.col(source).alias("addr")),
        F.struct(F.lit("r").alias("role"), F.col(dest).alias("addr")))).alias("_e")
    return (df.select(F.col(id).alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), role)
            .select("id", "us", "_e.role", "_e.addr"))


def burst_flags(rows: DataFrame, window_s: int = 180, sender_limit: int = 30,
                recipient_limit: int = 15, block_s: int | None = None) -> DataFrame:
    """1 for rows with more than ``limit`` rows of the address in [t - window, t].

    More than k rows in the window means that the k-th row before the last one of the same instant
    is still inside it, so one ``lag`` per role decides and no frame is re-aggregated per row.
    """
    width = window_s * 1_000_000
    block = (block_s or 4 * window_s) * 1_000_000
    if block < width:
        raise ValueError("a time block must be at least one window long")
    own = F.expr(f"(us - pmod(us, {block})) div {block}")
    blocks = F.when(F.col("us") + width >= (own + 1) * block,
                    F.array(own, own + 1)).otherwise(F.array(own))
    spread = (rows.withColumn("_own", own).withColumn("_block", F.explode_outer(blocks))
              .withColumn("_mine", F.col("_block").eqNullSafe(F.col("_own"))))
    by = Window.partitionBy("role", "addr", "_block").orderBy("us")
    same_instant = by.rangeBetween(Window.currentRow, Window.currentRow)
    k_back = F.when(F.col("role") == "s", F.lag("us", sender_limit).over(by)).otherwise(
        F.lag("us", recipient_limit).over(by))
    hit = F.coalesce(F.col("us") - k_back <= width, F.lit(False)) & (F.length("addr") > 0)
    return (spread.withColumn("_hit", hit.cast("int"))
            .withColumn("burst", F.coalesce(F.max("_hit").over(same_instant), F.lit(0)))
            .where("_mine").select("id", "us", "role", "addr", "burst"))


def address_activity(df: DataFrame, id="id", ts="timestamp", source="source_addr",
                     dest="dest_addr", window_s: int = 180, sender_limit: int = 30,
                     recipient_limit: int = 15, block_s: int | None = None) -> DataFrame:
    """One row per message: frequencies, high-frequency flags and burst flags of both addresses."""
    rows = address_rows(df, id, ts, source, dest)
    flagged = burst_flags(rows, window_s, sender_limit, recipient_limit, block_s)
    counted = attach_count(flagged, ["role", "addr"], "freq", "id")
    pick = lambda role, col: F.max(F.when(F.col("role") == role, F.col(col)))
    out = counted.groupBy("id").agg(
        pick("s", "freq").alias("sender_frequency"),
        pick("r", "freq").alias("recipient_frequency"),
        pick("s", "burst").alias("sender_burst"),
        pick("r", "burst").alias("recipient_burst"))
    return (out.withColumn("high_sender_frequency",
                           (F.col("sender_frequency") > sender_limit).cast("int"))
            .withColumn("high_recipient_frequency",
                        (F.col("recipient_frequency") > recipient_limit).cast("int"))
            .withColumnRenamed("id", id))
