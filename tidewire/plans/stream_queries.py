"""Streaming forms, each fed from files written out of the test tables."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from .. import config
from ..operators import thresholds as th
from ..operators.ordered import in_ranges
from ..session import work_dir
from ..sources.packets import packet_stream
from ..streaming import bursts, live
from ..streaming.frames import frame_pdus_stream
from . import sql_text as s
from .catalog import query
from .driver_tables import BURST, document_texts, message_rows
from .pdu_queries import FRAMED, FRAMED_BODY, PARTS, framed_rows, packets
from .sql_text import MSG, TEXTS, sql


#: bytes of packets in a file of a feed, and in a slice whose packets the stream meets at once
FEED_BYTES, SLICE_BYTES = 256 << 20, 512 << 20


def _feed(df: DataFrame, parts: list, path: str, files: int = 4) -> str:
    """Write the given slices one after the other, so that the stream meets them in order."""
    for cond in parts:
        df.where(cond).repartition(files).write.mode("append").parquet(path)
    return path


def _packet_bytes(spark, sf) -> int:
    """About how many bytes the packets of all texts have: two a character and a header for 67 characters."""
    return 3 * (document_texts(spark, sf).agg(F.sum(F.length("message_text"))).first()[0] or 0)


@query("framed_stream", sql(TEXTS, PARTS, FRAMED, body=FRAMED_BODY))
def framed_stream(spark, sf):
    """Units and damage framed from a packet stream in several micro-batches."""
    pid = F.col("packet_id")
    # written once in ranges, so that a slice reads its own files alone
    p = in_ranges(packets(spark, sf).where(pid.isNotNull()), [], "packet_id").drop("_range")
    n = max(3, math.ceil(_packet_bytes(spark, sf) / SLICE_BYTES))
    cuts = p.agg(F.percentile_approx(pid, F.array(*[F.lit(k / n) for k in range(1, n)]))).first()[0]
    path = _feed(p, [pid <= cuts[0], *[(pid > a) & (pid <= b) for a, b in zip(cuts, cuts[1:])], pid > cuts[-1]],
                 work_dir(spark, "packets"))
    out = work_dir(spark, "frames")
    # packets below 16 bytes are dropped by the live filter, so the feed is read without it
    raw = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 4).parquet(path)
    run = frame_pdus_stream(raw).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", work_dir(spark, "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    return framed_rows(spark.read.parquet(out))


@query("captured_packets_stream", sql(TEXTS, PARTS, body="""
SELECT CAST(40000 + doc_id % 13 AS INTEGER) AS src_port, CAST(sum(b // 700 + CASE WHEN b % 700 >= 16 THEN 1 ELSE 0 END) AS BIGINT) AS packets
FROM (SELECT doc_id, sum(33 + ls + ld + sm) + max(CASE WHEN doc_id % 7 IN (3, 5) THEN doc_id % 50 + 16 ELSE 0 END) AS b
  FROM unit GROUP BY doc_id) GROUP BY 1"""))
def captured_packets_stream(spark, sf):
    """Live packet filter: port and minimum size, counted by flow through the batch hook."""
    files = max(4, math.ceil(_packet_bytes(spark, sf) / FEED_BYTES))
    path = _feed(packets(spark, sf), [F.lit(True)], work_dir(spark, "packets"), files)
    out = work_dir(spark, "captured")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select("src_port", "packet_id").write.mode("overwrite").parquet(
            f"{out}/batch={batch_id}")

    live.run_batches(packet_stream(spark, path, files_per_trigger=2), keep,
                     work_dir(spark, "cp")).awaitTermination()
    return spark.read.parquet(out).groupBy("src_port").agg(F.count(F.lit(1)).alias("packets"))


def _message_feed(spark, sf) -> str:
    rows = message_rows(spark, sf).select(
        "id", F.col("timestamp").cast("timestamp").alias("timestamp"), "source_addr", "dest_addr",
        "value")
    day = F.dayofmonth("timestamp")
    return _feed(rows, [day <= 10, (day > 10) & (day <= 20), day > 20], work_dir(spark, "feed"))


MESSAGE_TYPE = ("id bigint, timestamp timestamp, source_addr string, dest_addr string, "
                "value double")


@query("burst_stream", sql(MSG, s.ACTIVITY, body="SELECT id, sender_burst, recipient_burst FROM act"))
def burst_stream(spark, sf):
    """Burst flags of a feed that comes in no order of time, corrected as late rows arrive; equal to the batch job."""
    rows = message_rows(spark, sf).select(
        "id", F.col("timestamp").cast("timestamp").alias("timestamp"), "source_addr", "dest_addr", "value")
    turn = F.pmod(F.xxhash64("id"), F.lit(3))
    path = _feed(rows, [turn == k for k in range(3)], work_dir(spark, "feed"))
    stream = spark.readStream.schema(MESSAGE_TYPE).option("maxFilesPerTrigger", 4).parquet(path)
    out = work_dir(spark, "bursts")
    bursts.burst_updates(stream, late="365 days", **BURST).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", work_dir(spark, "cp")).trigger(availableNow=True).start().awaitTermination()
    return bursts.latest_flags(spark.read.parquet(out))


@query("burst_window_stream", sql(MSG, body="""
SELECT window_start, source_addr, count(*) AS total FROM (
  SELECT source_addr, unnest(range(0, 12)) AS k, "timestamp", time_bucket(INTERVAL 30 MINUTES, "timestamp") - k * INTERVAL 30 MINUTES AS window_start FROM msg)
WHERE window_start <= (SELECT max("timestamp") FROM msg) - INTERVAL 6 HOURS - INTERVAL 5 MINUTES GROUP BY ALL HAVING count(*) > 12"""))
def burst_window_stream(spark, sf):
    """Closed sliding windows with more than twelve messages of one sender."""
    stream = spark.readStream.schema(MESSAGE_TYPE).option("maxFilesPerTrigger", 4).parquet(
        _message_feed(spark, sf))
    out = work_dir(spark, "windows")
    live.burst_windows(stream, limit=12, width="6 hours", slide="30 minutes").writeStream.format(
        "parquet").option("path", out).option("checkpointLocation", work_dir(spark, "cp")).trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("threshold_stream")
def threshold_stream(spark, sf):
    """Live threshold updates over three drifting batches."""
    day = F.dayofmonth("timestamp")
    score = -F.col("value") / 100 - F.when(day > 20, 0.5).otherwise(0.0)
    seed = message_rows(spark, sf).where(day <= 10).select("id", score.alias("score"))
    stream = spark.readStream.schema(MESSAGE_TYPE).option("maxFilesPerTrigger", 4).parquet(
        _message_feed(spark, sf)).select("id", score.alias("score"))
    out = work_dir(spark, "thresholds")
    step = live.recalibration_writer(
        out, work_dir(spark, "state"), th.low_tail(seed, "score", config.CALIBRATION["percentile"]),
        seed.agg(F.avg("score")).first()[0], seed, "id", "score")
    live.run_batches(stream, step, work_dir(spark, "cp")).awaitTermination()
    return spark.read.parquet(out).drop("step")

