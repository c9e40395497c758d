"""Live sliding-window counts, threshold updates and the per-batch hook."""
from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config
from ..operators.thresholds import low_tail


def run_batches(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str,
                available_now: bool = True):
    """Hand every micro-batch to ``process``; the hook for storing or scoring decoded units."""
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def burst_windows(stream: DataFrame, address: str = "source_addr", ts: str = "timestamp",
                  limit: int = 30, width: str = "3 minutes", slide: str = "30 seconds",
                  late: str = "5 minutes") -> DataFrame:
    """Sliding-window counts per address above the limit, emitted when the window closes."""
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide), address).agg(
        F.count(F.lit(1)).alias("total"))
    return counts.where(F.col("total") > limit).select(
        F.col("window.start").alias("window_start"), address, "total")


def recalibration_writer(out: str, state: str, start_threshold: float, baseline_mean: float,
                         training: DataFrame, order: str, score: str,
                         params: dict | None = None) -> Callable[[DataFrame, int], None]:
    """Batch function that applies the threshold update rule and records every decision.

    The state is two numbers and the last ``window_size`` scores, one folder per batch.
    """
    p = {**config.CALIBRATION, **(params or {})}
    size = p["window_size"]
    last = lambda df: df.orderBy(F.desc("batch"), F.desc("pos")).limit(size)
    shaped = lambda df, b: df.select(F.lit(b).cast("long").alias("batch"), F.col(
        order).cast("long").alias("pos"), F.col(score).cast("double").alias("score"))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        if batch_id == 0:
            current, waiting, buffer = start_threshold, 0, last(shaped(training, -1))
        else:
            kept = json.loads(spark.read.parquet(f"{state}/{batch_id - 1}/meta").first()[0])
            current, waiting = kept["threshold"], kept["waiting"]
            buffer = spark.read.parquet(f"{state}/{batch_id - 1}/scores")
        last(buffer.unionByName(shaped(batch, batch_id))).write.mode("overwrite").parquet(
            f"{state}/{batch_id}/scores")
        n, mean = batch.agg(F.count(F.lit(1)), F.avg(score)).first()
        waiting += n
        drift = n >= p["min_batch"] and abs(mean - baseline_mean) > p["mean_shift"]
        updated = False
        if waiting >= p["update_frequency"] and drift:
            scores = spark.read.parquet(f"{state}/{batch_id}/scores")
            candidate = low_tail(scores, "score", p["percentile"])
            updated = abs(candidate - current) > p["min_move"]
            if updated:
                current, waiting = candidate, 0
        meta = json.dumps({"threshold": current, "waiting": waiting})
        spark.createDataFrame([(meta,)], "meta string").write.mode("overwrite").parquet(
            f"{state}/{batch_id}/meta")
        spark.createDataFrame([(batch_id, n, mean, drift, updated, current)],
                              "batch long, n long, mean double, drift boolean, updated boolean, "
                              "threshold double").write.mode("overwrite").parquet(
            f"{out}/step={batch_id}")
        batch.unpersist()
    return step
