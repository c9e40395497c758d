"""Decision thresholds: percentile, best F1, inter-quartile range, recalibration over time."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config
from .evaluation import threshold_curve
from .ordered import exact_quantiles


def percentile_threshold(df: DataFrame, error: str, percentile: float = 95.0) -> float:
    """Exact percentile; values above 98 are treated as 98."""
    return exact_quantiles(df, [error], [min(percentile, 98.0) / 100.0])[error][0]


def iqr_threshold(df: DataFrame, error: str) -> float:
    q1, q3 = exact_quantiles(df, [error], [0.25, 0.75])[error]
    return q3 + 1.5 * (q3 - q1)


def _f1(eps: float) -> Column:
    p, r = F.col("precision"), F.col("recall")
    return 2 * (p * r) / (p + r + F.lit(eps))


def f1_threshold(curve: DataFrame, eps: float = 1e-8) -> DataFrame:
    """The smallest threshold with the largest F1."""
    best = F.max(F.struct(_f1(eps).alias("f1"), (-F.col("threshold")).alias("t")))
    return curve.agg(best.alias("b")).select((-F.col("b.t")).alias("threshold"),
                                             F.col("b.f1").alias("f1_score"))


def fit_threshold(df: DataFrame, error: str, label: str | None = None,
                  method: str = "percentile", percentile: float = 95.0) -> float:
    """Threshold by ``percentile``, ``optimal_f1`` (needs labels) or ``iqr``."""
    if method == "optimal_f1" and label is not None:
        return f1_threshold(threshold_curve(df, error, label)).first()[0]
    if method == "iqr":
        return iqr_threshold(df, error)
    return percentile_threshold(df, error, percentile)


def apply_threshold(df: DataFrame, error: str, threshold: float, out="prediction") -> DataFrame:
    return df.withColumn(out, (F.col(error) > F.lit(threshold)).cast("int"))


def threshold_stats(df: DataFrame, error: str, threshold: float) -> DataFrame:
    p95, p99 = exact_quantiles(df, [error], [0.95, 0.99])[error]
    e = F.col(error)
    return df.agg(F.avg(e).alias("mean_error"), F.stddev_pop(e).alias("std_error"),
                  F.min(e).alias("min_error"), F.max(e).alias("max_error")).withColumns({
        "threshold": F.lit(threshold), "percentile_95": F.lit(p95), "percentile_99": F.lit(p99)})


def forest_threshold(df: DataFrame, score: str, label: str | None = None,
                     params: dict | None = None) -> float:
    """Threshold on scores where lower means more anomalous.

    With both classes present: the cut of highest recall with the wanted precision, else of best
    F1. Without labels: the score below which the configured share lies.
    """
    params = {**config.CALIBRATION, **(params or {})}
    if label is not None:
        curve = threshold_curve(df.withColumn("_turned", -F.col(score)), "_turned", label)
        good = F.col("precision") >= params["min_precision"]
        pick = curve.agg(
            F.max(F.when(good, F.struct("recall", (-F.col("threshold")).alias("t")))).alias("a"),
            F.max(F.struct(_f1(1e-10).alias("f"), (-F.col("threshold")).alias("t"))).alias("b"),
            F.max("positives").alias("p"), F.max("negatives").alias("n")).first()
        if pick["p"] and pick["n"]:
            return (pick["a"] or pick["b"])["t"]
    return low_tail(df, score, params["percentile"])


def low_tail(df: DataFrame, score: str, percentile: float) -> float:
    """-percentile(-score)."""
    turned = df.select((-F.col(score)).alias("_turned"))
    return -exact_quantiles(turned, ["_turned"], [percentile / 100.0])["_turned"][0]


def _last_of_each(size: int, held: int = 1 << 16):
    """The rows of every batch with the ``size`` highest positions among those a task has read.

    Rows are thinned whenever ``held`` of them have come together, so a task holds few.
    """
    import pyarrow as pa

    def last(table):
        table = table.sort_by([("batch", "ascending"), ("pos", "descending")])
        codes = table.column("batch").combine_chunks().dictionary_encode().indices
        codes = codes.fill_null(-1).to_numpy(False)
        first = np.ones(len(codes), bool)
        first[1:] = codes[1:] != codes[:-1]
        starts = np.flatnonzero(first)
        rank = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
        return table.filter(pa.array(rank < size))

    def run(batches):
        parts, n, limit = [], 0, held
        for b in batches:
            parts.append(b)
            n += b.num_rows
            if n > limit:
                kept = last(pa.Table.from_batches(parts)).combine_chunks()
                parts, n = kept.to_batches(), kept.num_rows
                limit = max(held, 2 * n)
        if n:
            yield from last(pa.Table.from_batches(parts)).combine_chunks().to_batches()

    return run


def recalibrate(df: DataFrame, batch: str, order: str, score: str, training_batch,
                start_threshold: float, baseline_mean: float,
                params: dict | None = None) -> DataFrame:
    """Replay the threshold updates over a history of batches.

    ``batch`` values increase over time and ``training_batch`` is the first one: its scores only
    fill the buffer. Per batch three numbers are computed in parallel - size, mean, and the
    candidate threshold from the last ``window_size`` scores up to the end of that batch. The
    sequential part walks over those rows, one per batch.
    """
    params = {**config.CALIBRATION, **(params or {})}
    size = params["window_size"]
    rows = df.select(F.col(batch).alias("batch"), F.col(order).alias("pos"),
                     F.col(score).cast("double").alias("score"))
    per = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    run = Window.orderBy("batch")  # one row per batch
    ends = per.withColumn("end", F.sum("n").over(
        run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # only the last `size` rows of a batch can be in anyone's buffer; each task gives out at most as many of each
    back = Window.partitionBy("batch").orderBy(F.desc("pos"))
    tail = rows.mapInArrow(_last_of_each(size), rows.schema).withColumn(
        "back", F.row_number().over(back)).where(F.col("back") <= size)
    tail = tail.join(ends.select("batch", "end"), "batch").withColumn(
        "at", F.col("end") - F.col("back") + 1)
    # a row at position g is in the buffer of every batch whose end lies in [g, g + size)
    later = ends.select(F.col("batch").alias("b"), F.col("end").alias("e"),
                        F.floor(F.col("end") / size).alias("cell"))
    cells = tail.withColumn("cell", F.explode(F.array(F.floor(F.col("at") / size),
                                                      F.floor(F.col("at") / size) + 1)))
    buffers = cells.join(later, "cell").where(
        (F.col("e") >= F.col("at")) & (F.col("e") < F.col("at") + size))
    candidate = buffers.groupBy("b").agg((-F.percentile(-F.col("score"), F.lit(
        params["percentile"] / 100.0))).alias("candidate"))
    table = ends.join(candidate, ends["batch"] == candidate["b"]).select(
        "batch", "n", "mean", "candidate").where(F.col("batch") != F.lit(training_batch))

    def walk(pdf):
        current, waiting, out = start_threshold, 0, []
        for r in pdf.sort_values("batch").itertuples(index=False):
            waiting += r.n
            drift = r.n >= params["min_batch"] and abs(
                r.mean - baseline_mean) > params["mean_shift"]
            updated = (waiting >= params["update_frequency"] and drift
                       and abs(r.candidate - current) > params["min_move"])
            if updated:
                current, waiting = r.candidate, 0
            out.append((r.batch, r.n, r.mean, bool(drift), bool(updated), current))
        import pandas as pd
        return pd.DataFrame(out, columns=["batch", "n", "mean", "drift", "updated", "threshold"])

    kind = df.schema[batch].dataType.simpleString()
    return table.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(
        walk, f"batch {kind}, n bigint, mean double, drift boolean, updated boolean, "
              "threshold double")
