"""Combine detector outputs into final scores, risk levels and result rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import config


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reconstruction_score(error, threshold, alpha: float = 0.1) -> Column:
    """Logistic score of the distance between an error and its threshold."""
    gap = _col(error) - (F.lit(threshold) if not isinstance(threshold, Column) else threshold)
    return 1.0 / (1.0 + F.exp(-alpha * gap))


def confidence(a: Column, b: Column, mode: str = "literal") -> Column:
    """``literal``: 2ab/(ab), that is 2 where ab > 0. ``harmonic``: 2ab/(a+b)."""
    below = {"literal": a * b, "harmonic": a + b}[mode]
    return F.when(a * b > 0, F.try_divide(2 * a * b, below)).otherwise(0.0)


def risk_level(score) -> Column:
    s = _col(score)
    return (F.when(s > 0.8, "CRITICAL").when(s > 0.6, "HIGH").when(s > 0.3, "MEDIUM")
            .otherwise("LOW"))


def feature_vector(columns: list[str] | None = None, have: list[str] | None = None,
                   width: int | None = None) -> Column:
    """The scoring columns as an array of floats: missing is 0, zero-padded to ``width``."""
    columns = config.SCORING_COLUMNS if columns is None else columns
    parts = [F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float"))
             if have is None or c in have else F.lit(0.0).cast("float") for c in columns]
    vec = F.array(*parts)
    if width and width > len(columns):
        vec = F.concat(vec, F.array_repeat(F.lit(0.0).cast("float"), width - len(columns)))
    return vec


def combine_scores(df: DataFrame, error="reconstruction_error", members="member_scores",
                   threshold=0.0, weights=(0.5, 0.5), mode: str = "literal") -> DataFrame:
    """Add detector scores, flags, final score, risk and confidence.

    ``members`` is an array of anomaly-oriented forest scores, one per member.
    """
    ae = F.col("autoencoder_score")
    forest = F.col("isolation_forest_score")
    out = df.withColumns({
        "autoencoder_score": reconstruction_score(error, threshold),
        "autoencoder_reconstruction_error": _col(error),
        "isolation_forest_score": F.array_max(_col(members)),
        "isolation_forest_mean": F.aggregate(_col(members), F.lit(0.0), lambda a, x: a + x)
        / F.size(_col(members)),
    }).withColumns({
        "autoencoder_anomaly": (ae > 0.92).cast("int"),
        "isolation_forest_anomaly": (forest > 0.1).cast("int"),
        "final_anomaly_score": weights[0] * ae + weights[1] * forest,
    })
    either = (F.col("autoencoder_anomaly") == 1) | (F.col("isolation_forest_anomaly") == 1)
    return out.withColumns({
        "is_anomaly": (either & (F.col("final_anomaly_score") >= 0.5)).cast("int"),
        "risk_level": risk_level("final_anomaly_score"),
        "confidence_level": confidence(ae, forest, mode),
    })


RESULT_COLUMNS = ["message_id", "timestamp", "final_anomaly_score", "is_anomaly", "risk_level",
                  "confidence_level", "isolation_forest_score", "isolation_forest_anomaly",
                  "isolation_forest_version", "autoencoder_score", "autoencoder_anomaly",
                  "autoencoder_reconstruction_error", "autoencoder_version", "ensemble_method",
                  "ensemble_weights", "model_version", "processing_time_ms",
                  "feature_vector_used"]


def score_messages(df: DataFrame, id="id", error="reconstruction_error", members="member_scores",
                   threshold=0.0, weights=(0.5, 0.5), mode: str = "literal",
                   width: int | None = None, elapsed: Column | None = None) -> DataFrame:
    """One result row of 18 columns per message."""
    scored = combine_scores(df, error, members, threshold, weights, mode)
    out = scored.withColumns({
        "message_id": F.col(id),
        "isolation_forest_version": F.lit("1.0"),
        "autoencoder_version": F.lit("2.0"),
        "ensemble_method": F.lit("weighted_average"),
        "ensemble_weights": F.lit(f"AE:{weights[0]},IF:{weights[1]}"),
        "model_version": F.lit("AE:2.0,IF:1.0"),
        "processing_time_ms": (F.lit(0) if elapsed is None else elapsed).cast("int"),
        "feature_vector_used": F.to_json(feature_vector(have=df.columns, width=width)),
    })
    return out.select(*RESULT_COLUMNS)


def pending_messages(messages: DataFrame, results: DataFrame, limit: int | None = None,
                     id="id") -> DataFrame:
    """Messages without a result row."""
    todo = messages.join(results.select(F.col("message_id").alias(id)), id, "left_anti")
    return todo if limit is None else todo.orderBy(id).limit(limit)


def batch_counts(todo: DataFrame, scored: DataFrame) -> DataFrame:
    """Total, processed and anomalous counts of one scoring batch."""
    total = todo.agg(F.count(F.lit(1))).scalar()
    return scored.agg(F.count(F.lit(1)).alias("processed"),
                      F.count_if(F.col("is_anomaly") == 1).alias("anomalies")).withColumn(
        "total", total)


def message_by_id(df: DataFrame, value, id="id") -> DataFrame:
    """The one message with this id; an error when there is none."""
    found = df.where(F.col(id) == F.lit(value))
    if found.isEmpty():
        raise ValueError(f"message {value} not found")
    return found
