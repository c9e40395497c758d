"""The feature job: messages in, about forty feature columns out."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config
from ..functions import obfuscation, scan, sender as sn, text as tx
from ..operators.activity import address_activity


def clean_messages(df: DataFrame) -> DataFrame:
    """Fill missing texts, addresses and categories; derive hour and weekday when absent."""
    out = df.fillna("", subset=[c for c in ("message_text", "source_addr", "dest_addr")
                                if c in df.columns])
    if "category" in df.columns:
        out = out.withColumn("category", F.coalesce("category", F.lit("unknown")))
    for name, c in sn.clock("timestamp").items():
        if name not in df.columns:
            out = out.withColumn(name, c)
    return out


def classify_unknown(df: DataFrame, model=None) -> DataFrame:
    """Give rows without a category one: from the model when there is one, else by rule."""
    if model is not None:
        from ..operators.classify import predict
        found = predict(df, model).withColumnRenamed("predicted_category", "_found").drop(
            "confidence")
    else:
        found = df.withColumn("_found", tx.rule_category("message_text", "source_addr"))
    if "category" not in df.columns:
        return found.withColumnRenamed("_found", "category")
    missing = F.col("category").isNull() | (F.col("category") == "unknown")
    return found.withColumn("category", F.when(missing, F.col("_found")).otherwise(
        F.col("category"))).drop("_found")


def sender_features(df: DataFrame) -> DataFrame:
    """Address, category and clock features that need only the row itself."""
    s, d, c, h, w = "source_addr", "dest_addr", "category", "hour", "day_of_week"
    cols = {
        "source_addr_length": F.length(s),
        "source_is_numeric": sn.source_is_numeric(s),
        "dest_is_valid": sn.dest_is_valid(d),
        "typosquatting": sn.typosquatting(s, c),
        **sn.time_flags(h, w, "feature"),
        "source_category_mismatch": sn.source_category_mismatch(s, c),
        "time_category_anomaly": sn.time_category_anomaly(c, h),
        "unusual_sender_pattern": sn.unusual_sender_pattern(s),
        "category_time_mismatch": sn.category_time_mismatch(c, h, w),
        "sender_legitimacy": sn.sender_legitimacy(s, c),
    }
    return df.withColumns(cols)


def derived_scores(df: DataFrame) -> DataFrame:
    """Combined obfuscation, protocol score, and the processed marks."""
    flags = ["encoding_issues", "empty_message", "excessive_length", "source_is_numeric",
             "dest_is_valid"]
    out = df.withColumn("sender_obfuscation", obfuscation.obfuscation_score("source_addr"))
    return out.withColumns({
        "obfuscation_score": obfuscation.combined_obfuscation("message_obfuscation",
                                                              "sender_obfuscation"),
        "protocol_anomaly_score": sum((F.col(f) for f in flags[1:]), F.col(flags[0])) / 5.0,
        "features_extracted": F.lit(1),
        "feature_extraction_version": F.lit(config.FEATURE_VERSION),
    })


def extract_features(df: DataFrame, model=None, keep_text: bool = True, **burst) -> DataFrame:
    """Every message feature in one plan.

    Every row's text is scored, by blocks of rows. The address history is computed from narrow rows
    and joined back by message id, so each message is shuffled once.
    """
    rows = scan.add_text_scores(classify_unknown(clean_messages(df), model), keep_text=keep_text)
    rows = derived_scores(sender_features(rows))
    history = address_activity(clean_messages(df).select("id", "timestamp", "source_addr",
                                                         "dest_addr"), **burst)
    stale = [c for c in history.columns if c != "id" and c in rows.columns]
    return rows.drop(*stale).join(history, "id", "left")


def feature_report(df: DataFrame) -> DataFrame:
    """Per category and in total: counts, anomaly counters and mean scores, one scan."""
    defaults = {"features_extracted": 0, "category": "unknown", "obfuscation_score": 0.0,
                "sender_burst": 0, "recipient_burst": 0, "suspicious_url": 0,
                "social_engineering": 0, "night_time": 0, "weekend": 0, "urgency_score": 0.0,
                "message_entropy": 0.0, "sender_legitimacy": 0.0}
    have = df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})
    return (have.rollup("category").agg(
        F.grouping("category").alias("is_total"),
        F.count(F.lit(1)).alias("total_messages"),
        F.sum("features_extracted").alias("processed_messages"),
        F.count_if(F.col("obfuscation_score") > 0.4).alias("high_obfuscation"),
        F.sum("sender_burst").alias("sender_bursts"),
        F.sum("recipient_burst").alias("recipient_bursts"),
        F.sum("suspicious_url").alias("suspicious_urls"),
        F.sum("social_engineering").alias("social_engineering"),
        F.sum("night_time").alias("night_time_messages"),
        F.sum("weekend").alias("weekend_messages"),
        F.avg("obfuscation_score").alias("avg_obfuscation"),
        F.avg("urgency_score").alias("avg_urgency"),
        F.avg("message_entropy").alias("avg_entropy"),
        F.avg("sender_legitimacy").alias("avg_sender_legitimacy"))
        .withColumn("category", F.when(F.col("is_total") == 1, "(all)").otherwise(
            F.col("category"))))
