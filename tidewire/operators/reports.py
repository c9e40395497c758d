"""Reports and monitoring aggregates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PERIODS = {"1h": "1 hour", "24h": "1 day", "7d": "7 days", "30d": "30 days"}


def obfuscation_bands(df: DataFrame, col: str = "obfuscation_score") -> DataFrame:
    c = F.col(col)
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.avg(c).alias("mean_score"), F.max(c).alias("max_score"),
        F.count_if(c > 0.3).alias("above_03"), F.count_if(c > 0.5).alias("above_05"),
        F.count_if(c > 0.7).alias("above_07"), F.count_if(c > 0.4).alias("high_band"),
        F.count_if((c > 0.2) & (c <= 0.4)).alias("medium_band"),
        F.count_if(c <= 0.2).alias("low_band"))


def top_rows(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The n rows with the largest ``by``; ties are broken by ``tie`` ascending."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(n)


def shares(df: DataFrame, key: str) -> DataFrame:
    """Count and percentage per key value. The result has one row per value."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    whole = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.round(F.col("total") * 100.0 / whole, 1))


def since(df: DataFrame, as_of, period: str, ts="timestamp", default="24h") -> DataFrame:
    """Rows younger than the period before ``as_of``; an unknown period means the default."""
    length = PERIODS.get(period, PERIODS[default])
    start = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {length}")
    return df.where(F.col(ts) > start)


def anomaly_rate(part, whole) -> Column:
    return F.round(F.try_divide(F.col(part) * 100.0, F.col(whole)), 2)


def _flagged() -> Column:
    return F.count_if(F.col("is_anomaly") == 1)


def summary_stats(results: DataFrame, as_of, *periods: str) -> DataFrame:
    """Headline numbers of every period, one row each, from one scan; an unknown period means one day."""
    out = []
    for p in periods or ("24h",):
        start = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {PERIODS.get(p, PERIODS['24h'])}")
        inside = F.col("timestamp") > start
        out.append(F.struct(
            F.lit(p).alias("period"), F.count_if(inside).alias("total_messages"),
            F.count_if(inside & (F.col("is_anomaly") == 1)).alias("total_anomalies"),
            F.count_if(inside & (F.col("risk_level") == "CRITICAL")).alias("critical_alerts"),
            F.avg(F.when(inside, F.col("confidence_level"))).alias("avg_confidence"),
            F.avg(F.when(inside, F.col("processing_time_ms"))).alias("avg_processing_time")))
    rows = results.agg(*[c.alias(f"_{k}") for k, c in enumerate(out)])
    return rows.select(F.explode(F.array(*[f"_{k}" for k in range(len(out))])).alias("s")).select("s.*").withColumn(
        "anomaly_rate", F.round(F.col("total_anomalies") * 100.0 / F.greatest(F.col("total_messages"), F.lit(1)), 2))


def hourly_stats(results: DataFrame, as_of, period: str = "24h") -> DataFrame:
    return _rates(since(results, as_of, period).groupBy(F.hour("timestamp").alias("hour")))


def daily_stats(results: DataFrame, as_of, period: str = "30d") -> DataFrame:
    return _rates(since(results, as_of, period, default="30d").groupBy(
        F.to_date("timestamp").alias("date")))


def _rates(grouped) -> DataFrame:
    out = grouped.agg(F.count(F.lit(1)).alias("total_count"), _flagged().alias("anomaly_count"))
    return out.withColumn("anomaly_rate", anomaly_rate("anomaly_count", "total_count"))


def category_stats(results: DataFrame, messages: DataFrame, as_of, period: str = "24h",
                   n: int = 10) -> DataFrame:
    joined = since(results, as_of, period).join(
        messages.select(F.col("id").alias("message_id"), "category"), "message_id")
    out = joined.groupBy("category").agg(
        F.count(F.lit(1)).alias("total_count"), _flagged().alias("anomaly_count"),
        F.round(F.avg("final_anomaly_score"), 3).alias("avg_score"))
    return top_rows(out.withColumn("anomaly_rate", anomaly_rate("anomaly_count", "total_count")),
                    "anomaly_count", n, tie="category")


def alert_class(risk="risk_level") -> Column:
    r = F.col(risk)
    return F.when(r == "CRITICAL", "alert-critical").when(r == "HIGH", "alert-high").otherwise(
        "alert-normal")


def recent_alerts(results: DataFrame, messages: DataFrame, n: int = 20) -> DataFrame:
    """Newest anomalies with addresses and the head of the text.

    The top n are taken before the join, so only n rows look up their message.
    """
    newest = top_rows(results.where("is_anomaly = 1").select(
        "message_id", "timestamp", "risk_level", "final_anomaly_score", "is_anomaly"),
        "timestamp", n, tie="message_id")
    found = messages.select(F.col("id").alias("message_id"), "source_addr", "dest_addr",
                            F.substring("message_text", 1, 50).alias("message"))
    return newest.join(found, "message_id").withColumn("alert_class", alert_class())


def dataset_stats(df: DataFrame) -> DataFrame:
    """Total, by label, by anomaly type (anomalies only), by category and label, time range.

    One scan with grouping sets; the ``part`` column names the table a row belongs to.
    """
    src = df.select("category", F.col("is_anomaly").cast("int").alias("is_anomaly"),
                    F.when(F.col("is_anomaly").cast("int") == 1, F.coalesce(
                        "anomaly_type", F.lit("(none)"))).alias("anomaly_type"), "submit_time")
    sets = [[], ["is_anomaly"], ["anomaly_type"], ["category", "is_anomaly"]]
    g = src.groupingSets([[F.col(c) for c in one] for one in sets], "category", "is_anomaly",
                         "anomaly_type").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("count"),
        F.min("submit_time").alias("min_time"), F.max("submit_time").alias("max_time"))
    part = (F.when(F.col("gid") == 7, "total").when(F.col("gid") == 5, "label")
            .when(F.col("gid") == 6, "type").otherwise("category"))
    out = g.withColumn("part", part).where(
        (F.col("part") != "type") | F.col("anomaly_type").isNotNull())
    in_total = F.col("part") == "total"
    return out.select("part", "category", "is_anomaly", "anomaly_type", "count",
                      F.when(in_total, F.col("min_time")).alias("min_time"),
                      F.when(in_total, F.col("max_time")).alias("max_time"))


def category_label_table(df: DataFrame) -> DataFrame:
    """Category by label counts; the label has two values, so both columns are conditional counts."""
    flag = F.col("is_anomaly").cast("int")
    return df.groupBy("category").agg(F.count_if(flag == 0).alias("normal"),
                                      F.count_if(flag == 1).alias("anomaly"))


def type_shares(df: DataFrame) -> DataFrame:
    return shares(df.where("is_anomaly = 1"), "anomaly_type")


def weekday_counts(df: DataFrame, ts="submit_time") -> DataFrame:
    return df.groupBy(F.date_format(ts, "EEEE").alias("weekday")).agg(
        F.count(F.lit(1)).alias("total"))


def top_values(df: DataFrame, col: str, n: int) -> DataFrame:
    return top_rows(df.groupBy(col).agg(F.count(F.lit(1)).alias("total")), "total", n, tie=col)


def run_stats(df: DataFrame, notes: str = "") -> DataFrame:
    """One bookkeeping row: totals, rate and the breakdown by type as JSON.

    The breakdown is a map with one entry per anomaly type.
    """
    flag = F.col("is_anomaly").cast("int")
    by_type = df.groupBy(F.when(flag == 1, F.col("anomaly_type")).alias("kind"),
                         flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.filter(F.collect_list(F.struct("kind", "n", "flag")),
                     lambda e: (e["flag"] == 1) & e["kind"].isNotNull())
    ordered = F.array_sort(pairs, lambda a, b: F.when(a["n"] != b["n"], F.when(
        a["n"] > b["n"], -1).otherwise(1)).when(a["kind"] < b["kind"], -1).when(
        a["kind"] > b["kind"], 1).otherwise(0))
    stats = by_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_messages"),
        F.coalesce(F.sum(F.when(F.col("flag") == 0, F.col("n"))), F.lit(0)).alias("normal_messages"),
        F.coalesce(F.sum(F.when(F.col("flag") == 1, F.col("n"))), F.lit(0)).alias("anomaly_messages"),
        F.to_json(F.map_from_entries(F.transform(
            ordered, lambda e: F.struct(e["kind"], e["n"])))).alias("anomaly_breakdown"))
    return stats.withColumn("anomaly_rate", F.when(F.col("total_messages") > 0, F.col(
        "anomaly_messages") / F.col("total_messages")).otherwise(0.0)).withColumn(
        "notes", F.lit(notes))


def hour_category_table(df: DataFrame, n: int = 5, ts="submit_time") -> DataFrame:
    """Hour by category counts of normal rows, for the n most frequent categories.

    The n names (a handful) become the columns.
    """
    normal = df.where("is_anomaly = 0")
    names = [r[0] for r in top_values(normal, "category", n).select("category").collect()]
    hour = F.hour(ts).alias("hour")
    return normal.groupBy(hour).pivot("category", names).count().fillna(0)


def histogram(df: DataFrame, col: str, bins: int = 50, by: list[str] | None = None) -> DataFrame:
    """Counts in equal-width bins between the minimum and maximum of each ``by`` group.

    The range of each group is joined back on its key, so ``by`` should be a label with few values.
    """
    by = by or []
    keyed = df.where(F.col(col).isNotNull())
    rng = keyed.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    if by:
        on = keyed.join(rng, by)
    else:
        on = keyed.withColumns({"_lo": keyed.agg(F.min(col)).scalar(),
                                "_hi": keyed.agg(F.max(col)).scalar()})
    span = F.col("_hi") - F.col("_lo")
    pos = F.when(span == 0, F.lit(bins // 2)).otherwise(F.least(
        F.floor((F.col(col) - F.col("_lo")) * bins / F.when(span != 0, span)), F.lit(bins - 1)))
    return (on.groupBy(*by, pos.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("total"), F.first("_lo").alias("_a"),
                 F.first("_hi").alias("_b"))
            .withColumn("bin_start", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("bin") / bins)
            .drop("_a", "_b"))
