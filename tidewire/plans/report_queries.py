"""Reports, monitoring aggregates, ensemble results and table operations."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config
from ..operators import ensemble as en, reports as rp
from . import sql_text as s
from .catalog import query
from .driver_tables import document_texts, message_rows, messages, with_label
from .message_queries import feature_table
from .sql_text import LABELLED, MSG, TEXTS, sql

AS_OF = "2024-01-30 12:00:00"


def R(expr: str) -> str:
    return f"round({expr} + 1e-9, 6)"


# ---- ensemble results -------------------------------------------------------------------------

MEMBERS_SQL = """det AS (SELECT *, value AS reconstruction_error,
  [(id * 7919 % 1000) / 1000.0, (id * 104729 % 1000) / 1000.0 - 0.5, value / 200.0] AS member_scores FROM msg)"""
COMBINED_SQL = MEMBERS_SQL + """,
sc AS (SELECT *, 1 / (1 + exp(-0.1 * (reconstruction_error - 20.0))) AS ae, list_max(member_scores)::DOUBLE AS fo,
  list_avg(member_scores)::DOUBLE AS fo_mean FROM det),
fin AS (SELECT *, 0.5 * ae + 0.5 * fo AS score FROM sc),
res AS (SELECT id AS message_id, "timestamp", score AS final_anomaly_score,
  CAST((ae > 0.92 OR fo > 0.1) AND score >= 0.5 AS INTEGER) AS is_anomaly,
  CASE WHEN score > 0.8 THEN 'CRITICAL' WHEN score > 0.6 THEN 'HIGH' WHEN score > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN ae * fo > 0 THEN 2.0 ELSE 0.0 END AS confidence_level, CASE WHEN ae * fo > 0 THEN 2 * ae * fo / (ae + fo) ELSE 0.0 END AS harmonic,
  fo AS isolation_forest_score, fo_mean AS isolation_forest_mean, CAST(fo > 0.1 AS INTEGER) AS isolation_forest_anomaly,
  ae AS autoencoder_score, CAST(ae > 0.92 AS INTEGER) AS autoencoder_anomaly,
  reconstruction_error AS autoencoder_reconstruction_error, CAST(id % 50 AS INTEGER) AS processing_time_ms FROM fin)"""


def detector_rows(spark, sf) -> DataFrame:
    """Messages with a reconstruction error and three member scores derived from the events."""
    return message_rows(spark, sf).withColumns({
        "reconstruction_error": F.col("value"),
        "member_scores": F.array(F.pmod(F.col("id") * 7919, F.lit(1000)) / 1000.0,
                                 F.pmod(F.col("id") * 104729, F.lit(1000)) / 1000.0 - 0.5,
                                 F.col("value") / 200.0)})


def result_rows(spark, sf) -> DataFrame:
    return en.score_messages(detector_rows(spark, sf), threshold=20.0,
                             elapsed=F.pmod(F.col("id"), F.lit(50)))


@query("ensemble_scores", sql(MSG, COMBINED_SQL, body=f"""
SELECT message_id, {R('final_anomaly_score')} AS final_anomaly_score, is_anomaly, risk_level, confidence_level,
  {R('harmonic')} AS harmonic_confidence, {R('isolation_forest_score')} AS isolation_forest_score,
  {R('isolation_forest_mean')} AS isolation_forest_mean, isolation_forest_anomaly, {R('autoencoder_score')} AS autoencoder_score,
  autoencoder_anomaly FROM res"""))
def ensemble_scores(spark, sf):
    """Detector scores, flags, final score, risk level and both confidence forms."""
    c = en.combine_scores(detector_rows(spark, sf), threshold=20.0)
    return c.select(F.col("id").alias("message_id"), "final_anomaly_score", "is_anomaly",
                    "risk_level", "confidence_level", en.confidence(
                        F.col("autoencoder_score"), F.col("isolation_forest_score"),
                        "harmonic").alias("harmonic_confidence"), "isolation_forest_score",
                    "isolation_forest_mean", "isolation_forest_anomaly", "autoencoder_score",
                    "autoencoder_anomaly")


_VEC = " + ".join(f"coalesce({c}, 0)" for c in config.SCORING_COLUMNS)


@query("scored_messages", sql(TEXTS, MSG, s.FEATURES, COMBINED_SQL, body=f"""
SELECT message_id, r."timestamp", {R('final_anomaly_score')} AS final_anomaly_score, is_anomaly, risk_level, confidence_level,
  {R('isolation_forest_score')} AS isolation_forest_score, isolation_forest_anomaly, '1.0' AS isolation_forest_version,
  {R('autoencoder_score')} AS autoencoder_score, autoencoder_anomaly, autoencoder_reconstruction_error, '2.0' AS autoencoder_version,
  'weighted_average' AS ensemble_method, 'AE:0.5,IF:0.5' AS ensemble_weights, 'AE:2.0,IF:1.0' AS model_version, processing_time_ms,
  CAST(43 AS INTEGER) AS vector_size, round(({_VEC}) + 1e-9, 2) AS vector_sum FROM res r JOIN feat f ON f.id = r.message_id"""))
def scored_messages(spark, sf):
    """The full result row; the stored feature vector is checked by its length and sum."""
    rows = feature_table(spark, sf).withColumns({
        "reconstruction_error": F.col("value"),
        "member_scores": F.array(F.pmod(F.col("id") * 7919, F.lit(1000)) / 1000.0,
                                 F.pmod(F.col("id") * 104729, F.lit(1000)) / 1000.0 - 0.5,
                                 F.col("value") / 200.0)})
    out = en.score_messages(rows, threshold=20.0, width=43,
                            elapsed=F.pmod(F.col("id"), F.lit(50)))
    vec = F.from_json("feature_vector_used", "array<double>")
    return out.withColumns({"vector_size": F.size(vec), "vector_sum": F.round(F.aggregate(
        vec, F.lit(0.0), lambda a, x: a + x) + 1e-9, 2)}).drop("feature_vector_used")


@query("pending_batch", sql(MSG, COMBINED_SQL, body="""
SELECT id FROM msg WHERE id NOT IN (SELECT message_id FROM res WHERE message_id % 3 <> 0) ORDER BY id LIMIT 1000"""))
def pending_batch(spark, sf):
    """The next batch: messages that have no result yet."""
    done = result_rows(spark, sf).where("message_id % 3 != 0")
    return en.pending_messages(message_rows(spark, sf), done, 1000).select("id")


@query("batch_counts", sql(MSG, COMBINED_SQL, body="""
SELECT count(*) AS total, count(*) AS processed, count(*) FILTER (is_anomaly = 1) AS anomalies FROM res WHERE message_id % 3 = 0"""))
def batch_counts(spark, sf):
    """Counts of one scoring run over everything that is pending."""
    done = result_rows(spark, sf).where("message_id % 3 != 0")
    todo = en.pending_messages(detector_rows(spark, sf), done)
    return en.batch_counts(todo, en.score_messages(todo, threshold=20.0))


# ---- monitoring -------------------------------------------------------------------------------

def _since(days: str) -> str:
    return f"\"timestamp\" > TIMESTAMP '{AS_OF}' - INTERVAL {days}"


@query("summary_stats", sql(MSG, COMBINED_SQL, body=" UNION ALL ".join(f"""
SELECT '{p}' AS period, count(*) AS total_messages, count(*) FILTER (is_anomaly = 1) AS total_anomalies,
  count(*) FILTER (risk_level = 'CRITICAL') AS critical_alerts, {R('avg(confidence_level)')} AS avg_confidence,
  {R('avg(processing_time_ms)')} AS avg_processing_time,
  {R('round(count(*) FILTER (is_anomaly = 1) * 100.0 / greatest(count(*), 1), 2)')} AS anomaly_rate
FROM res WHERE {_since(d)}""" for p, d in [("1h", "1 hour"), ("24h", "1 day"), ("7d", "7 days"), ("30d", "30 days"), ("x", "1 day")])))
def summary_stats(spark, sf):
    """Headline numbers for each period; an unknown period means one day."""
    return rp.summary_stats(result_rows(spark, sf), AS_OF, "1h", "24h", "7d", "30d", "x")


_RATE = "round(count(*) FILTER (is_anomaly = 1) * 100.0 / count(*), 2)"


@query("hourly_stats", sql(MSG, COMBINED_SQL, body=f"""
SELECT CAST(hour("timestamp") AS INTEGER) AS hour, count(*) AS total_count, count(*) FILTER (is_anomaly = 1) AS anomaly_count,
  {_RATE} AS anomaly_rate FROM res WHERE {_since('7 days')} GROUP BY 1"""))
def hourly_stats(spark, sf):
    """Totals and anomaly rate by hour of day."""
    return rp.hourly_stats(result_rows(spark, sf), AS_OF, "7d")


@query("daily_stats", sql(MSG, COMBINED_SQL, body=f"""
SELECT strftime("timestamp", '%Y-%m-%d') AS date, count(*) AS total_count, count(*) FILTER (is_anomaly = 1) AS anomaly_count,
  {_RATE} AS anomaly_rate FROM res WHERE {_since('30 days')} GROUP BY 1"""))
def daily_stats(spark, sf):
    """Totals and anomaly rate by day."""
    return rp.daily_stats(result_rows(spark, sf), AS_OF, "30d").withColumn(
        "date", F.date_format("date", "yyyy-MM-dd"))


@query("category_stats", sql(MSG, COMBINED_SQL, body=f"""
SELECT category, count(*) AS total_count, count(*) FILTER (is_anomaly = 1) AS anomaly_count,
  round(avg(final_anomaly_score), 3) AS avg_score, {_RATE} AS anomaly_rate
FROM res r JOIN msg m ON m.id = r.message_id WHERE r.{_since('30 days')} GROUP BY category
ORDER BY anomaly_count DESC, category LIMIT 10"""))
def category_stats(spark, sf):
    """Totals, anomalies and mean score by category."""
    return rp.category_stats(result_rows(spark, sf), message_rows(spark, sf), AS_OF, "30d")


@query("recent_alerts", sql(TEXTS, MSG, COMBINED_SQL, body=f"""
SELECT message_id, r."timestamp", risk_level, {R('final_anomaly_score')} AS final_anomaly_score, is_anomaly, source_addr, dest_addr,
  substr(message_text, 1, 50) AS message, CASE risk_level WHEN 'CRITICAL' THEN 'alert-critical' WHEN 'HIGH' THEN 'alert-high'
  ELSE 'alert-normal' END AS alert_class
FROM res r JOIN msg m ON m.id = r.message_id JOIN texts USING (doc_id) WHERE is_anomaly = 1
ORDER BY r."timestamp" DESC, message_id LIMIT 20"""))
def recent_alerts(spark, sf):
    """The newest anomalies with addresses and the head of the text."""
    return rp.recent_alerts(result_rows(spark, sf), messages(spark, sf), 20)


# ---- data set reports -------------------------------------------------------------------------

TYPES = ["structural", "frequency", "semantic", "behavioral", "obfuscation", "sender_mismatch"]
DATASET_SQL = LABELLED + """,
ds AS (SELECT id, source_addr, dest_addr, "timestamp" AS submit_time, category, is_anomaly, doc_id,
  CASE WHEN is_anomaly = 1 THEN [""" + ", ".join(f"'{t}'" for t in TYPES) + """][id % 6 + 1] END AS anomaly_type FROM lab)"""


def dataset(spark, sf) -> DataFrame:
    rows = with_label(message_rows(spark, sf), spark, sf)
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]),
                        (F.pmod(F.col("id"), F.lit(6)) + 1).cast("int"))
    return rows.select("id", "source_addr", "dest_addr", F.col("timestamp").alias("submit_time"),
                       "category", "is_anomaly", "doc_id",
                       F.when(F.col("is_anomaly") == 1, kind).alias("anomaly_type"))


@query("dataset_stats", sql(MSG, DATASET_SQL, body="""
SELECT 'total' AS part, NULL AS category, -1 AS is_anomaly, NULL AS anomaly_type, count(*) AS count, min(submit_time) AS min_time,
  max(submit_time) AS max_time FROM ds
UNION ALL SELECT 'label', NULL, is_anomaly, NULL, count(*), NULL, NULL FROM ds GROUP BY is_anomaly
UNION ALL SELECT 'type', NULL, -1, anomaly_type, count(*), NULL, NULL FROM ds WHERE is_anomaly = 1 GROUP BY anomaly_type
UNION ALL SELECT 'category', category, is_anomaly, NULL, count(*), NULL, NULL FROM ds GROUP BY category, is_anomaly"""))
def dataset_stats(spark, sf):
    """Totals by label, type, category and label, and the time range, in one scan."""
    return rp.dataset_stats(dataset(spark, sf)).withColumn(
        "is_anomaly", F.coalesce("is_anomaly", F.lit(-1)))


@query("category_by_label", sql(MSG, DATASET_SQL, body="""
SELECT category, count(*) FILTER (is_anomaly = 0) AS normal, count(*) FILTER (is_anomaly = 1) AS anomaly FROM ds GROUP BY category"""))
def category_by_label(spark, sf):
    """Category by label counts."""
    return rp.category_label_table(dataset(spark, sf))


@query("anomaly_type_shares", sql(MSG, DATASET_SQL, body=f"""
SELECT anomaly_type, count(*) AS total, {R('round(count(*) * 100.0 / sum(count(*)) OVER (), 1)')} AS share
FROM ds WHERE is_anomaly = 1 GROUP BY anomaly_type"""))
def anomaly_type_shares(spark, sf):
    """Anomaly types with their percentage."""
    return rp.type_shares(dataset(spark, sf))


@query("category_shares", sql(MSG, body=f"""
SELECT category, count(*) AS total, {R('round(count(*) * 100.0 / sum(count(*)) OVER (), 1)')} AS share FROM msg GROUP BY category"""))
def category_shares(spark, sf):
    """Categories with their percentage."""
    return rp.shares(message_rows(spark, sf), "category")


@query("weekday_counts", sql(MSG, DATASET_SQL, body="SELECT dayname(submit_time) AS weekday, count(*) AS total FROM ds GROUP BY 1"))
def weekday_counts(spark, sf):
    """Messages by day name."""
    return rp.weekday_counts(dataset(spark, sf))


@query("top_senders", sql(MSG, body="""
SELECT source_addr, count(*) AS total FROM msg GROUP BY source_addr ORDER BY total DESC, source_addr LIMIT 10"""))
def top_senders(spark, sf):
    """The ten busiest senders."""
    return rp.top_values(message_rows(spark, sf), "source_addr", 10)


@query("run_stats", sql(MSG, DATASET_SQL, body=f"""
SELECT count(*) AS total_messages, count(*) FILTER (is_anomaly = 0) AS normal_messages, count(*) FILTER (is_anomaly = 1) AS anomaly_messages,
  {R('count(*) FILTER (is_anomaly = 1) / count(*)')} AS anomaly_rate,
  (SELECT '{{' || string_agg('"' || anomaly_type || '":' || n, ',' ORDER BY n DESC, anomaly_type) || '}}'
   FROM (SELECT anomaly_type, count(*) AS n FROM ds WHERE is_anomaly = 1 GROUP BY 1)) AS anomaly_breakdown, 'run' AS notes FROM ds"""))
def run_stats(spark, sf):
    """One bookkeeping row with the breakdown as JSON."""
    return rp.run_stats(dataset(spark, sf), "run")


@query("hour_by_category", sql(MSG, DATASET_SQL, body="""
SELECT CAST(hour(submit_time) AS INTEGER) AS hour, """ + ", ".join(
    f"count(*) FILTER (category = '{c}') AS {c}" for c in
    ["banking", "government", "delivery", "medical", "other"]) + """
FROM ds WHERE is_anomaly = 0 GROUP BY 1"""))
def hour_by_category(spark, sf):
    """Hour by category counts of normal rows for the five most frequent categories."""
    return rp.hour_category_table(dataset(spark, sf), 5)


@query("score_histogram", sql(MSG, LABELLED, body=f"""
SELECT is_anomaly, CAST(least(floor((value - lo) * 50 / (hi - lo)), 49) AS INTEGER) AS bin, count(*) AS total,
  {R('any_value(lo + (hi - lo) * least(floor((value - lo) * 50 / (hi - lo)), 49) / 50)')} AS bin_start
FROM lab JOIN (SELECT is_anomaly, min(value) AS lo, max(value) AS hi FROM lab GROUP BY 1) USING (is_anomaly) GROUP BY 1, 2"""))
def score_histogram(spark, sf):
    """Fifty-bin histogram of the score for each label."""
    rows = with_label(message_rows(spark, sf), spark, sf)
    return rp.histogram(rows, "value", 50, ["is_anomaly"])
