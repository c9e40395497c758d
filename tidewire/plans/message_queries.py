"""Text, obfuscation, sender, activity and feature-job queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config
from ..functions import obfuscation as ob, sender as sn, text as tx
from ..functions.chars import NONSPACE, SPACE
from ..operators.activity import address_activity
from . import features as ft, sql_text as s
from .catalog import query, stable
from .driver_tables import (BURST, document_features, document_texts, message_rows, messages, table,
                            with_label)
from .sql_text import LABELLED, MSG, TEXTS, q, r6, sql

RATE_COLUMNS = ["urgency_score", "message_entropy"]
TEXT_COLS = tx.TEXT_FEATURES


@query("text_features", sql(TEXTS, s.TEXTFEAT, body=(
    f"SELECT * EXCLUDE (urgency_score, message_entropy), {r6(*RATE_COLUMNS)} FROM textfeat")))
def text_features(spark, sf):
    """Scalar text features of every document text."""
    return tx.add_text_features(document_texts(spark, sf)).select("doc_id", *TEXT_COLS)


def _marker_sql(extended: bool) -> str:
    t = (f"regexp_replace(regexp_replace(lower(message_text), {q(SPACE + '+')}, ' ', 'g'), "
         f"{q(f'^{SPACE}+|{SPACE}+$')}, '', 'g')")
    mark = lambda x: f"regexp_replace({x}, {q('(' + s.W + '+)')}, chr(1) || '\\1' || chr(2), 'g')"
    drop = lambda x: f"replace(replace({x}, chr(1), ''), chr(2), '')"
    t = drop(f"regexp_replace({mark(t)}, chr(1) || '\\p{{Nd}}{{4,}}' || chr(2), 'LONGNUM', 'g')")
    for pat, m in [(rf"\p{{Nd}}+{SPACE}*(?:грн|₴|uah)", "MONEY"),
                   (r"[+]?3?8?0?\p{Nd}{9,}", "PHONE"), (rf"https?://{NONSPACE}+", "URL")]:
        t = f"regexp_replace({t}, {q(pat)}, '{m}', 'g')"
    if extended:
        t = f"regexp_replace({t}, {q(f'www[.]{NONSPACE}+')}, 'URL', 'g')"
        t = drop(f"regexp_replace({mark(t)}, chr(1) || '\\p{{Nd}}{{4,6}}' || chr(2), 'CODE', 'g')")
    return t


@query("normalized_text", sql(TEXTS, body=(
    f"SELECT doc_id, {_marker_sql(False)} AS short_form, {_marker_sql(True)} AS long_form FROM texts")))
def normalized_text(spark, sf):
    """Both normal forms of every text."""
    return document_texts(spark, sf).select(
        "doc_id", tx.normalize_text("message_text").alias("short_form"),
        tx.normalize_text("message_text", extended=True).alias("long_form"))


def _rule_sql() -> str:
    up, low = "upper(source_addr)", "lower(message_text)"
    arms = [f"WHEN {s.any_of(up, [n.upper() for n in names])} THEN {q(cat)}"
            for cat, names in config.CATEGORY_SENDERS.items()]
    arms += [f"WHEN {s.any_of(low, words)} THEN {q(cat)}" for cat, words in config.FEATURE_KEYWORDS]
    return "CASE " + " ".join(arms) + " ELSE 'other' END"


def _capture_sql() -> str:
    sides = {"text": "lower(message_text)", "source": "upper(source_addr)"}
    return "CASE " + " ".join(f"WHEN {s.any_of(sides[a], ws)} THEN {q(c)}"
                              for a, c, ws in config.CAPTURE_RULES) + " ELSE 'other' END"


@query("rule_categories", sql(TEXTS, MSG, body=(
    f"SELECT id, {_rule_sql()} AS rule_category, {_capture_sql()} AS capture_category "
    "FROM msg JOIN texts USING (doc_id)")))
def rule_categories(spark, sf):
    """Both rule classifiers on every message."""
    return messages(spark, sf).select(
        "id", tx.rule_category("message_text", "source_addr").alias("rule_category"),
        tx.rule_category_capture("message_text", "source_addr").alias("capture_category"))


@query("cleaned_messages", sql(MSG, body="""
SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE source_addr END AS source_addr,
  CASE WHEN id % 5 = 0 THEN '' ELSE dest_addr END AS dest_addr,
  CASE WHEN category = 'other' THEN 'unknown' ELSE category END AS category, hour, day_of_week FROM msg"""))
def cleaned_messages(spark, sf):
    """Null filling on messages with gaps, clock columns derived."""
    rows = message_rows(spark, sf).select(
        "id", "timestamp", F.when(F.col("id") % 3 != 0, F.col("source_addr")).alias("source_addr"),
        F.when(F.col("id") % 5 != 0, F.col("dest_addr")).alias("dest_addr"),
        F.when(F.col("category") != "other", F.col("category")).alias("category"))
    return ft.clean_messages(rows).drop("timestamp")


@query("classified_messages", sql(TEXTS, MSG, body=(
    f"SELECT id, CASE WHEN category = 'other' THEN {_rule_sql()} ELSE category END AS category "
    "FROM msg JOIN texts USING (doc_id)")))
def classified_messages(spark, sf):
    """Rows without a category get one from the rules."""
    rows = messages(spark, sf).withColumn(
        "category", F.when(F.col("category") != "other", F.col("category")))
    return ft.classify_unknown(ft.clean_messages(rows)).select("id", "category")


# ---- obfuscation ------------------------------------------------------------------------------

@query("word_obfuscation", sql(TEXTS, MSG, s.OBFUSCATION, body=(
    "SELECT w AS word, CAST(sum(n) AS BIGINT) AS uses, round(any_value(dig) + 1e-9, 6) AS digit_score, "
    "round(any_value(score) + 1e-9, 6) AS word_score FROM toks JOIN wdig USING (w) "
    "JOIN wscore USING (w) WHERE kind = 'd' AND NOT wscore.known AND score > 0 GROUP BY w")))
def word_obfuscation(spark, sf):
    """Every scored word of all texts with its digit and substitution scores."""
    words = document_texts(spark, sf).where(F.length(tx.strip("message_text")) >= 2).select(
        F.explode(ob.candidate_words(ob.clean_for_scoring("message_text"))).alias("word"))
    return (words.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
            .withColumn("digit_score", ob.digit_score("word"))
            .withColumn("word_score", ob.word_score("word")).where("word_score > 0"))


_OBF_BODY = f"""SELECT m.id, round(od.score + 1e-9, 6) AS message_obfuscation, round(os.score + 1e-9, 6) AS sender_obfuscation,
  round({s.combine('od.score', 'os.score')} + 1e-9, 6) AS obfuscation_score
FROM msg m JOIN obf od ON od.kind = 'd' AND od.key = CAST(m.doc_id AS VARCHAR)
JOIN obf os ON os.kind = 's' AND os.key = m.source_addr"""


def scored_messages(spark, sf) -> DataFrame:
    docs = document_texts(spark, sf).select(
        "doc_id", ob.obfuscation_score("message_text").alias("message_obfuscation"))
    return (message_rows(spark, sf).join(docs, "doc_id")
            .withColumn("sender_obfuscation", ob.obfuscation_score("source_addr"))
            .withColumn("obfuscation_score",
                        ob.combined_obfuscation("message_obfuscation", "sender_obfuscation")))


@query("message_obfuscation", sql(TEXTS, MSG, s.OBFUSCATION, body=_OBF_BODY))
def message_obfuscation(spark, sf):
    """Message, sender and combined obfuscation score of every message."""
    return scored_messages(spark, sf).select("id", "message_obfuscation", "sender_obfuscation",
                                             "obfuscation_score")


@query("obfuscation_report", sql(TEXTS, MSG, s.OBFUSCATION, f"o AS ({_OBF_BODY})", body="""
SELECT count(*) AS total, round(avg(obfuscation_score) + 1e-9, 6) AS mean_score, max(obfuscation_score) AS max_score,
  count(*) FILTER (obfuscation_score > 0.3) AS above_03, count(*) FILTER (obfuscation_score > 0.5) AS above_05,
  count(*) FILTER (obfuscation_score > 0.7) AS above_07,
  count(*) FILTER (obfuscation_score > 0.4) AS high_band,
  count(*) FILTER (obfuscation_score > 0.2 AND obfuscation_score <= 0.4) AS medium_band,
  count(*) FILTER (obfuscation_score <= 0.2) AS low_band FROM o"""))
def obfuscation_report(spark, sf):
    """Mean, maximum, counts above the marks and the three bands."""
    from ..operators.reports import obfuscation_bands
    return obfuscation_bands(scored_messages(spark, sf).withColumn(
        "obfuscation_score", stable("obfuscation_score")))


@query("most_obfuscated", sql(TEXTS, MSG, s.OBFUSCATION, f"o AS ({_OBF_BODY})", body=(
    "SELECT id, obfuscation_score FROM o ORDER BY obfuscation_score DESC, id LIMIT 10")))
def most_obfuscated(spark, sf):
    """The ten most obfuscated messages."""
    from ..operators.reports import top_rows
    return top_rows(scored_messages(spark, sf).withColumn(
        "obfuscation_score", stable("obfuscation_score")).select("id", "obfuscation_score"),
        "obfuscation_score", 10, tie="id")


# ---- sender, clock, activity ------------------------------------------------------------------

ROW_COLS = ["source_addr_length", "source_is_numeric", "dest_is_valid", "typosquatting",
            "night_time", "weekend", "business_hours", "source_category_mismatch",
            "time_category_anomaly", "unusual_sender_pattern", "category_time_mismatch",
            "sender_legitimacy"]


@query("sender_features", sql(MSG, s.ROWFEAT, body=f"SELECT id, {', '.join(ROW_COLS)} FROM rowfeat"))
def sender_features(spark, sf):
    """Address, category and clock features of every message."""
    return ft.sender_features(message_rows(spark, sf)).select("id", *ROW_COLS)


@query("ingest_flags", sql(TEXTS, MSG, body="""
SELECT id, CAST(regexp_full_match(replace(source_addr, '+', ''), '\\p{Nd}+') AS INTEGER) AS source_is_numeric,
  CAST(length(source_addr) AS INTEGER) AS source_addr_length,
  CAST(length(trim(message_text)) = 0 AS INTEGER) AS empty_message,
  CAST(contains(message_text, '�') AS INTEGER) AS encoding_issues,
  CAST(length(message_text) > 160 AS INTEGER) AS excessive_length,
  CAST(regexp_full_match(dest_addr, '\\p{Nd}+') AS INTEGER) AS dest_is_valid,
  CAST(hour >= 22 OR hour < 6 AS INTEGER) AS night_time, CAST(day_of_week >= 5 AS INTEGER) AS weekend,
  CAST(hour BETWEEN 9 AND 18 AND day_of_week < 5 AS INTEGER) AS business_hours
FROM msg JOIN texts USING (doc_id)""".replace("\\uFFFD", "�")))
def ingest_flags(spark, sf):
    """The flags set when a message is first stored."""
    return messages(spark, sf).select(
        "id", *[c.alias(n) for n, c in {**tx.basic_flags(),
                                        **sn.time_flags("hour", "day_of_week", "ingest")}.items()])


ACT_COLS = ["sender_frequency", "recipient_frequency", "sender_burst", "recipient_burst",
            "high_sender_frequency", "high_recipient_frequency"]


@query("address_activity", sql(MSG, s.ACTIVITY, body=f"SELECT id, {', '.join(ACT_COLS)} FROM act"))
def activity(spark, sf):
    """Frequencies and bursts of both addresses, six-hour window."""
    return address_activity(message_rows(spark, sf), **BURST)


@query("address_activity_default", sql(MSG, s.activity_sql("interval 3 minutes", 30, 15), body=(
    f"SELECT id, {', '.join(ACT_COLS)} FROM act")))
def activity_default(spark, sf):
    """The same with the default three-minute window and limits."""
    return address_activity(message_rows(spark, sf))


# ---- feature job ------------------------------------------------------------------------------

FEATURE_COLS = (["category", "hour", "day_of_week"] + ROW_COLS + TEXT_COLS + ACT_COLS
                + ["obfuscation_score", "protocol_anomaly_score", "features_extracted",
                   "feature_extraction_version"])
_ROUND = {"message_entropy", "urgency_score", "obfuscation_score", "protocol_anomaly_score"}
FEATURE_SELECT = ", ".join(f"round({c} + 1e-9, 6) AS {c}" if c in _ROUND else c for c in FEATURE_COLS)


def feature_table(spark, sf) -> DataFrame:
    """All features of every message; text features are computed once per distinct document."""
    rows = message_rows(spark, sf)
    wide = ft.derived_scores(ft.sender_features(rows).join(document_features(spark, sf), "doc_id"))
    return wide.join(address_activity(rows, **BURST), "id")


def labelled_features(spark, sf) -> DataFrame:
    return with_label(feature_table(spark, sf), spark, sf)


@query("feature_job", sql(TEXTS, MSG, s.FEATURES, body=f"SELECT id, {FEATURE_SELECT} FROM feat"))
def feature_job(spark, sf):
    """The complete feature row of every message."""
    return feature_table(spark, sf).select("id", *FEATURE_COLS)


@query("feature_job_inline", sql(TEXTS, MSG, s.FEATURES, body=(
    f"SELECT id, {FEATURE_SELECT} FROM feat")))
def feature_job_inline(spark, sf):
    """The same rows from the general job, which scores the text of every message row."""
    return ft.extract_features(messages(spark, sf), keep_text=False, **BURST).select(
        "id", *FEATURE_COLS)


@query("feature_report", sql(TEXTS, MSG, s.FEATURES, body="""
SELECT coalesce(category, '(all)') AS category, CAST(grouping(category) AS INTEGER) AS is_total, count(*) AS total_messages,
  CAST(sum(features_extracted) AS BIGINT) AS processed_messages,
  count(*) FILTER (obfuscation_score > 0.4) AS high_obfuscation,
  CAST(sum(sender_burst) AS BIGINT) AS sender_bursts, CAST(sum(recipient_burst) AS BIGINT) AS recipient_bursts,
  CAST(sum(suspicious_url) AS BIGINT) AS suspicious_urls, CAST(sum(social_engineering) AS BIGINT) AS social_engineering,
  CAST(sum(night_time) AS BIGINT) AS night_time_messages, CAST(sum(weekend) AS BIGINT) AS weekend_messages,
  round(avg(obfuscation_score) + 1e-9, 6) AS avg_obfuscation, round(avg(urgency_score) + 1e-9, 6) AS avg_urgency,
  round(avg(message_entropy) + 1e-9, 6) AS avg_entropy, round(avg(sender_legitimacy) + 1e-9, 6) AS avg_sender_legitimacy
FROM feat GROUP BY ROLLUP (category)"""))
def feature_report(spark, sf):
    """Counts, counters and means by category and in total."""
    return ft.feature_report(feature_table(spark, sf)).withColumn(
        "is_total", F.col("is_total").cast("int"))
