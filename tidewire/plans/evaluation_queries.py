"""Thresholds, curves, evaluation and feature preparation queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import config
from ..functions import sender as sn, text as tx
from ..functions.chars import SPACE
from ..operators import evaluation as ev, prepare as pr, thresholds as th
from ..session import cut_lineage
from . import sql_text as s
from .catalog import query
from .driver_tables import document_texts, message_rows, with_label
from .message_queries import FEATURE_COLS, labelled_features
from .report_queries import R
from .sql_text import LABELLED, MSG, TEXTS, q, sql

LAB = (MSG, LABELLED)
CURVE_SQL = """pts AS (SELECT value AS threshold, count(*) FILTER (is_anomaly = 1) AS pos, count(*) FILTER (is_anomaly = 0) AS neg FROM lab GROUP BY 1),
curve AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, CAST(sum(pos) OVER () AS BIGINT) AS positives,
  CAST(sum(neg) OVER () AS BIGINT) AS negatives FROM pts WINDOW w AS (ORDER BY threshold DESC)),
pr AS (SELECT *, tp * 1.0::DOUBLE / (tp + fp) AS precision, tp * 1.0::DOUBLE / positives AS recall, fp * 1.0::DOUBLE / negatives AS false_positive_rate FROM curve)"""


def labelled(spark, sf) -> DataFrame:
    return with_label(message_rows(spark, sf), spark, sf).select("id", "timestamp", "category",
                                                                 "value", "is_anomaly")


@query("binary_metrics", sql(*LAB, body=f"""
SELECT tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives, {R('(tp + tn) / n')} AS accuracy,
  {R('tp / (tp + fp)')} AS precision, {R('tp / (tp + fn)')} AS recall, {R('2 * tp / (2 * tp + fp + fn)')} AS f1_score
FROM (SELECT count(*) FILTER (is_anomaly = 1 AND value > 20) AS tp, count(*) FILTER (is_anomaly = 0 AND value > 20) AS fp,
  count(*) FILTER (is_anomaly = 0 AND value <= 20) AS tn, count(*) FILTER (is_anomaly = 1 AND value <= 20) AS fn, count(*) AS n FROM lab)"""))
def binary_metrics(spark, sf):
    """Confusion counts and ratios of a thresholded score."""
    return ev.binary_metrics(th.apply_threshold(labelled(spark, sf), "value", 20.0))


@query("threshold_curve", sql(*LAB, CURVE_SQL, body=f"""
SELECT threshold, pos, neg, tp, fp, positives, negatives, {R('precision')} AS precision, {R('recall')} AS recall,
  {R('false_positive_rate')} AS false_positive_rate FROM pr"""))
def threshold_curve(spark, sf):
    """Precision, recall and false-positive rate at every distinct score."""
    return ev.threshold_curve(labelled(spark, sf), "value")


@query("roc_auc", sql(*LAB, CURVE_SQL, body=f"SELECT {R('sum(pos * (negatives - fp + neg / 2.0)) / max(positives * negatives)')} AS roc_auc FROM pr"))
def roc_auc(spark, sf):
    """Area under the ROC curve."""
    return ev.roc_auc(ev.threshold_curve(labelled(spark, sf), "value"))


@query("precision_at_k", sql(*LAB, body=f"""
SELECT {R('avg(is_anomaly)')} AS precision_at_k, count(*) AS k FROM (SELECT is_anomaly FROM lab ORDER BY value DESC, id DESC LIMIT 500)"""))
def precision_at_k(spark, sf):
    """Precision among the 500 highest scores."""
    return ev.precision_at_k(labelled(spark, sf), 500, "value")


PRED_SQL = "pred AS (SELECT category AS y, CASE WHEN id % 5 = 0 THEN 'other' WHEN id % 11 = 0 THEN 'banking' ELSE category END AS p FROM msg)"


def predicted(spark, sf) -> DataFrame:
    return message_rows(spark, sf).select(
        F.col("category").alias("label"), F.when(F.col("id") % 5 == 0, "other").when(
            F.col("id") % 11 == 0, "banking").otherwise(F.col("category")).alias("prediction"))


@query("class_report", sql(MSG, PRED_SQL, body=f"""
, per AS (SELECT c AS class, sum(support)::BIGINT AS support, sum(hit) / sum(chosen) AS precision, sum(hit) / sum(support) AS recall,
  2 * sum(hit) / (sum(support) + sum(chosen)) AS f1_score, sum(hit) AS hit FROM (
  SELECT y AS c, 1 AS support, 0 AS chosen, CAST(y = p AS INTEGER) AS hit FROM pred UNION ALL SELECT p, 0, 1, 0 FROM pred) GROUP BY c)
SELECT class, {R('precision')} AS precision, {R('recall')} AS recall, {R('f1_score')} AS f1_score, support FROM per
UNION ALL SELECT '(weighted)', {R('sum(precision * support) / sum(support)')}, {R('sum(recall * support) / sum(support)')},
  {R('sum(f1_score * support) / sum(support)')}, sum(support)::BIGINT FROM per
UNION ALL SELECT '(accuracy)', {R('sum(hit) / sum(support)')}, {R('sum(hit) / sum(support)')}, {R('sum(hit) / sum(support)')}, sum(support)::BIGINT FROM per"""))
def class_report(spark, sf):
    """Per-class precision, recall, F1 and support with weighted means."""
    return ev.class_report(predicted(spark, sf))


CATEGORIES = ["banking", "delivery", "government", "medical", "other"]


def _score_sql(k: int) -> str:
    return f"((id * {37 + 10 * k} + {k}) % 101 + CASE WHEN category = '{CATEGORIES[k]}' THEN 13 ELSE 0 END)::DOUBLE"


@query("class_auc", sql(MSG, "scored AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS class, category = '{c}' AS hit, {_score_sql(k)} AS score FROM msg" for k, c in enumerate(CATEGORIES))
    + "), ranked AS (SELECT *, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS r FROM scored)",
    f"""per AS (SELECT class, count(*) FILTER (hit) AS positives, count(*) FILTER (NOT hit) AS negatives,
  (sum(r) FILTER (hit) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2.0) / (count(*) FILTER (hit) * count(*) FILTER (NOT hit)) AS auc
  FROM ranked GROUP BY class)""", body=f"""
SELECT class, positives, negatives, {R('auc')} AS roc_auc FROM per
UNION ALL SELECT '(macro)', sum(positives)::BIGINT, sum(negatives)::BIGINT, {R('avg(auc)')} FROM per"""))
def class_auc(spark, sf):
    """One-vs-rest area under the ROC curve of every category, and their mean."""
    rows = message_rows(spark, sf).select("category", F.array(*[F.expr(
        _score_sql(k).replace("::DOUBLE", "")).cast("double") for k in range(len(CATEGORIES))]).alias("scores"))
    return ev.one_vs_rest_auc(rows, "category", "scores", CATEGORIES)


@query("confusion_matrix", sql(MSG, PRED_SQL, body="""
SELECT y AS label, """ + ", ".join(f"count(*) FILTER (p = '{c}') AS {c}" for c in
                                   ["banking", "delivery", "government", "medical", "other"])
    + " FROM pred GROUP BY y"))
def confusion_matrix(spark, sf):
    """Label by prediction counts."""
    return ev.confusion_matrix(predicted(spark, sf), values=[
        "banking", "delivery", "government", "medical", "other"])


# ---- thresholds -------------------------------------------------------------------------------

@query("error_thresholds", sql(*LAB, CURVE_SQL, body=f"""
SELECT 'percentile' AS method, {R('quantile_cont(value, 0.98)')} AS threshold FROM lab
UNION ALL SELECT 'iqr', {R('quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))')} FROM lab
UNION ALL SELECT 'optimal_f1', {R('threshold')} FROM (SELECT threshold FROM pr
  ORDER BY 2 * (precision * recall) / (precision + recall + 1e-8) DESC, threshold LIMIT 1)"""))
def error_thresholds(spark, sf):
    """Error thresholds by the three methods; a percentile of 99 is capped at 98."""
    df = labelled(spark, sf)
    rows = [("percentile", th.fit_threshold(df, "value", percentile=99.0)),
            ("iqr", th.fit_threshold(df, "value", method="iqr")),
            ("optimal_f1", th.fit_threshold(df, "value", "is_anomaly", "optimal_f1"))]
    return spark.createDataFrame(rows, "method string, threshold double")


@query("threshold_stats", sql(*LAB, body=f"""
SELECT {R('quantile_cont(value, 0.95)')} AS threshold, {R('avg(value)')} AS mean_error, {R('stddev_pop(value)')} AS std_error,
  {R('min(value)')} AS min_error, {R('max(value)')} AS max_error, {R('quantile_cont(value, 0.95)')} AS percentile_95,
  {R('quantile_cont(value, 0.99)')} AS percentile_99 FROM lab"""))
def threshold_stats(spark, sf):
    """Threshold and error statistics."""
    df = labelled(spark, sf)
    return th.threshold_stats(df, "value", th.percentile_threshold(df, "value", 95.0))


@query("forest_thresholds", sql(*LAB, CURVE_SQL, body=f"""
SELECT 'labels' AS basis, {R('-threshold')} AS threshold FROM (SELECT threshold FROM pr ORDER BY precision >= 0.5 DESC,
  CASE WHEN precision >= 0.5 THEN recall ELSE 2 * (precision * recall) / (precision + recall + 1e-10) END DESC, threshold LIMIT 1)
UNION ALL SELECT 'no labels', {R('-quantile_cont(value, 0.9)')} FROM lab"""))
def forest_thresholds(spark, sf):
    """Initial cut of a lower-is-worse score with and without labels."""
    df = labelled(spark, sf).withColumn("score", -F.col("value"))
    rows = [("labels", th.forest_threshold(df, "score", "is_anomaly", {"min_precision": 0.5})),
            ("no labels", th.forest_threshold(df, "score"))]
    return spark.createDataFrame(rows, "basis string, threshold double")


@query("threshold_history", sql(MSG, body=f"""
, sc AS (SELECT id, CASE WHEN "timestamp" < TIMESTAMP '2024-01-11' THEN 0 ELSE day("timestamp") END AS batch,
    -value / 100 - CASE WHEN day("timestamp") > 15 THEN day("timestamp") / 60.0 ELSE 0 END AS score FROM msg),
seq AS (SELECT *, row_number() OVER (ORDER BY batch, id) AS g FROM sc),
per AS (SELECT batch, count(*) AS n, avg(score) AS mean, max(g) AS e FROM seq GROUP BY batch),
cand AS (SELECT p.batch, any_value(n) AS n, any_value(mean) AS mean, -quantile_cont(-score, 0.9) AS candidate,
    row_number() OVER (ORDER BY p.batch) AS i
  FROM per p JOIN seq s ON s.g > p.e - 2000 AND s.g <= p.e WHERE p.batch > 0 GROUP BY p.batch),
base AS (SELECT avg(score) AS m, -quantile_cont(-score, 0.9) AS t FROM sc WHERE batch = 0),
fold AS (WITH RECURSIVE f AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS batch, 0::BIGINT AS n, 0.0::DOUBLE AS mean, false AS drift, false AS updated, t::DOUBLE AS threshold, 0::BIGINT AS waiting FROM base
  UNION ALL
  SELECT c.i, c.batch, c.n, c.mean, c.d, c.u, CASE WHEN c.u THEN c.candidate ELSE c.threshold END, CASE WHEN c.u THEN 0 ELSE c.w END
  FROM (SELECT *, w >= 500 AND d AND abs(candidate - threshold) > 0.01 AS u FROM (
    SELECT k.i, k.batch, k.n, k.mean, k.candidate, f.threshold, f.waiting + k.n AS w,
      k.n >= 50 AND abs(k.mean - (SELECT m FROM base)) > 0.15 AS d FROM f JOIN cand k ON k.i = f.i + 1)) c)
  SELECT * FROM f WHERE i > 0)
SELECT CAST(batch AS INTEGER) AS batch, n, {R('mean')} AS mean, CAST(drift AS INTEGER) AS drift, CAST(updated AS INTEGER) AS updated,
  {R('threshold')} AS threshold FROM fold"""))
def threshold_history(spark, sf):
    """Replay of the dynamic threshold over daily batches that start to drift."""
    day = F.dayofmonth("timestamp")
    rows = message_rows(spark, sf).select(
        "id", F.when(F.col("timestamp") < "2024-01-11", 0).otherwise(day).alias("batch"),
        (-F.col("value") / 100 - F.when(day > 15, day / 60.0).otherwise(0.0)).alias("score"))
    seed = rows.where("batch = 0")
    mean = seed.agg(F.avg("score")).first()[0]
    start = th.low_tail(seed, "score", config.CALIBRATION["percentile"])
    out = th.recalibrate(rows, "batch", "id", "score", 0, start, mean)
    return out.withColumns({"drift": F.col("drift").cast("int"),
                            "updated": F.col("updated").cast("int")})


# ---- classifier features ----------------------------------------------------------------------

@query("text_statistics", sql(TEXTS, body=f"""
SELECT doc_id, CAST(length(t) AS INTEGER) AS length, CAST(wc AS INTEGER) AS word_count,
  {R("length(regexp_replace(t, '[^\\p{Nd}]', '', 'g')) / greatest(length(t), 1)")} AS digit_ratio,
  {R("length(regexp_replace(t, '[^\\p{Lu}]', '', 'g')) / greatest(length(t), 1)")} AS upper_ratio,
  CAST(regexp_matches(lower(t), {q(rf'\p{{Nd}}+{SPACE}*(?:грн|₴|[$]|uah|usd|eur)')}) AS INTEGER) AS has_money,
  CAST(regexp_matches(t, '[+]?3?8?0?\\p{{Nd}}{{9,}}') AS INTEGER) AS has_phone,
  CAST(regexp_matches(lower(t), 'https?://|www[.]') AS INTEGER) AS has_url,
  CAST(regexp_matches(lower(t), '(?:код|code|pin|otp)[^\\n]*\\p{{Nd}}{{4,}}') AS INTEGER) AS has_code,
  CAST(length(t) - length(replace(t, '!', '')) AS INTEGER) AS exclamation_count,
  CAST(length(t) - length(replace(t, '?', '')) AS INTEGER) AS question_count,
  {R('CASE WHEN wc > 0 THEN wl / wc ELSE 0.0 END')} AS avg_word_length
FROM (SELECT doc_id, message_text AS t, len(regexp_extract_all(message_text, {q('[^' + SPACE[1:-1] + ']+')})) AS wc,
  length(regexp_replace(message_text, {q(SPACE)}, '', 'g')) AS wl FROM texts)"""))
def text_statistics(spark, sf):
    """The eleven text statistics of the classifier."""
    return document_texts(spark, sf).select(
        "doc_id", *[c.alias(n) for n, c in tx.text_model_features("message_text").items()])


_KNOWN = s.lst(sorted({n for names in config.CLASSIFIER_SENDERS.values() for n in names}))


@query("source_clock_statistics", sql(MSG, body=f"""
SELECT id, CAST(length(source_addr) AS INTEGER) AS source_length, CAST(regexp_full_match(source_addr, '\\p{{Nd}}+') AS INTEGER) AS source_numeric,
  CAST(length(source_addr) <= 6 AS INTEGER) AS source_short, CAST(regexp_matches(source_addr, '\\p{{Nd}}') AS INTEGER) AS source_has_digits,
  CAST(list_contains({_KNOWN}, upper(source_addr)) AS INTEGER) AS source_known, hour, day_of_week,
  CAST(day_of_week >= 5 AS INTEGER) AS is_weekend, CAST(hour >= 22 OR hour < 6 AS INTEGER) AS is_night,
  CAST(hour BETWEEN 9 AND 18 AND day_of_week < 5 AS INTEGER) AS is_business_hours, {R('sin(2 * pi() * hour / 24)')} AS hour_sin,
  {R('cos(2 * pi() * hour / 24)')} AS hour_cos, {R('sin(2 * pi() * day_of_week / 7)')} AS day_sin, {R('cos(2 * pi() * day_of_week / 7)')} AS day_cos
FROM msg"""))
def source_clock_statistics(spark, sf):
    """Sender and clock statistics of the classifier."""
    cols = {**sn.source_model_features("source_addr"), **sn.time_model_features("timestamp")}
    return message_rows(spark, sf).select("id", *[c.alias(n) for n, c in cols.items()])


# ---- preparation ------------------------------------------------------------------------------

FEATS = (TEXTS, MSG, s.FEATURES)
GAPPED = """gap AS (SELECT id, CASE WHEN id % 10 <> 0 THEN value END AS value, CASE WHEN id % 7 <> 0 THEN CAST(hour AS DOUBLE) END AS hour,
  CAST(user_id AS DOUBLE) AS user_id, CAST(id % 2 AS DOUBLE) AS flag FROM msg)"""


def gapped(spark, sf) -> DataFrame:
    return message_rows(spark, sf).select(
        "id", F.when(F.col("id") % 10 != 0, F.col("value")).alias("value"),
        F.when(F.col("id") % 7 != 0, F.col("hour").cast("double")).alias("hour"),
        F.col("user_id").cast("double").alias("user_id"),
        (F.col("id") % 2).cast("double").alias("flag"))


@query("composite_features", sql(*FEATS, body=f"""
SELECT id, {R('0.3 * suspicious_word_count + 0.4 * social_engineering + 0.3 * financial_patterns')} AS total_suspicion_score FROM feat"""))
def composite_features(spark, sf):
    """Weighted suspicion score of every message."""
    return pr.add_composites(labelled_features(spark, sf)).select("id", "total_suspicion_score")


_PAIRS = [(a, b) for j, b in enumerate(config.FOREST_FEATURES) for a in config.FOREST_FEATURES[:j]]


@query("feature_correlations", sql(*FEATS, body=" UNION ALL ".join(f"""
SELECT '{a}' AS first, '{b}' AS second, round(coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), -9) + 1e-9, 5) AS correlation FROM feat"""
                                                                          for a, b in _PAIRS)))
def feature_correlations(spark, sf):
    """Pairwise correlations of the forest features; -9 stands for a constant column."""
    table = pr.correlations(labelled_features(spark, sf), config.FOREST_FEATURES)
    rows = [(a, b, float(v) if v is not None else -9.0) for (a, b), v in table.items()]
    return spark.createDataFrame(rows, "first string, second string, correlation double").withColumn(
        "correlation", F.round(F.col("correlation") + 1e-9, 5))


_COMPOSED = [*config.FOREST_FEATURES, *config.FOREST_COMPOSITES]
_COMPOSITE_SQL = ", ".join(" + ".join(f"{p} * {w}" for p, w in zip(parts, weights)) + f" AS {name}"
                           for name, (parts, weights) in config.FOREST_COMPOSITES.items())


@query("selected_features", sql(*FEATS, f"composed AS (SELECT *, {_COMPOSITE_SQL} FROM feat)", "high AS (" + " UNION ALL ".join(f"""
  SELECT '{b}' AS feature, abs(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)) > 0.85 AS much FROM composed"""
    for j, b in enumerate(_COMPOSED) for a in _COMPOSED[:j]) + ")",
    "named AS (" + " UNION ALL ".join(f"SELECT {j} AS j, '{c}' AS feature" for j, c in enumerate(_COMPOSED)) + ")", body="""
SELECT CAST(row_number() OVER (ORDER BY j) - 1 AS INTEGER) AS pos, feature FROM named
WHERE feature NOT IN (SELECT feature FROM high WHERE much)"""))
def selected_features(spark, sf):
    """Forest features left after dropping correlated ones."""
    df = pr.add_composites(labelled_features(spark, sf))
    kept = pr.drop_correlated(df, pr.select_features(df))
    return spark.createDataFrame([(i, c) for i, c in enumerate(kept)], "pos int, feature string")


@query("zero_filled", sql(MSG, GAPPED, body=f"SELECT id, {R('coalesce(value, 0)')} AS value, {R('coalesce(hour, 0)')} AS hour FROM gap"))
def zero_filled(spark, sf):
    """Missing values become zero."""
    return pr.zero_missing(gapped(spark, sf), ["value", "hour"]).select("id", "value", "hour")


@query("median_filled", sql(MSG, GAPPED, body=f"""
SELECT id, {R('coalesce(value, (SELECT median(value) FROM gap))')} AS value, {R('coalesce(hour, (SELECT median(hour) FROM gap))')} AS hour FROM gap"""))
def median_filled(spark, sf):
    """Missing values become the column median."""
    return pr.fill_median(gapped(spark, sf), ["value", "hour"]).select("id", "value", "hour")


@query("standardized", sql(MSG, GAPPED, body=f"""
SELECT id, {R('(user_id - avg(user_id) OVER ()) / stddev_pop(user_id) OVER ()')} AS user_id, {R('(flag - avg(flag) OVER ()) / stddev_pop(flag) OVER ()')} AS flag FROM gap"""))
def standardized(spark, sf):
    """Columns scaled by fitted mean and population deviation."""
    df = gapped(spark, sf)
    return pr.standardize(df, pr.mean_std(df, ["user_id", "flag"])).select("id", "user_id", "flag")


@query("adaptive_scaled", sql(MSG, body=f"""
, v AS (SELECT id, value AS plain, CASE WHEN id % 12 = 0 THEN value * 100 ELSE value END AS spiky, CAST(id % 2 AS DOUBLE) AS flag FROM msg),
q AS (SELECT quantile_cont(plain, 0.25) AS a1, quantile_cont(plain, 0.5) AS a2, quantile_cont(plain, 0.75) AS a3, avg(plain) AS am, stddev_pop(plain) AS asd,
  quantile_cont(spiky, 0.25) AS b1, quantile_cont(spiky, 0.5) AS b2, quantile_cont(spiky, 0.75) AS b3, avg(spiky) AS bm, stddev_pop(spiky) AS bsd FROM v),
o AS (SELECT avg(CAST(plain < a1 - 1.5 * (a3 - a1) OR plain > a3 + 1.5 * (a3 - a1) AS INTEGER)) > 0.05 AS ar,
  avg(CAST(spiky < b1 - 1.5 * (b3 - b1) OR spiky > b3 + 1.5 * (b3 - b1) AS INTEGER)) > 0.05 AS br FROM v, q)
SELECT id, {R('CASE WHEN ar THEN (plain - a2) / (a3 - a1) ELSE (plain - am) / asd END')} AS plain,
  {R('CASE WHEN br THEN (spiky - b2) / (b3 - b1) ELSE (spiky - bm) / bsd END')} AS spiky, {R('flag')} AS flag FROM v, q, o"""))
def adaptive_scaled(spark, sf):
    """Scaling chosen per column: none, robust or standard."""
    df = message_rows(spark, sf).select(
        "id", F.col("value").alias("plain"), F.when(F.col("id") % 12 == 0, F.col("value") * 100)
        .otherwise(F.col("value")).alias("spiky"), (F.col("id") % 2).cast("double").alias("flag"))
    return pr.adaptive_scale(df, ["plain", "spiky", "flag"])


@query("engineered_features", sql(*FEATS, body=f"""
SELECT id, {R('sin(2 * pi() * hour / 24)')} AS hour_sin, {R('cos(2 * pi() * hour / 24)')} AS hour_cos, {R('sin(2 * pi() * day_of_week / 7)')} AS day_sin,
  {R('cos(2 * pi() * day_of_week / 7)')} AS day_cos,
  {R('message_entropy * 0.3 + obfuscation_score * 0.3 + CAST(url_count > 0 AS INTEGER) * 0.2 + suspicious_word_count / 10.0 * 0.2')} AS complexity_score,
  {R('(1 - sender_legitimacy) * 0.4 + unusual_sender_pattern * 0.3 + source_category_mismatch * 0.3')} AS sender_risk,
  {R('night_time * 0.3 + time_category_anomaly * 0.4 + category_time_mismatch * 0.3')} AS time_risk,
  {R('(message_length - avg(message_length) OVER ()) / stddev_samp(message_length) OVER ()')} AS message_length_zscore,
  {R('message_entropy / ln(message_length + 1)')} AS entropy_length_ratio FROM feat"""))
def engineered_features(spark, sf):
    """Cyclic, risk and length features."""
    df = pr.add_length_stats(pr.add_risks(pr.add_cyclic(labelled_features(spark, sf))))
    return df.select("id", "hour_sin", "hour_cos", "day_sin", "day_cos", "complexity_score",
                     "sender_risk", "time_risk", "message_length_zscore", "entropy_length_ratio")


_SPECIAL = ["day_of_week", "time_category_anomaly"]


@query("feature_kinds", sql(*FEATS, body=" UNION ALL ".join([
    *[f"SELECT 'numeric' AS kind, '{c}' AS feature" for c in config.RECONSTRUCTION_FEATURES if c not in _SPECIAL],
    *[f"SELECT 'binary', '{c}' FROM feat HAVING count(DISTINCT {c}) = 2" for c in config.RECONSTRUCTION_FEATURES],
    *[f"SELECT 'categorical', '{c}'" for c in _SPECIAL]])))
def feature_kinds(spark, sf):
    """Which columns count as numeric, two-valued and categorical."""
    rows = labelled_features(spark, sf)
    # written once: the columns are passed over twice
    kinds = pr.feature_types(cut_lineage(rows.select(*dict.fromkeys([*config.RECONSTRUCTION_FEATURES, *_SPECIAL])), "kinds"))
    return spark.createDataFrame([(k, c) for k, cs in kinds.items() for c in cs],
                                 "kind string, feature string")


@query("one_hot", sql(MSG, body="SELECT id, " + ", ".join(
    f"CAST(day_of_week = {d} AND id % 9 <> 0 AS INTEGER) AS day_{d}" for d in range(7))
    + ", CAST(id % 9 = 0 AS INTEGER) AS day_unknown FROM msg"))
def one_hot(spark, sf):
    """Weekday as indicator columns; missing days fall under 'unknown'."""
    df = message_rows(spark, sf).withColumn("day", F.when(F.col("id") % 9 != 0,
                                                          F.col("day_of_week")))
    values = pr.category_values(df, "day")
    hot = pr.one_hot(df, "day", values, "v")
    return hot.select("id", *[F.col("v")[i].cast("int").alias(f"day_{v}")
                              for i, v in enumerate(values)])


@query("stratified_split", sql(MSG, body="""
SELECT id, category, CAST(row_number() OVER (PARTITION BY category ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id)
  <= floor(count(*) OVER (PARTITION BY category) * 0.8) AS INTEGER) AS is_train FROM msg"""))
def stratified_split(spark, sf):
    """80/20 split with exact shares per category."""
    return pr.stratified_split(message_rows(spark, sf).select("id", "category"), "category", "id")


@query("train_validation")
def train_validation(spark, sf):
    """Hash split sizes and the augmented training set."""
    train, valid = pr.train_validation_split(gapped(spark, sf), "id")
    more = pr.augment(train, ["user_id", "flag"], "id")
    size = lambda df, n: df.agg(F.count(F.lit(1)).alias("rows"), F.avg(
        "user_id").alias("mean_user")).withColumn("part", F.lit(n))
    return size(train, "train").unionByName(size(valid, "validation")).unionByName(
        size(more, "augmented"))


@query("scoring_vector", sql(*FEATS, body="SELECT id, CAST(43 AS INTEGER) AS width, round(("
                             + " + ".join(config.SCORING_COLUMNS) + ") + 1e-9, 2) AS total, round(("
                             + " + ".join(f"{k + 1} * {c}::FLOAT::DOUBLE" for k, c in enumerate(config.SCORING_COLUMNS))
                             + ") + 1e-9, 2) AS by_place FROM feat"))
def scoring_vector(spark, sf):
    """The padded scoring vector, checked by width, sum and the sum weighted by place."""
    from ..operators.ensemble import feature_vector
    v = feature_vector(width=43).cast("array<double>")
    return labelled_features(spark, sf).select("id", F.size(v).alias("width"), F.round(F.aggregate(
        v, F.lit(0.0), lambda a, x: a + x) + 1e-9, 2).alias("total"), F.round(F.aggregate(F.transform(
            v, lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x) + 1e-9, 2).alias("by_place"))
