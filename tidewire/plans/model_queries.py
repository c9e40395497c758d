"""Detectors and classifier on the derived messages."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import classify as cl, ensemble as en, evaluation as ev, iforest as fo
from ..operators import prepare as pr, thresholds as th
from ..operators.reconstruct import Reconstruction
from ..session import cut_lineage
from ..sources import models as store
from . import sql_text as s
from .catalog import query
from .driver_tables import document_texts, messages, with_label
from .message_queries import labelled_features
from .report_queries import R
from .sql_text import LABELLED, MSG, TEXTS, q, sql

def feature_rows(spark, sf) -> DataFrame:
    """Labelled features, written once: fitting and scoring pass over them several times."""
    return cut_lineage(pr.add_composites(labelled_features(spark, sf)), "features")


def fitted_forest(rows: DataFrame, how=fo.Forest.fit):
    normal = rows.where("is_anomaly = 0")
    kept = pr.drop_correlated(normal, pr.select_features(normal))
    return how(pr.zero_missing(normal, kept), kept)


def scored_forest(rows: DataFrame):
    """The fitted forest and the scores of all rows; the label cuts come from those of the normal rows."""
    model = fitted_forest(rows, fo.Forest.grow)
    scored = cut_lineage(model.score(pr.zero_missing(rows, model.features), keep=["is_anomaly"]), "scored")
    return model.set_offsets(scored.where("is_anomaly = 0")), scored


@query("forest_scores")
def forest_scores(spark, sf):
    """Ensemble score, member vote and thresholded prediction of every message."""
    model, scored = scored_forest(feature_rows(spark, sf))
    cut = th.forest_threshold(scored, "score", "is_anomaly")
    return fo.predict_forest(model.vote(scored), cut).drop("member_scores")


@query("forest_summary")
def forest_summary(spark, sf):
    """Sample, anomaly and threshold summary of the forest."""
    _, scored = scored_forest(feature_rows(spark, sf))
    cut = th.forest_threshold(scored, "score", "is_anomaly")
    return fo.prediction_summary(fo.predict_forest(scored, cut), cut)


@query("embedding_forest")
def embedding_forest(spark, sf):
    """Forest over the embedding vectors; the score of every vector."""
    from .driver_tables import table
    vectors = table(spark, sf, "embeddings")
    width = vectors.select(F.max(F.size("embedding"))).first()[0]
    cols = [f"e{i}" for i in range(width)]
    rows = vectors.select(F.col("vec_id").alias("id"), *[
        F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    return fo.Forest.fit(rows, cols).score(rows).drop("member_scores")


@query("reconstruction_errors")
def reconstruction_errors(spark, sf):
    """Reconstruction error and prediction of every message."""
    rows = feature_rows(spark, sf)
    model = Reconstruction.fit(rows.where("is_anomaly = 0"))
    return model.predict(rows, keep=["is_anomaly"])


@query("reconstruction_summary")
def reconstruction_summary(spark, sf):
    """Sample, anomaly, error and threshold summary, with quality measures."""
    rows = feature_rows(spark, sf)
    model = Reconstruction.fit(rows.where("is_anomaly = 0"))
    out = cut_lineage(model.predict(rows, keep=["is_anomaly"]), "errors")
    summary = fo.prediction_summary(out, model.threshold, "error")
    quality = ev.binary_metrics(out)
    auc = ev.roc_auc(ev.threshold_curve(out, "error"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(summary).join(one(quality), "_k").join(one(auc), "_k").drop("_k")


@query("ensemble_results")
def ensemble_results(spark, sf):
    """Both detectors fitted, stored, loaded and combined into result rows."""
    from ..session import work_dir
    rows = feature_rows(spark, sf)
    forest = fitted_forest(rows)
    recon = Reconstruction.fit(rows.where("is_anomaly = 0"))
    path = work_dir(spark, "models")
    store.save_forest(spark, forest, f"{path}/forest", 0.0)
    store.save_reconstruction(spark, recon, f"{path}/recon")
    forest, _, _ = store.load_forest(spark, f"{path}/forest")
    recon = store.load_reconstruction(spark, f"{path}/recon")
    members = forest.decision(forest.score(rows)).drop("score")
    errors = recon.errors(rows).withColumnRenamed("error", "reconstruction_error")
    joined = rows.join(members, "id").join(errors, "id")
    return en.score_messages(joined, threshold=recon.threshold, width=43)


# ---- classifier -------------------------------------------------------------------------------

TEXT_CORPUS = "corpus AS (SELECT doc_id, lower(message_text) AS t FROM texts)"
GRAMS = TEXT_CORPUS + f""",
words AS (SELECT doc_id, regexp_extract_all(t, {q(s.W + '+')}) AS w FROM corpus),
grams AS (
  SELECT doc_id, unnest(w) AS term FROM words
  UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM words)
  UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
tf AS (SELECT doc_id, term, count(*) AS k FROM grams GROUP BY ALL),
vocab AS (SELECT term, CAST(sum(k) AS BIGINT) AS total, count(*) AS df FROM tf GROUP BY term
  HAVING count(*) >= 3 AND count(*) <= 0.95 * (SELECT count(*) FROM texts) ORDER BY total DESC, term LIMIT 2000)"""


@query("vocabulary", sql(TEXTS, GRAMS, body="SELECT term, total, df FROM vocab"))
def vocabulary(spark, sf):
    """The 2000 most frequent n-grams of all texts."""
    return cl.vocabulary(document_texts(spark, sf), "message_text")


@query("tfidf_weights", sql(TEXTS, GRAMS, body=f"""
, w AS (SELECT doc_id, term, k * (ln((1.0 + (SELECT count(*) FROM texts)) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term))
SELECT doc_id, term, {R('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM w"""))
def tfidf_weights(spark, sf):
    """Unit-length TF-IDF rows of every text."""
    return cl.tfidf(document_texts(spark, sf), "doc_id", "message_text")


def labelled_messages(spark, sf) -> DataFrame:
    return with_label(messages(spark, sf), spark, sf)


@query("training_rows", sql(MSG, LABELLED, body="""
SELECT id, category FROM lab WHERE is_anomaly = 0 AND category IN (
  SELECT category FROM lab WHERE is_anomaly = 0 GROUP BY category HAVING count(*) >= 10)"""))
def training_rows(spark, sf):
    """Normal rows of frequent categories."""
    return cl.training_rows(labelled_messages(spark, sf)).select("id", "category")


@query("class_weights", sql(MSG, body=f"""
SELECT category, count(*) AS total, {R('sum(count(*)) OVER () / (count(*) OVER () * count(*))')} AS weight FROM msg GROUP BY category"""))
def class_weights(spark, sf):
    """Balanced class weights."""
    from .driver_tables import message_rows
    return cl.class_weights(message_rows(spark, sf), "category").groupBy("category").agg(
        F.count(F.lit(1)).alias("total"), F.first("weight").alias("weight"))


def trained(spark, sf) -> dict:
    rows = cut_lineage(labelled_messages(spark, sf).select(
        "id", "timestamp", "source_addr", "category", "message_text", "is_anomaly"), "training")
    return {"rows": rows, **cl.train(rows)}


@query("classifier_report")
def classifier_report(spark, sf):
    """Train both model families, then report the better one on the held-out rows."""
    return ev.class_report(trained(spark, sf)["test"], "category", "predicted_category")


@query("classifier_predictions")
def classifier_predictions(spark, sf):
    """Predicted category and confidence of every message, by the trained model as stored and loaded again."""
    from ..session import work_dir
    fitted = trained(spark, sf)
    path = work_dir(spark, "classifier")
    store.save_classifier(spark, fitted["model"], path, fitted["scores"])
    model, _ = store.load_classifier(spark, path)
    return cl.predict(fitted["rows"].select("id", "timestamp", "source_addr", "message_text"), model) \
        .select("id", "predicted_category", "confidence")
