"""Message tables derived from the generic test tables.

The supplied tables hold no message traffic, so one view maps them onto it: every event is a
message, a document is its text. Some texts are changed by a fixed rule (look-alike letters, digits
for letters, hidden characters, an alert sentence) so that every text rule meets real cases. All
rows and whole texts take part.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import obfuscation, text as tx
from ..functions.sender import clock
from ..session import spread

ALERT = (" Терміново! Увага! Ваш рахунок 1234 заблоковано, переказ 500 грн. Click here:"
         " https://bit.ly/a1 або +380501234567!")
BURST = {"window_s": 21600, "sender_limit": 12, "recipient_limit": 2}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, message_text."""
    kind = F.pmod(F.col("doc_id"), F.lit(10))
    t = F.col("text")
    shown = (F.when(kind == 0, F.translate(t, "aeo", "аео"))
             .when(kind == 1, F.concat(t, F.lit(ALERT)))
             .when(kind == 2, F.replace(t, F.lit(" the "), F.lit(" th​e ")))
             .when(kind == 3, F.translate(t, "os", "05"))
             .otherwise(t))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return spread(docs).select("doc_id", shown.alias("message_text"), "lang", "source", "n_chars")


def _source_addr() -> Column:
    pick = F.pmod(F.col("event_id"), F.lit(8))
    names = ["MONOBANK", "M0NOBANK", "PRIVAT24", "BANK1", None, "NOVAPOSHTA", "DIIA", "GOV.UA"]
    out = None
    for i, name in enumerate(names):
        value = F.col("user_id").cast("string") if name is None else F.lit(name)
        out = F.when(pick == i, value) if out is None else out.when(pick == i, value)
    return out


def _category() -> Column:
    e = F.col("event_type")
    return (F.when(e == "purchase", "banking").when(e == "signup", "government")
            .when(e == "click", "delivery").when(e == "view", "medical").otherwise("other"))


def message_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without their text: id, time, addresses, category, label, doc_id."""
    n_docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
    dest = F.when(F.pmod(F.col("event_id"), F.lit(7)) == 0, F.col("user_id").cast("string")) \
        .otherwise((F.col("user_id") + 380000000000).cast("string"))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), "user_id",
        F.pmod(F.col("event_id"), n_docs).alias("doc_id"), _source_addr().alias("source_addr"),
        dest.alias("dest_addr"), _category().alias("category"), "value")
    return rows.select("*", *[c.alias(n) for n, c in clock("timestamp").items()])


def with_label(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("_t"))
    return (rows.join(labels, "doc_id", "left")
            .withColumn("is_anomaly", F.coalesce(F.col("_t"), F.lit(0))).drop("_t"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with their text."""
    texts = document_texts(spark, sf_dir).select("doc_id", "message_text")
    return message_rows(spark, sf_dir).join(texts, "doc_id")


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text features and the text part of the obfuscation score, once per document."""
    docs = tx.add_text_features(document_texts(spark, sf_dir))
    return docs.select("doc_id", *tx.text_features("message_text"), obfuscation.obfuscation_score(
        "message_text").alias("message_obfuscation"))
