"""From raw documents to tokens: the stages a training corpus goes through, each a step on the last."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewire.llm import decontaminate, langid, line_windows, near_text, pieces
from tidewire.llm.common import staged, table
from tidewire.llm.queries import PIECES

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a learned language; texts without letters go."""
    docs = docs.select(*COLUMNS)
    return langid.identify(docs, langid.fit(docs)).where("accepted").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines; a document of which nothing is left goes."""
    found = line_windows.without_repeated_lines(docs, carry=("lang", "source"))
    return found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    kept = near_text.near_duplicates(docs).where("kept").select("doc_id")
    return docs.join(kept.hint("shuffle_hash"), "doc_id", "left_semi").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    hit = found.where("contaminated").select("doc_id")
    return docs.join(hit.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left."""
    return pieces.tokens(docs, public_tokenizers.path(PIECES)).select(
        "doc_id", "n_bytes", F.size("tokens").cast("long").alias("n_tokens"), "n_byte_tokens", "tokens", "round_trip")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates),
          ("benchmark", benchmark), ("tokens", tokens)]

#: Language identification and tokens cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
