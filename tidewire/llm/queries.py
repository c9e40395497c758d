"""Registered queries: each operator with its production parameters over whole tables."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (decontaminate, divergence, fm_index, langid, licenses, line_windows, near_text, near_vectors,
               personal_data, pieces, spelling, suffix_sort, token_counts)
from .common import table

COUNTED = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left without repeated 100-byte strings."""
    return suffix_sort.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three consecutive lines."""
    return line_windows.without_repeated_lines(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return near_text.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents")
    return pieces.tokens(docs, public_tokenizers.path(PIECES)).select(
        "doc_id", "n_bytes", F.size("tokens").cast("long").alias("n_tokens"), "n_byte_tokens", "tokens",
        "round_trip")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document holds within their edits."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left without windows of 50 words of earlier documents."""
    return fm_index.without_repeats(table(spark, sf_dir, "documents")).drop("text")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNTED))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate vectors of one label."""
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; the counts by kind are of the base spans, the contract fixes them."""
    docs = table(spark, sf_dir, "documents")
    found = personal_data.personal_data(docs, personal_data.fit())
    counts = [F.regexp_count("base_spans", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in personal_data.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_secret", "n_spans")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of each source's terms to its language's and its peers'."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words of every word, the form it varies and the root of its forms."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices and identifier tags of every document."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_language, op2_suffix_dedup, op3_line_dedup, op4_minhash, op5_sentencepiece, op6_decontaminate,
        op7_substring_dedup, op8_token_counts, op9_near_vectors, op10_personal_data, op11_divergence, op12_spelling,
        op13_licenses)}

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

NEAR_TEXT_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {near_text.WORDS} THEN array_to_string(w, ' ')
         ELSE array_to_string(w[i:i + {near_text.WORDS - 1}], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {near_text.WORDS - 2}, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
           GROUP BY 1, 2),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
          UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM roots LEFT JOIN sizes USING (doc_id)
"""

PASSAGES_SQL = f"""
WITH words AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + {fm_index.WIDTH - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {fm_index.WIDTH - 2})) AS i FROM words WHERE len(w) >= {fm_index.WIDTH})),
repeats AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first_doc FROM windows),
gone AS (SELECT doc_id, list(DISTINCT p) AS g FROM (
           SELECT doc_id, unnest(range(i, i + {fm_index.WIDTH})) AS p FROM repeats WHERE first_doc < doc_id) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN g IS NULL THEN w
         ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(g, i)] END, ' '), '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""

VECTORS_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= {near_vectors.THRESHOLD}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, vec_id = component_id AS kept
FROM roots LEFT JOIN counts USING (vec_id)
"""

ORACLES = {"op3_line_dedup": line_windows.SQL, "op4_minhash": NEAR_TEXT_SQL, "op7_substring_dedup": PASSAGES_SQL,
           "op9_near_vectors": VECTORS_SQL, "op11_divergence": divergence.SQL, "op12_spelling": spelling.SQL}
