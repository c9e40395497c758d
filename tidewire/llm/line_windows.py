"""Line dedup over windows of three consecutive lines, in DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LINES = 3


def _lines():
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc_id, at): first line numbers, from 0, of windows that stand earlier somewhere.

    Windows are compared by two 64-bit hashes of their lines. First places are found with partial
    aggregation; the join back is an equi-join of narrow rows, which adaptive execution splits when
    one window is very common.
    """
    places = F.sequence(F.lit(0), F.size("lines") - lines)
    windows = docs.select("doc_id", _lines().alias("lines")).where(F.size("lines") >= lines).select(
        "doc_id", F.explode(F.transform(places, lambda i: F.struct(
            i.alias("at"), F.slice("lines", i + 1, lines).alias("window")))).alias("w"))
    windows = windows.where(F.array_join("w.window", "").rlike("[^ \t\r]")).select(
        "doc_id", F.col("w.at").alias("at"), F.xxhash64("w.window").alias("key1"),
        F.xxhash64(F.lit(lines), "w.window").alias("key2"))
    first = windows.groupBy("key1", "key2").agg(
        F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return windows.join(first.drop("n"), ["key1", "key2"]) \
        .where(F.struct("doc_id", "at") > F.col("first")).select("doc_id", "at")


def without_repeated_lines(docs: DataFrame, lines: int = LINES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, text: lines in no later occurrence of a repeated window.

    The columns named in ``carry`` come along; others are dropped.

    Lines are what stands between newline characters. A window counts as later when it also starts in
    a smaller doc_id, or earlier in the same document; every line it covers goes, overlaps are merged.
    Windows of blank lines only are left alone, texts of fewer lines than a window too. A null text
    is one empty line and stays null. Rows without a doc_id are dropped; a doc_id must be unique.
    """
    docs = docs.select("doc_id", "text", F.struct(*carry).alias("rest") if carry else F.lit(0).alias("rest")) \
        .where("doc_id is not null")
    later = repeated_lines(docs, lines).groupBy("doc_id").agg(F.collect_set("at").alias("later"))
    gone = F.flatten(F.transform("later", lambda i: F.sequence(i, i + lines - 1)))
    joined = docs.join(later.hint("shuffle_hash"), "doc_id", "left").select(
        "doc_id", "text", "rest", _lines().alias("lines"), gone.alias("gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    joined = joined.select("doc_id", "text", "rest", "lines", F.when(F.col("gone").isNotNull(), kept).alias("kept"))
    return joined.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("kept")).cast("long")
        .alias("n_removed"),
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(
            F.array_join(F.transform("kept", lambda i: F.element_at("lines", i + 1)), "\n")).alias("text"),
        *[F.col("rest").getField(c).alias(c) for c in carry])


SQL = f"""
WITH lines AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, i AS p, array_to_string(l[i + 1:i + {LINES}], chr(10)) AS w
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - {LINES - 1})) AS i FROM lines)
  WHERE regexp_matches(array_to_string(l[i + 1:i + {LINES}], ''), '[^ \\t\\r]')),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS r FROM windows),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + {LINES})))) AS g
         FROM ranked WHERE r > 1 GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed,
       CASE WHEN g IS NULL THEN text ELSE coalesce(array_to_string(
         [l[i + 1] FOR i IN range(0, len(l)) IF NOT list_contains(g, i)], chr(10)), '') END AS text
FROM lines LEFT JOIN gone USING (doc_id)
"""
