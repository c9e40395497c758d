"""Spelling variants: words one edit apart, and the far more frequent form that a rare word is taken for.

Words are counted map-side. Near words are found with chunks: the shorter word of a pair (either one if they are
equally long) gives two disjoint chunks, its halves, and the longer one the positional grams that such a half can
meet within a shift of one. One edit leaves one of the halves whole, so each near pair meets at an equal gram.
Where many words share a gram, its words go on with the part that is still open: that is cut into two chunks
again, until few enough words share all that is fixed, or one letter is left open.
"""
from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks, byte_table, staged, word_runs

LENGTH = 7
OCCURRENCES = 2
RATIO = 10
EVERY = 31
#: a gram's words are compared where that takes at most so many pairs a word
PAIRS = 12
#: counted words that a task holds before it gives them out
ENTRIES = 300_000

#: Latin-1 holds every letter of the runs in one byte
LETTERS = byte_table(lambda c: 97 <= c <= 122 or c >= 0xC0)


def _count(batches):
    held = Counter()

    def given():
        keys = [k for k in held]
        return pa.RecordBatch.from_arrays([pa.array([k.decode("latin-1") for k in keys], pa.string()),
                                           pa.array(held.values(), pa.int64())], names=["word", "n"])

    for b in blocks(batches):
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            if not text:
                continue
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for _, runs in word_runs(text.encode("latin-1", "replace"), LETTERS):
                for run, n in Counter(runs).items():
                    size = len(run)
                    if size < LENGTH:
                        continue
                    code = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if code % EVERY == 0:
                        run = run[:code % size] + run[code % size + 1:]
                        if size == LENGTH:
                            continue
                    held[run] += n
        if len(held) > ENTRIES:
            yield given()
            held.clear()
    yield given()


def words(docs: DataFrame) -> DataFrame:
    """word, n: the distinct runs of at least seven letters that occur twice or more, marked letters deleted."""
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def _part(start, end):
    """Code points of ``word`` from ``start`` to before ``end``, from 0."""
    return F.substring(F.col("word"), start + 1, end - start)


def _keyed(rows: DataFrame) -> DataFrame:
    """The key of a row: all of its word but the open part, and the chunk word's length and open part."""
    shift = F.when(F.col("grams"), F.col("longer")).otherwise(0)
    key = F.xxhash64("size", "longer", "low", "high", _part(F.lit(0), F.col("low")), F.lit("|"),
                     _part(F.col("high") + shift, F.length("word")))
    return rows.withColumn("key", key)


def _halves(rows: DataFrame) -> DataFrame:
    """Two rows for one: the open part is the second half, where the first is equal, or the first half."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    ways = F.array(F.struct(middle.alias("low"), F.col("high")), F.struct(F.col("low"), middle.alias("high")))
    return _keyed(rows.select("word", "n", "grams", "size", "longer", F.explode(ways).alias("way"))
                  .select("word", "n", "grams", "size", "longer", "way.low", "way.high"))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of words that differ by one inserted, deleted or replaced code point, once.

    A row stands for a word in one role: with ``grams`` false it gives chunks to partners ``longer`` by 0 or 1, with
    ``grams`` true it is that partner of a word of ``size`` letters; letters ``low`` to ``high`` of the chunk word are
    open. Keys under which few pairs meet are joined, the others are halved again.
    """
    size = F.length("word")
    roles = F.array(*[F.struct(F.lit(bool(g)).alias("grams"), F.lit(d).alias("longer"), (size - g * d).alias("size"))
                      for g in (0, 1) for d in (0, 1)])
    rows = vocabulary.select("word", "n", F.explode(roles).alias("role")).select(
        "word", "n", "role.*", F.lit(0).alias("low"), F.col("role.size").alias("high"))
    found, level = [], 0
    while True:
        rows = _halves(rows)
        chunks, grams = F.count_if(~F.col("grams")), F.count_if("grams")
        keys = rows.groupBy("key").agg(chunks.alias("chunks"), grams.alias("grams_"),
                                       F.max(F.col("high") - F.col("low")).alias("open")) \
            .where("chunks > 0 and grams_ > 0")
        many = (F.col("open") > 1) & (F.col("chunks") * F.col("grams_") > PAIRS * (F.col("chunks") + F.col("grams_")))
        keys = staged(keys.select("key", many.alias("many")), f"keys{level}")
        few = keys.where("not many").select("key")
        a = rows.where("not grams").join(few, "key").alias("a")
        b = rows.where("grams").select("key", "word", "n").alias("b")
        low, wide = F.col("a.low"), F.col("a.high") - F.col("a.low")
        longer = F.col("a.longer")
        pairs = a.join(b, "key").where((longer == 1) | (F.col("a.word") < F.col("b.word"))) \
            .where(F.levenshtein("a.word", "b.word", 1) == 1)
        pairs = pairs.where(
            (F.substring("a.word", F.lit(1), low) == F.substring("b.word", F.lit(1), low))
            & (F.substring(F.col("a.word"), F.col("a.high") + 1, F.col("a.size"))
               == F.substring(F.col("b.word"), F.col("a.high") + longer + 1, F.col("a.size")))
            # a pair that agrees in both halves counts at the first
            & ((F.col("a.high") == F.col("a.size"))
               | (F.substring(F.col("a.word"), low + 1, wide) != F.substring(F.col("b.word"), low + 1, wide))))
        found.append(staged(pairs.select(F.col("a.word").alias("a"), F.col("a.n").alias("n_a"),
                                         F.col("b.word").alias("b"), F.col("b.n").alias("n_b")), f"pairs{level}"))
        crowded = keys.where("many").select("key")
        if crowded.isEmpty():
            break
        rows = staged(rows.join(crowded, "key").drop("key"), f"rows{level}")
        level += 1
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where following the forms ends. Each round doubles the steps; counts grow tenfold a step."""
    roots = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = staged(roots.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return roots


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of ``docs``.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of which one letter goes where the checksum
    of ``doc_id:run`` asks for it; the distinct ones of seven letters or more that occur at least twice. ``form`` is
    the near word of largest n, the first in code-point order on ties, if it occurs ten times as often. A null
    text has no words, a null doc_id reads as nothing before the colon; rows with equal ids count each. An empty
    table gives no rows. Columns other than doc_id and text do not matter.
    """
    vocabulary = staged(words(docs), "vocabulary")
    pairs = near_pairs(vocabulary)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n")),
                    F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n")))
    near = pairs.select(F.explode(sides).alias("s")).groupBy(F.col("s.word").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("s.n")).alias("minus"), F.col("s.other").alias("other"))).alias("best"))
    often = -F.col("best.minus") >= RATIO * F.col("n")
    found = staged(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(often, F.col("best.other")).alias("form"), F.when(often, -F.col("best.minus")).alias("form_n")), "near")
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = f"""
WITH runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LENGTH} GROUP BY 1, 2),
steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k:
            CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
coded AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
           string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
           lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195, unicode(ch)::BIGINT - 64] END))),
         lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) AS h
  FROM counted, steps),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
           ELSE run END AS word, n FROM coded)
  WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(n) >= {OCCURRENCES}),
shorter AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
            FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
half AS (
  SELECT a.word AS a, b.word AS b FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word < b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word),
near AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
best AS (SELECT a AS word, count(*) AS n_near, max(n) AS form_n, arg_min(b, (-n, b)) AS form
         FROM near JOIN words ON words.word = b GROUP BY a),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * w.n THEN form END AS form,
                 CASE WHEN form_n >= {RATIO} * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word))
SELECT f.word, f.form, coalesce(f8.form, f7.form, f6.form, f5.form, f4.form, f3.form, f2.form, f.form, f.word) AS root,
       f.n, f.n_near, f.form_n
FROM forms f LEFT JOIN forms f2 ON f2.word = f.form LEFT JOIN forms f3 ON f3.word = f2.form
LEFT JOIN forms f4 ON f4.word = f3.form LEFT JOIN forms f5 ON f5.word = f4.form LEFT JOIN forms f6 ON f6.word = f5.form
LEFT JOIN forms f7 ON f7.word = f6.form LEFT JOIN forms f8 ON f8.word = f7.form
"""
