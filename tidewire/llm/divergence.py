"""How far each source's use of terms is from that of its language and of the other sources.

Terms are counted map-side and kept where enough documents of the language hold them. The kept terms form an
index, a term's postings being its sources with their shares. Distances between sources are row products over
it: a group scatters the postings of its terms into one dense accumulator of its peers. Peers that lack a term
have a share all the same, that of a count of zero; sorted shares and their running sums correct for these, so
that absent terms are never written out and no pair of postings leaves a task.
"""
from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import blocks, byte_table, staged, word_runs

LEAST = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
#: counted terms that a task holds before it gives them out
ENTRIES = 300_000
#: postings of one block of the index, at least and at most; in between a quarter of the squared number of peers
POSTINGS = (1 << 17, 1 << 22)
#: rows of a result batch
ROWS = 1 << 16
#: above every share, below 2^31
WIDE = np.int64(1) << np.int64(31)

TERM_BYTES = byte_table(lambda c: 97 <= c <= 122 or c >= 128)

COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()),
                     ("docs", pa.int64())])
DISTANCES = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _count(batches):
    uses, docs, held = defaultdict(Counter), defaultdict(Counter), 0

    def given():
        for (lang, source), terms in uses.items():
            keys = list(terms)
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                 pa.array(keys, pa.binary()).cast(pa.string()), pa.array(terms.values(), pa.int64()),
                 pa.array(map(docs[lang, source].__getitem__, keys), pa.int64())], schema=COUNTED)

    for b in blocks(batches):
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
            if not text:
                continue
            group, seen = (lang, source), set()
            for _, words in word_runs(text.encode(), TERM_BYTES):
                uses[group].update(words)
                seen.update(words)
            docs[group].update(seen)
        held = sum(map(len, uses.values()))
        if held > ENTRIES:
            yield from given()
            uses.clear()
            docs.clear()
    yield from given()


def _groups_of(batches):
    """Tables of rows with equal ``key``; the rows come sorted by it."""
    parts, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("key").dictionary_encode()
        names, places = codes.dictionary.to_pylist(), codes.indices.to_numpy(False)
        cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(places)]
        for a, b in zip(cuts, cuts[1:]):
            name = names[places[a]]
            if name != last and parts:
                yield pa.Table.from_batches(parts)
                parts = []
            last = name
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


class Block:
    """One block of the index: terms in order, each with its postings, and the peers of the language."""

    def __init__(self, peers: pa.Array, zero, term, peer, share):
        self.peers, self.zero, self.peer, self.share = peers, zero, peer, share
        n = len(zero)
        first = np.ones(len(term), bool)
        first[1:] = term[1:] != term[:-1]
        self.term = np.cumsum(first) - 1
        self.starts = np.append(np.flatnonzero(first), len(term))
        order = np.lexsort((share, peer))
        self.owned = order
        self.begin = np.searchsorted(peer[order], np.arange(n + 1))
        self.sums = np.append(0, np.cumsum(share[order]))
        self.places = peer[order] * WIDE + share[order]

    def _baseline(self, group, zero):
        """Sum over the terms of ``group`` of |share - zero| - |own zero - zero|; either may be an array."""
        a, b = self.begin[group], self.begin[np.add(group, 1)]
        k = np.searchsorted(self.places, group * WIDE + zero)
        below, all_ = self.sums[k] - self.sums[a], self.sums[b] - self.sums[a]
        return all_ - 2 * below + zero * (2 * (k - a) - (b - a)) - (b - a) * np.abs(self.zero[group] - zero)

    def row(self, g: int, terms: int) -> np.ndarray:
        """Distances of group ``g`` to all peers: ``terms`` times the one of their zeros, corrected by the block."""
        mine = self.owned[self.begin[g]:self.begin[g + 1]]
        term = self.term[mine]
        sizes = self.starts[term + 1] - self.starts[term]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[term] - (ends - sizes), sizes)
        peer, theirs, own, zero = self.peer[at], self.share[at], np.repeat(self.share[mine], sizes), self.zero[g]
        z = self.zero[peer]
        total = terms * np.abs(self.zero - zero)
        np.add.at(total, peer, np.abs(own - theirs) - np.abs(own - z) - np.abs(zero - theirs) + np.abs(zero - z))
        everyone = np.arange(len(self.zero))
        return total + self._baseline(np.int64(g), self.zero) + self._baseline(everyone, zero)


def _distances(batches):
    """Rows of partial distances; of a block, first its peers (null term) and then its postings by term."""
    for table in _groups_of(batches):
        table = table.combine_chunks()
        n = table.column("term").null_count
        peers, postings = table.slice(0, n), table.slice(n)
        names = peers.column("source").combine_chunks()
        block = Block(names, peers.column("share").to_numpy(),
                      postings.column("term").combine_chunks().dictionary_encode().indices.to_numpy(False),
                      pc.index_in(postings.column("source"), value_set=names).to_numpy().astype(np.int64),
                      postings.column("share").to_numpy())
        lang, terms = peers.column("lang")[0].as_py(), peers.column("terms")[0].as_py()
        parts, held = [], 0
        for g in range(n):
            others = np.delete(np.arange(n), g)
            value = block.row(g, terms)[others]
            parts.append(pa.RecordBatch.from_arrays(
                [pa.array([lang] * (n - 1), pa.string()), pa.array([names[g].as_py()] * (n - 1), pa.string()),
                 names.take(pa.array(others)), pa.array(value, pa.int64())], schema=DISTANCES))
            held += n - 1
            if held >= ROWS or g == n - 1:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches(ROWS)
                parts, held = [], 0


def _share(n: str, size: str, terms: str):
    """1 + floor(SCALE * (n + SMOOTH) / (size + SMOOTH * terms)), exact in decimals."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + {SMOOTH} as decimal(19,0)))"
                  f" div cast({size} + {SMOOTH} * {terms} as decimal(20,0))")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of ``docs``.

    Part ``pair`` holds the distance to every other source of the language, summed over the language's kept
    terms, all ranks; part ``term`` the ``top`` terms that the source uses and uses more than its language does.
    A null text, lang or source is read as empty; every row is a document, also where a doc_id repeats. Ties rank
    by item. A language without kept terms has distances of 0; a language with one source has no pairs; an
    empty table gives none. Columns other than text, lang and source do not matter.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long") \
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    index = counts.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("docs"),
        F.collect_list(F.struct("source", "n")).alias("postings")).where(F.col("docs") >= least).drop("docs")
    index = staged(index, "terms")

    langs = index.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_size"),
                                      F.sum(F.size("postings")).alias("postings"))
    sizes = index.select("lang", F.explode("postings").alias("p")).groupBy("lang", F.col("p.source").alias("source")) \
        .agg(F.sum("p.n").alias("size"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left") \
        .fillna(0, ["size", "terms", "lang_size", "postings"])
    n_peers = F.count(F.lit(1)).over(Window.partitionBy("lang"))
    target = F.greatest(F.lit(POSTINGS[0]), F.least(F.lit(POSTINGS[1]), (n_peers * n_peers / 4).cast("long")))
    groups = groups.select(
        "lang", "source", "size", "terms", "lang_size",
        F.greatest(F.lit(1), F.ceil(F.col("postings") / target)).alias("blocks"),
        F.when(F.col("terms") > 0, _share("0", "size", "terms")).otherwise(0).alias("zero"))
    groups = staged(groups, "groups")

    key = F.concat_ws(":", F.col("block"), F.col("lang"))
    used = index.select("lang", "term", "total", F.explode("postings").alias("p")) \
        .select("lang", "term", "total", "p.source", "p.n").join(groups, ["lang", "source"]) \
        .withColumn("share", _share("n", "size", "terms"))
    postings = used.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))) \
        .select(key.alias("key"), "lang", "term", "source", "share", F.lit(None).cast("long").alias("terms"))
    peers = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).select(
        key.alias("key"), "lang", F.lit(None).cast("string").alias("term"), "source", F.col("zero").alias("share"),
        F.when(F.col("block") == 0, F.col("terms")).otherwise(0).alias("terms"))
    pairs = peers.union(postings).repartition("key").sortWithinPartitions("key", F.asc_nulls_first("term"), "source") \
        .mapInArrow(_distances, "lang string, source string, item string, value long") \
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    common = used.select("lang", "source", F.col("term").alias("item"),
                         (F.col("share") - _share("total", "lang_size", "terms")).alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select("*", F.lit("pair").alias("part"), rank.alias("rank")).select(*columns).union(
        common.select("*", F.lit("term").alias("part"), rank.alias("rank")).where(F.col("rank") <= top).select(*columns))


SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM documents),
uses AS (SELECT id, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM uses GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST}),
counts AS (SELECT u.lang, u.source, u.term, count(*) AS n FROM uses u JOIN kept k ON u.lang = k.lang AND u.term = k.term
           GROUP BY 1, 2, 3),
langs AS (SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(n) AS size FROM counts GROUP BY 1, 2),
sources AS (SELECT DISTINCT lang, source FROM docs),
shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + (({SCALE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH})) // (coalesce(z.size, 0) + {SMOOTH} * l.v)) AS p,
         1 + (({SCALE}::HUGEINT * (k.total + {SMOOTH})) // (l.size + {SMOOTH} * l.v)) AS q
  FROM sources s JOIN kept k ON k.lang = s.lang JOIN langs l ON l.lang = s.lang
  LEFT JOIN sizes z ON z.lang = s.lang AND z.source = s.source
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
          FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
WHERE part = 'pair' OR rank <= {TOP}
"""
