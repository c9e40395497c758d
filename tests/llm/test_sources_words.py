"""Source divergence, spelling variants and license scans against plain versions, odd rows included."""
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import common, divergence, licenses, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_word_runs():
    rng = random.Random(1)
    table = common.byte_table(lambda c: 97 <= c <= 122 or c >= 128)
    for _ in range(300):
        text = "".join(rng.choice("aB é日0 .") for _ in range(rng.randint(0, 60))) + "x" * rng.choice((0, 0, 50))
        found = [w.decode() for _, words in common.word_runs(text.encode(), table, rng.randint(1, 12)) for w in words]
        assert found == re.findall("[^\x00-\x60\x7b-\x7f]+", text.translate(LOWER))


# --- source divergence

def plain_divergence(rows, least, top):
    rows = [tuple(v or "" for v in r) for r in rows]
    words = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(LOWER)) for t, *_ in rows]
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for (_, lang, source), w in zip(rows, words):
        docs[lang].update(set(w))
        groups[lang, source].update(w)
    out = []
    for (lang, source), uses in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        everyone = {s: u for (la, s), u in groups.items() if la == lang}

        def shares(uses):
            size = sum(uses[t] for t in kept)
            return {t: 1 + 10 ** 9 * (uses[t] + 5) // (size + 5 * len(kept)) for t in kept}

        mine, whole = shares(uses), shares(sum(everyone.values(), Counter()))
        pairs = [(s, sum(abs(mine[t] - p) for t, p in shares(u).items())) for s, u in everyone.items() if s != source]
        terms = [(t, mine[t] - whole[t]) for t in kept if uses[t] and mine[t] > whole[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(found, 1)
                    if part == "pair" or k <= top]
    return sorted(out)


def test_divergence(spark, monkeypatch):
    monkeypatch.setattr(divergence, "POSTINGS", (7, 7))  # several blocks a language
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    rng = random.Random(4)
    vocabulary = ["Ab", "cd", "Été", "日本", "x y", "q", "zz", "ab", "word", "other", "\U0001f600", "rare", "ÿ"]
    rows = [(" ".join(rng.choices(vocabulary, [1 + (i * s) % 7 for i in range(len(vocabulary))], k=rng.randint(0, 40))),
             la, f"s{s}") for la in ("en", "fr", None) for s in range(6) for _ in range(rng.randint(1, 8))]
    rows += [(None, "en", "silent"), ("", "en", None), ("123 ..", "xx", "a"), ("123", "xx", "b"), (None, None, None),
             ("only one", "yy", "alone"), *[("same text", "zz", "t1")] * 4, *[("same text", "zz", "t2")] * 4]
    rows.append(("ab " * 4000 + "long", "fr", "s1"))
    table = spark.createDataFrame(rows, "text string, lang string, source string").withColumns(
        {c: F.lit("x") for c in ("term", "n", "key", "share", "zero", "terms", "block", "rank", "item", "doc_id")})
    want = plain_divergence(rows, 4, 3)
    assert any(r[2] == "term" and r[5] == 3 for r in want) and any(r[4] == 0 for r in want)
    got = sorted(tuple(r) for r in divergence.divergence(table.repartition(5), 4, 3).collect())
    assert got == want
    assert divergence.divergence(table.limit(0)).collect() == []


def test_row_products():
    rng = np.random.default_rng(2)
    counts = rng.poisson(0.6, (9, 40)) * rng.integers(1, 500, (9, 40))
    counts[3] = 0
    size = counts.sum(1)
    share = 1 + 10 ** 9 * (counts + 5) // (size[:, None] + 5 * 40)
    zero = 1 + 10 ** 9 * 5 // (size + 5 * 40)
    term, peer = np.nonzero(counts.T)
    block = divergence.Block(None, zero, term, peer, share[peer, term])
    for g in range(9):
        assert (block.row(g, 40) == np.abs(share - share[g]).sum(1)).all()


# --- spelling variants

def plain_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def test_variants(spark):
    rng = random.Random(7)
    words = ["différente", "Wordlist", "running", "runnings", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaaaaaab", "short"]
    # one stem with many endings meets at every first gram
    words += ["commonstem" + a + b for a in "abcdefgh" for b in "abcdefgh"] + ["commonstem" + a for a in "abcdefghé"]
    words += ["".join(rng.choice("ab") for _ in range(8)) for _ in range(60)]
    words += ["x" * 700, "x" * 350 + "y" + "x" * 349, "x" * 701]
    counts = [(w, rng.choice((1, 2, 3, 25, 30, 300))) for w in words]
    rows = [(i, " ".join(rng.sample([w for w, n in counts for _ in range(n) if n <= 30], 120))) for i in range(40)]
    rows += [(100 + k, " ".join(w for w, n in counts if n == 300)) for k in range(300)]
    rows += [(None, None), (5, ""), (None, "Running running"), (6, "日本語 a×b÷c  running"), (6, "runninx runninx")]
    rows += [(500 + k, "variantsss " * (k < 3) + "variantsst " * (k < 40) + "variantstt") for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("word", "n", "key", "size", "low", "form", "root")})
    want = plain_variants(plain_words(rows))
    assert any(v[0] and v[1] != v[0] for v in want.values())
    got = {r.word: tuple(r)[1:] for r in spelling.variants(table.repartition(4)).collect()}
    assert got == want
    assert spelling.variants(table.limit(0)).collect() == []


def test_near_pairs_once(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(7, 10))) for _ in range(700)})
    want = {tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[:i]
            if abs(len(a) - len(b)) < 2 and one_edit(a, b)}
    got = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(
        spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


# --- license scans

def test_expressions():
    def value(line):
        found = licenses.expression(line.lower().encode())
        return found and (found[0], sorted(set(found[2])))

    assert value(" MIT") == (1, ["mit"])
    assert value("MIT OR GPL-3.0-only */") == (1, ["gpl", "mit"])
    assert value("MIT AND GPL-3.0-only") == (3, ["gpl", "mit"])
    assert value("MIT OR Apache-2.0 AND GPL-2.0+") == (1, ["apache", "gpl", "mit"])
    assert value("(MIT OR Apache-2.0) AND GPL-2.0+") == (3, ["apache", "gpl", "mit"])
    assert value("GPL-2.0-only WITH Classpath-exception-2.0 and MIT") == (2, ["gpl", "mit"])
    assert value("LicenseRef-own or CC-BY-SA-4.0") == (2, ["cc-by-sa", "other"])
    assert value("mit some words") == (1, ["mit"])
    assert licenses.expression(b"mit or apache-2.0 and gpl-3.0")[1] == "mit apache-2.0 gpl-3.0 and or"
    for bad in ("", "or mit", "mit or", "(mit", "mit)", "()", "mit with (x)", "with", "-->"):
        assert value(bad) is None
    assert licenses.expression(b"(" * 5000 + b"mit" + b")" * 5000)[0] == 1
    # every expression against the value of its own tree
    rng = random.Random(3)

    def tree(depth):
        if not depth or rng.random() < 0.3:
            name = rng.choice(("mit", "gpl-3.0", "mpl-2.0", "unlicense", "cc-by-nc-4.0"))
            return name, licenses.STRICTNESS[licenses.family(name)]
        op = rng.choice(("and", "or"))
        (a, x), (b, y) = tree(depth - 1), tree(depth - 1)
        return f"({a} {op} {b})", max(x, y) if op == "and" else min(x, y)

    for _ in range(200):
        text, want = tree(4)
        assert licenses.expression(text.encode())[0] == want


def plain_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    at = [(i, label) for i in range(len(words)) for phrase, label in licenses.BASE.items()
          if words[i:i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return (len(words), len(at), min(places, default=None), max(places, default=None),
            ",".join(sorted({label for _, label in at})))


TEXTS = {
    None: "", "": "", "...": "", "no notice at all, with a licence": "",
    "Released under the MIT\n License.": "mit",
    "GNU General  Public-License, Apache License; MIT license mit license": "apache,gpl,mit",
    "the mit licenses": "", "été mit license日 mit license": "mit",
    "GNU Lesser General Public License": "gpl,lgpl",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc", "CC-BY": "cc-by", "accc by": "",
    "x\n# SPDX-License-Identifier: MIT OR Apache-2.0\nand gpl-3.0": "apache,mit",
    "// spdx-license-identifier: (GPL-2.0-only WITH Classpath-exception-2.0) */": "gpl",
    "SPDX-License-Identifier MIT": "", "SPDX-License-Identifier: or": "",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
}


def test_license_scan(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "MIT License"), (3, "MIT License"), (3, "MIT License")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("labels", "score", "n_words")}).repartition(3)
    got = licenses.license_scan(table).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] if r.doc_id not in (None, 3) else None
        if text is None and r.n_words == 2:
            text = "MIT License"
        elif r.doc_id == 3:
            text = list(TEXTS)[3]
        assert tuple(r)[1:6] == plain_base(text), text
        assert r.labels == TEXTS.get(text, "mit"), text
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") == (r.strictness is not None)
    assert licenses.license_scan(table.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [1, 5, 16, 64])
def test_license_slices(monkeypatch, limit):
    rng = random.Random(limit)
    parts = [t for t in TEXTS if t] + ["and", "words", "é" * 9, "x" * 40, "\n"]
    texts = [" ".join(rng.choices(parts, k=12)) for _ in range(60)]
    want = [licenses.scan(t) for t in texts]
    runs = common.word_runs
    monkeypatch.setattr(licenses, "word_runs", lambda raw, table: runs(raw, table, limit))
    for text, row in zip(texts, want):
        assert row[:5] == plain_base(text)
        assert licenses.scan(text) == row
