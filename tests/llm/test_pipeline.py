"""The corpus pipeline stage by stage, and decontamination, against plain versions on planted cases."""
import random
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidewire.llm import decontaminate

SYLLABLES = {"aa": ("ba", "do", "ki", "ru", "sel", "tam"), "bb": ("ché", "vü", "zo", "nj", "pla", "wy")}


def prose(rng, lang, n, line=9):
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return "".join(w + ("\n" if k % line == line - 1 else " ") for k, w in enumerate(words)).strip()


# --- decontamination

def plain_hit(item, text):
    """Whether some part of ``text`` lies within 5 % edits of ``item`` (Sellers' rows, one text character each)."""
    item, text = decontaminate.normal(item), decontaminate.normal(text)
    if not item:
        return False
    codes, places = np.array([ord(c) for c in item]), np.arange(len(item) + 1)
    row, best = places.copy(), len(item)
    for c in text:
        step = np.empty_like(row)
        step[0] = 0
        step[1:] = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(step - places) + places
        best = min(best, int(row[-1]))
    return best <= int(0.05 * len(item))


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k:k + 1] = rng.choice(([], [out[k], "q"], ["q"]))
    return "".join(out)


def test_decontaminate_brute_force(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, "aa", n)) for i, n in enumerate((3, 8, 20, 45))] + [(7, None), (8, ""), (9, "x"), (3, "zzz"), (None, "q")]
    base = {i: min(t for j, t in items if j == i and t is not None) for i in {i for i, t in items if i is not None and t}}
    texts = [None, "", "x", "short"]
    for i, item in sorted(base.items()):
        for n in (0, 1, int(0.05 * len(item)), int(0.05 * len(item)) + 1, int(0.05 * len(item)) + 3):
            if item:
                texts.append(prose(rng, "bb", 12) + " " + edited(rng, item, n).upper() + "\n " + prose(rng, "bb", 9))
    texts += [" ".join(base.values()), (prose(rng, "bb", 400) + " ") * 20 + base[2]]
    rows = [(k * 2, t, "n") for k, t in enumerate(texts)] + [(None, base[1], "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_ids string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    want = {k: sorted(i for i, t in base.items() if plain_hit(t, text or "")) for k, text, _ in rows if k is not None}
    assert any(want.values()) and not all(want.values())
    got = {r.doc_id: r.item_ids for r in decontaminate.contaminated(docs, table).collect()}
    assert got == want


def test_decontaminate_in_rounds(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, prose(rng, "aa", 12)) for i in range(9)]
    docs = spark.createDataFrame([(k, prose(rng, "bb", 5) + " " + items[k % 9][1] + " " + items[(k + 3) % 9][1])
                                  for k in range(12)] + [(20, None)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    key = lambda d: sorted((r.doc_id, tuple(r.item_ids), r.n_items, r.contaminated) for r in d.collect())
    one = key(decontaminate.contaminated(docs, table))
    monkeypatch.setattr(decontaminate, "ROUND_CHARS", 100)
    assert key(decontaminate.contaminated(docs, table)) == one
    assert all(set(ids) >= {k % 9, (k + 3) % 9} for k, ids, *_ in one if k < 20)


# --- the pipeline

@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [(i, prose(rng, "aa", 30, 100)) for i in range(3)]
    rows, kind = [], {}

    def add(text, lang, name):
        kind[len(rows) * 3] = name
        rows.append((len(rows) * 3, text, lang, "s", len(text or "")))

    for lang in SYLLABLES:
        for _ in range(45):
            add(prose(rng, lang, rng.randint(60, 160)), lang, "clean")
    base = prose(rng, "aa", 120, 1000)  # one line, so that line dedup leaves the copies alone
    words = base.split(" ")
    words[60] = "kikiki"
    for text in (base, base, " ".join(words)):
        add(text, "aa", "copy")
    repeated = "\n".join(prose(rng, "bb", 9) for _ in range(4))
    for _ in range(3):
        add(prose(rng, "bb", 70) + "\n" + repeated + "\n" + prose(rng, "bb", 50), "bb", "lines")
    add(repeated, "bb", "gone")  # nothing is left of it
    add(prose(rng, "aa", 50) + " " + items[1][1] + " " + prose(rng, "aa", 40), "aa", "leak")
    for _ in range(3):
        add(" ".join("".join(rng.choice("QXJW0123456789+/=") for _ in range(24)) for _ in range(60)), None, "junk")
    for text in (None, "", "123 456", " \n"):
        add(text, None, "empty")
    folder = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in ("lang_pred", "accepted", "kept", "item_ids", "tokens")})
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, kind, items


def plain_lines(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines = (text or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i:i + 3])
            if not "".join(window).strip(" \t\r"):
                continue
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone:
            out[doc_id] = text
        elif left.strip():
            out[doc_id] = left
    return out


def plain_kept(rows):
    sets, root = {}, {}
    for doc_id, text in rows:
        w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        sets[doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
        root[doc_id] = doc_id
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {k: low if r == high else r for k, r in root.items()}
    return {k for k, r in root.items() if k == r}


def test_stages(spark, corpus):
    folder, kind, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        docs = cp.staged(out, name)
        assert name == "tokens" or docs.columns == list(cp.COLUMNS)
        before, rows = seen[list(seen)[-1]] if seen else given, docs.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        after = {r.doc_id: r.text for r in rows} if name != "tokens" else {r.doc_id: r for r in rows}
        if name == "language":
            assert all(after[k] == before[k] for k in after)
            kept = {k for k in given if kind[k] not in ("junk", "empty")}
            assert set(after) <= kept and len(kept - set(after)) <= 0.05 * len(kept)
            assert not {k for k in kept - set(after) if kind[k] != "clean"}
        elif name == "lines":
            assert after == plain_lines(before.items())
            assert any(kind[k] == "gone" for k in set(before) - set(after))
        elif name == "near_duplicates":
            assert set(after) == plain_kept(before.items()) and all(after[k] == before[k] for k in after)
            assert sum(kind[k] == "copy" for k in after) == 1
        elif name == "benchmark":
            hit = {k for k, t in before.items() if any(plain_hit(i, t) for _, i in items)}
            assert set(after) == set(before) - hit and {kind[k] for k in hit} == {"leak"}
        else:
            model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(cp.PIECES))
            assert set(after) == set(before)
            for k, r in after.items():
                assert r.round_trip and r.n_tokens == len(r.tokens) and r.n_bytes == len(before[k].encode())
                assert model.decode(list(r.tokens)).strip() == before[k].strip()
        seen[name] = after
    final = {r.doc_id: list(r.tokens) for r in cp.run(spark, folder).collect()}
    assert final == {k: list(r.tokens) for k, r in seen["tokens"].items()}


def test_empty_corpus(spark, corpus, tmp_path):
    folder, *_ = corpus
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
