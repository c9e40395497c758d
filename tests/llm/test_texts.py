"""Text operators against plain versions on small tables, odd rows included."""
import hashlib
import random
from itertools import combinations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewire.llm import (decontaminate, fm_index, langid, line_windows, near_text, personal_data, pieces,
                          suffix_sort, token_counts)

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [a + b for a in ("la", "Mo", "ré", "tu", "xi") for b in ("", "ne", "St", "über", "9")]
    text = lambda n: "".join(rng.choice(words) + rng.choice((" ", " ", ", ", ".\n")) for _ in range(n))
    base, passage = text(130), text(60)
    near = base.split(" ")
    near[40] = "changed"
    out = [None, "", " ", "a", "one two", "one two", "one two three\n\n\n", "z" * 700, "ab " * 300, base, base,
           " ".join(near), text(30) + passage + text(20), text(10) + passage, passage, "日本 😀 " * 20,
           "mail a.b@c.de, 10.0.0.1 or 4111 1111 1111 1111 and +1 (555) 123-4567 <|endoftext|> x"]
    out += [text(rng.randint(1, 200)) for _ in range(12)]
    return [(i * 3, t, "xx" if i % 2 else None, "extra") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_strings(docs, rows):
    seen, want = set(), {}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        cut = [False] * len(raw)
        for at in range(len(raw) - 99):
            if raw[at:at + 100] in seen:
                cut[at:at + 100] = [True] * 100
            seen.add(raw[at:at + 100])
        kept = bytes(b for b, c in zip(raw, cut) if not c)
        want[i] = (len(raw), sum(cut), sum(c and not (k and cut[k - 1]) for k, c in enumerate(cut)),
                   hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_sort.without_repeats(docs).collect()}
    assert got == want


def test_passages(docs, rows):
    seen, want = {}, {}
    for i, text, *_ in rows:
        w = (text or "").encode().split()
        for at in range(len(w) - 49):
            seen.setdefault(tuple(w[at:at + 50]), i)
    for i, text, *_ in rows:
        w = (text or "").encode().split()
        cut = [False] * len(w)
        for at in range(len(w) - 49):
            if seen[tuple(w[at:at + 50])] < i:
                cut[at:at + 50] = [True] * 50
        want[i] = (len(w), sum(cut), b" ".join(x for x, c in zip(w, cut) if not c).decode())
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in fm_index.without_repeats(docs).collect()}
    assert got == want


def test_near_text_shared_passage(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage[:rng.randint(50, 60)] + [f"w{k}_{i}" for i in range(rng.randint(0, 24))])
             for k in range(120)]
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(texts)))
    for a, b in combinations(root[:], 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    assert 3 < len(set(root)) < 100
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_text.near_duplicates(table).collect()}
    assert got == dict(enumerate(root))
    # every link is also found where no hub round has joined anything
    groups = {(r.a, r.b) for r in _linked_by_rare(table)}
    assert groups == {(a, b) for a, b in combinations(range(len(texts)), 2)
                      if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}


def _linked_by_rare(table):
    sets = table.mapInArrow(near_text._sets, "doc_id long, n long, shingles binary")
    label = sets.select("doc_id", F.col("doc_id").alias("root"), "n")
    placed = near_text._mixed(near_text.rare_shingles(sets, 75), label, 1)
    pairs = near_text._across(placed, 75).distinct()
    return near_text.confirmed(pairs, sets, 75).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().collect()


def test_near_text(docs, rows):
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").encode().translate(LOWER).split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in combinations(sorted(sets), 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = near_text.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == \
        {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def test_lines(spark, rows):
    table = spark.createDataFrame([(1, "a\nb\nc\nd", 1), (2, "x\na\nb\nc\nd", 1), (3, "a\nb\nc", 1), (4, None, 1),
                                   (5, "\n\n\n\n", 1), (6, "q\nq\nq\nq\nq", 1)], "doc_id long, text string, n_lines long")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_windows.without_repeated_lines(table).collect()}
    assert got == {1: (4, 0, "a\nb\nc\nd"), 2: (5, 4, "x"), 3: (3, 3, ""), 4: (1, 0, None), 5: (5, 0, "\n\n\n\n"),
                   6: (5, 4, "q")}


def test_token_counts(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = token_counts.load(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in rows}


def test_pieces(docs, rows):
    v = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    got = pieces.tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    # best score by a plain search over characters
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    known = {model.id_to_piece(i): v.scores[i] for i in range(len(v.scores))
             if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    is_byte = set(v.byte_ids.tolist())
    for text in ["one  two", "日本 😀x", "a\n\tb", "ré über9"]:
        marked = "▁" + text.replace(" ", "▁")
        best = [0.0]
        for end in range(1, len(marked) + 1):
            best.append(max([best[end - 1] + v.fallback] + [
                best[a] + known[marked[a:end]] for a in range(max(0, end - 48), end) if marked[a:end] in known]))
        ids, _ = pieces.encode([text], v)
        raw = [v.bytes_of[i][0] for i in ids if i in is_byte]
        score = sum(v.scores[i] for i in ids if i not in is_byte) + v.fallback * sum(b & 0xC0 != 0x80 for b in raw)
        assert abs(score - best[-1]) < 1e-6


def test_long_text_in_slices():
    v = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    for text in ["one  two three", "ab " * 30, " a  b   c▁ d ", "z" * 40, "x" + " " * 30, "日本 😀 " * 9]:
        parts = pieces.cut(text, 5)
        assert " ".join(parts) == text and all(parts)
        whole, _ = pieces.encode([text], v)
        assert sum((pieces.encode([p], v)[0].tolist() for p in parts), []) == whole.tolist()


def test_decontaminate(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from the barking hound tonight"
    broken = item.replace("quick", "quack").replace("lazy", "lzy")
    far = item.replace("quick", "slow").replace("lazy", "eager").replace("hound", "cat")
    docs = spark.createDataFrame([(1, f"Intro. {item.upper()} end"), (2, f"x {broken} y"), (3, far), (4, None), (5, "")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {1: [7], 2: [7], 3: [], 4: [], 5: []}


def test_language(spark):
    rng = random.Random(1)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["straße", "über", "schön"]}
    rows = [(i, " ".join(rng.choices(words[k], k=30)), k) for i, k in enumerate(["aa", "bb"] * 40)]
    rows += [(100, None, "aa"), (101, "123 456", None), (102, "Жизнь " * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert all(got[i].lang_pred == k and got[i].accepted for i, _, k in rows[:80])
    assert [got[i].lang_pred for i in (100, 101)] == ["und", "und"] and not got[102].accepted


def test_personal_data(docs, rows):
    got = {r.doc_id: r for r in personal_data.personal_data(docs, personal_data.fit()).collect()}
    assert len(got) == len(rows)
    row = got[16 * 3]
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert row.base_spans.startswith("email:5:13,ip:15:23,card:27:46,phone:")


def test_empty_tables(empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for result in (suffix_sort.without_repeats(empty), fm_index.without_repeats(empty),
                   near_text.near_duplicates(empty), line_windows.without_repeated_lines(empty),
                   token_counts.token_counts(empty, path), langid.identify(empty, langid.fit(empty)),
                   personal_data.personal_data(empty, personal_data.fit()),
                   pieces.tokens(empty, public_tokenizers.path("piece_bpe_32k.model")),
                   decontaminate.contaminated(empty, empty.withColumn("item_id", F.lit(1)))):
        assert result.count() == 0
