"""Personal data: base spans against the plain patterns, the field against enumeration and held-out labelled rows."""
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.llm import personal_data as pd_, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def plain(text):
    def digits(t):
        return [int(c) for c in t if c in "0123456789"]

    def luhn(n):
        return sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(reversed(n))) % 10 == 0

    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


@pytest.fixture(scope="module")
def field():
    return pd_.fit()


def odd_texts():
    rng = random.Random(2)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "+1 (555) 123-4567", "++12",
             "0" * 16, "é", "日本", " ", "\n", ".", "-", "+", "%", "12-34", "a@b.c@d.e", "a@b..c", "1.1.1.1@x.y", "٣٤", "word"]
    out = ["".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    return out + [t for t, _ in pd_.labelled_rows(5, 1)]


def test_base_spans():
    for text in odd_texts():
        assert pd_.base_spans(text) == sorted(plain(text)), text


def test_field_finds_held_out_rows(field):
    rows = list(pd_.labelled_rows(77, 8))
    found = pd_.all_spans(field, pa.array([t for t, _ in rows]))
    hit, wanted, added, right = Counter(), Counter(), Counter(), Counter()
    for (text, gold), (base, spans) in zip(rows, found):
        assert set(base) <= set(spans) and spans == sorted(spans)
        wanted.update(k for k, *_ in gold)
        hit.update(k for k, *_ in set(gold) & set(spans))
        added.update(k for k, *_ in set(spans) - set(base))
        right.update(k for k, *_ in (set(spans) - set(base)) & set(gold))
    for k, name in enumerate(pd_.KINDS):
        assert hit[k] >= 0.85 * wanted[k], name
        assert right[k] >= 0.85 * added[k] > 0, name


def test_decode_is_the_best_path():
    rng = np.random.default_rng(4)
    labels = 1 + len(pd_.KINDS)
    model = pd_.Field([], [], rng.normal(size=(labels, labels)))
    sizes = [1, 4, 2, 3, 1, 4]
    e = rng.normal(size=(sum(sizes), labels))
    heads = np.cumsum([0, *sizes[:-1]])
    got = pd_.decode(model, e, heads)
    for a, n in zip(heads, sizes):
        best = max(itertools.product(range(labels), repeat=n), key=lambda y: sum(e[a + i, k] for i, k in enumerate(y)) + sum(
            model.moves[p, q] for p, q in zip(y, y[1:])))
        assert got[a:a + n].tolist() == list(best)
    assert pd_.decode(model, e[:0], heads[:0]).tolist() == []


def test_neighbours_do_not_cross_texts(field):
    # what a text holds does not change with the texts around it, nor with its row's place
    texts = [t for t, _ in pd_.labelled_rows(9, 1)] + ["", None, "token", '= "', "tel", "5551234567"]
    alone = [pd_.all_spans(field, pa.array([t], pa.string()))[0] for t in texts]
    assert pd_.all_spans(field, pa.array(texts, pa.string())) == alone
    assert pd_.all_spans(field, pa.array(texts[::-1], pa.string())) == alone[::-1]


def test_rows(spark, field):
    clean = "plain words without anything of the kind, 12 of them in 2024 at 10:30. " * 3000
    rows = [(1, None), (2, ""), (3, clean), (4, 'a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" b'), (4, "4994226020900891"),
            (None, "ann at host dot org or (555) 123-4567"), (7, clean + "x@y.zz 1.2.3.4")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("spans", "n_email", "kind")}).repartition(2)
    got = sorted(pd_.personal_data(table, field).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_secret))
    assert [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_secret, r.n_spans) for r in got] == [
        (1, 0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0, 0), (4, 0, 0, 1, 0, 0, 1), (4, 0, 0, 0, 0, 1, 1),
        (7, 1, 1, 0, 0, 0, 2), (None, 1, 0, 0, 1, 0, 2)]
    assert got[3].spans == "card:0:16" and got[4].spans == "secret:11:51" and got[4].base_spans == ""
    assert pd_.personal_data(table.limit(0), field).collect() == []


def test_query_counts_base_spans(spark, tmp_path):
    # the field's spans are in spans, not in the counts that the contract fixes
    rows = [(1, "write to ann at host dot org or (555) 123-4567 today"), (2, "x@y.zz 1.2.3.4"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(queries.op10_personal_data(spark, str(tmp_path)).collect())
    assert [tuple(r[1:5]) for r in got] == [(0, 0, 0, 0), (1, 1, 0, 0), (0, 0, 0, 0)]
    assert [r.n_spans for r in got] == [2, 2, 0]
    for r, (_, text) in zip(got, rows):
        base = ",".join(f"{pd_.KINDS[k]}:{a}:{z}" for k, a, z in sorted(plain(text or "")))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
