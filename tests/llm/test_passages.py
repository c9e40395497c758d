"""Hot anchors: windows over the edges of a shared passage part, whole copies are dealt out, nothing is lost."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.llm import fm_index, passages, suffix_sort

WIDTHS = {"byte": (100, 24), "word": (50, 12)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    header, copy = text(40), text(120)
    out = [f"{text(70)} {header} {text(70)}" for _ in range(60)] + [copy] * 60 + [None, "", "x", "\0" * 300, "\0" * 300]
    rng.shuffle(out)
    return [(i * 5 - 40, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("unit", ["byte", "word"])
def test_hot_anchors(spark, docs, unit):
    width, gram = WIDTHS[unit]
    hot = passages.hot_anchors(docs, unit, width, gram)
    assert len(hot.crowded) and len(hot.frequent)

    def most(hot):
        runs = docs.mapInArrow(passages._runs(unit, width, gram, spark.sparkContext.broadcast(hot)), passages.RUNS)
        crowd = runs.groupBy("anchor").agg(F.countDistinct("stretch").alias("n")).agg(F.max("n")).scalar()
        deal = runs.groupBy("anchor", "deal").count().agg(F.max("count")).scalar()
        return docs.select(crowd, deal).first()
    plain, steered = most(passages.NOTHING_HOT), most(hot)
    assert plain[0] >= 40 and steered[0] <= plain[0] / 4
    assert plain[1] >= 60 and steered[1] <= plain[1] / 4


def test_listed():
    known = np.array([3, 1 << 50, (1 << 64) - 1], np.uint64)
    marks = np.array([4, 3, (1 << 64) - 1, (1 << 50) + 1, 1 << 50], np.uint64)
    assert passages.listed(marks, known).tolist() == [False, True, True, False, True]
    assert not passages.listed(marks, known[:0]).any()


@pytest.mark.parametrize("least", [1, 8, 1000])
def test_results_do_not_depend_on_the_lists(docs, rows, monkeypatch, least):
    monkeypatch.setattr(passages, "CROWDED", least)
    monkeypatch.setattr(passages, "FREQUENT", least)
    for cut, parts, width, joint in ((suffix_sort, lambda t: t.encode(), 100, b""),
                                     (fm_index, lambda t: t.encode().split(), 50, b" ")):
        first, want = {}, {}
        for i, text in sorted(rows):
            got = parts(text or "")
            gone = [False] * len(got)
            for at in range(len(got) - width + 1):
                key = got[at:at + width] if joint == b"" else tuple(got[at:at + width])
                if key not in first:
                    first[key] = i
                elif joint == b"" or first[key] < i:
                    gone[at:at + width] = [True] * width
            want[i] = sum(gone)
        assert {r.doc_id: r.n_removed for r in cut.without_repeats(docs).collect()} == want


def test_grams_beside_look_at_a_stretch_once(spark, monkeypatch):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    header = words(40)
    texts = [f"{words(70)} {header} {words(70)}" for _ in range(30)]
    made, real = [], passages.grams_beside

    def kept(*args):
        made.append(real(*args))
        return made[-1]
    monkeypatch.setattr(passages, "grams_beside", kept)
    for copies in (1, 20):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * copies)], "doc_id long, text string").repartition(4)
        assert len(passages.hot_anchors(docs, "word", 50, 12).crowded)
    once, often = ({r["gram"]: r["n"] for r in m.groupBy("gram").agg(F.sum("n").alias("n")).collect()} for m in made)
    assert once == often and max(once.values()) >= passages.CROWDED


def test_rows_of_stretches_are_small():
    # anchors keep 40 bits; zeros beside zeros are what the shuffle's compression takes out
    codes, offsets = passages.UNITS["byte"](pa.array([bytes(random.Random(3).choices(range(97, 123), k=4000)).decode()]))
    anchor = passages.stretches(codes, offsets, 100, 24)[1]
    assert len(anchor) > 20 and not (anchor & 0xFFFFFF).any() and len(set(anchor.tolist())) > 20


def test_span_lists(spark):
    rows = [(1, 0, 100), (1, 0, 100), (1, (1 << 31) - 5000, (1 << 31) - 1), (2, 7, 4202)]
    found = passages.span_lists(spark.createDataFrame(rows, "doc_id long, begin long, end long"))
    assert found.schema["spans"].dataType.simpleString() == "array<struct<begin:bigint,end:bigint>>"
    assert {r.doc_id: {tuple(s) for s in r.spans} for r in found.collect()} == {
        1: {(0, 100), ((1 << 31) - 5000, (1 << 31) - 1)}, 2: {(7, 4202)}}
