"""Feeds and files of the stream and table queries: their parts grow in number, not in size; nothing is worked out twice."""
import datetime as dt
import os

import pytest

from pyspark.sql import functions as F

from tidewire import config
from tidewire.plans import evaluation_queries, stream_queries
from tidewire.sources import tables as tb


class Stopped(Exception):
    pass


@pytest.fixture()
def fed(monkeypatch):
    seen = {}

    def feed(df, parts, path, files=4):
        seen.update(df=df, parts=parts, files=files)
        raise Stopped
    monkeypatch.setattr(stream_queries, "_feed", feed)
    return seen


def documents(spark, path):
    rows = [(i, "word and тест " * (20 + i % 7), "en", "web", 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(path / "documents.parquet"))
    return str(path)


def test_slices_of_the_framing_feed_are_bounded(spark, tmp_path, monkeypatch, fed):
    sf = documents(spark, tmp_path)
    monkeypatch.setattr(stream_queries, "SLICE_BYTES", 8000)
    with pytest.raises(Stopped):
        stream_queries.framed_stream(spark, sf)
    sizes = [fed["df"].where(c).count() for c in fed["parts"]]
    # every packet stands in one slice
    assert sum(sizes) == stream_queries.packets(spark, sf).count()
    assert len(sizes) > 3 and max(sizes) * 700 <= 3 * 8000


def test_files_of_the_packet_feed_are_bounded(spark, tmp_path, monkeypatch, fed):
    sf = documents(spark, tmp_path)
    monkeypatch.setattr(stream_queries, "FEED_BYTES", 8000)
    with pytest.raises(Stopped):
        stream_queries.captured_packets_stream(spark, sf)
    assert fed["files"] > 4 and len(fed["parts"]) == 1


def test_feature_kinds_works_rows_out_once(spark, monkeypatch):
    names = list(dict.fromkeys([*config.RECONSTRUCTION_FEATURES, "day_of_week", "time_category_anomaly"]))
    kind = ", ".join(f"{c} double" for c in names)
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            passes.add(len(b))
            yield b
    rows = spark.createDataFrame([[float(i % 2 if c == "hour" else i) for c in names] for i in range(6)], kind)
    monkeypatch.setattr(evaluation_queries, "labelled_features", lambda *_: rows.mapInPandas(counted, kind))
    got = {tuple(r) for r in evaluation_queries.feature_kinds(spark, "").collect()}
    assert passes.value == 6
    assert {c for k, c in got if k == "binary"} == {"hour"} and ("categorical", "day_of_week") in got


def test_export_may_be_compressed(spark, tmp_path):
    text = 'a "quoted", text\nover lines ' * 50 + "end"
    rows = [(str(i), "s", "d", dt.datetime(2024, 1, 1, 0, 0, 9 - i), text, "c", i % 2 == 0, None) for i in range(5)]
    df = spark.createDataFrame(rows, tb.LABELLED_SCHEMA)
    path = str(tmp_path / "out")
    tb.export_csv(df, path, compression="gzip")
    assert {f.rsplit(".", 1)[1] for f in os.listdir(path) if f.startswith("part-")} == {"gz"}
    got = tb.read_messages_csv(spark, path).collect()
    assert {r["message_id"]: r["message_text"] for r in got} == {str(i): text for i in range(5)}


def test_packed_texts_come_back_whole(spark, tmp_path):
    texts = [None, "", "x", 'a "b", c', "ї" * 3000, "line\nbreak, \"q\"", "​ 😀"] * 60
    df = spark.createDataFrame([(str(i), t, i) for i, t in enumerate(texts)], "message_id string, message_text string, n int")
    packed = tb.pack_text(df, "message_text")
    assert dict(packed.dtypes)["message_text"] == "binary"
    assert packed.where("message_id = '4'").select(F.octet_length("message_text")).first()[0] < 200
    back = tb.unpack_text(packed, "message_text")
    assert back.schema == df.schema and sorted(back.collect(), key=lambda r: r.n) == df.collect()
    paths = [str(tmp_path / x) for x in ("plain", "packed")]
    tb.export_csv(df, paths[0], by="n")
    tb.export_csv(packed, paths[1], by="n", packed="message_text")
    read = [sorted(tb.read_messages_csv(spark, p, schema=df.schema).collect(), key=lambda r: r.n) for p in paths]
    assert read[0] == read[1] and len(read[0]) == len(texts)
