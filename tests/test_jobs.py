import datetime as dt
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions import pdu as pf
from tidewire.operators import activity as ac, evaluation as ev, iforest as fo, ordered as od
from tidewire.operators import pdus as pd_, prepare as pr, thresholds as th
from tidewire.sources import tables as tb

T0 = dt.datetime(2024, 1, 5, 12, 0, 0)


def test_bursts_match_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        hot = rng.random() < 0.4
        s = "BULK" if hot else f"s{rng.randrange(20)}"
        us = rng.randrange(0, 3600) * 1_000_000 + rng.choice([0, 0, 1])
        rows.append((i, T0 + dt.timedelta(microseconds=us), s, f"r{rng.randrange(15)}"))
    rows += [(2000 + i, T0, "EDGE", "e") for i in range(30)]
    rows += [(3000, T0 + dt.timedelta(seconds=180), "EDGE", "e"),
             (3001, T0 + dt.timedelta(seconds=180, microseconds=1), "EDGE2", "e")]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp, source_addr string, dest_addr string")
    got = {r["id"]: r for r in ac.address_activity(df).collect()}
    w = dt.timedelta(seconds=180)
    for i, t, s, d in rows:
        ns = sum(1 for _, t2, s2, _ in rows if s2 == s and t - w <= t2 <= t)
        nd = sum(1 for _, t2, _, d2 in rows if d2 == d and t - w <= t2 <= t)
        assert got[i]["sender_burst"] == int(ns > 30) and got[i]["recipient_burst"] == int(nd > 15)
        assert got[i]["sender_frequency"] == sum(1 for r in rows if r[2] == s)


@pytest.mark.parametrize("parts", ["1", "3", "16"])
def test_quantiles(spark, monkeypatch, parts):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=30_000), np.full(10_000, 0.25), [-0.0, 0.0]])
    rows = [(float(v), None if i % 3 else float(i % 7)) for i, v in enumerate(values)] + [(None, None), (math.nan, 1.0)]
    df = spark.createDataFrame(rows, "v double, w double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 0.98, 1.0]
    few = np.array([w for _, w in rows if w is not None])
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for accuracy in (200, 10_000):
            got = od.exact_quantiles(df, ["v", "w"], probs, accuracy=accuracy)
            for c, want in (("v", values), ("w", few)):
                assert np.allclose(got[c], np.percentile(want, [p * 100 for p in probs]), atol=1e-9)
        # brackets that miss are found out and widened
        select = od._select
        calls = []

        def narrow(data, wanted):
            calls.append(wanted)
            return select(data, {k: (99.0, 99.0, r) for k, (_, _, r) in wanted.items()} if len(calls) == 1 else wanted)

        monkeypatch.setattr(od, "_select", narrow)
        assert np.allclose(od.exact_quantiles(df, ["v"], [0.5])["v"], np.median(values))
        assert len(calls) == 2
        assert od.exact_quantiles(df.limit(0), ["v"], [0.5]) == {"v": [None]}
        assert od.exact_quantiles(df.where("v = 0.25").limit(1), ["v"], [0.1, 0.9]) == {"v": [0.25, 0.25]}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("parts", ["1", "7"])
def test_curve_in_ranges(spark, parts):
    rows = [(i, (i * 7919 % 613) / 613.0, int(i % 7 == 0)) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, score double, is_anomaly int")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.threshold: (r.tp, r.fp, r.positives, r.negatives) for r in ev.threshold_curve(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    p = sum(y for _, _, y in rows)
    for cut in {s for _, s, _ in rows}:
        tp = sum(y for _, s, y in rows if s >= cut)
        assert got[cut] == (tp, sum(s >= cut for _, s, _ in rows) - tp, p, 5000 - p)
    assert ev.threshold_curve(df.limit(0)).collect() == []


def test_one_vs_rest_auc(spark):
    rng = random.Random(5)
    names = ["a", "b", "c", "never"]
    rows = [(rng.choice(names[:3]), [rng.randint(0, 9) / 10 for _ in names]) for _ in range(300)]
    df = spark.createDataFrame([*rows, (None, [0.1] * 4), ("a", None)], "label string, scores array<double>")
    got = {r["class"]: r.roc_auc for r in ev.one_vs_rest_auc(df, classes=names).collect()}
    want = {}
    for k, name in enumerate(names[:3]):
        pos, neg = [s[k] for y, s in rows if y == name], [s[k] for y, s in rows if y != name]
        want[name] = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    want["(macro)"] = sum(want.values()) / 3
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert ev.one_vs_rest_auc(df.limit(0), classes=names).collect() == []


def test_thresholds(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.1, 0)],
                               "score double, is_anomaly int")
    assert abs(ev.roc_auc(ev.threshold_curve(df)).first()[0] - 5 / 6) < 1e-6
    best = th.f1_threshold(ev.threshold_curve(df)).first()
    assert best["threshold"] == 0.6
    low = df.withColumn("score", -F.col("score"))
    assert th.forest_threshold(low, "score", "is_anomaly") == -0.8


def body(text=b"\x00A", coding=8, esm=0, src=b"INFO", dst=b"380501234567"):
    return (b"\0\1\1" + src + b"\0\1\1" + dst + b"\0" + bytes([esm, 0, 0]) + b"\0\0"
            + bytes([1, 0, coding, 0, len(text)]) + text)


def test_decode_texts_and_errors(spark):
    udh = b"\x05\x00\x03\x07\x02\x01"
    bodies = [body("Привіт".encode("utf-16-be")), body(b"caf\xe9", 0), body("є".encode(), 4),
              body(b"\xff\xfe", 4), body(udh + "х".encode("utf-16-be"), 8, 0x40),
              body(b"\x04", 8), body()[:-1], b"short", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, raw_body binary")
    got = {r["id"]: r for r in pf.decode_body(df).collect()}
    assert [got[i]["message_text"] for i in range(5)] == ["Привіт", "café", "є", "ÿþ", "х"]
    assert (got[4]["ref_num"], got[4]["total_parts"], got[4]["part_num"]) == (7, 2, 1)
    assert got[5]["message_text"] == "�" and got[6]["error"] == "sm_length beyond the body"
    assert got[7]["error"].startswith("body shorter") and got[8]["error"] == "no body"


def unit(n, command=4):
    return struct.pack(">IIII", 16 + n, command, 0, n) + bytes([n % 251]) * n


def test_framing_segments(spark):
    rng = random.Random(5)
    sizes = {"a": [rng.randrange(0, 300) for _ in range(400)], "b": [10, 2000, 0, 7]}
    rows, pid = [], 0
    for flow, ns in sizes.items():
        data, at = b"".join(unit(n) for n in ns) + b"\0\0\0", 0
        while at < len(data):
            step = rng.randrange(1, 90)
            rows.append((pid, T0 + dt.timedelta(milliseconds=pid * 40), flow, 1, "x", 2775,
                         data[at:at + step]))
            at, pid = at + step, pid + 1
    schema = ("packet_id long, timestamp timestamp, src_ip string, src_port int, dst_ip string, "
              "dst_port int, payload binary")
    df = spark.createDataFrame(rows, schema)
    for size in (1 << 25, 900):
        out = pd_.frame_pdus(df, segment_bytes=size).collect()
        for flow, ns in sizes.items():
            mine = sorted((r["unit_start"], bytes(r["raw"])) for r in out if r["src_ip"] == flow)
            assert [raw for _, raw in mine] == [unit(n) for n in ns]


def test_forest_finds_outliers(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(600)]
    rows += [(1000 + i, 9.0 + i, -9.0, 9.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    params = {"trees": 25, "feature_share": 1.0}
    model = fo.Forest.fit(df, ["a", "b", "c"], params=params)
    scored = {r["id"]: r["score"] for r in model.score(df).collect()}
    assert all(-1 < s < 0 for s in scored.values())
    assert set(sorted(scored, key=scored.get)[:5]) == {1000, 1001, 1002, 1003, 1004}
    again = fo.Forest.fit(df.repartition(7), ["a", "b", "c"], params=params)
    assert again.nodes.reset_index(drop=True).equals(model.nodes.reset_index(drop=True))


def test_csv_encodings(spark, tmp_path):
    text = ("message_id,source_addr,dest_addr,submit_time,message_text,category,is_anomaly,"
            "anomaly_type\n1,INFO,380,2024-01-01 10:00:00,\"Привіт, світ\",otp,False,\n")
    for enc, raw in {"UTF-8": text.encode("utf-8-sig"), "UTF-16": text.encode("utf-16"),
                     "cp1251": text.encode("cp1251", "replace")}.items():
        path = tmp_path / f"{enc}.csv"
        path.write_bytes(raw)
        row = tb.read_messages_csv(spark, str(path), enc).first()
        assert row["message_id"] == "1" and row["message_text"] == "Привіт, світ"
    assert tb.read_messages_csv(spark, str(tmp_path / "UTF-16.csv"), "auto").count() == 1


def test_letters_of_all_encodings(spark):
    from tidewire.plans.table_queries import _JSHARED, _SHARED
    texts = [(k, "".join(map(chr, range(k, k + 64)))) for k in [*range(0, 0xD800, 64), *range(0xE000, 0x10FFFF, 64 * 97)]]
    df = spark.createDataFrame(texts, "k int, t string")
    both = df.select(*[F.regexp_replace("t", F.lit(p), F.lit("?")) for p in (_JSHARED, _SHARED)]).collect()
    assert len(both) == len(texts) and all(a == b for a, b in both)
    assert sum(len(a) - a.count("?") for a, _ in both) == 95 + 1 + 64 + 10 - 1


def test_preparation(spark):
    df = spark.createDataFrame([(i, float(i), float(2 * i), 1.0, float(i % 2)) for i in range(50)],
                               "id long, a double, b double, k double, f double")
    assert pr.drop_correlated(df, ["a", "b", "k", "f"]) == ["a", "k", "f"]
    assert pr.two_valued(df, ["a", "k", "f"]) == ["f"]
    split = pr.stratified_split(df, "f", "id")
    assert [r["n"] for r in split.groupBy("f").agg(F.sum("is_train").alias("n")).collect()] == [20, 20]


def test_reconstruction_is_centred(spark):
    import numpy as np
    from tidewire.operators.reconstruct import Reconstruction
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)) + 5
    rows = [(i, *map(float, r), i % 2, "abc"[i % 3]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, flag int, kind string")
    model = Reconstruction.fit(df, ["a", "b", "c", "d", "flag", "kind"], k=3, augment=False)
    m = np.array([r[0] for r in model.prepare(df).select("_x").orderBy("id").collect()])
    pc, mean = model.pca.pc.toArray(), np.array(model.center)
    want = (((m - mean) - (m - mean) @ pc @ pc.T) ** 2).mean(axis=1)
    got = [r[0] for r in model.errors(df).orderBy("id").select("error").collect()]
    assert np.abs(got - want).max() < 1e-9


def test_last_update_wins(spark):
    from tidewire.sources.tables import apply_updates
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(1, "x", 1), (1, "m", 2)], "id long, v string, n int")
    assert sorted(map(tuple, apply_updates(base, new, "id", ["v"], "n").collect())) == [(1, "m"), (2, "b")]


def test_trees_draw_alike_at_every_share():
    import pyarrow as pa
    n, slots = 4000, 30
    h = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63 - 1, n)
    batch = pa.RecordBatch.from_arrays([pa.array(h), pa.array([[float(i)] for i in range(n)])], names=["h", "x"])
    for share in (1.0, 0.3, 0.02, 0.0005):
        got = [t for out in fo._draw(slots, share)([batch]) for t in zip(*(out.column(c).to_pylist() for c in ("slot", "x", "order")))]
        pairs = {(s, x[0]) for s, x, _ in got}
        assert len(pairs) == len(got) and all(0 <= s < slots for s, _ in pairs)
        mean, var = n * slots * share, n * slots * share * (1 - share)
        assert abs(len(got) - mean) <= 5 * var ** 0.5 + 1e-9, share
        per = np.bincount([s for s, *_ in got], minlength=slots)
        assert np.all(np.abs(per - n * share) <= 6 * (n * share * (1 - share)) ** 0.5 + 1e-9)
        if share >= 0.02:
            order = np.array([o for *_, o in got])
            assert abs(order.mean() - 0.5) < 0.05 and len(set(order)) == len(order)


def test_forest_scores_follow_the_nodes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(900, 2)))] + [(900, 40.0, -40.0), (901, None, 0.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    model = fo.Forest.fit(df, ["a", "b"], psi=64, params={"trees": 20, "members": 2})
    trees = {}
    for r in model.nodes.itertuples():
        trees.setdefault((r.member, r.tree), {})[r.node] = r
    assert len(trees) == 40

    def path(tree, x):
        node = tree[0]
        while node.feature >= 0:
            node = tree[node.left if x[node.feature] < node.cut else node.right]
        return node.path

    got = {r["id"]: r for r in model.score(df).collect()}
    for i, a, b in rows[::37] + rows[-2:]:
        x = (a or 0.0, b or 0.0)
        means = [np.mean([path(t, x) for (m, _), t in trees.items() if m == member]) for member in (0, 1)]
        want = [-2.0 ** (-v / fo.average_path(64)) for v in means]
        assert np.allclose(got[i]["member_scores"], want) and abs(got[i]["score"] - np.mean(want)) < 1e-12
    assert min(got.values(), key=lambda r: r["score"])["id"] == 900


def test_last_rows_of_each_batch(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, 3, None]), i, float(i)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "batch long, pos long, score double").repartition(3)
    got = df.mapInArrow(th._last_of_each(20, 100), df.schema).collect()
    assert len(got) <= 3 * 4 * 20
    for b in (1, 2, 3, None):
        best = sorted((p for k, p, _ in rows if k == b), reverse=True)[:20]
        assert set(best) <= {r.pos for r in got if r.batch == b}


def test_late_rows_correct_bursts(spark, tmp_path):
    from tidewire.streaming.bursts import burst_updates, latest_flags
    rng = random.Random(8)
    rows = [(i, T0 + dt.timedelta(seconds=rng.randrange(2000)), rng.choice(["A", "B", "", None]), rng.choice(["x", "y"]))
            for i in range(500)]
    rows += [(900, T0, "A", "x"), (901, T0 + dt.timedelta(seconds=180), "A", "x")]
    rng.shuffle(rows)
    kind = "id long, timestamp timestamp, source_addr string, dest_addr string"
    for k in range(3):
        spark.createDataFrame(rows[k::3], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    burst_updates(stream, sender_limit=20, recipient_limit=25, late="1 day").writeStream.format("parquet").option(
        "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(str(tmp_path / "out"))
    assert updates.groupBy("id", "role").count().where("count > 1").count() > 0
    got = {r["id"]: (r["sender_burst"], r["recipient_burst"]) for r in latest_flags(updates).collect()}
    want = {r["id"]: (r["sender_burst"], r["recipient_burst"]) for r in ac.address_activity(
        spark.createDataFrame(rows, kind), sender_limit=20, recipient_limit=25).collect()}
    assert got == want and {1} <= {s for s, _ in want.values()}


def test_one_burst_state_holds_many_addresses():
    # a call takes all addresses of a bucket, so that calls do not grow with the number of addresses
    import pandas as pd
    from tidewire.streaming.bursts import BurstProcessor

    class Held:
        value = None

        def getValueState(self, *_):
            return self

        def registerTimer(self, _):
            pass

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    held, minute = Held(), 60_000_000
    state = BurstProcessor(3 * minute, 12 * minute, {"s": 2})
    state.init(held)

    def call(*rows):
        new = pd.DataFrame(rows, columns=["id", "us", "addr", "own"])
        out = pd.concat(state.handleInputRows(("s", 0, 1), iter([new]), None))
        return {r.id: r.burst for r in out.itertuples()}

    at = 12 * minute
    assert call((1, at, "a", True), (2, at + 1, "b", True), (3, at + 2, "a", True), (4, at + 3, "b", True)) == {1: 0, 2: 0, 3: 0, 4: 0}
    # the late row is context of another block: it changes the flag of "a" alone
    assert call((5, at - 1, "a", False)) == {3: 1}
    assert call((6, at + 3 * minute + 2, "b", True), (7, at + 5, "c", True)) == {6: 0, 7: 0}


def feature_table(spark, n=300):
    from tidewire import config
    rng = np.random.default_rng(5)
    cols = config.FOREST_FEATURES
    rows = [(i, int(rng.random() < 0.1), *map(float, rng.normal(size=len(cols)))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, is_anomaly int, " + ", ".join(f"{c} double" for c in cols))


def test_forest_queries_score_every_row_once(spark, monkeypatch):
    from tidewire import config
    from tidewire.plans import model_queries as mq
    monkeypatch.setitem(config.FOREST_PARAMS, "trees", 6)
    df = pr.add_composites(feature_table(spark))
    model = mq.fitted_forest(df)
    want = {r["id"]: (r["score"], r["vote"]) for r in model.vote(model.score(df)).collect()}
    calls, real = [], fo.Forest.score
    monkeypatch.setattr(fo.Forest, "score", lambda self, *a, **k: calls.append(1) or real(self, *a, **k))
    monkeypatch.setattr(mq, "feature_rows", lambda spark, sf: df)
    assert {r["id"]: (r["score"], r["vote"]) for r in mq.forest_scores(spark, "").collect()} == want
    assert len(calls) == 1
    assert mq.forest_summary(spark, "").first()["total_samples"] == 300
    assert len(calls) == 2


def test_correlations_add_blocks_up(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(3 * a + b) if i % 5 else None, 0.7, float(i), None) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    calls, real = [], pr.linear.summed
    monkeypatch.setattr(pr.linear, "summed", lambda *a: calls.append(1) or real(*a))
    got = pr.correlations(df, ["a", "b", "c", "d", "e"])
    assert calls == [1]  # one sum over blocks, not three aggregates per pair
    a, b, _, d, _ = (np.array([np.nan if v is None else v for v in c]) for c in zip(*rows))
    here = ~np.isnan(b)
    for pair, (x, y) in {("a", "b"): (a, b), ("b", "d"): (b, d), ("a", "d"): (a, d)}.items():
        both = here if "b" in pair else slice(None)
        assert got[pair] == pytest.approx(np.corrcoef(x[both], y[both])[0, 1], abs=1e-12)
    assert all(v is None for p, v in got.items() if "c" in p or "e" in p)
    assert pr.correlations(df.limit(0), ["a", "b"]) == {("a", "b"): None}


def test_reconstruction_works_its_matrix_out_once(spark, monkeypatch):
    from tidewire.operators import reconstruct as rc
    rng = np.random.default_rng(8)
    rows = [(i, *map(float, rng.normal(size=3)), float(i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, flag double")
    names, real = [], rc.cut_lineage
    monkeypatch.setattr(rc, "cut_lineage", lambda d, name: names.append(name) or real(d, name))
    model = rc.Reconstruction.fit(df, ["a", "b", "c", "flag"], k=2)
    assert names == ["matrix"]
    x = {r["id"]: np.array(r["_x"]) - model.center for r in model.prepare(df).collect()}
    comps = model.pca.pc.toArray()
    found = {r["id"]: r["error"] for r in model.errors(df).collect()}
    for i, v in x.items():
        assert found[i] == pytest.approx(max((v @ v - ((v @ comps) ** 2).sum()) / len(v), 0.0), abs=1e-12)
    assert {r["id"]: r["error"] for r in model.errors(df.repartition(9)).collect()} == found
