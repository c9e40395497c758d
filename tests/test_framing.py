"""Flows with damaged units: the units around them are kept, the damage is an error row."""
import datetime as dt
import random
import struct

from tidewire import config
from tidewire.operators import ordered, pdus as pd_
from tidewire.streaming.frames import frame_pdus_stream

T0 = dt.datetime(2024, 1, 5, 12, 0, 0)
SCHEMA = ("packet_id long, timestamp timestamp, src_ip string, src_port int, dst_ip string, dst_port int, "
          "payload binary")


def unit(n, command=4, length=None):
    return struct.pack(">IIII", 16 + n if length is None else length, command, 0, n) + bytes([n % 200 + 40]) * n


def flows():
    """flow -> byte strings of its units in order, damaged ones with a length too small or too large."""
    rng = random.Random(9)
    out = {"one": [unit(9), unit(30, length=3), unit(7), unit(8), unit(5)], "start": [unit(4, length=0), unit(6)],
           "end": [unit(6), unit(50, length=15)], "short": [unit(3), b"\0\0\0\5" + b"\xff" * 5, unit(2), b"\0\0\0\1"],
           "huge": [unit(9), unit(20, length=1 << 31), unit(7), unit(70_001 - 16), b"\xff" * 900, unit(9)],
           None: [unit(20), unit(11, length=2), unit(5)], "part": [unit(3), unit(60)[:40]]}
    for k in range(2):
        out[f"r{k}"] = [unit(rng.randrange(200), length=rng.choice((None, None, None, rng.randrange(16))))
                        for _ in range(80)] + [b"\0\0\0"] * (k % 2)
    return out


def packets(spark, rng):
    rows, pid = [], 0
    for flow, units in flows().items():
        data, at = b"".join(units), 0
        while at < len(data):
            step = rng.randrange(1, 60) if flow != "huge" else rng.randrange(1, 5000)
            rows.append((pid, T0 + dt.timedelta(milliseconds=pid * 40), flow, 1, "x", 2775, data[at:at + step]))
            at, pid = at + step, pid + 1
    return spark.createDataFrame(rows, SCHEMA)


def expected(units, longest=pd_.LONGEST):
    """(start, bytes, damaged), read byte by byte."""
    data, at, out = b"".join(units), 0, []
    while at + 16 <= len(data):
        length = int.from_bytes(data[at:at + 4], "big")
        to, bad = at + length, not 16 <= length <= longest
        if bad:
            to = min(len(data), at + longest, next(
                (q for q in range(at + 1, len(data) - 7) if 16 <= int.from_bytes(data[q:q + 4], "big") <= longest
                 and int.from_bytes(data[q + 4:q + 8], "big") in config.COMMANDS), len(data)))
        if to > len(data):
            break
        out.append((at, data[at:to], bad))
        at = to
    return out


def found(rows, flow):
    return sorted((r["unit_start"], bytes(r["raw"]), r["error"] is not None) for r in rows if r["src_ip"] == flow)


def test_damaged_units(spark, monkeypatch):
    monkeypatch.setattr(pd_, "FAN", 3)  # tables are put together over several levels
    p = packets(spark, random.Random(2)).cache()
    wanted = {flow: expected(units) for flow, units in flows().items()}
    assert [w[2] for w in wanted["one"]] == [False, True, False, False, False]
    assert [w[2] for w in wanted["huge"]] == [False, True, False, True, True, False]
    for size, longest in ((1 << 25, pd_.LONGEST), (60_000, pd_.LONGEST), (600, 250), (97, 60), (40, 20)):
        rows = pd_.frame_pdus(p, segment_bytes=size, longest=longest).collect()
        for flow, units in flows().items():
            if longest < 100 and flow == "huge":
                continue
            assert found(rows, flow) == expected(units, longest), (size, flow)
    counted = pd_.capture_counts(p, pd_.frame_pdus(p)).first()
    assert counted.parse_errors == sum(w[2] for v in wanted.values() for w in v)
    assert counted.pdus_parsed == sum(not w[2] for v in wanted.values() for w in v)
    assert pd_.frame_pdus(p.limit(0)).collect() == []


def test_odd_packets(spark):
    whole = b"".join([unit(30), unit(9), unit(41)])
    rows = [(None, None, "a", 1, "x", None, whole[:20]), (2, T0, "a", 1, "x", None, whole[20:50]), (3, T0, "a", 1, "x", None, b""),
            (3, T0, "a", 1, "x", None, None), (4, T0, "a", 1, "x", None, whole[50:])]
    got = pd_.frame_pdus(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [bytes(r["raw"]) for r in sorted(got, key=lambda r: r["unit_start"])] == [unit(30), unit(9), unit(41)]
    assert {r["dst_port"] for r in got} == {None}


def test_damaged_units_in_a_stream(spark, tmp_path):
    p = packets(spark, random.Random(3))
    p.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    run = frame_pdus_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    for flow, units in flows().items():
        size = len(b"".join(units))
        # a damaged unit at the end stays open
        assert found(rows, flow) == [w for w in expected(units) if not (w[2] and w[0] + len(w[1]) == size)], flow


def test_jump_table_takes_few_steps(monkeypatch):
    # all entries are followed at once, and a table is stored as what changes from entry to entry
    rng, parts = random.Random(3), []
    for _ in range(60):
        body = "".join(rng.choice("ab \u0434") for _ in range(rng.randrange(60))).encode("utf-16-be")
        parts.append((16 + len(body)).to_bytes(4, "big") + (4).to_bytes(4, "big") + bytes(8) + body)
        parts.append(rng.choice([b"", b"\x7f\xff\xff\xff\xff", bytes(9), b"\x00\x00\x00\x05abc"]))
    data, longest = b"".join(parts), 700
    pd_step = pd_.step
    heads, size, calls = pd_.plausible_headers(data, longest), len(data) - longest - 16, []
    want = []
    for pos in range(longest):
        while pos < size:
            pos, _ = pd_step(data, heads, pos, longest)
        want.append(min(pos - size, longest - 1))
    monkeypatch.setattr(pd_, "step", lambda *a: calls.append(a) or pd_step(*a))
    table = pd_.jump_table(data, size, longest)
    assert table.tolist() == want and len(calls) < longest // 2
    packed = pd_._packed(table)
    assert pd_._unpacked(packed).tolist() == want and len(packed) < table.nbytes // 4


def test_packets_are_written_once(spark):
    """No window and no join moves payloads: they are put in order by one shuffle, then dealt into groups of segments."""
    plan = pd_.frame_pdus(packets(spark, random.Random(3)), segment_bytes=1000, longest=500)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "FlatMapCoGroupsInPandas" in physical
    for line in physical.splitlines():
        assert "payload" not in line or ("Window" not in line and "SortMergeJoin" not in line)


def test_starts_in_ranges(spark):
    rng = random.Random(4)
    rows = [(f"f{rng.choice((0, 0, 0, 1, 2))}", k, rng.randrange(5), f"p{k}") for k in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered.starts_in_ranges(spark.createDataFrame(rows, "g string, k int, n int, p string").repartition(3), "g", "k", "n")
        found = {r["p"]: r["start"] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    at = {}
    for g, _, n, p in rows:
        assert found[p] == at.get(g, 0)
        at[g] = at.get(g, 0) + n
