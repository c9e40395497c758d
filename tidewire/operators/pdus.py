"""Jobs over protocol data units: build, frame, decode, select, report."""
from __future__ import annotations

import zlib
from bisect import bisect_right

from pyspark.sql import DataFrame, functions as F

from .. import config
from ..functions import pdu as pf, sender as sn, text as tx
from ..functions.chars import JSPACE
from ..session import cut_lineage
from ..sources.tables import with_pdu_defaults
from .ordered import starts_in_ranges

FLOW = ["src_ip", "src_port", "dst_ip", "dst_port"]
PORT = 2775


def named_codes(df: DataFrame, col: str, table: dict[int, str], out: str) -> DataFrame:
    """Attach the name of a code; unlisted codes show as ``Unknown (0x...)``.

    The tables have a few dozen fixed entries and are part of the expression.
    """
    names = F.create_map(*[x for code, name in table.items()
                           for x in (F.lit(code).cast("bigint"), F.lit(name))])
    code = F.col(col).cast("bigint")
    unknown = F.concat(F.lit("Unknown (0x"), F.lpad(F.hex(code), 8, "0"), F.lit(")"))
    return df.withColumn(out, F.coalesce(F.try_element_at(names, code), unknown))


# ---- building ---------------------------------------------------------------------------------

def segment_messages(df: DataFrame, id="id", source="source_addr", dest="dest_addr",
                     text="message_text", ts="timestamp") -> DataFrame:
    """Submit units for every message: UTF-16BE, one unit up to 140 bytes, else 134-byte parts.

    Parts carry a six-byte header with reference, total and part number. The reference number and
    the sequence number are digits of checksums of the message id, so the job repeats exactly.
    """
    clean = F.col(text)
    for old, new in (("–", "-"), ("—", "-"), ("…", "...")):
        clean = F.replace(clean, F.lit(old), F.lit(new))
    clean = tx.strip(F.regexp_replace(clean, F.lit(f"{JSPACE}+"), F.lit(" ")))
    ascii_only = lambda c: F.encode(F.regexp_replace(
        F.col(c), F.lit(r"[^\x00-\x7f]"), F.lit("?")), "ISO-8859-1")
    rows = df.select(F.col(id).alias("message_id"), F.col(ts).alias("timestamp"),
                     ascii_only(source).alias("_s"), ascii_only(dest).alias("_d"),
                     F.encode(clean, "UTF-16BE").alias("_m"))
    size = F.octet_length("_m")
    parts = F.when(size <= 140, 1).otherwise(F.ceil(size / F.lit(134)).cast("int"))
    rows = rows.withColumn("_parts", parts).withColumn(
        "part", F.explode(F.sequence(F.lit(1), F.col("_parts"))))
    many = F.col("_parts") > 1
    low = lambda c: pf.byte_text(F.pmod(c, F.lit(256)))
    head = F.concat(F.unhex(F.lit("050003")), F.unhex(F.substring(F.md5(F.col("message_id").cast("string")), 1, 2)), low(F.col("_parts")),
                    low(F.col("part")))
    piece = F.substring(F.col("_m"), (F.col("part") - 1) * 134 + 1, F.when(many, 134).otherwise(140))
    rows = rows.withColumn("_short", F.when(many, F.concat(head, piece)).otherwise(piece))
    zero, one = F.unhex(F.lit("00")), F.unhex(F.lit("0101"))
    body = F.concat(
        zero, one, F.col("_s"), zero, one, F.col("_d"), zero,
        F.when(many, F.unhex(F.lit("40"))).otherwise(zero), F.unhex(F.lit("0000")), zero, zero,
        F.unhex(F.lit("01000800")), pf.byte_text(F.octet_length("_short")), F.col("_short"))
    rows = rows.withColumn("raw_body", body).withColumns({
        "command_id": F.lit(4).cast("bigint"), "command_name": F.lit("submit_sm"),
        "command_status": F.lit(0).cast("bigint"),
        "sequence_number": F.conv(F.substring(F.md5(F.concat_ws(":", "message_id", "part")), 1, 7), 16, 10).cast("bigint"),
        "command_length": (F.octet_length("raw_body") + 16).cast("int")})
    rows = rows.withColumn("raw_header", F.concat(
        pf.byte_text(F.col("command_length"), 4), pf.byte_text(F.col("command_id"), 4),
        pf.byte_text(F.col("command_status"), 4), pf.byte_text(F.col("sequence_number"), 4)))
    rows = rows.withColumn("raw_data", F.lower(F.hex(F.concat("raw_header", "raw_body"))))
    keys = rows.select("message_id", "part", *[c for c in rows.columns if c.startswith(
        ("raw_", "command_", "sequence"))], "timestamp",
        (F.col("message_id") * 100_000 + F.col("part")).alias("id"))
    stored = with_pdu_defaults(keys.select("*"))
    return stored.withColumns({"message_id": F.floor(F.col("id") / 100_000),
                               "part": F.pmod("id", F.lit(100_000)).cast("int")})


# ---- decoding ---------------------------------------------------------------------------------

def decode_pdus(df: DataFrame, body: str = "raw_body", lenient: bool = False) -> DataFrame:
    return pf.decode_unit_lenient(df, body) if lenient else pf.decode_body(df, body)


def store_messages(decoded: DataFrame) -> DataFrame:
    """Message rows from decoded units: the good ones, with ingest flags."""
    from ..config import INGEST_VERSION
    good = decoded.where(F.col("error").isNull())
    clock = sn.clock("timestamp")
    rows = good.withColumns(clock)
    flags = {**tx.basic_flags(length=F.col("message_length")),
             **sn.time_flags("hour", "day_of_week", "ingest")}
    rows = rows.withColumns(flags).withColumns({
        "features_extracted": F.lit(1), "feature_extraction_version": F.lit(INGEST_VERSION)})
    return rows.select(
        F.col("id").alias("pdu_id"), "timestamp", "source_addr", "source_addr_ton",
        "source_addr_npi", "dest_addr", "dest_addr_ton", "dest_addr_npi", "message_text",
        "message_length", "data_coding", "esm_class", "priority_flag", "message_parts",
        *flags, "hour", "day_of_week", "features_extracted", "feature_extraction_version")


def pending_pdus(pdus: DataFrame, messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Submit and deliver units without a message row, newest first."""
    todo = pdus.where(F.col("command_name").isin("submit_sm", "deliver_sm")).join(
        messages.select(F.col("pdu_id").alias("id")), "id", "left_anti")
    return todo if limit is None else todo.orderBy(F.desc("timestamp"), "id").limit(limit)


def decode_report(decoded: DataFrame) -> DataFrame:
    """Decoded and failed counts, by error."""
    return decoded.groupBy("error").agg(F.count(F.lit(1)).alias("total"))


def first_errors(decoded: DataFrame, n: int = 10) -> DataFrame:
    """The first n bad rows with the head of their body."""
    bad = decoded.where(F.col("error").isNotNull())
    return bad.orderBy("id").limit(n).select(
        "id", "error", F.octet_length("raw_body").alias("body_length"),
        F.hex(F.substring("raw_body", 1, 50)).alias("body_head"))


def command_counts(pdus: DataFrame) -> DataFrame:
    return pdus.groupBy("command_name").agg(F.count(F.lit(1)).alias("total")).orderBy(
        F.desc("total"), "command_name")


def status_counts(pdus: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent non-zero statuses with their names."""
    top = pdus.where("command_status != 0").groupBy("command_status").agg(
        F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "command_status").limit(n)
    return named_codes(top, "command_status", config.STATUS_CODES, "status_name")


def capture_filter(packets: DataFrame, port: int = PORT) -> DataFrame:
    """Packets of the protocol port that can hold at least one header."""
    return packets.where(((F.col("src_port") == port) | (F.col("dst_port") == port))
                         & (F.octet_length("payload") >= 16))


def capture_counts(packets: DataFrame, units: DataFrame) -> DataFrame:
    """packets_captured, pdus_parsed, parse_errors."""
    seen = packets.agg(F.count(F.lit(1))).scalar()
    return units.agg(F.count_if(F.col("error").isNull()).alias("pdus_parsed"),
                     F.count_if(F.col("error").isNotNull()).alias("parse_errors")).withColumn(
        "packets_captured", seen)


# ---- framing ----------------------------------------------------------------------------------
#
# The unit boundaries of a flow form a chain, each unit saying where the next one starts. No unit is longer than
# ``longest`` bytes: a length field below 16 or beyond that is damage, which ends at the next plausible header or after
# ``longest`` bytes. So where a chain goes on from a place is told by the bytes of the next ``longest``, and a flow of
# any size is cut into segments of bounded bytes, each with as many bytes of what follows:
#   1. every segment gives a table that says where a chain that enters it at any place comes out behind it;
#   2. tables of neighbours are put one after the other, group by group, until a flow has few left; walking down again
#      tells where the flow's own chain enters each segment;
#   3. every segment cuts the units that start in it.

_FLOW_TYPES = "src_ip string, src_port int, dst_ip string, dst_port int"

LONGEST = 70_000
HEADER = 16
#: tables that are put together at once
FAN = 128
#: small segments travel in groups of about so many bytes, as each needs the bytes that follow it
GROUP_BYTES = 1 << 20

_COMMANDS = sorted(config.COMMANDS)
#: offsets looked at in one go
_CHUNK = 1 << 20


def _fields(data: bytes, at: int, count: int):
    """The four-byte numbers at ``count`` offsets from ``at`` on."""
    import numpy as np
    b = np.frombuffer(data, np.uint8, count + 3, at).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


def plausible_headers(data: bytes, longest: int = LONGEST) -> list[int]:
    """All offsets with a believable length and a known command."""
    import numpy as np
    known, out = np.array(_COMMANDS, np.uint32), []
    for at in range(0, len(data) - 7, _CHUNK):
        values = _fields(data, at, min(_CHUNK + 4, len(data) - at - 3))
        fits = np.flatnonzero((values[:-4] >= HEADER) & (values[:-4] <= longest))
        out += (fits[np.isin(values[fits + 4], known)] + at).tolist()
    return out


def step(data: bytes, heads: list[int], pos: int, longest: int = LONGEST) -> tuple[int, bool]:
    """Where the piece at ``pos`` ends, and whether it is damaged; ``heads`` are the plausible headers.

    The end of a unit may lie behind the data, that of damage does not.
    """
    length = int.from_bytes(data[pos:pos + 4], "big") if pos + 4 <= len(data) else 0
    if HEADER <= length <= longest:
        return pos + length, False
    k = bisect_right(heads, pos)
    end = min(pos + longest, max(len(data), pos + 1))
    return min(end, heads[k]) if k < len(heads) else end, True


def jump_table(data: bytes, size: int, longest: int = LONGEST):
    """For every offset below ``longest`` where a chain may enter: the offset behind ``size`` where it comes out."""
    import numpy as np
    heads, width = plausible_headers(data, longest), min(longest, size)
    # one step from every entry
    at, lengths = np.arange(width), np.zeros(width, np.int64)
    count = max(0, min(width, len(data) - 3))
    if count:
        lengths[:count] = _fields(data, 0, count)
    places = np.append(np.array(heads, np.int64), np.iinfo(np.int64).max)
    damaged = np.minimum(np.minimum(at + longest, np.maximum(len(data), at + 1)), places[np.searchsorted(places, at, "right")])
    after = np.where((lengths >= HEADER) & (lengths <= longest), at + lengths, damaged)
    # twice as many steps a round
    while (inside := after < width).any():
        after[inside] = after[after[inside]]
    # few chains are left behind these entries; they are followed one by one
    left, which = np.unique(after, return_inverse=True)
    out: dict[int, int] = {}
    for entry in left.tolist():
        path, pos = [], entry
        while pos < size and pos not in out:
            path.append(pos)
            pos, _ = step(data, heads, pos, longest)
        end = out[pos] if pos < size else min(pos - size, longest - 1)
        out.update(dict.fromkeys([*path, entry], end))
    table = np.arange(longest, dtype=np.int32) - size
    table[:width] = np.array([out[e] for e in left.tolist()], np.int32)[which] if width else []
    return table


def _packed(table) -> bytes:
    """A table as bytes; neighbouring entries mostly come out at one place, so their differences are stored."""
    import numpy as np
    return zlib.compress(np.diff(table, prepend=np.int32(0)).astype(np.int32).tobytes(), 1)


def _unpacked(jumps):
    import numpy as np
    return np.cumsum(np.frombuffer(zlib.decompress(bytes(jumps)), np.int32), dtype=np.int32)


def _segments(pdf, width: int, group: int, longest: int):
    """Per segment of a group: its number, its bytes and what follows them, its own size, packet ends and times."""
    import numpy as np
    pdf = pdf.sort_values("start")
    origin, whole = int(pdf["start"].iloc[0]), b"".join(pdf["payload"])
    ends = np.cumsum([len(x) for x in pdf["payload"]]) + origin
    first = int(pdf["_g"].iloc[0]) * group
    for segment in range(first, first + group):
        at = segment * width - origin
        if at >= len(whole):
            break
        data = whole[at:at + width + longest + HEADER]
        yield segment, data, min(width, len(data)), ends, pdf["us"].to_numpy() if "us" in pdf else None


def _tables(width: int, group: int, longest: int):
    def run(pdf):
        import pandas as pd
        found = [(segment, _packed(jump_table(data, size, longest)))
                 for segment, data, size, *_ in _segments(pdf, width, group, longest)]
        frame = pd.DataFrame(found, columns=["segment", "jumps"])
        frame.insert(0, "flow", pdf["flow"].iloc[0])
        return frame
    return run


def _compose(key, pdf):
    """One table for the neighbouring segments of a group."""
    import numpy as np
    import pandas as pd
    pdf = pdf.sort_values("segment")
    table = None
    for jumps in pdf["jumps"]:
        jumps = _unpacked(jumps)
        table = jumps if table is None else jumps[table]
    return pd.DataFrame({"flow": [key[0]], "segment": [key[1]], "jumps": [_packed(table)]})


def _walk(pdf):
    """Where the chain enters each segment, given where it enters the first."""
    import numpy as np
    import pandas as pd
    pdf = pdf.sort_values("segment")
    at, entries = int(pdf["entry"].iloc[0]), []
    for jumps in pdf["jumps"]:
        entries.append(at)
        at = int(_unpacked(jumps)[at])
    return pd.DataFrame({"flow": pdf["flow"], "segment": pdf["segment"], "entry": entries})


def _entries(tables: DataFrame) -> DataFrame:
    """flow, segment, entry: composed tables up to few per flow, then walks down to the segments."""
    levels = [tables]
    while (levels[-1].agg(F.max("segment")).first()[0] or 0) >= FAN:
        group = F.expr(f"segment div {FAN}")
        levels.append(cut_lineage(levels[-1].groupBy("flow", group.alias("_g")).applyInPandas(
            _compose, "flow string, segment bigint, jumps binary"), "composed"))
    kind = "flow string, segment bigint, entry int"
    found = levels[-1].withColumn("entry", F.lit(0)).groupBy("flow").applyInPandas(_walk, kind)
    for level in reversed(levels[:-1]):
        above = found.select("flow", F.col("segment").alias("_g"), "entry")
        found = level.withColumn("_g", F.expr(f"segment div {FAN}")).join(above, ["flow", "_g"]) \
            .groupBy("flow", "_g").applyInPandas(_walk, kind)
    return found


def _cut(width: int, group: int, longest: int):
    """Units and damage that start in a group's segments; what the flow does not end is left out."""
    def run(pdf, entries):
        import numpy as np
        import pandas as pd
        out, entry = [], dict(zip(entries["segment"], entries["entry"]))
        for segment, data, size, ends, us in _segments(pdf, width, group, longest):
            heads, pos, first = plausible_headers(data, longest), int(entry[segment]), segment * width
            while pos < size and pos + HEADER <= len(data):
                after, _ = step(data, heads, pos, longest)
                if after > len(data):
                    break
                out.append((first + pos, data[pos:after], int(us[np.searchsorted(ends, first + after)])))
                pos = after
        frame = pd.DataFrame(out, columns=["unit_start", "raw", "us"])
        for c in FLOW:
            frame[c] = pd.Series([pdf[c].iloc[0]] * len(frame), dtype=object)
        return frame[[*FLOW, "unit_start", "raw", "us"]]
    return run


def unit_length(raw: str = "raw"):
    """The length field of a unit."""
    return F.conv(F.hex(F.substring(raw, 1, 4)), 16, 10).cast("bigint")


def framing_error(longest: int = LONGEST):
    """Why a piece of a flow is no unit; null for units."""
    return F.when(unit_length() < HEADER, F.lit("length below 16")).when(
        unit_length() > longest, F.lit(f"length above {longest}"))


def frame_pdus(packets: DataFrame, seq: str = "packet_id", ts: str = "timestamp",
               segment_bytes: int = 32 << 20, longest: int = LONGEST) -> DataFrame:
    """Units of every flow: flow columns, unit_start (byte offset), raw bytes, completion time, error.

    Packets count in (time, ``seq``) order, nulls first; equal ones by their bytes. Null flow columns are a flow like
    any other; packets without bytes do not count. A unit is complete when all its bytes have arrived; a trailing
    partial unit is left out. Damage, where a length field is below 16 or above ``longest``, comes with its bytes
    up to the next plausible header, ``longest`` bytes or the flow's end, and an ``error``; units have none.
    """
    size = F.octet_length("payload")
    rows = packets.where(size > 0).select(
        *[F.col(c).cast("int" if c.endswith("port") else "string").alias(c) for c in FLOW],
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), size.cast("bigint").alias("size"), "payload",
        F.col(seq).alias("_seq"))
    rows = rows.select("*", F.to_json(F.struct(*FLOW), {"ignoreNullFields": "false"}).alias("flow"),
                       F.struct("us", "_seq", F.xxhash64("payload")).alias("_order")).drop("_seq")
    placed = starts_in_ranges(rows, "flow", "_order", "size")
    # a packet counts in its own group of segments and in those that look ahead as far as it
    group = max(1, GROUP_BYTES // segment_bytes)
    wide, look = F.lit(group * segment_bytes), longest + HEADER
    low = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("start") - look) / wide))
    high = F.floor((F.col("start") + F.col("size") - 1) / wide)
    placed = placed.select(*FLOW, "flow", "us", "payload", "start", F.explode(F.sequence(low, high)).alias("_g"))
    tables = cut_lineage(placed.select("flow", "_g", "start", "payload").groupBy("flow", "_g").applyInPandas(
        _tables(segment_bytes, group, longest), "flow string, segment bigint, jumps binary"), "jumps")
    entries = _entries(tables).withColumn("_g", F.expr(f"segment div {group}"))
    cut = placed.groupBy("flow", "_g").cogroup(entries.groupBy("flow", "_g")).applyInPandas(
        _cut(segment_bytes, group, longest), f"{_FLOW_TYPES}, unit_start bigint, raw binary, us bigint")
    return cut.select(*FLOW, "unit_start", "raw", F.timestamp_micros("us").alias("timestamp"),
                      framing_error(longest).alias("error"))
