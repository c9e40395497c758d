"""Byte-level expressions for protocol data units, all inside the JVM.

A binary value is viewed twice: as Latin-1 text, where one character is one byte and text functions
find terminators, and as the binary itself, from which payload slices are cut. Offsets are 0-based.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import _col, let

REPLACEMENT = "�"


def uint(binary, offset: int, size: int) -> Column:
    """Big-endian unsigned integer at a fixed place."""
    return F.conv(F.hex(F.substring(_col(binary), offset + 1, size)), 16, 10).cast("bigint")


def parse_header(binary) -> Column:
    """Length, command, status and sequence from the first 16 bytes; null when there are fewer."""
    b = _col(binary)
    parts = F.struct(uint(b, 0, 4).alias("command_length"), uint(b, 4, 4).alias("command_id"),
                     uint(b, 8, 4).alias("command_status"),
                     uint(b, 12, 4).alias("sequence_number"))
    return F.when(F.octet_length(b) >= 16, parts)


def byte_text(value: Column | int, size: int = 1) -> Column:
    """Big-endian bytes of a non-negative integer."""
    v = F.lit(value) if isinstance(value, int) else value
    return F.unhex(F.lpad(F.hex(v), 2 * size, "0"))


def body_bytes(col, is_text: bool) -> Column:
    """The body as binary. Text is taken as hex when it is valid hex, else as Latin-1."""
    c = _col(col)
    if not is_text:
        return c
    compact = F.regexp_replace(c, F.lit(r"[ \t\n\x0b\f\r]+"), F.lit(""))
    return F.when(F.rlike(compact, F.lit("^(?:[0-9A-Fa-f]{2})*$")), F.unhex(compact)).otherwise(
        F.encode(c, "ISO-8859-1"))


def _byte(text: Column, at: Column) -> Column:
    return F.ascii(F.substring(text, at + 1, F.lit(1)))


def _after(text: Column, at: Column, n: Column) -> Column:
    """Offset behind the zero byte at or after ``at``; the end when there is none."""
    hit = F.position(F.lit("\0"), text, at + 1)
    return F.when((at < n) & (hit > 0), hit).otherwise(n)


def _string(text: Column, at: Column, after: Column, n: Column) -> Column:
    """Text between ``at`` and its terminator, non-ASCII bytes replaced."""
    ended = F.substring(text, after, F.lit(1)) == F.lit("\0")
    raw = F.substring(text, at + 1, F.greatest(
        after - at - F.when(ended & (after > at), 1).otherwise(0), F.lit(0)))
    return F.regexp_replace(raw, F.lit(r"[\x80-\xff]"), F.lit(REPLACEMENT))


def decode_text(payload, coding) -> Column:
    """Payload text: coding 8 is UTF-16BE, 0 Latin-1, anything else UTF-8 or else Latin-1."""
    b, c = _col(payload), _col(coding)
    latin = F.decode(b, "ISO-8859-1")
    return (F.when(c == 8, F.decode(b, "UTF-16BE")).when(c == 0, latin)
            .when(F.is_valid_utf8(b.cast("string")), F.decode(b, "UTF-8")).otherwise(latin))


def guess_text(b: Column) -> Column:
    """UTF-8 when valid, else cp1251 when every byte is defined there, else Latin-1."""
    latin = F.decode(b, "ISO-8859-1")
    return (F.when(F.is_valid_utf8(b.cast("string")), F.decode(b, "UTF-8"))
            .when(~F.contains(latin, F.lit("\x98")), F.decode(b, "windows-1251"))
            .otherwise(latin))


def decode_text_lenient(payload, coding) -> Column:
    """Payload text of the capture job: declared coding when it fits, else ``guess_text``."""
    b, c = _col(payload), _col(coding)
    fits = (F.octet_length(b) % 2 == 0) & (F.encode(F.decode(b, "UTF-16BE"), "UTF-16BE") == b)
    return (F.when(c.isin(0, 4), F.decode(b, "ISO-8859-1"))
            .when((c == 8) & fits, F.decode(b, "UTF-16BE")).otherwise(guess_text(b)))


def parse_udh(payload, esm_class) -> Column:
    """Split the user-data header off: user_data, ref_num, total_parts, part_num, message_parts."""
    b, esm = _col(payload), _col(esm_class)
    size = F.when(F.octet_length(b) > 0, uint(b, 0, 1))
    has = ((esm.bitwiseAND(0x40) != 0) & (F.octet_length(b) > 0) & (size + 1 <= F.octet_length(b)))
    multi = has & (size >= 5) & (uint(b, 1, 1) == 0) & (uint(b, 2, 1) == 3)
    pick = lambda at: F.when(multi, uint(b, at, 1).cast("int"))
    return F.struct(
        F.when(has, F.substring(b, (size + 2).cast("int"), F.octet_length(b))).otherwise(b)
        .alias("user_data"), pick(3).alias("ref_num"), pick(4).alias("total_parts"),
        pick(5).alias("part_num"), F.coalesce(pick(4), F.lit(1)).alias("message_parts"))


def barrier(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fix columns as computed: filters on what builds on them are not rewritten in their terms.

    Offsets build on each other, and a filter pushed below them would repeat every one of them
    inside the next. A one-row generator stops that without a shuffle.
    """
    rest = [c for c in df.columns if c not in cols]
    held = df.select(*rest, F.explode(F.array(F.struct(*cols))).alias("_held"))
    return held.select(*rest, *[F.col(f"_held.{c}").alias(c) for c in cols])


ERRORS = ["no body", "body shorter than 20 bytes", "ends before source_addr_ton",
          "ends before source_addr_npi", "ends before dest_addr_ton", "ends before dest_addr_npi",
          "ends before message flags", "ends before delivery flags", "sm_length beyond the body"]


def decode_body(df: DataFrame, body: str = "raw_body") -> DataFrame:
    """Decode submit and deliver bodies strictly; a bad row gets an ``error`` and null fields."""
    is_text = df.schema[body].dataType.simpleString() == "string"
    keep = df.columns
    t, n = F.col("_t"), F.col("_n")
    df = df.withColumn("_b", body_bytes(body, is_text))
    df = df.withColumns({"_t": F.decode("_b", "ISO-8859-1"), "_n": F.octet_length("_b")})
    df = df.withColumn("_o1", _after(t, F.lit(0), n))
    df = df.withColumn("_o4", _after(t, F.col("_o1") + 2, n))
    df = df.withColumn("_o5", _after(t, F.col("_o4") + 2, n))
    df = df.withColumn("_o7", _after(t, F.col("_o5") + 3, n))
    df = df.withColumn("_o8", _after(t, F.col("_o7"), n))
    o1, o4, o5, o7, o8 = (F.col(c) for c in ("_o1", "_o4", "_o5", "_o7", "_o8"))
    df = df.withColumns({"_esm": _byte(t, o5), "_coding": _byte(t, o8 + 2),
                         "_len": _byte(t, o8 + 4)})
    checks = [F.col("_b").isNull(), n < 20, o1 >= n, o1 + 1 >= n, o4 >= n, o4 + 1 >= n, o5 + 3 > n,
              o8 + 5 > n, o8 + 5 + F.col("_len") > n]
    error = None
    for cond, text in zip(checks, ERRORS):
        error = F.when(cond, text) if error is None else error.when(cond, text)
    df = barrier(df.withColumn("error", error), [
        "_b", "_t", "_n", "_o1", "_o4", "_o5", "_o7", "_o8", "_esm", "_coding", "_len", "error"])
    ok = F.col("error").isNull()
    df = df.withColumn("_udh", F.when(ok, parse_udh(
        F.substring(F.col("_b"), o8 + 6, F.col("_len")), F.col("_esm"))))
    good = lambda c: F.when(ok, c)
    fields = {
        "service_type": _string(t, F.lit(0), o1, n),
        "source_addr_ton": _byte(t, o1), "source_addr_npi": _byte(t, o1 + 1),
        "source_addr": _string(t, o1 + 2, o4, n),
        "dest_addr_ton": _byte(t, o4), "dest_addr_npi": _byte(t, o4 + 1),
        "dest_addr": _string(t, o4 + 2, o5, n),
        "esm_class": F.col("_esm"), "protocol_id": _byte(t, o5 + 1),
        "priority_flag": _byte(t, o5 + 2), "schedule_delivery_time": _string(t, o5 + 3, o7, n),
        "validity_period": _string(t, o7, o8, n), "registered_delivery": _byte(t, o8),
        "replace_if_present_flag": _byte(t, o8 + 1), "data_coding": F.col("_coding"),
        "sm_default_msg_id": _byte(t, o8 + 3), "sm_length": F.col("_len"),
        "message_text": decode_text(F.col("_udh.user_data"), F.col("_coding")),
    }
    df = df.withColumns({k: good(v) for k, v in fields.items()})
    df = df.withColumns({
        "message_length": F.length("message_text"), "ref_num": F.col("_udh.ref_num"),
        "total_parts": F.col("_udh.total_parts"), "part_num": F.col("_udh.part_num"),
        "message_parts": F.col("_udh.message_parts"), "user_data": F.col("_udh.user_data")})
    extra = ["message_length", "ref_num", "total_parts", "part_num", "message_parts", "user_data"]
    new = list(fields) + extra + ["error"]
    return df.select(*[c for c in keep if c not in new], *new)


def decode_unit_lenient(df: DataFrame, unit: str = "raw") -> DataFrame:
    """Decode whole units the way the capture job does: what is missing stays null, no errors."""
    keep = df.columns
    t, n = F.col("_t"), F.col("_n")
    df = df.withColumns({"_t": F.decode(unit, "ISO-8859-1"), "_n": F.octet_length(unit)})

    def cstring(start: str, end: str) -> None:
        nonlocal df
        hit = F.position(F.lit("\0"), t, F.col(start) + 1)
        df = df.withColumn(end, F.when((F.col(start) < n) & (hit > 0), hit).otherwise(F.col(start)))

    def skip(count: int, start: str, end: str) -> None:
        nonlocal df
        df = df.withColumn(end, F.when(F.col(start) + count <= n, F.col(start) + count).otherwise(
            F.col(start)))

    df = df.withColumn("_p0", F.lit(16))
    cstring("_p0", "_p1")
    skip(2, "_p1", "_p2")
    cstring("_p2", "_p3")
    skip(2, "_p3", "_p4")
    cstring("_p4", "_p5")
    skip(3, "_p5", "_p6")
    cstring("_p6", "_p7")
    cstring("_p7", "_p8")
    skip(5, "_p8", "_p9")
    df = barrier(df, ["_t", "_n"] + [f"_p{i}" for i in range(10)])

    def text_at(start: str, end: str) -> Column:
        raw = F.substring(F.col(unit), F.col(start) + 1, F.col(end) - F.col(start) - 1)
        return F.when(F.col(end) > F.col(start), guess_text(raw)).otherwise("")

    def octets(names: list[str], start: str) -> dict[str, Column]:
        there = F.col(start) + len(names) <= n
        return {x: F.when(there, _byte(t, F.col(start) + i)) for i, x in enumerate(names)}

    df = df.withColumns({
        "service_type": text_at("_p0", "_p1"),
        **octets(["source_addr_ton", "source_addr_npi"], "_p1"),
        "source_addr": text_at("_p2", "_p3"),
        **octets(["dest_addr_ton", "dest_addr_npi"], "_p3"),
        "dest_addr": text_at("_p4", "_p5"),
        **octets(["esm_class", "protocol_id", "priority_flag"], "_p5"),
        **octets(["registered_delivery", "replace_if_present_flag", "data_coding",
                  "sm_default_msg_id", "sm_length"], "_p8")})
    size = F.coalesce("sm_length", F.lit(0))
    there = (size > 0) & (F.col("_p9") + size <= n)
    df = df.withColumns({
        "message_text": F.when(there, decode_text_lenient(
            F.substring(F.col(unit), F.col("_p9") + 1, size), F.coalesce("data_coding", F.lit(0)))),
        "message_length": F.when(there, size)})
    new = ["service_type", "source_addr_ton", "source_addr_npi", "source_addr", "dest_addr_ton",
           "dest_addr_npi", "dest_addr", "esm_class", "protocol_id", "priority_flag",
           "registered_delivery", "replace_if_present_flag", "data_coding", "sm_default_msg_id",
           "sm_length", "message_text", "message_length"]
    return df.select(*[c for c in keep if c not in new], *new)


__all__ = ["ERRORS", "body_bytes", "byte_text", "decode_body", "decode_text", "decode_text_lenient",
           "decode_unit_lenient", "guess_text", "let", "parse_header", "parse_udh", "uint"]
