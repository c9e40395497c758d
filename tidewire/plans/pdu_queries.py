"""Protocol-unit queries on units built from the document texts."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config
from ..functions import pdu as pf
from ..functions.chars import SPACE
from ..operators import pdus as pd_
from ..sources.tables import with_pdu_defaults
from . import sql_text as s
from .catalog import query
from .driver_tables import document_texts
from .sql_text import TEXTS, q, sql

# One message per document. Characters beyond the basic plane are masked so that every part of the
# expected text can be told by position.
PLAIN = f"""plain AS (SELECT doc_id, 'S' || doc_id % 20 || source AS src, CAST(380000000000 + doc_id AS VARCHAR) AS dst,
  regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(message_text, '[\\x{{10000}}-\\x{{10ffff}}]', '?', 'g'), '–', '-'), '—', '-'), '…', '...'),
    {q(SPACE + '+')}, ' ', 'g'), '^ | $', '', 'g') AS txt FROM texts)"""
PARTS = PLAIN + """,
sized AS (SELECT *, CASE WHEN 2 * length(txt) <= 140 THEN 1 ELSE CAST(ceil(2 * length(txt) / 134.0) AS INTEGER) END AS parts FROM plain),
part AS (SELECT *, CASE WHEN parts = 1 THEN txt ELSE substr(txt, 67 * (part - 1) + 1, 67) END AS piece,
    length(src) AS ls, length(dst) AS ld FROM (SELECT *, unnest(range(1, parts + 1)) AS part FROM sized)),
unit AS (SELECT *, 2 * length(piece) + CASE WHEN parts > 1 THEN 6 ELSE 0 END AS sm, doc_id * 100000 + part AS id FROM part)"""


# The bytes of a unit in hexadecimal, header and body.
BYTES = """bytes AS (SELECT *, printf('%08X0000000400000000%08X', 33 + ls + ld + sm, ('0x' || substr(md5(doc_id || ':' || part), 1, 7))::BIGINT) AS head,
  '000101' || hex(encode(src)) || '000101' || hex(encode(dst)) || '00' || CASE WHEN parts > 1 THEN '40' ELSE '00' END || '0000000001000800' || printf('%02X', sm)
  || CASE WHEN parts > 1 THEN '050003' || upper(substr(md5(doc_id::VARCHAR), 1, 2)) || printf('%02X%02X', parts % 256, part % 256) ELSE '' END
  || array_to_string(list_transform(string_split(piece, ''), lambda c: printf('%04X', unicode(c))), '') AS body FROM unit)"""


def text_units(spark, sf) -> DataFrame:
    docs = document_texts(spark, sf)
    rows = docs.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("S"), F.pmod("doc_id", F.lit(20)),
                                              "source").alias("source_addr"),
        (F.col("doc_id") + 380000000000).cast("string").alias("dest_addr"),
        F.regexp_replace("message_text", F.lit(r"[\x{10000}-\x{10ffff}]"), F.lit("?")).alias(
            "message_text"),
        F.timestamp_seconds(F.col("doc_id") * 30 + 1704067200).alias("timestamp"))
    return pd_.segment_messages(rows)


@query("segmented_units", sql(TEXTS, PARTS, body="""
SELECT id, doc_id AS message_id, CAST(part AS INTEGER) AS part, CAST(16 + 17 + ls + ld + sm AS INTEGER) AS command_length, 4::BIGINT AS command_id,
  CAST(2 * (33 + ls + ld + sm) AS INTEGER) AS hex_length FROM unit"""))
def segmented_units(spark, sf):
    """Units built from whole texts: parts and lengths."""
    return text_units(spark, sf).select("id", "message_id", "part", "command_length", "command_id",
                                        F.length("raw_data").alias("hex_length"))


@query("decoded_units", sql(TEXTS, PARTS, body="""
SELECT id, src AS source_addr, dst AS dest_addr, 1 AS source_addr_ton, 1 AS dest_addr_npi, CASE WHEN parts > 1 THEN 64 ELSE 0 END AS esm_class,
  8 AS data_coding, CAST(sm AS INTEGER) AS sm_length, piece AS message_text, CAST(length(piece) AS INTEGER) AS message_length,
  CASE WHEN parts > 1 THEN CAST(parts % 256 AS INTEGER) ELSE 1 END AS message_parts,
  CASE WHEN parts > 1 THEN CAST(part % 256 AS INTEGER) ELSE -1 END AS part_num, '' AS service_type FROM unit"""))
def decoded_units(spark, sf):
    """Strict decoding gives back addresses, part numbers and the text of every part."""
    return pd_.decode_pdus(text_units(spark, sf)).where("error IS NULL").select(
        "id", "source_addr", "dest_addr", "source_addr_ton", "dest_addr_npi", "esm_class",
        "data_coding", "sm_length", "message_text", "message_length", "message_parts",
        F.coalesce("part_num", F.lit(-1)).alias("part_num"), "service_type")


@query("decoded_hex_units", sql(TEXTS, PARTS, body="SELECT id, piece AS message_text FROM unit"))
def decoded_hex_units(spark, sf):
    """The same from bodies stored as hex text."""
    units = text_units(spark, sf).withColumn("raw_body", F.hex("raw_body"))
    return pd_.decode_pdus(units).select("id", "message_text")


@query("decoded_lenient", sql(TEXTS, PARTS, body="""
SELECT id, src AS source_addr, dst AS dest_addr, CASE WHEN parts > 1 THEN 64 ELSE 0 END AS esm_class, CAST(sm AS INTEGER) AS sm_length,
  CASE WHEN parts = 1 THEN piece ELSE '-' END AS single_text, CAST(coalesce(nullif(sm, 0), -1) AS INTEGER) AS message_length FROM unit"""))
def decoded_lenient(spark, sf):
    """Capture-style decoding of whole units; it leaves the part header in the text."""
    units = text_units(spark, sf).withColumn("raw", F.concat("raw_header", "raw_body"))
    out = pd_.decode_pdus(units.select("id", "raw"), "raw", lenient=True)
    return out.select("id", "source_addr", "dest_addr", "esm_class", "sm_length", F.when(
        F.col("esm_class") == 0, F.coalesce("message_text", F.lit(""))).otherwise("-").alias("single_text"),
        F.coalesce("message_length", F.lit(-1)).alias("message_length"))


_CUT_WHY = """WHEN k < 20 THEN 'body shorter than 20 bytes' WHEN k <= 1 THEN 'ends before source_addr_ton'
  WHEN k <= 2 THEN 'ends before source_addr_npi' WHEN k <= 4 + ls THEN 'ends before dest_addr_ton' WHEN k <= 5 + ls THEN 'ends before dest_addr_npi'
  WHEN k < 10 + ls + ld THEN 'ends before message flags' WHEN k < 17 + ls + ld THEN 'ends before delivery flags'
  WHEN k < 17 + ls + ld + sm THEN 'sm_length beyond the body'"""
CUT = "cut AS (SELECT *, least(17 + ls + ld + sm, id % 97) AS k FROM unit)"


@query("decode_errors", sql(TEXTS, PARTS, CUT, body="""
SELECT id, CASE """ + _CUT_WHY + " ELSE 'ok' END AS error FROM cut"))
def decode_errors(spark, sf):
    """Bodies cut at every possible place name the field they fail at."""
    return pd_.decode_pdus(cut_units(spark, sf)).select(
        "id", F.coalesce("error", F.lit("ok")).alias("error"))


def cut_units(spark, sf) -> DataFrame:
    return text_units(spark, sf).withColumn("raw_body", F.substring(
        F.col("raw_body"), F.lit(1), F.pmod("id", F.lit(97)).cast("int")))


_WHY = f"CASE {_CUT_WHY} END"


@query("decode_report", sql(TEXTS, PARTS, CUT, body=f"SELECT {_WHY} AS error, count(*) AS total FROM cut GROUP BY 1"))
def decode_report(spark, sf):
    """Good and bad rows by error."""
    return pd_.decode_report(pd_.decode_pdus(cut_units(spark, sf)))


@query("first_decode_errors", sql(TEXTS, PARTS, BYTES, "cut AS (SELECT *, least(17 + ls + ld + sm, id % 97) AS k FROM bytes)", body=f"""
SELECT id, error, CAST(k AS INTEGER) AS body_length, substr(body, 1, least(2 * k, 100)) AS body_head
FROM (SELECT *, {_WHY} AS error FROM cut) WHERE error IS NOT NULL ORDER BY id LIMIT 10"""))
def first_decode_errors(spark, sf):
    """The first ten bad rows with the head of their body."""
    return pd_.first_errors(pd_.decode_pdus(cut_units(spark, sf)))


@query("stored_messages", sql(TEXTS, PARTS, body="""
SELECT id AS pdu_id, piece AS message_text, CAST(length(src) AS INTEGER) AS source_addr_length,
  CAST(length(regexp_replace(piece, '^ +| +$', '', 'g')) = 0 AS INTEGER) AS empty_message, 1 AS dest_is_valid, 0 AS source_is_numeric,
  CAST((doc_id * 30 // 3600) % 24 AS INTEGER) AS hour, CAST((doc_id * 30 // 86400) % 7 AS INTEGER) AS day_of_week FROM unit"""))
def stored_messages(spark, sf):
    """Message rows with ingest flags from decoded units."""
    return pd_.store_messages(pd_.decode_pdus(text_units(spark, sf))).select(
        "pdu_id", "message_text", "source_addr_length", "empty_message", "dest_is_valid",
        "source_is_numeric", "hour", "day_of_week")


@query("pending_units", sql(TEXTS, PARTS, body="""
SELECT id, doc_id AS message_id FROM unit WHERE id % 2 = 1 ORDER BY doc_id DESC, id LIMIT 500"""))
def pending_units(spark, sf):
    """Units without a message row, newest first."""
    units = text_units(spark, sf)
    done = units.where("id % 2 = 0").select(F.col("id").alias("pdu_id"))
    return pd_.pending_pdus(units, done, 500).select("id", "message_id")


def _names_sql(col: str, table: dict[int, str]) -> str:
    return (f"CASE {col} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items())
            + f" ELSE 'Unknown (0x' || lpad(upper(to_hex({col})), 8, '0') || ')' END")


CODED = "coded AS (SELECT *, (id % 40)::BIGINT AS command_id, (CASE WHEN id % 3 = 0 THEN 0 ELSE id % 100 END)::BIGINT AS command_status FROM unit)"


def coded_units(spark, sf) -> DataFrame:
    rows = text_units(spark, sf).withColumns({
        "command_id": F.pmod("id", F.lit(40)), "command_status": F.when(
            F.col("id") % 3 == 0, 0).otherwise(F.pmod("id", F.lit(100)))})
    return pd_.named_codes(rows, "command_id", config.COMMANDS, "command_name")


@query("command_counts", sql(TEXTS, PARTS, CODED, body=(
    f"SELECT {_names_sql('command_id', config.COMMANDS)} AS command_name, count(*) AS total FROM coded GROUP BY 1")))
def command_counts(spark, sf):
    """Units by command name."""
    return pd_.command_counts(coded_units(spark, sf))


@query("status_counts", sql(TEXTS, PARTS, CODED, body=(
    f"SELECT command_status, count(*) AS total, {_names_sql('command_status', config.STATUS_CODES)} AS status_name FROM coded "
    "WHERE command_status <> 0 GROUP BY command_status ORDER BY total DESC, command_status LIMIT 10")))
def status_counts(spark, sf):
    """The ten most frequent error statuses."""
    return pd_.status_counts(coded_units(spark, sf))


DAMAGED = {3: "00000005", 5: "7FFFFFFF"}


def packets(spark, sf, size: int = 700) -> DataFrame:
    """The byte stream of every document's units in packets of ``size`` bytes.

    Units cross packets and packets hold several units. Documents share 13 flows, one of which has no source
    address. Some documents follow bytes whose length field is too small or too large.
    """
    units = text_units(spark, sf).withColumn("raw", F.concat("raw_header", "raw_body"))
    docs = units.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct(
        "part", "raw"))).alias("u"), F.min("timestamp").alias("timestamp"))
    kind, noise = F.pmod("message_id", F.lit(7)), F.unhex(F.repeat(F.lit("FF"), (F.col("message_id") % 50 + 12).cast("int")))
    lead = F.lit(b"")
    for k, field in DAMAGED.items():
        lead = F.when(kind == k, F.concat(F.unhex(F.lit(field)), noise)).otherwise(lead)
    stream = docs.withColumn("bytes", F.concat(lead, F.aggregate("u", F.lit(b""), lambda a, x: F.concat(
        a, x["raw"])))).drop("u")
    pieces = stream.select("message_id", "timestamp", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.expr(f"(octet_length(bytes) - 1) div {size}")),
        lambda i: F.substring(F.col("bytes"), i * size + 1, F.lit(size)))).alias("n", "payload"))
    flow = F.pmod("message_id", F.lit(13))
    return pieces.select(
        (F.col("message_id") * 1_000_000 + F.col("n")).alias("packet_id"), "timestamp",
        F.when(flow > 0, F.concat(F.lit("10.0.0."), flow)).alias("src_ip"),
        F.lit("10.1.0.1").alias("dst_ip"), (flow + 40000).cast("int").alias("src_port"),
        F.lit(2775).alias("dst_port"), "payload")


FRAMED = BYTES + """,
framed AS (SELECT CAST(40000 + doc_id % 13 AS INTEGER) AS src_port, CASE WHEN doc_id % 13 > 0 THEN '10.0.0.' || doc_id % 13 END AS src_ip,
  33 + ls + ld + sm AS n, doc_id, part, head || body AS raw, CAST(NULL AS VARCHAR) AS error, ('0x' || substr(head, 25))::BIGINT AS seq FROM bytes
  UNION ALL SELECT CAST(40000 + doc_id % 13 AS INTEGER), CASE WHEN doc_id % 13 > 0 THEN '10.0.0.' || doc_id % 13 END, doc_id % 50 + 16, doc_id, 0,
    CASE doc_id % 7 WHEN 3 THEN '00000005' ELSE '7FFFFFFF' END || repeat('FF', CAST(doc_id % 50 + 12 AS BIGINT)),
    CASE doc_id % 7 WHEN 3 THEN 'length below 16' ELSE 'length above 70000' END, NULL FROM texts WHERE doc_id % 7 IN (3, 5))"""
FRAMED_BODY = """
SELECT src_ip, src_port, CAST(sum(n) OVER w - n AS BIGINT) AS unit_start, n::BIGINT AS length, error, md5(raw) AS raw_md5,
  CASE WHEN error IS NULL THEN 4::BIGINT END AS command_id, CASE WHEN error IS NULL THEN 0::BIGINT END AS command_status, seq AS sequence_number
FROM framed WINDOW w AS (PARTITION BY src_port ORDER BY doc_id, part ROWS UNBOUNDED PRECEDING)"""


def framed_rows(units: DataFrame) -> DataFrame:
    """Place, length, error, checksum of the bytes and header fields of every unit and damaged piece."""
    good = lambda c: F.when(F.col("error").isNull(), c)
    h = units.withColumn("h", pf.parse_header("raw"))
    return h.select(
        "src_ip", "src_port", "unit_start", F.octet_length("raw").cast("bigint").alias("length"), "error",
        F.md5(F.hex("raw")).alias("raw_md5"), *[good(F.col(f"h.{c}")).alias(c) for c in (
            "command_id", "command_status", "sequence_number")])


@query("framed_units", sql(TEXTS, PARTS, FRAMED, body=FRAMED_BODY))
def framed_units(spark, sf):
    """Units and damage cut from the packet stream of every flow."""
    return framed_rows(pd_.frame_pdus(packets(spark, sf)))


@query("framed_units_segmented", sql(TEXTS, PARTS, FRAMED, body=FRAMED_BODY))
def framed_units_segmented(spark, sf):
    """The same with small segments, so that flows are cut in many places."""
    return framed_rows(pd_.frame_pdus(packets(spark, sf), segment_bytes=40_000))


@query("capture_counts", sql(TEXTS, PARTS, body="""
SELECT count(*) AS pdus_parsed, (SELECT count(*) FROM texts WHERE doc_id % 7 IN (3, 5)) AS parse_errors, (SELECT CAST(sum(ceil(b / 700.0)) AS BIGINT) FROM (
  SELECT sum(33 + ls + ld + sm) + max(CASE WHEN doc_id % 7 IN (3, 5) THEN doc_id % 50 + 16 ELSE 0 END) AS b FROM unit GROUP BY doc_id)) AS packets_captured
FROM unit"""))
def capture_counts(spark, sf):
    """Packets seen, units parsed and errors."""
    p = packets(spark, sf)
    return pd_.capture_counts(p, pd_.frame_pdus(p))


@query("unit_defaults", sql(TEXTS, PARTS, body="""
SELECT id, '127.0.0.1' AS src_ip, CAST(CASE WHEN id % 2 = 0 THEN 5000 ELSE 12345 END AS INTEGER) AS src_port, CAST(2775 AS INTEGER) AS dst_port,
  0::BIGINT AS command_status FROM unit"""))
def unit_defaults(spark, sf):
    """Appended units take the default network fields."""
    from ..session import work_dir
    from ..sources.tables import append_pdus
    path = work_dir(spark, "units")
    rows = text_units(spark, sf).withColumn("src_port", F.when(F.col("id") % 2 == 0, 5000)).drop(
        "src_ip", "dst_port", "command_status")
    append_pdus(rows, path)
    return spark.read.parquet(path).select("id", "src_ip", "src_port", "dst_port",
                                           "command_status")
