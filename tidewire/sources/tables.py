"""Message tables in Parquet and CSV: scans, updates, inserts, appends, exports."""
from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

LABELLED_SCHEMA = T.StructType([
    T.StructField("message_id", T.StringType()), T.StructField("source_addr", T.StringType()),
    T.StructField("dest_addr", T.StringType()), T.StructField("submit_time", T.TimestampType()),
    T.StructField("message_text", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("is_anomaly", T.BooleanType()), T.StructField("anomaly_type", T.StringType())])

SCAN_COLUMNS = ["id", "pdu_id", "timestamp", "source_addr", "source_addr_ton", "source_addr_npi",
                "dest_addr", "dest_addr_ton", "dest_addr_npi", "message_text", "message_length",
                "data_coding", "esm_class", "priority_flag", "category", "message_parts", "hour",
                "day_of_week", "features_extracted", "feature_extraction_version"]

UPDATE_COLUMNS = ["category", "encoding_issues", "excessive_length", "dest_is_valid",
                  "source_addr_length", "source_is_numeric", "empty_message",
                  "protocol_anomaly_score", "sender_frequency", "recipient_frequency",
                  "sender_burst", "recipient_burst", "high_sender_frequency",
                  "high_recipient_frequency", "suspicious_word_count", "url_count",
                  "suspicious_url", "urgency_score", "financial_patterns", "phone_numbers",
                  "message_entropy", "obfuscation_score", "social_engineering", "typosquatting",
                  "night_time", "weekend", "business_hours", "source_category_mismatch",
                  "time_category_anomaly", "unusual_sender_pattern", "category_time_mismatch",
                  "sender_legitimacy", "features_extracted", "feature_extraction_version"]

#: rows whose packed texts are opened at once
PACKED_ROWS = 256

_MARKS = [(b"\xff\xfe", "UTF-16"), (b"\xfe\xff", "UTF-16"), (b"\xef\xbb\xbf", "UTF-8")]


def detect_encodings(spark: SparkSession, path: str, default: str = "UTF-8") -> DataFrame:
    """path, encoding: decided by the byte-order mark of each file."""
    head = spark.read.format("binaryFile").load(path).select(
        "path", F.hex(F.substring("content", 1, 3)).alias("head"))
    rule = None
    for mark, name in _MARKS:
        cond = F.startswith("head", F.lit(mark.hex().upper()))
        rule = F.when(cond, name) if rule is None else rule.when(cond, name)
    return head.select("path", rule.otherwise(default).alias("encoding"))


def read_messages_csv(spark: SparkSession, path: str, encoding: str = "UTF-8",
                      schema: T.StructType = LABELLED_SCHEMA) -> DataFrame:
    """Messages from CSV in a declared encoding; ``auto`` reads the mark of one file.

    UTF-16 needs whole-file records, so such inputs are split by file only; large feeds should come
    as many files.
    """
    if encoding == "auto":
        found = detect_encodings(spark, path).select("encoding").distinct().limit(2).collect()
        if len(found) != 1:
            raise ValueError("files of one read must share an encoding")
        encoding = found[0][0]
    name = {"utf-8-sig": "UTF-8", "cp1251": "windows-1251", "latin-1": "ISO-8859-1"}.get(
        encoding.lower(), encoding)
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("encoding", name).option("escape", '"').option("mode", "PERMISSIVE").csv(path))


def read_messages(source: DataFrame | str, where: Column | str | None = None,
                  limit: int | None = None, spark: SparkSession | None = None) -> DataFrame:
    """The scan of the feature job: its columns, an optional predicate and limit."""
    df = (spark or SparkSession.active()).read.parquet(source) if isinstance(source, str) else source
    out = df.select(*[c for c in SCAN_COLUMNS if c in df.columns])
    if where is not None:
        out = out.where(where)
    if limit is not None:
        out = out.limit(limit)
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def unprocessed(flag="features_extracted") -> Column:
    return (F.col(flag) == 0) | F.col(flag).isNull()


def apply_updates(base: DataFrame, updates: DataFrame, key: str = "id",
                  columns: list[str] | None = None, order: str | None = None) -> DataFrame:
    """New version of ``base``: matched rows take the update values, NULL included.

    Of several updates of one key the last by ``order`` wins (without ``order`` the largest by value).
    """
    wanted = UPDATE_COLUMNS if columns is None else columns
    use = [c for c in wanted if c in updates.columns and c in base.columns]
    values = F.struct(*use) if use else F.struct(F.lit(0).alias("_none"))
    last = F.max(values) if order is None else F.max_by(values, F.struct(F.col(order), values))
    new = updates.groupBy(key).agg(last.alias("_last")).select(
        F.col(key), F.lit(True).alias("_hit"), *[F.col("_last").getField(c).alias(f"_new_{c}") for c in use])
    joined = base.join(new, key, "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in use
        else F.col(c) for c in base.columns])


def insert_ignore(target: DataFrame, incoming: DataFrame, key: str = "message_id",
                  arrival: str = "arrival") -> DataFrame:
    """``target`` plus the first arrival of each new key.

    The first row per key is an aggregate, so copies of one key collapse before the shuffle.
    """
    cols = [c for c in incoming.columns if c != arrival]
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*cols), arrival).alias("_row")).select(
        "_row.*")
    return target.unionByName(first.join(target.select(key), key, "left_anti").select(
        *target.columns))


# Defaults of a stored protocol unit.
PDU_DEFAULTS = {"src_ip": "127.0.0.1", "dst_ip": "127.0.0.1", "src_port": 12345, "dst_port": 2775,
                "command_status": 0}
PDU_TYPES = {"timestamp": "timestamp", "src_ip": "string", "dst_ip": "string", "src_port": "int",
             "dst_port": "int", "command_id": "bigint", "command_name": "string",
             "command_status": "bigint", "sequence_number": "bigint", "command_length": "int",
             "raw_data": "string", "raw_header": "binary", "raw_body": "binary"}


def with_pdu_defaults(df: DataFrame) -> DataFrame:
    """All stored columns of a unit; absent or null network fields take their default."""
    def one(name, kind):
        value = F.col(name) if name in df.columns else F.lit(None)
        if name in PDU_DEFAULTS:
            value = F.coalesce(value, F.lit(PDU_DEFAULTS[name]))
        return value.cast(kind).alias(name)
    keep = [F.col("id")] if "id" in df.columns else []
    return df.select(*keep, *[one(n, k) for n, k in PDU_TYPES.items()])


def append_pdus(df: DataFrame, path: str) -> None:
    with_pdu_defaults(df).write.mode("append").parquet(path)


def append_results(results: DataFrame, path: str) -> None:
    """Append scoring results; one folder per day keeps later period filters to few files."""
    (results.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day")
     .parquet(path))


def _changed(df: DataFrame, column: str, kind: T.DataType, change) -> DataFrame:
    """``df`` with ``change`` applied to the bytes of ``column``; nulls stay null."""
    at = df.columns.index(column)
    schema = T.StructType([T.StructField(f.name, kind) if f.name == column else f for f in df.schema.fields])
    # the bytes of texts and binary columns are the same
    source = df.withColumn(column, F.col(column).cast("binary"))

    def run(batches):
        for batch in batches:
            # a batch of packed texts can hold far more text than bytes
            for k in range(0, batch.num_rows, PACKED_ROWS):
                b = batch.slice(k, PACKED_ROWS)
                values = [None if v is None else change(v) for v in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, pa.binary()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    binary = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == column else f for f in df.schema.fields])
    return source.mapInArrow(run, binary).withColumn(column, F.col(column).cast(kind)).select(*schema.names)


def pack_text(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the texts of ``column`` compressed one by one; joins and sorts that follow move fewer bytes."""
    return _changed(df, column, T.BinaryType(), lambda v: zlib.compress(v, 6))


def unpack_text(df: DataFrame, column: str) -> DataFrame:
    return _changed(df, column, T.StringType(), zlib.decompress)


def export_csv(df: DataFrame, path: str, limit: int | None = None, by="submit_time",
               encoding: str = "UTF-8", compression: str = "none", packed: str | None = None) -> None:
    """Messages in time order as CSV; part files follow each other in time. Texts of ``packed`` come from ``pack_text``."""
    out = df.orderBy(by)
    if limit is not None:
        out = out.limit(limit)
    if packed is not None:
        out = unpack_text(out, packed)
    out.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "encoding", encoding).option("compression", compression).csv(path)
