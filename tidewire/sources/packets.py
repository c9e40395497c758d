"""Packet stream source."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.pdus import PORT, capture_filter

PACKET_SCHEMA = T.StructType([
    T.StructField("packet_id", T.LongType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("src_ip", T.StringType()), T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()), T.StructField("dst_port", T.IntegerType()),
    T.StructField("payload", T.BinaryType())])


def packet_stream(spark: SparkSession, path: str, fmt: str = "parquet", port: int = PORT,
                  files_per_trigger: int | None = None) -> DataFrame:
    """Stream of captured packets from a folder, limited to the protocol port."""
    reader = spark.readStream.schema(PACKET_SCHEMA).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return capture_filter(reader.load(path), port)
