"""Frame protocol units from a packet stream with one small state per flow."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.pdus import FLOW, HEADER, LONGEST, framing_error, plausible_headers, step

OUTPUT = ("src_ip string, src_port int, dst_ip string, dst_port int, unit_start bigint, raw binary, "
          "timestamp timestamp")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FlowFramer(StatefulProcessor):
    """Keeps the bytes from the last boundary on and their stream offset: at most one unit and a packet.

    An idle flow is dropped after the time to live. Damage goes out with an error once the next plausible header
    or as many bytes as the longest unit have arrived.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "data binary, offset bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        data, offset = self.rest.get() if self.rest.exists() else (b"", 0)
        batch = pd.concat(list(rows)).sort_values(["timestamp", "packet_id"], kind="stable")
        payloads = [bytes(p) for p in batch["payload"] if p is not None]
        ends = np.cumsum([len(p) for p in payloads]) + len(data)
        times = batch["timestamp"][batch["payload"].notna()].tolist()
        data = b"".join([bytes(data), *payloads])
        heads, out, pos = plausible_headers(data), [], 0
        while pos + HEADER <= len(data):
            after, damaged = step(data, heads, pos)
            # damage that ends where the data does may go on
            if after > len(data) or damaged and after == len(data) < pos + LONGEST:
                break
            out.append((*key, offset + pos, data[pos:after], times[int(np.searchsorted(ends, after))]))
            pos = after
        self.rest.update((data[pos:], offset + pos))
        yield pd.DataFrame(out, columns=[*FLOW, "unit_start", "raw", "timestamp"])

    def close(self) -> None:
        pass


def frame_pdus_stream(packets: DataFrame, ttl: int | None = None) -> DataFrame:
    """Complete units as they arrive, damaged ones with an ``error`` when the next header is seen.

    With ``ttl``, that many seconds of silence end a flow. Expiry runs on processing time and keeps
    scheduling batches, so it belongs to continuously running queries; a run over a fixed set of
    files leaves it out.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return packets.groupBy(*FLOW).transformWithStateInPandas(
        statefulProcessor=FlowFramer(ttl * 1000 if ttl else None), outputStructType=OUTPUT,
        outputMode="append", timeMode="processingTime" if ttl else "none").withColumn("error", framing_error())
