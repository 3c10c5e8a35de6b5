"""Sessions over a stream of packets: anchored at their start, kept as state until no packet can still join."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, session long, anchor timestamp, last timestamp, packets long, bytes long"
STATE = "number long, anchor long, last long, packets long, bytes long"


def anchored(packets: DataFrame, width_s: int, lateness: str = "1 minute") -> DataFrame:
    """(key, session, anchor, last, packets, bytes) of a stream with key, ts and size.

    A session ends ``width_s`` after its first packet. It is given out when a
    packet of the key begins the next, or when the watermark has passed its end. Packets of a batch are put in order; one that
    comes after its session was given out begins a new one.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, anchor, last, packets, size = state.get if state.exists else (-1, -1, -1, 0, 0)
        done = []
        told = lambda: (key[0], number, pd.Timestamp(anchor, unit="us"), pd.Timestamp(last, unit="us"), packets, size)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([told()], columns=[c.split()[0] for c in OUT.split(", ")])
            return
        rows = pd.concat(list(parts))
        for us, n in sorted(zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["size"], strict=True)):
            if packets and us - anchor >= width_s * 1_000_000:
                done.append(told())
                packets = size = 0
            if not packets:
                number, anchor, last = number + 1, int(us), int(us)
            last, packets, size = max(last, int(us)), packets + 1, size + int(n)
        state.update((number, anchor, last, packets, size))
        state.setTimeoutTimestamp(max(anchor // 1000 + width_s * 1000, state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame(done, columns=[c.split()[0] for c in OUT.split(", ")])

    keyed = packets.withWatermark("ts", lateness).select(F.col("key").cast("string").alias("key"), "ts", F.col("size").cast("long").alias("size"))
    return keyed.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windows(packets: DataFrame, size: str, slide: str | None = None, lateness: str = "1 minute") -> DataFrame:
    """Packets and bytes of each key in tumbling or sliding windows, once the watermark has passed them."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return packets.withWatermark("ts", lateness).groupBy("key", w).agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes")).select("key", F.col("window.start").alias("start"), "packets", "bytes")
