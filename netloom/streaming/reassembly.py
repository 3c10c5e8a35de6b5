"""TCP streams put together while packets arrive, with state for what is out of order and nothing else.

A connection's state is where each side's next byte is, and the segments that
came before bytes in front of them. What is in order is given out at once and
kept nowhere, so state is bounded by the gaps of open connections, not by
their streams. A connection that is idle for a time closes: what is still held
is given out, with the number of bytes that are missing before it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.pcap import flow

OUT = "flow string, conn long, side int, offset long, length long, missing long, part binary, ts timestamp, path string, frame_no long"
#: number and first end of the connection, where each side begins and what its next byte is, bytes given out, the least place held of each side, and the timer that is set.
CONNECTION = "number long, first_a boolean, base0 long, base1 long, next0 long, next1 long, offset long, least0 long, least1 long, timer long"
SYN, ACK = 2, 16
NOTHING = -1


class Reassembly(StatefulProcessor):
    """One flow: a pair of endpoints, and its connections one after the other."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.connection = handle.getValueState("connection", CONNECTION)
        self.inbox = handle.getMapState("inbox", "path string, frame_no long", "payload binary")
        self.held = handle.getMapState("held", "side int, rel long", "path string, frame_no long, ts timestamp, payload binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Bytes go to the store at once; only places of a batch's packets are in memory, to be put in order.
        places = []
        for r in rows:
            places.append((r.path, r.frame_no, r.from_a, r.tcp_seq, r.tcp_flags, len(r.payload or b""), r.ts))
            if r.payload:
                self.inbox.updateValue((r.path, r.frame_no), (bytes(r.payload),))
        places.sort(key=lambda p: p[:2])
        c = list(self.connection.get()) if self.connection.exists() else None
        latest = 0
        for path, frame_no, from_a, seq, flags, n, ts in places:
            latest = max(latest, int(ts.timestamp() * 1000))
            if flags & SYN and not flags & ACK or c is None:
                if c is not None:
                    yield from self._rest(key, c)
                c = [0 if c is None else c[0] + 1, from_a, None, None, 0, 0, 0, NOTHING, NOTHING, None if c is None else c[9]]
            side = int(from_a != c[1])
            if c[2 + side] is None:
                c[2 + side] = (seq + 1 if flags & SYN else seq) % (1 << 32)
            if not n:
                continue
            # The place nearest to the next byte among those that the sequence number may mean.
            rel = c[4 + side] + ((seq - c[2 + side] - c[4 + side] + (1 << 31)) % (1 << 32) - (1 << 31))
            payload = bytes(self.inbox.getValue((path, frame_no))[0])
            self.inbox.removeKey((path, frame_no))
            if rel + n <= c[4 + side] or rel < 0:
                continue  # was given out already, or lies before the opening
            if rel <= c[4 + side]:
                yield self._give(key, c, side, rel, path, frame_no, ts, payload, 0)
                yield from self._drain(key, c, side, False)
            else:
                old = self.held.getValue((side, rel)) if self.held.containsKey((side, rel)) else None
                if old is None or len(old[3]) < n:
                    self.held.updateValue((side, rel), (path, frame_no, ts, payload))
                c[7 + side] = rel if c[7 + side] == NOTHING else min(c[7 + side], rel)
        if c is None:
            return
        if c[9] is not None:
            self.handle.deleteTimer(c[9])
        c[9] = max(latest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        self.handle.registerTimer(c[9])
        self.connection.update(tuple(c))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.connection.exists():
            yield from self._rest(key, list(self.connection.get()))
            self.connection.clear()

    def _give(self, key, c: list, side: int, rel: int, path: str, frame_no: int, ts, payload: bytes, missing: int) -> Row:
        part = payload[c[4 + side] - rel :] if rel < c[4 + side] else payload
        out = Row(flow=key[0], conn=c[0], side=side, offset=c[6], length=len(part) + missing, missing=missing, part=part, ts=ts, path=path, frame_no=frame_no)
        c[4 + side] = rel + len(payload)
        c[6] += len(part) + missing
        return out

    def _drain(self, key, c: list, side: int, closing: bool) -> Iterator[Row]:
        """What is held of a side and now in order; all of it where the connection closes."""
        if c[7 + side] == NOTHING or (c[7 + side] > c[4 + side] and not closing):
            return
        waiting = sorted(k[1] for k in self.held.keys() if k[0] == side)
        for i, rel in enumerate(waiting):
            missing = max(0, rel - c[4 + side])
            if missing and not closing:
                c[7 + side] = waiting[i]
                return
            path, frame_no, ts, payload = self.held.getValue((side, rel))
            self.held.removeKey((side, rel))
            if rel + len(payload) > c[4 + side]:
                yield self._give(key, c, side, rel, path, frame_no, ts, bytes(payload), missing)
        c[7 + side] = NOTHING

    def _rest(self, key, c: list) -> Iterator[Row]:
        for side in (0, 1):
            yield from self._drain(key, c, side, True)

    def close(self) -> None:
        pass


def reassembled(packets: DataFrame, idle: str = "2 minutes", idle_ms: int = 120_000) -> DataFrame:
    """(flow, conn, side, offset, length, missing, part, ts, path, frame_no): the pieces of each connection in the order in which they could be delivered.

    ``packets`` is a stream of dissected packets with ``ts``. A connection
    begins with an opening SYN, or with the first packet of its flow; ``side``
    is 0 for the direction of that packet. Packets of one batch are taken in
    the order of their captures. Bytes that came before are cut off. A packet
    later than ``idle`` behind the watermark is left out, and a connection
    closes ``idle_ms`` after its last packet. The session must keep its state
    in RocksDB. Null payloads count as empty; packets of other protocols are ignored.
    """
    a, b = flow()
    tcp = packets.where("l4 = 'tcp' AND tcp_seq IS NOT NULL").withWatermark("ts", idle)
    from_a = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")) == a
    keyed = tcp.select(F.to_json(F.struct(a.alias("a"), b.alias("b"))).alias("flow"), from_a.alias("from_a"), "path", "frame_no", "ts", F.col("tcp_seq").cast("long").alias("tcp_seq"), F.col("tcp_flags").cast("int").alias("tcp_flags"), "payload")
    return keyed.groupBy("flow").transformWithState(statefulProcessor=Reassembly(idle_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
