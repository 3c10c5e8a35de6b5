"""Streams put together over micro-batches against the batch result."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from netloom.decoders import streams
from netloom.streaming import reassembly

PACKET = "path string, frame_no long, ts_us long, l4 string, src_ip string, src_port int, dst_ip string, dst_port int, tcp_seq long, tcp_flags int, payload binary"


def connection(rnd, client_port, first, shuffle, lost=()):
    """Packets of two connections one after the other between the same ends; sides talk by turns, segments are shuffled within three places and some come twice."""
    rows = []
    for opening in range(2):
        seq, out = {True: 4_294_967_000 + rnd.randrange(200), False: rnd.randrange(1 << 31)}, []
        rows.append((True, seq[True] - 1, 2, b""))
        rows.append((False, seq[False] - 1, 18, b""))
        for k in range(12):
            side = k % 3 != 2
            data = bytes([65 + k]) * rnd.randint(1, 40)
            out.append((side, seq[side] % (1 << 32), 24, data))
            seq[side] += len(data)
        if shuffle:
            out = [x for _, x in sorted(enumerate(out), key=lambda t: t[0] + 3 * rnd.random())]
            out += out[4:5]
        rows += [x for k, x in enumerate(out) if k not in lost or opening]
    at = first
    for side, seq, flags, data in rows:
        ends = ("10.0.0.1", client_port, "10.0.0.2", 80) if side else ("10.0.0.2", 80, "10.0.0.1", client_port)
        yield ("p", at, 5_000_000_000 + at * 1000, "tcp", *ends, seq, flags, data)
        at += 7


def run(spark, df, tmp_path, cuts):
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        df.where(F.col("frame_no").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = reassembly.reassembled(source, "10 seconds", 20_000).writeStream.format("memory").queryName("pieces").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table("pieces").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def joined(rows):
    out = defaultdict(bytes)
    for r in sorted(rows, key=lambda r: (r.flow, r.conn, r.offset)):
        assert r.offset == len(out[r.flow, r.conn])
        out[r.flow, r.conn] += b"\0" * r.missing + bytes(r.part)
    return dict(out)


@pytest.mark.parametrize("shuffle", [False, True])
def test_streamed_equals_batch(spark, tmp_path, shuffle):
    rnd = random.Random(9)
    rows = [p for k in range(6) for p in connection(rnd, 4000 + k, k, shuffle)] + [("p", 10_000, 6_000_000_000, "udp", "1.1.1.1", 1, "2.2.2.2", 2, None, None, b"x")]
    df = spark.createDataFrame(rows, PACKET).select("*", F.timestamp_micros("ts_us").alias("ts"))
    got = joined(run(spark, df, tmp_path, [0, 40, 41, 90, 130, 20_000]))
    batch = streams.runs(streams.tcp_segments(df.withColumns({"ts_ns": F.col("ts_us") * 1000, "payload_at": F.lit(0)})))
    want = defaultdict(bytes)
    for r in batch.orderBy("stream", "run").collect():
        want[r.stream] += bytes(r.content)
    assert len(got) == 12 and sorted(got.values()) == sorted(want.values())


def test_gaps_close_with_the_connection(spark, tmp_path):
    rows = [*connection(random.Random(1), 4000, 0, False, lost=(3,)), *connection(random.Random(2), 4001, 10_000_000, False), *connection(random.Random(2), 4001, 30_000_000, False)]
    df = spark.createDataFrame(rows, PACKET).select("*", F.timestamp_micros("ts_us").alias("ts"))
    out = run(spark, df, tmp_path, [0, 50, 5_000_000, 20_000_000, 40_000_000])
    gaps = [r for r in out if r.missing]
    whole = streams.streams(streams.tcp_segments(df.where("src_port = 4000 OR dst_port = 4000").withColumns({"ts_ns": F.col("ts_us") * 1000, "payload_at": F.lit(0)}))).collect()
    assert len(gaps) == 1 and sorted(len(v) for k, v in joined(out).items() if "4000" in k[0]) == sorted(r["size"] for r in whole)
