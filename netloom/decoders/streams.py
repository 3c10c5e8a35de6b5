"""TCP streams and UDP sessions out of packets, with windows only.

A stream's bytes are the two directions in the order in which they could be
delivered. Within a direction segments are put in order by sequence number;
bytes that came before are cut off, missing ones become zeros. Everything is a
row a segment until content is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.gather import in_order, zeros
from ..operators.sequence import START, anchored_sessions
from ..sources.pcap import flow

SYN, ACK = 2, 16
#: Packets, and bytes of them, that one task should put in order at most: its sorts hold each row some four times.
PACKETS, BYTES = 100_000, 32 << 20


def tasks(packets: DataFrame) -> int | None:
    """How many tasks should put packets in order, so that none holds more as there are more of them; null where all cores have few. They are read for it: they should be cheap, or lasting."""
    n, size = packets.agg(F.count(F.lit(1)), F.sum(F.octet_length("payload"))).first()
    least = max(-(-n // PACKETS), -(-(size or 0) // BYTES))
    return least if least > packets.sparkSession.sparkContext.defaultParallelism else None


def tcp_segments(packets: DataFrame, tasks: int | None = None) -> DataFrame:
    """A row for each piece of a stream: stream, pos, side, run, offset, length, missing, part, and the packet's place and time.

    A stream is a pair of endpoints from one opening SYN to the next. ``side`` is
    0 for the direction of its first packet. Captures are read in path order, so a stream may span them.
    ``tasks`` is how many tasks flows are dealt to; Spark's choice where it is null.
    """
    p = packets.where("l4 = 'tcp'").withColumns(dict(zip(["end_a", "end_b"], flow(), strict=True)))
    syn = F.col("tcp_flags").bitwiseAND(SYN) != 0
    opening = syn & (F.col("tcp_flags").bitwiseAND(ACK) == 0)
    from_a = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")) == F.col("end_a")
    # Rows are sorted four times, so they hold nothing twice: endpoints are those of the flow, and which of them speaks.
    p = p.select("end_a", "end_b", "path", "frame_no", "ts_ns", "tcp_seq", syn.alias("syn"), opening.alias("opening"), from_a.alias("from_a"), "payload", "payload_at")
    p = p if tasks is None else p.repartition(tasks, "end_a", "end_b")
    w = Window.partitionBy("end_a", "end_b").orderBy("path", "frame_no").rowsBetween(START, 0)
    # A stream's first packet is its opening one, or without such the flow's.
    a_first = F.coalesce(F.last(F.when(F.col("opening"), F.col("from_a")), ignorenulls=True).over(w), F.first("from_a").over(w))
    p = p.withColumns({"conn": F.sum(F.col("opening").cast("int")).over(w), "a_first": a_first})
    p = p.withColumn("side", (F.col("a_first") != F.col("from_a")).cast("int")).drop("opening", "from_a")
    key = ["end_a", "end_b", "conn"]
    way = Window.partitionBy(*key, "side")
    seen = F.struct("path", "frame_no")
    # Places are told from the opening SYN, else from the least sequence number near the first one that was seen.
    p = p.withColumns({"opened": F.min_by(F.col("tcp_seq") + 1, F.when(F.col("syn"), seen)).over(way), "base": F.min_by("tcp_seq", seen).over(way)})
    near = F.pmod(F.col("tcp_seq") - F.coalesce("opened", "base") + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    p = p.withColumn("near", near).withColumn("rel", F.col("near") - F.when(F.col("opened").isNull(), F.min("near").over(way)).otherwise(0))
    p = p.drop("syn", "tcp_seq", "opened", "base", "near").withColumn("len", F.octet_length("payload").cast("long")).where("len > 0 AND rel >= 0")
    seq = way.orderBy("rel", "path", "frame_no")
    had = F.coalesce(F.max(F.col("rel") + F.col("len")).over(seq.rowsBetween(START, -1)), F.lit(0))
    p = p.withColumn("had", had)
    p = p.withColumns({"cut": F.greatest(F.lit(0), F.col("had") - F.col("rel")), "missing": F.greatest(F.lit(0), F.col("rel") - F.col("had"))}).where("cut < len")
    # A segment can be delivered when all that gave bytes before it were seen; one that was only sent again holds nothing up.
    p = p.withColumn("ready", F.max(seen).over(seq.rowsBetween(START, 0)))
    p = p.withColumns({"part": F.expr("substring(payload, cast(cut AS int) + 1)"), "length": F.col("len") - F.col("cut") + F.col("missing")}).drop("payload", "len", "had", "cut")
    given = Window.partitionBy(*key).orderBy("ready", "side", "rel")
    so_far = given.rowsBetween(START, 0)
    # Number and time are those of the first bytes, endpoints those of the packet that opened the stream.
    begun = F.first(F.struct("path", "frame_no", "ts_ns")).over(so_far)
    p = p.withColumns({"pos": F.row_number().over(given) - 1, "offset": F.coalesce(F.sum("length").over(given.rowsBetween(START, -1)), F.lit(0)), "turn": F.coalesce((F.lag("side").over(given) != F.col("side")).cast("int"), F.lit(1)), "begun": begun})
    p = p.withColumn("run", F.sum("turn").over(so_far) - 1)
    src, dst = [F.when(a, F.col("end_a")).otherwise(F.col("end_b")) for a in (F.col("a_first"), ~F.col("a_first"))]
    first = F.struct("begun.path", "begun.frame_no", "begun.ts_ns", src["ip"].alias("src_ip"), src["port"].alias("src_port"), dst["ip"].alias("dst_ip"), dst["port"].alias("dst_port"))
    return p.withColumn("first", first).select(
        F.concat_ws("-", "first.path", "first.frame_no").alias("stream"), "pos", "side", "run", "offset", "length", "missing", "part", "path", "frame_no", "ts_ns", "payload_at", "first", "end_a", "end_b"
    )


def streams(segments: DataFrame) -> DataFrame:
    """A row a stream: its endpoints as its first packet has them, size, first packet and time, whether bytes are missing, and its runs.

    ``first`` is the same in all segments of a stream.
    """
    return segments.groupBy("stream").agg(
        F.first("first").alias("first"), F.sum("length").alias("size"), (F.max("missing") > 0).alias("missing_data"), F.max("run").alias("last_run")
    ).select(
        "stream", F.col("first.path").alias("path"), F.col("first.frame_no").alias("first_packet_no"), F.col("first.ts_ns").alias("ts_ns"), "first.src_ip", "first.src_port", "first.dst_ip", "first.dst_port", "size", "missing_data", "last_run"
    )


def breaks(segments: DataFrame) -> DataFrame:
    """(stream, run, side, offset, ts_ns): where the talking side changes."""
    return segments.groupBy("stream", "run", "side").agg(F.min("offset").alias("offset"), F.min_by("ts_ns", "pos").alias("ts_ns"))


def runs(segments: DataFrame) -> DataFrame:
    """(stream, run, side, offset, ts_ns, content, missing_data, ...): one message run with its bytes, missing ones as zeros.

    Segments lie where their flow was put in order: with its ends among the keys no bytes are dealt again.
    """
    ends = [c for c in ("end_a", "end_b") if c in segments.columns]
    return segments.withColumn("piece", F.concat(zeros(F.col("missing")), F.col("part"))).groupBy("stream", "run", "side", *ends).agg(
        F.min("offset").alias("offset"), F.min_by("ts_ns", "pos").alias("ts_ns"), F.first("first").alias("first"), (F.max("missing") > 0).alias("missing_data"),
        in_order("piece", "pos").alias("content"),
    ).drop(*ends)


def udp_sessions(packets: DataFrame, width_s: int = 30) -> DataFrame:
    """Datagrams with their session: same endpoints in one capture, less than ``width_s`` seconds after the session's first."""
    p = packets.where("l4 = 'udp'").withColumns(dict(zip(["end_a", "end_b"], flow(), strict=True)))
    p = p.withColumn("flow", F.to_json(F.struct("end_a", "end_b"))).drop("end_a", "end_b")
    return anchored_sessions(p, ["path", "flow"], "ts_ns", width_s * 1_000_000_000, "frame_no")
