"""Captures made of tables, for tests and demonstrations: frames as Columns, then one file for each capture name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.gather import in_order


def _n(x: Column, size: int, little: bool = False) -> Column:
    h = F.lpad(F.hex(x.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(size))]) if little else h


def _ip(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, r"\."), lambda p: F.lpad(F.hex(p.cast("long")), 2, "0")), "")


def frames(df: DataFrame) -> DataFrame:
    """Adds ``frame``: Ethernet, IPv4, and TCP (with tcp_seq and tcp_flags) or UDP around ``payload``."""
    n = F.octet_length("payload")
    tcp = F.col("l4") == "tcp"
    head = F.when(tcp, 20).otherwise(8)
    ip = F.concat(F.lit("4500"), _n(n + head + 20, 2), F.lit("0000400040"), F.when(tcp, "06").otherwise("11"), F.lit("0000"), _ip(F.col("src_ip")), _ip(F.col("dst_ip")))
    ports = F.concat(_n(F.col("src_port"), 2), _n(F.col("dst_port"), 2))
    rest = F.when(tcp, F.concat(_n(F.col("tcp_seq") % (1 << 32), 4), F.lit("0000000050"), _n(F.col("tcp_flags"), 1), F.lit("ffff00000000"))).otherwise(F.concat(_n(n + 8, 2), F.lit("0000")))
    return df.withColumn("frame", F.concat(F.unhex(F.concat(F.lit("02000000000202000000000108" + "00"), ip, ports, rest)), F.col("payload")))


def pcap(df: DataFrame, order: list[str]) -> DataFrame:
    """(path, content): a capture file for each ``path`` with its frames in order; ``ts_us`` is their time. A path's frames must fit one row."""
    size = F.octet_length("frame")
    head = F.unhex(F.concat(_n(F.floor(F.col("ts_us") / 1_000_000), 4, True), _n(F.col("ts_us") % 1_000_000, 4, True), _n(size, 4, True), _n(size, 4, True)))
    start = F.unhex(F.lit("d4c3b2a102000400000000000000000000000400" + "01000000"))
    return _file(df, order, F.concat(head, F.col("frame")), start)


def pcapng(df: DataFrame, order: list[str]) -> DataFrame:
    """As ``pcap``, in blocks: a section header, an interface, and an enhanced packet block a frame."""
    size = F.octet_length("frame")
    pad = (4 - size % 4) % 4
    total = size + pad + 32
    head = F.concat(F.lit("06000000"), _n(total, 4, True), F.lit("00000000"), _n(F.floor(F.col("ts_us") / (1 << 32)), 4, True), _n(F.col("ts_us") % (1 << 32), 4, True), _n(size, 4, True), _n(size, 4, True))
    tail = F.unhex(F.concat(F.repeat(F.lit("00"), pad.cast("int")), _n(total, 4, True)))
    start = F.unhex(F.lit("0a0d0d0a1c0000004d3c2b1a01000000ffffffffffffffff1c000000" + "01000000140000000100000000000400" + "14000000"))
    return _file(df, order, F.concat(F.unhex(head), F.col("frame"), tail), start)


def _file(df: DataFrame, order: list[str], record: Column, start: Column) -> DataFrame:
    rows = df.select("path", *order, record.alias("r")).groupBy("path").agg(in_order("r", ", ".join(order)).alias("records"))
    return rows.select("path", F.concat(start, "records").alias("content"))
