"""Packet captures as DataFrames: a walk over the records of each file, then header fields as Columns.

A capture is a row (path, content), as Spark's ``binaryFile`` source gives it,
so any store that Spark reads will do, and files are the unit that is dealt to
tasks. The walk only finds records; what is inside a frame is told by Columns.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.binary import ipv4, number

#: The first four bytes of the formats that are read.
PCAP_MICRO, PCAP_NANO, PCAPNG = b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1", b"\x0a\x0d\x0d\x0a"
#: Block types of the second format, and the kind of secrets read there.
ENHANCED, SIMPLE, SECRETS, INTERFACE, SECTION, TLS_LOG = 6, 3, 10, 1, 0x0A0D0D0A, 0x544C534B
#: The option of an interface that tells its resolution.
TICKS = 9

FRAMES = "path string, frame_no long, ts_ns long, at long, frame binary"


def captures(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, content) of one file, or of the files of a folder with a name suffix."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "content")


def _records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(time in ns, place of the frame, frame) of each packet; nothing for formats that are not known, and an end at a cut record."""
    magic, n = data[:4], len(data)
    if magic in (PCAP_MICRO, PCAP_NANO):
        unit, at = (1000 if magic == PCAP_MICRO else 1), 24
        while at + 16 <= n:
            sec, sub, size = struct.unpack_from("<III", data, at)
            if at + 16 + size > n:
                return
            yield sec * 1_000_000_000 + sub * unit, at + 16, data[at + 16 : at + 16 + size]
            at += 16 + size
    elif magic == PCAPNG:
        known = Resolution()
        for kind, at, size in _sections(data):
            if kind in (INTERFACE, SECTION):
                known.see(kind, data[at : at + size])
            elif kind == ENHANCED and size >= 32:
                interface, high, low, held = struct.unpack_from("<IIII", data, at + 8)
                yield known.ns(interface, (high << 32) | low), at + 28, data[at + 28 : at + 28 + held]
            elif kind == SIMPLE and size >= 16:
                held = min(struct.unpack_from("<I", data, at + 8)[0], size - 16)
                yield 0, at + 12, data[at + 12 : at + 12 + held]


class Resolution:
    """How many ticks of each interface of a section are a second: a million where it does not say."""

    def __init__(self) -> None:
        self.ticks: list[int] = []

    def see(self, kind: int, block: bytes) -> None:
        """A section begins anew; an interface adds itself, with what its options tell."""
        if kind == SECTION:
            self.ticks = []
        if kind != INTERFACE:
            return
        ticks, at = 1_000_000, 16
        while at + 4 <= len(block) - 4:
            code, n = struct.unpack_from("<HH", block, at)
            if code == 0:
                break
            if code == TICKS and n == 1 and at + 4 < len(block):
                exponent = block[at + 4]
                ticks = 1 << (exponent & 0x7F) if exponent & 0x80 else 10**exponent
            at += 4 + n + -n % 4
        self.ticks.append(ticks)

    def ns(self, interface: int, time: int) -> int:
        ticks = self.ticks[interface] if interface < len(self.ticks) else 1_000_000
        return time * 1_000_000_000 // ticks


def _sections(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(type, place, length) of the blocks; a length that cannot be ends the walk."""
    at = 0
    while at + 12 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if size < 12 or size % 4 or at + size > len(data):
            return
        yield kind, at, size
        at += size


def frames(files: DataFrame, rows: int = 2000) -> DataFrame:
    """(path, frame_no, ts_ns, at, frame): the packets of each capture, numbered from 0 in file order."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "frame_no", "ts_ns", "at", "frame"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                out: list[tuple] = []
                for k, (ts, at, frame) in enumerate(_records(content.as_py() or b"")):
                    out.append((path.as_py(), k, ts, at, frame))
                    if len(out) == rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(walk, FRAMES)


def secrets(files: DataFrame) -> DataFrame:
    """(path, line): the lines of TLS key logs that captures carry in their own blocks."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if content and content[:4] == PCAPNG:
                    for kind, at, size in _sections(content):
                        if kind == SECRETS and struct.unpack_from("<I", content, at + 8)[0] == TLS_LOG:
                            held = struct.unpack_from("<I", content, at + 12)[0]
                            out += [(path, x) for x in content[at + 16 : at + 16 + held].decode("latin-1").splitlines() if x]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in (0, 1)], ["path", "line"])

    return files.select("path", "content").mapInArrow(walk, "path string, line string")


@F.arrow_udf(StringType())
def _ipv6(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None or len(x) != 16 else ipaddress.ip_address(x).compressed for x in data.to_pylist()], pa.string())


def dissect(raw: DataFrame) -> DataFrame:
    """Adds l4, src_ip, dst_ip, src_port, dst_port, tcp_seq, tcp_flags, payload of Ethernet frames with TCP or UDP over IPv4 or IPv6.

    Other frames are left out. One VLAN tag is stepped over. Addresses are text.
    """
    f = F.col("frame")
    tag = F.when(number(f, 12, 2) == 0x8100, 4).otherwise(0)
    df = raw.withColumns({"__t": tag, "__k": number(f, F.lit(12) + tag, 2)})
    ip = F.lit(14) + F.col("__t")
    four = F.col("__k") == 0x0800
    size = F.when(four, (number(f, ip, 1) % 16) * 4).otherwise(40)
    proto = F.when(four, number(f, ip + 9, 1)).otherwise(number(f, ip + 6, 1))
    end = ip + F.when(four, number(f, ip + 2, 2)).otherwise(number(f, ip + 4, 2) + 40)
    df = df.where(F.col("__k").isin(0x0800, 0x86DD)).withColumns({"__ip": ip, "__l4": ip + size, "__p": proto, "__end": end, "__four": four})
    at = F.col("__l4")
    tcp = F.col("__p") == 6
    start = at + F.when(tcp, F.shiftright(number(f, at + 12, 1), 4) * 4).otherwise(8)
    slice_ = lambda a, n: F.substring(f, a.cast("int") + 1, n)
    address = lambda v4, v6: F.when(F.col("__four"), ipv4(f, F.col("__ip") + v4)).otherwise(_ipv6(F.when(~F.col("__four"), slice_(F.col("__ip") + v6, F.lit(16)))))
    df = df.where(F.col("__p").isin(6, 17)).withColumns(
        {
            "l4": F.when(tcp, "tcp").otherwise("udp"),
            "src_ip": address(12, 8),
            "dst_ip": address(16, 24),
            "src_port": number(f, at, 2).cast("int"),
            "dst_port": number(f, at + 2, 2).cast("int"),
            "tcp_seq": F.when(tcp, number(f, at + 4, 4)),
            "tcp_flags": F.when(tcp, number(f, at + 13, 1)).cast("int"),
            "payload": slice_(start, F.greatest(F.lit(0), F.least(F.col("__end"), F.octet_length(f)) - start).cast("int")),
            "payload_at": F.col("at") + start,
        }
    )
    return df.drop("__t", "__k", "__ip", "__l4", "__p", "__end", "__four", "frame", "at")


def packets(files: DataFrame) -> DataFrame:
    return dissect(frames(files))


def flow() -> list[Column]:
    """Both endpoints of a packet, the lesser first, so that both directions have one key."""
    one, two = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    return [F.least(one, two).alias("end_a"), F.greatest(one, two).alias("end_b")]
