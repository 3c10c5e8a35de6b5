"""Captures read in ranges against the walk over whole files, among them one that holds a capture."""

import random
import struct

import pytest

from netloom.sources import pcap, ranges


def record(ts, data):
    return struct.pack("<IIII", ts, ts % 1_000_000, len(data), len(data)) + data


HEAD = b"\xd4\xc3\xb2\xa1" + struct.pack("<HHIIII", 2, 4, 0, 0, 65535, 1)


def first_format(rnd, n):
    inner = b"".join(record(7, bytes([k]) * 50) for k in range(60))  # a chain of headers that are no records of this file
    return HEAD + b"".join(record(1000 + k, inner if k % 7 == 3 else rnd.randbytes(rnd.randint(1, 900))) for k in range(n))


def block(kind, body):
    body += b"\0" * (-len(body) % 4)
    return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)


def second_format(rnd, n, resolution=None):
    section = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    options = b"" if resolution is None else struct.pack("<HHB3x", 9, 1, resolution) + struct.pack("<HH", 0, 0)
    out = section + block(1, struct.pack("<HHI", 1, 0, 0) + options)
    for k in range(n):
        data = rnd.randbytes(rnd.randint(1, 700))
        out += block(6, struct.pack("<IIIII", 0, 0, 5_000_000 + k, len(data), len(data)) + data) if k % 9 else block(5, b"\0" * 12)
    return out


@pytest.fixture(scope="module")
def captures(tmp_path_factory):
    rnd, folder = random.Random(3), tmp_path_factory.mktemp("captures")
    for name, data in {"a.pcap": first_format(rnd, 150), "b.pcapng": second_format(rnd, 120), "c.pcapng": second_format(rnd, 40, 9), "d.pcapng": second_format(rnd, 30, 0x8A), "cut.pcap": first_format(rnd, 30)[:-100], "other.pcap": b"nothing of the kind" * 50, "empty.pcap": b""}.items():
        (folder / name).write_bytes(data)
    return folder


@pytest.mark.parametrize("size", [1 << 20, 5_000, 1_500])
def test_ranges_give_the_packets_of_whole_files(spark, captures, size):
    key = lambda df: sorted((r.path.rsplit("/", 1)[1], r.frame_no, r.ts_ns, r.at, bytes(r.frame)) for r in df.collect())
    want = key(pcap.frames(pcap.captures(spark, str(captures))))
    assert key(ranges.frames(spark, str(captures), size=size)) == want and len(want) > 280


def test_resolution_of_interfaces(spark, captures):
    ts = {name: spark_min for name, spark_min in ((r.path.rsplit("/", 1)[1], r.t) for r in pcap.frames(pcap.captures(spark, str(captures))).groupBy("path").agg({"ts_ns": "min"}).withColumnRenamed("min(ts_ns)", "t").collect())}
    assert (ts["b.pcapng"], ts["c.pcapng"], ts["d.pcapng"]) == (5_000_001_000, 5_000_001, 5_000_001 * 1_000_000_000 // 1024)


def test_bytes_at_places(spark, captures):
    data = (captures / "a.pcap").read_bytes()
    rows = [(str(captures / "a.pcap"), at, n) for at, n in ((0, 4), (24, 16), (len(data) - 3, 10), (len(data) + 5, 2), (500, 0), (-1, 2), (None, 2))] + [(None, 1, 1), (f"file://{captures}/b.pcapng", 0, 4)]
    got = ranges.bytes_at(spark.createDataFrame(rows, "path string, at long, length long")).collect()
    told = {(r.path and r.path[-3:], r.at, r.length): None if r.content is None else bytes(r.content) for r in got}
    assert told[("cap", 0, 4)] == data[:4] and told[("cap", len(data) - 3, 10)] == data[-3:] and told[("cap", len(data) + 5, 2)] == b"" and told[("cap", 500, 0)] == b""
    assert told[("cap", -1, 2)] is None and told[("cap", None, 2)] is None and told[(None, 1, 1)] is None and told[("png", 0, 4)] == b"\x0a\x0d\x0d\x0a"
