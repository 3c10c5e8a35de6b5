"""Files that servers hold, sessions, snapshots and directories through the user's side; and the joins and times beneath."""

import struct

import pytest
from pyspark.sql import functions as F

from netloom.api import Engine
from netloom.decoders import http, ssh
from netloom.functions import times
from netloom.operators import files, gather, joins

from .test_protocols import captured, runs_of, talk
from .test_smb import create, created, framed, message, tree_connect, write, wrote


@pytest.fixture(scope="module")
def share(spark, tmp_path_factory):
    f = b"f" * 16
    turns = [(True, framed(tree_connect(1, "\\\\srv\\docs"))), (False, framed(message(3, 1, struct.pack("<HBBIII", 16, 1, 0, 0, 0, 0), True, tree=1)))]
    turns += [(True, framed(create(2, "dir\\a.txt"))), (False, framed(created(2, f)))]
    for mid, data in [(3, b"old"), (4, b"newer")]:
        turns += [(True, framed(write(mid, f, 0, data))), (False, framed(wrote(mid, len(data))))]
    index = str(tmp_path_factory.mktemp("share") / "index")
    Engine.open(spark, captures=captured(talk(spark, turns, 445)), config='[general]\nsortby = "/protocol/path/"').save(index)
    return Engine.load(spark, index)


def test_versions_are_files(share):
    rows = {(r.directory, r.display_name): r for r in share.listing().collect()}
    assert {k for k in rows if k[0].startswith("/smb")} == {("/smb/docs/dir", "a.txt@0"), ("/smb/docs/dir", "a.txt@1")}
    late = rows["/smb/docs/dir", "a.txt@1"]
    assert share.cat(late.stream, "smb", late.start) == b"newer" and late.size == 5
    old = share.cat(late.stream, "smb", 0)
    assert old == b"old"
    seen = {r.start: r for r in share.files.where("file_type = 'smb' AND NOT is_metadata").collect()}
    second = seen[1].ts_ns // 1_000_000_000
    of = lambda **how: [(r.name, bytes(r.content), r.mtime_ns) for r in share.visible(**how).where("file_type = 'smb'").orderBy("name").collect()]
    # No name has a number in a snapshot, and each clock shows its own time.
    assert of(snapshot=str(second), timestamp_mode="network") == [("a.txt", b"old", seen[0].ts_ns)]
    assert of(snapshot="1970-01-01T00:00:00Z") == [] and len(of(snapshot="1970-01-01T00:00:00Z", timestamp_mode="network")) == 2
    assert [x[2] for x in of(timestamp_mode="network")] == [seen[0].ts_ns, seen[1].ts_ns] and [x[2] for x in of(timestamp_mode="hybrid")] == [seen[0].hybrid_ns, seen[1].hybrid_ns]
    assert [x[2] for x in of(timestamp_mode="fs")] == [0, 0] and [x[0] for x in of(snip=(seen[1].ts_ns, None))] == ["a.txt@1"]
    # The server told of no time after the writes, and that of the open is used up by the version after it.
    assert of(snapshot="2025-01-01T00:00:00Z", timestamp_mode="fs", show_metadata=True) == []
    by_client = {r.directory for r in share.listing("/protocol/srcIP/").where("file_type = 'smb'").collect()}
    assert by_client == {"/smb/10.0.0.1"}


def test_directories(share):
    top = share.readdir("/").collect()
    assert [(r.name, r.is_dir) for r in top if r.name == "smb"] == [("smb", True)]
    assert [(r.name, r.is_dir, r["size"]) for r in share.readdir("/smb/docs").collect()] == [("dir", True, 2)]
    assert [(r.name, r.is_dir) for r in share.readdir("/smb/docs/dir/").collect()] == [("a.txt@0", False), ("a.txt@1", False)]
    assert share.getattr("/smb/docs/dir")["size"] == 2 and share.getattr("/smb/docs")["size"] == 0 and share.getattr("/none") is None
    assert share.getattr("/smb/docs/dir/a.txt@1") | {"ts_ns": 0} == {"is_dir": False, "size": 5, "blocks": 1, "ts_ns": 0}
    assert share.ls("/smb/docs/dir").count() == 2 and share.ls("/smb/docs/dir", limit=1).count() == 1


def test_options():
    assert times.snip_ns("5,") == (5_000_000_000, None) and times.moment_ns("1970-01-01T00:00:07Z") == 7_000_000_000
    for bad in ("5", "1,2,3"):
        with pytest.raises(ValueError):
            times.snip_ns(bad)


def test_points_that_repeat_and_long_slots(spark):
    points = spark.createDataFrame([(1, 50), (1, 50), (1, 7_000_000), (2, 50), (1, None)], "k int, t long")
    slots = spark.createDataFrame([(1, 0, 10_000_000, 2, "long"), (1, 40, 60, 1, "short"), (1, 60, 40, 0, "turned"), (2, 51, 52, 1, "other")], "k int, lo long, hi long, o int, name string")
    got = joins.first_interval(points, slots, ["k"], "t", "lo", "hi", "o", 10).select("k", "t", "name").collect()
    assert sorted(map(tuple, got)) == [(1, 50, "short"), (1, 50, "short"), (1, 7_000_000, "long")]
    assert joins.first_interval(points, slots.limit(0), ["k"], "t", "lo", "hi", "o", 10).count() == 0


def test_keys_without_number(spark):
    locks = spark.range(3000).select("id", (F.col("id") % 2500).alias("mark"))
    keys = spark.range(5000).select(F.col("id").alias("key"), ((F.col("id") * 7) % 2500).alias("mark"))
    got = {r.id: r.key for r in files.first_opening(locks, keys, ["mark"], "key").collect()}
    first = {}
    for k in range(5000):
        first.setdefault(k * 7 % 2500, k)
    assert got == {i: first[i % 2500] for i in range(3000)}


def test_bytes_in_order(spark):
    df = spark.createDataFrame([(1, 2, b"b\xff"), (1, 1, b"\x00a"), (2, 1, None)], "k int, p int, b binary")
    assert {r.k: bytes(r.c) for r in df.groupBy("k").agg(gather.in_order("b", "p").alias("c")).collect()} == {1: b"\x00ab\xff", 2: b""}


def test_many_headers_and_long_lists(spark):
    head = b"GET / HTTP/1.1\r\n" + b"".join(b"X-%d: v\r\n" % k for k in range(1500)) + b"\r\n"
    one, two = (http.messages(runs_of(talk(spark, [(True, h)], 80))).first().ja4h for h in (head, head.replace(b"X-1499", b"Y-1499")))
    assert one != two
    lists = [b"a" * (1 << 20) + b"tail", *[b"x"] * 7]
    kex = bytes([20]) + b"c" * 16 + b"".join(struct.pack(">I", len(x)) + x for x in lists)
    read = lambda b: spark.createDataFrame([(b,)], "b binary").select(ssh._lists(F.col("b")).alias("x")).first().x
    assert read(kex) == [x.decode() for x in lists] and read(kex[:40]) == ["a" * 19, *[""] * 7]
