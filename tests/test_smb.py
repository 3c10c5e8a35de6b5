"""A share as SMB2 messages made by hand."""

import struct

from netloom.decoders import smb
from netloom.operators.tables import lasting

from .test_protocols import runs_of, talk

T0 = 133_500_000_000_000_000  # 2024-01-18 in tenths of microseconds since 1601


def message(command, mid, body, response=False, tree=1, status=0, chain=0):
    return b"\xfeSMB" + struct.pack("<HHIHHIIQIIQ16s", 64, 0, status, command, 1, int(response), chain, mid, 0, tree, 77, b"") + body


def framed(*messages):
    data = b"".join(messages)
    return struct.pack(">I", len(data)) + data


def utf(s):
    return s.encode("utf-16le")


def tree_connect(mid, path):
    return message(3, mid, struct.pack("<HHHH", 9, 0, 72, len(utf(path))) + utf(path), tree=0)


def create(mid, name, chain=0):
    body = struct.pack("<H", 57) + b"\0" * 42 + struct.pack("<HHII", 120, len(utf(name)), 0, 0) + utf(name)
    body += b"\0" * (-len(body) % 8)
    return message(5, mid, body, chain=64 + len(body) if chain else 0)


def created(mid, fid, mtime=T0):
    return message(5, mid, struct.pack("<HBBI4QQQII", 89, 0, 0, 1, T0, T0, mtime, T0, 0, 0, 32, 0) + fid + b"\0" * 8, True)


def write(mid, fid, pos, data):
    return message(9, mid, struct.pack("<HHIQ", 49, 112, len(data), pos) + fid + b"\0" * 16 + data)


def wrote(mid, n):
    return message(9, mid, struct.pack("<HHI", 17, 0, n) + b"\0" * 8, True)


def read(mid, fid, pos):
    return message(8, mid, struct.pack("<HBBIQ", 49, 0, 0, 100, pos) + fid + b"\0" * 17)


def was_read(mid, data):
    return message(8, mid, struct.pack("<HBBIII", 17, 80, 0, len(data), 0, 0) + data, True)


def test_share(spark):
    f, g = b"f" * 16, b"g" * 16
    turns = [(True, framed(tree_connect(1, "\\\\srv\\docs"))), (False, framed(message(3, 1, struct.pack("<HBBIII", 16, 1, 0, 0, 0, 0), True, tree=1)))]
    turns += [(True, framed(create(2, "dir\\ä.txt"))), (False, framed(created(2, f)))]
    for mid, pos, data in [(3, 0, b"one"), (4, 3, b"two"), (5, 9, b"lost"), (6, 0, b"onetwo"), (7, 0, b"new")]:
        turns += [(True, framed(write(mid, f, pos, data))), (False, framed(wrote(mid, len(data))))]
    turns += [(True, framed(create(8, "b.bin", chain=1), read(9, b"\xff" * 16, 0))), (False, framed(created(8, g)) + framed(was_read(9, b"\0\1\2")))]
    turns += [(True, framed(read(10, b"h" * 16, 0)))]
    msgs = smb.messages(runs_of(talk(spark, turns, 445)))
    ex = lasting(smb.exchanges(msgs))
    assert [r.share for r in smb.trees(ex).collect()] == ["docs"]
    assert sorted((r.path, r.is_directory) for r in smb.opens(ex).collect()) == [("/docs/b.bin", False), ("/docs/dir/ä.txt", False)]
    assert smb.opens(ex).first().mtime.year == 2024
    ops, told = lasting(smb.operations(ex)), lasting(smb.told(ex))
    v = smb.names(smb.versions(ops, told)).orderBy("name").collect()
    assert [(r.name, bytes(r.content), r.is_read) for r in v] == [("/docs/b.bin", b"\0\1\2", True), ("/docs/dir/ä.txt@0", b"onetwo", False), ("/docs/dir/ä.txt@1", b"new", False)]
    assert v[1].client_ips == ["10.0.0.1"] and v[1].last_access > v[1].ts_ns and v[2].last_access is None
    opened = (T0 - 116_444_736_000_000_000) * 100
    # A read has its server's time from the Create before it; a write from what comes after it, which is nothing here.
    assert (v[0].fs_time, v[1].fs_time) == (opened, None)
    e = sorted((r.path, r.kind, r.version, r.a, r.m, r.c) for r in smb.entries(smb.versions(ops, told), ops, told).collect())
    assert ("/docs/b.bin", "fs", 0, opened, opened, opened) in e and any(x[:3] == ("/docs/dir/ä.txt", "hybrid", 1) and x[3] == opened and x[4] == x[5] == v[2].ts_ns for x in e)
    assert smb.log(msgs).orderBy("run", "n").first().line == "[>] TREE_CONNECT" and ex.where("rsp IS NULL").count() == 1


def entry(kind, name, t, last=False):
    n = utf(name)
    head = struct.pack("<4QQQII", *t, 7, 8, 16 if name == "sub" else 32, len(n))
    body = struct.pack("<I", 0) + (struct.pack("<I", len(n)) if kind == 12 else head) + b"\0" * (smb.NAME_AT[kind] - (12 if kind == 12 else 64)) + n
    body += b"\0" * (-(len(body) + 4) % 8)
    return struct.pack("<I", 0 if last else len(body) + 4) + body


def test_directories_information_and_upserts(spark):
    """Entries of each class; and one file's times from a Create, a query, a setting and a Close."""
    f, d = b"f" * 16, b"d" * 16
    day = 864_000_000_000
    turns = [(True, framed(message(0, 0, struct.pack("<HH", 36, 1) + b"\0" * 32, tree=0))), (False, framed(message(0, 0, struct.pack("<HHHH", 65, 1, 0x0311, 0) + b"\0" * 32 + struct.pack("<QQ", 116_444_736_000_000_000 + 10_000_000 * 100, 0), True, tree=0)))]
    turns += [(True, framed(tree_connect(1, "\\\\srv\\docs"))), (False, framed(message(3, 1, struct.pack("<HBBIII", 16, 1, 0, 0, 0, 0), True, tree=1)))]
    turns += [(True, framed(create(2, ""))), (False, framed(created(2, d)))]
    mid = 3
    for kind in smb.NAME_AT:
        data = entry(kind, ".", (T0,) * 4) + entry(kind, f"file{kind}é", (T0 + kind * day,) * 4) + entry(kind, "sub", (T0,) * 4, True)
        turns += [(True, framed(message(14, mid, struct.pack("<HBBI", 33, kind, 0, 0) + d + struct.pack("<HHI", 0, 0, 65536)))), (False, framed(message(14, mid, struct.pack("<HHI", 9, 72, len(data)) + data, True)))]
        mid += 1
    turns += [(True, framed(create(50, "a.txt"))), (False, framed(created(50, f)))]
    basic = struct.pack("<4QI", T0 - day, T0 + day, T0 + 2 * day, T0 + 3 * day, 32)
    turns += [(True, framed(message(16, 51, struct.pack("<HBBIHHIII", 41, 1, 18, 200, 0, 0, 0, 0, 0) + f))), (False, framed(message(16, 51, struct.pack("<HHI", 9, 72, len(basic)) + basic, True)))]
    given = struct.pack("<4QI", 0, T0 + 5 * day, T0 + 6 * day, T0 + 7 * day, 0)
    turns += [(True, framed(message(17, 52, struct.pack("<HBBIHHI", 33, 1, 4, len(given), 96, 0, 0) + f + given))), (False, framed(message(17, 52, struct.pack("<H", 2), True)))]
    turns += [(True, framed(message(6, 53, struct.pack("<HHI", 24, 1, 0) + f))), (False, framed(message(6, 53, struct.pack("<HHI4Q", 60, 1, 0, T0, T0 + 8 * day, T0 + 8 * day, T0 + 8 * day), True)))]
    ex = lasting(smb.exchanges(smb.messages(runs_of(talk(spark, turns, 445)))))
    rows = smb.listed(ex).collect()
    assert {r.path for r in rows} == {"/docs/sub", *[f"/docs/file{k}é" for k in smb.NAME_AT]} and all(r.is_directory for r in rows if r.path.endswith("sub") and r.size)
    assert {r.path: r.mtime for r in rows if r.path != "/docs/sub"} == {f"/docs/file{k}é": None if k == 12 else T0 + k * day for k in smb.NAME_AT}
    ns = lambda k: (T0 + k * day - 116_444_736_000_000_000) * 100
    told = sorted((r.at, r.a, r.m, r.c, r.b) for r in smb.told(ex).where("path = '/docs/a.txt'").collect())
    assert [t[1:] for t in told] == [(ns(0),) * 4, (ns(1), ns(2), ns(3), ns(-1)), (ns(5), ns(6), ns(7), 0), (ns(8), ns(8), ns(8), ns(0))]
    assert smb.told(ex).where("path = '/docs/file12é' AND a IS NULL").count() == 1
    # The connection began in second 2 of 1970, and its server said 100.
    assert [r.skew for r in smb.skews(ex).collect()] == [98_000_000_000]
