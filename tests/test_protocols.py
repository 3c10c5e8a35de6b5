"""Whole captures through the decoders and the engine."""

import hashlib
import hmac
import struct

import pytest
from pyspark.sql import functions as F

from netloom.api import FORMAT, Engine
from netloom.decoders import ftp, ssh, streams, tls
from netloom.sources import pcap, synth
from netloom.streaming import sessions


def talk(spark, turns, port, path="p.pcap", client_port=40000, base_us=1_000_000):
    """Packets of one connection: turns are (from_client, bytes)."""
    rows, seq = [(0, True, 99, 2, b"")], {True: 100, False: 500}
    for k, (out, data) in enumerate(turns, 1):
        rows.append((k, out, seq[out], 24, data))
        seq[out] += len(data)
    df = spark.createDataFrame(rows, "n int, out boolean, tcp_seq long, tcp_flags int, payload binary")
    either = lambda a, b: F.when(F.col("out"), F.lit(a)).otherwise(F.lit(b))
    return df.select(
        F.lit(path).alias("path"), "n", F.lit("tcp").alias("l4"), either("10.0.0.1", "10.0.0.2").alias("src_ip"), either("10.0.0.2", "10.0.0.1").alias("dst_ip"),
        either(client_port, port).alias("src_port"), either(port, client_port).alias("dst_port"), "tcp_seq", "tcp_flags", "payload", (F.lit(base_us) + F.col("n") * 1_000_000).cast("long").alias("ts_us"),
    )


def captured(packets):
    return synth.pcap(synth.frames(packets), ["ts_us", "n"])


def runs_of(packets):
    return streams.runs(streams.tcp_segments(pcap.packets(captured(packets))))


def test_ftp(spark):
    turns = [(False, b"220 hi\r\n"), (True, b"USER bob\r\n"), (False, b"331 pass\r\n"), (True, b"CWD pub\r\n"), (False, b"250 ok\r\n"), (True, b"CWD sub dir\r\n"), (False, b"250 ok\r\n")]
    turns += [(True, b"PASV\r\n"), (False, b"227 Entering (10,0,0,2,19,137)\r\n"), (True, b"RETR a.txt\r\n"), (False, b"150 go\r\n"), (True, b"CDUP\r\n"), (False, b"250 ok\r\n"), (True, b"QUIT\r\n")]
    control = talk(spark, turns, 21)
    data = talk(spark, [(False, b"content of a")], 5001, client_port=40001, base_us=11_000_000 + 500_000)
    seg = streams.tcp_segments(pcap.packets(captured(control.unionByName(data))))
    runs, whole = streams.runs(seg), streams.streams(seg)
    rows = {r.verb + str(r.argument): r for r in ftp.directories(ftp.control(runs)).collect()}
    assert rows["CDUPNone"].cwd == "/pub/sub dir" and rows["QUITNone"].cwd == "/pub" and rows["RETRa.txt"].port == 5001 and rows["USERbob"].code == 331
    f = ftp.data_files(ftp.control(runs), whole).collect()
    assert [(r.verb, r.path, r.size) for r in f] == [("RETR", "/FILES_FROM_10.0.0.2/pub/sub dir/a.txt", 12)]
    text = ftp.log(runs).first().content
    assert text.startswith("[<] 220 hi\r\n[>] USER bob\r\n")
    ls = ftp.mlsd(spark.createDataFrame([("/d", "type=dir;modify=20240102030405; x y\r\nType=file;Modify=bad; b\n")], "path string, content string")).orderBy("name").collect()
    assert (ls[1].name, ls[1].is_dir, str(ls[1].modified)) == ("x y", True, "2024-01-02 03:04:05") and ls[0].modified is None


def kexinit(lists):
    body = b"\x14" + b"c" * 16 + b"".join(struct.pack(">I", len(x)) + x for x in lists) + b"\0" * 13
    return struct.pack(">IB", len(body) + 1, 0) + body


def test_ssh(spark):
    lists = [b"kexA", b"hostkey", b"encOut", b"encIn", b"macOut", b"macIn", b"none", b"zlib", b"", b""]
    r = {x.side: x for x in ssh.handshakes(runs_of(talk(spark, [(False, b"SSH-2.0-srv\r\n"), (True, b"SSH-2.0-cli\r\n" + kexinit(lists)), (False, kexinit(lists)), (True, b"\0" * 30)], 22))).collect()}
    assert r[0].ident == "SSH-2.0-cli" and r[0].hassh == hashlib.md5(b"kexA;encOut;macOut;none").hexdigest()
    assert r[1].ident == "SSH-2.0-srv" and r[1].hassh == hashlib.md5(b"kexA;encIn;macIn;zlib").hexdigest()


def ext(kind, body):
    return struct.pack(">HH", kind, len(body)) + body


def record(kind, body):
    return struct.pack(">BHH", kind, 0x0303, len(body)) + body


def prf(secret, label, seed, n):
    out, a = b"", label + seed
    while len(out) < n:
        a = hmac.digest(secret, a, "sha256")
        out += hmac.digest(secret, a + label + seed, "sha256")
    return out[:n]


@pytest.fixture(scope="module")
def tls_capture(spark):
    cr, sr, master = b"C" * 32, b"S" * 32, b"M" * 48
    exts = ext(0, struct.pack(">HBH", 11, 0, 8) + b"test.org") + ext(0x0A0A, b"") + ext(10, struct.pack(">HH", 2, 29)) + ext(11, b"\1\0") + ext(13, struct.pack(">HH", 2, 0x0403)) + ext(16, b"\0\3\2h2")
    ch = struct.pack(">H", 0x0303) + cr + b"\0" + struct.pack(">4H", 6, 0x0A0A, 0xC02F, 0x009C) + b"\1\0" + struct.pack(">H", len(exts)) + exts
    sx = ext(0xFF01, b"\0")
    sh = struct.pack(">H", 0x0303) + sr + b"\0" + struct.pack(">H", 0xC02F) + b"\0" + struct.pack(">H", len(sx)) + sx
    hs = lambda t, b: record(22, struct.pack(">I", t << 24 | len(b)) + b)
    block = prf(master, b"key expansion", sr + cr, 192)
    keys = {True: (block[:16], block[32:36]), False: (block[16:32], block[36:40])}

    def seal(out, seq, plain, kind=23):
        key, salt = keys[out]
        nonce = struct.pack(">Q", seq + 77)
        aad = struct.pack(">QBHH", seq, kind, 0x0303, len(plain))
        b = lambda x: F.unhex(F.lit(x.hex()))
        c = spark.range(1).select(F.aes_encrypt(b(plain), b(key), F.lit("GCM"), F.lit("DEFAULT"), b(salt + nonce), b(aad)).alias("c")).first().c
        return record(kind, nonce + bytes(c)[12:])

    ask, answer = b"GET /x/y.txt?q HTTP/1.1\r\nHost: test.org\r\n\r\n", b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    turns = [(True, hs(1, ch)), (False, hs(2, sh)), (True, record(20, b"\1") + seal(True, 0, b"finished", 22)), (False, record(20, b"\1") + seal(False, 0, b"finished", 22))]
    turns += [(True, seal(True, 1, ask[:20]) + seal(True, 2, ask[20:])), (False, seal(False, 1, answer))]
    log = spark.createDataFrame([(f"CLIENT_RANDOM {cr.hex()} {master.hex()}",), ("# other",)], "line string")
    return captured(talk(spark, turns, 443)), log


def test_tls_hello_and_plaintext(spark, tls_capture):
    files, log = tls_capture
    runs = streams.runs(streams.tcp_segments(pcap.packets(files)))
    recs = tls.records(runs)
    h = tls.hellos(recs).first()
    assert h.sni == "test.org" and h.suite == 0xC02F and bytes(h.client_random) == b"C" * 32
    assert h.ja3 == hashlib.md5(b"771,49199-156,0-10-11-13-16,29,0").hexdigest() and h.ja3s == hashlib.md5(b"771,49199,65281").hexdigest()
    part = lambda s: hashlib.sha256(s.encode()).hexdigest()[:12]
    assert h.ja4 == f"t12d0205h2_{part('009c,c02f')}_{part('000a,000b,000d_0403')}" and h.ja4s == f"t120100_c02f_{part('ff01')}"


def test_engine_decrypts_and_lists(spark, tls_capture, tmp_path):
    files, log = tls_capture
    e = Engine.open(spark, captures=files, key_log=log)
    rows = e.visible(show_metadata=True, show_all=True).collect()
    kinds = sorted((r.file_type, r.name, r.is_metadata) for r in rows)
    assert kinds == [("http", "GET-y.txt", True), ("http", "y.txt", False), ("http", "y.txt", True), ("tcp", "tcp", False), ("tls", "TLS", False)]
    body = next(r for r in rows if r.name == "y.txt" and not r.is_metadata)
    assert bytes(body.content) == b"hello" and body.props["domain"] == "test.org" and body.props["srcIP"] == "10.0.0.2" and body.props["ja3"]
    assert {r.directory for r in e.listing("/protocol/domain/").collect()} == {"/http/test.org"}
    assert e.cat(body.stream, "http", body.start, 1, 3) == b"ell" and e.cat("none", "http") is None
    e.save(str(tmp_path / "index"))
    again = Engine.load(spark, str(tmp_path / "index"))
    key = lambda df: sorted((r.file_type, r.name, r.size, bytes(r.content)) for r in df.collect())
    assert key(again.files) == key(e.files)
    spark.createDataFrame([('{"format": %d}' % (FORMAT + 1),)], "value string").write.mode("overwrite").text(str(tmp_path / "index/meta"))
    with pytest.raises(ValueError):
        Engine.load(spark, str(tmp_path / "index"))


def test_xor_rule(spark):
    key = b"\x5a\xa5\x01"
    clear = b"attack at dawn, as ever"
    hidden = bytes(c ^ key[i % 3] for i, c in enumerate(clear))
    keys = spark.createDataFrame([("/k/xor.key", key)], "path string, key binary")
    rules = {"xor": [{"dstPort": "9", "keyfile": "none.key"}, {"dstPort": "7777", "dstIP": "10.0.0.2", "keyfile": "xor.key"}]}
    e = Engine.open(spark, captures=captured(talk(spark, [(True, hidden)], 7777)), rules=rules, xor_keys=keys)
    assert [bytes(r.content) for r in e.files.where("file_type = 'xor'").collect()] == [clear]


def test_same_captures(spark):
    a = spark.createDataFrame([("/x/a.pcap", 3)], "path string, length long")
    assert Engine.same_captures(a, spark.createDataFrame([("/y/a.pcap", 3), ("/y/b", 1)], "path string, length long"))
    assert not Engine.same_captures(a, spark.createDataFrame([("/y/a.pcap", 4)], "path string, length long"))


def test_streamed_sessions_equal_batch(spark, tmp_path):
    rows = [("a", t, 10) for t in (0, 5, 29, 31, 62, 200)] + [("b", t, 1) for t in (3, 40)] + [("z", 1000, 1)]
    df = spark.createDataFrame(rows, "key string, at long, size long").select("key", F.timestamp_seconds(F.col("at") + 5000).alias("ts"), "size")
    for k, (lo, hi) in enumerate([(0, 30), (30, 100), (100, 2000)]):
        df.where((F.unix_timestamp("ts") - 5000).between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessions.anchored(stream, 30, "10 seconds").writeStream.format("memory").queryName("anchored").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.key, r.session, r.packets, r.bytes) for r in spark.table("anchored").collect())
    assert got == [("a", 0, 3, 30), ("a", 1, 1, 10), ("a", 2, 1, 10), ("a", 3, 1, 10), ("b", 0, 1, 1), ("b", 1, 1, 1)]


def test_windows(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2), ("a", 59, 3), ("a", 61, 4), ("a", 1000, 1)], "key string, at long, size long").select("key", F.timestamp_seconds("at").alias("ts"), "size")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sessions.windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "1 minute").writeStream.format("memory").queryName("counted").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.packets, r.bytes) for r in spark.table("counted").collect()) == [(1, 4), (2, 5)]
