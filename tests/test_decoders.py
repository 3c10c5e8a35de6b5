"""Decoders and functions on bytes made by hand."""

import json
import struct

from pyspark.sql import functions as F

from netloom.decoders import dns, streams
from netloom.functions import binary, fingerprints, text
from netloom.operators import filters, sequence
from netloom.sources import keys, pcap, synth


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_aes_cbc_vector(spark):
    key, iv = "2b7e151628aed2a6abf7158809cf4f3c", "000102030405060708090a0b0c0d0e0f"
    r = one(spark, p=F.hex(binary.aes_cbc(F.unhex(F.lit("7649abac8119b246cee98e9b12e9197d")), F.unhex(F.lit(key)), F.unhex(F.lit(iv)))))
    assert r.p.lower() == "6bc1bee22e409f96e93d7e117393172a"


def test_little_and_big_numbers(spark):
    d = F.unhex(F.lit("01020304"))
    r = one(spark, big=binary.number(d, 0, 4), little=binary.number(d, 0, 4, little=True), beyond=binary.number(d, 2, 4))
    assert (r.big, r.little, r.beyond) == (0x01020304, 0x04030201, None)


def test_empty_list_part(spark):
    assert one(spark, p=fingerprints.part(F.lit(""))).p == "e3b0c44298fc"


def test_ja4_counts_and_grease(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, j=fingerprints.ja4(F.lit(0x0304), F.lit("host"), a(0x1301, 0x0A0A, 0x1302), a(0, 16, 43, 0x1A1A), a(0x0403), F.lit("h2")))
    assert r.j.startswith("t13d0203h2_")


def test_ftp_text(spark):
    r = one(
        spark,
        p=text.port_of_pair(F.lit("227 Entering Passive Mode (1,2,3,4,19,137)")),
        e=text.port_of_bars(F.lit("229 ok (|||6446|)")),
        none=text.port_of_bars(F.lit("nothing")),
        c=text.response_code(F.lit("250-x")),
        z=text.response_code(F.lit("USER a")),
        n=text.fact_name(F.lit("type=dir;modify=20240101000000; a; b")),
    )
    assert (r.p, r.e, r.none, r.c, r.z, r.n) == (5001, 6446, None, 250, 0, "b")


def test_chunks_and_bad_bytes(spark):
    rows = spark.createDataFrame([(b"3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n",), (b"3\r\nabc\r\nzz",), (b"",), (None,)], "c binary")
    got = [None if r.u is None else bytes(r.u) for r in rows.select(binary.unchunk("c").alias("u")).collect()]
    assert got == [b"abcde", b"abc", b"", None]
    assert bytes(spark.createDataFrame([(b"junk",)], "c binary").select(binary.gunzip("c").alias("g")).first().g) == b""


def test_dns_golden():
    q = b"\x10\x32" + struct.pack(">5H", 0x0100, 1, 0, 0, 0) + b"\x06google\x03com\x00" + struct.pack(">2H", 15, 1)
    q = struct.pack("<H", 28663) + q[2:]
    assert json.loads(dns.to_json(q)) == {"ID": "28663", "Queries": [{"class": "IN", "name": "google.com", "type": "MX"}]}
    assert dns.to_json(q).startswith('{\n\t"ID": "28663",\n\t"Queries": [\n\t\t{')
    assert dns.to_json(b"short") is None
    loop = struct.pack(">6H", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c" + struct.pack(">2H", 1, 1)
    assert dns.to_json(loop) is None


def test_dns_answer():
    head = struct.pack(">6H", 1, 0x8180, 1, 2, 1, 0) + b"\x01a\x00" + struct.pack(">2H", 1, 1)
    a = b"\xc0\x0c" + struct.pack(">2HIH", 1, 1, 60, 4) + bytes([1, 2, 3, 4])
    mx = b"\xc0\x0c" + struct.pack(">2HIH", 15, 1, 60, 4) + struct.pack(">H", 10) + b"\xc0\x0c"
    ns = b"\xc0\x0c" + struct.pack(">2HIH", 2, 1, 7, 2) + b"\xc0\x0c"
    j = json.loads(dns.to_json(head + a + mx + ns))
    assert [x["data"] for x in j["Answers"]] == ["1.2.3.4", "a"]
    assert j["Answers"][1]["preference"] == "10" and j["Authorities"] == [{"auth": "a", "ttl": "7"}]


def test_unknown_and_cut_captures(spark):
    files = spark.createDataFrame([("a", b"nothing"), ("b", b""), ("c", b"\xd4\xc3\xb2\xa1" + b"\0" * 20 + b"\1\0\0\0" * 4)], "path string, content binary")
    assert pcap.frames(files).count() == 0


def test_embedded_secrets_and_key_log(spark):
    line = b"CLIENT_RANDOM " + b"ab" * 32 + b" " + b"cd" * 48
    line += b"\n# comment\nRSA zz 00\n"
    pad = -len(line) % 4
    block = struct.pack("<IIII", 10, 20 + len(line) + pad, 0x544C534B, len(line)) + line + b"\0" * pad + struct.pack("<I", 20 + len(line) + pad)
    head = bytes.fromhex("0a0d0d0a1c0000004d3c2b1a01000000ffffffffffffffff1c000000")
    rows = keys.key_log(pcap.secrets(spark.createDataFrame([("x", head + block)], "path string, content binary"))).collect()
    assert len(rows) == 1 and bytes(rows[0].id) == b"\xab" * 32


def test_overlap_is_cut_and_first_bytes_win(spark):
    base = dict(path="p", l4="tcp", src_ip="1.1.1.1", dst_ip="2.2.2.2", src_port=5, dst_port=6)
    rows = [(0, 9, 2, b""), (1, 10, 24, b"abcd"), (2, 12, 24, b"XXef"), (3, 10, 24, b"abcd"), (4, 18, 24, b"ij")]
    df = spark.createDataFrame([(k, s, f, p) for k, s, f, p in rows], "n int, tcp_seq long, tcp_flags int, payload binary")
    df = df.select("*", *[F.lit(v).alias(k) for k, v in base.items()], F.col("n").cast("long").alias("ts_us"))
    r = streams.runs(streams.tcp_segments(pcap.packets(synth.pcap(synth.frames(df), ["n"])))).collect()
    assert len(r) == 1 and bytes(r[0].content) == b"abcdef\0\0ij" and r[0].missing_data


def test_ipv6_udp(spark):
    udp = struct.pack(">4H", 1, 2, 11, 0) + b"xyz"
    ip = struct.pack(">IHBB", 6 << 28, len(udp), 17, 64) + b"\0" * 15 + b"\1" + b"\xfe\x80" + b"\0" * 13 + b"\2"
    frame = b"\0" * 12 + b"\x81\x00\x00\x07" + b"\x86\xdd" + ip + udp
    df = spark.createDataFrame([("p", 0, 0, 0, frame)], pcap.FRAMES)
    r = pcap.dissect(df).first()
    assert (r.src_ip, r.dst_ip, r.src_port, bytes(r.payload)) == ("::1", "fe80::2", 1, b"xyz")


def test_sessions_are_anchored_at_their_start(spark):
    df = spark.createDataFrame([("a", t, t) for t in (0, 20, 29, 30, 59, 61)], "k string, at long, id long")
    got = {r.at: r.session for r in sequence.anchored_sessions(df, ["k"], "at", 30, "id").collect()}
    assert got == {0: 0, 20: 0, 29: 0, 30: 1, 59: 1, 61: 2}


def test_rules(spark):
    p = {"a": F.col("a"), "b": F.col("b")}
    df = spark.createDataFrame([("1", "2"), ("1", None), (None, None)], "a string, b string")
    got = [r.m for r in df.select(filters.matches([{"a": "1", "b": "2"}], p).alias("m")).collect()]
    assert got == [True, False, False]
    assert not df.select(filters.matches([], p).alias("m")).first().m


def test_config():
    c = keys.config('[general]\nsortby="/srcIP/"\n[keys]\nkeyfiles="a.key"\n[[decode.xor.properties]]\ndstPort="1"\n')
    assert c == {"sortby": "/srcIP/", "keyfiles": ["a.key"], "rules": {"xor": [{"dstPort": "1"}]}}


def test_dhcp_golden():
    from netloom.decoders import dhcp

    head = struct.pack(">4BIHH", 1, 1, 6, 0, 15645, 0, 0) + b"\0" * 16 + bytes.fromhex("000b8201fc42") + b"\0" * 10 + b"\0" * 192 + b"\x63\x82\x53\x63"
    options = b"\x35\1\1" + b"\x3d\7\1" + bytes.fromhex("000b8201fc42") + b"\x32\4\0\0\0\0" + b"\x37\4\1\3\6\x2a" + b"\xff"
    text = dhcp.to_json(head + options)
    assert len(text.encode()) == 561
    j = json.loads(text)
    assert j["ID"] == "15645" and j["Options"]["Parameter Request List"] == ["Subnet Mask", "Router", "DNS Servers", "NTP Server Addresses"]
    assert j["Options"]["Client Identifier"] == {"Client MAC Address": "00:0b:82:01:fc:42", "Hardware Type": "Ethernet"}
    assert dhcp.to_json(head[:200]) is None and dhcp.to_json(head + b"\x33\4\0") is not None


def test_sessions_and_hosts_are_not_packed_into_one_file(spark, monkeypatch):
    import datetime

    from netloom.plans import captures

    def packed(*_):
        raise AssertionError("all frames in one file")

    monkeypatch.setattr(captures.synth, "pcap", packed)
    t = datetime.datetime(2024, 1, 1)
    wide = (1 << 24) + 7  # one stream with user 7, were addresses three bytes
    e = spark.createDataFrame([(1, 7, t, "a"), (2, wide, t, "b"), (3, 7, t, "c"), (4, 7, t + datetime.timedelta(hours=7), "d")], "event_id long, user_id long, ts timestamp, props string")
    got = sorted((r.user_id, r.session, r.datagrams) for r in captures.event_sessions(e).collect())
    assert got == [(7, 0, 2), (7, 1, 1), (wide, 0, 1)]
    assert captures.pcap_dns_hosts(spark, "/root/testdata/sf0.001").count() > 0


def test_whole_texts_are_told_apart(spark, tmp_path):
    import hashlib

    from netloom import registry

    texts = ["same words " * 20 + "é tail one", "same words " * 20 + "é tail two", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hexed = {r.doc_id: r for r in registry.queries()["hex_roundtrip_text"](spark, str(tmp_path)).collect()}
    assert [hexed[i].hex for i in range(4)] == [t if t is None else t.encode().hex() for t in texts]
    assert hexed[0].back == hashlib.md5(texts[0].encode()).hexdigest() != hexed[1].back
    parts = {r.doc_id: r.part for r in registry.queries()["fingerprint_sorted_text"](spark, str(tmp_path)).collect()}
    for i in (0, 1):
        words = sorted("".join(c for c in texts[i] if c == " " or c.isascii() and c.isalpha()).split(" "))
        assert parts[i] == hashlib.sha256(",".join(words).encode()).hexdigest()[:12]
    assert parts[0] != parts[1]
