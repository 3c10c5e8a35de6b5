"""TLS sessions of several versions, suites and key exchanges made by hand, and published vectors."""

import hashlib
import hmac
import random
import struct

from pyspark.sql import functions as F

from netloom.decoders import certificates, keyexchange, tls
from netloom.operators.tables import lasting
from netloom.sources import keys as keysource

from .test_protocols import ext, runs_of, talk


def prime(rnd, bits):
    while True:
        n = rnd.getrandbits(bits) | (3 << (bits - 2)) | 1
        if n % 65537 != 1 and all(pow(a, n - 1, n) == 1 for a in (2, 3, 5, 7)):
            return n


def tlv(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + struct.pack(">H", n)) + body


def integer(n):
    return tlv(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def make_key(rnd):
    p, q = prime(rnd, 512), prime(rnd, 512)
    return p * q, pow(65537, -1, (p - 1) * (q - 1)), p, q


def certificate(n):
    name = tlv(0x30, tlv(0x31, tlv(0x30, tlv(6, b"\x55\4\3") + tlv(12, b"srv"))))
    alg = tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01010b")) + b"\5\0")
    key = tlv(0x30, tlv(0x30, tlv(6, certificates.RSA) + b"\5\0") + tlv(3, b"\0" + tlv(0x30, integer(n) + integer(65537))))
    return tlv(0x30, tlv(0x30, integer(1) + alg + name + tlv(0x30, b"") + name + key) + alg + tlv(3, b"\0" * 9))


def rc4(key, data):
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) % 256
        box[i], box[j] = box[j], box[i]
    out, i, j = [], 0, 0
    for x in data:
        i = (i + 1) % 256
        j = (j + box[i]) % 256
        box[i], box[j] = box[j], box[i]
        out.append(x ^ box[(box[i] + box[j]) % 256])
    return bytes(out)


class Session:
    def __init__(self, spark, version, suite, premaster, sealed, exts=(), cert=None):
        self.spark, self.version, self.mode = spark, version, tls.SUITES[suite]
        self.cr, self.sr = random.Random(suite).randbytes(32), random.Random(suite + 1).randbytes(32)
        message = lambda kind, body: struct.pack(">I", kind << 24 | len(body)) + body
        xs = b"".join(ext(k, b"") for k in exts)
        ch = message(1, b"\3\3" + self.cr + b"\0" + struct.pack(">HHBBH", 2, suite, 1, 0, 0))
        sh = message(2, b"\3\3" + self.sr + b"\0" + struct.pack(">HBH", suite, 0, len(xs)) + xs)
        chain = b"" if cert is None else message(11, struct.pack(">I", len(cert) + 3)[1:] + struct.pack(">I", len(cert))[1:] + cert)
        done, cke = message(14, b""), message(16, struct.pack(">H", len(sealed)) + sealed)
        digest = self.mode[3]
        hashed = keyexchange.session_hash(version, digest, ch + sh + chain + done + cke)
        self.master = keyexchange.prf(version, digest, premaster, *((b"extended master secret", hashed) if 23 in exts else (b"master secret", self.cr + self.sr)), 48)
        block = keyexchange.prf(version, digest, self.master, b"key expansion", self.sr + self.cr, 192)
        m, k = self.mode[2], self.mode[1]
        self.keys = {True: (block[2 * m : 2 * m + k], block[2 * m + 2 * k :][:16]), False: (block[2 * m + k : 2 * m + 2 * k], block[2 * m + 2 * k + 16 :][:16])}
        self.gcm_iv = {True: block[2 * m + 2 * k :][:4], False: block[2 * m + 2 * k + 4 :][:4]}
        self.seen, self.tail, self.exts = {True: b"", False: b""}, {True: None, False: None}, exts
        self.seq = {True: 0, False: 0}
        self.turns = [(True, self.record(22, ch)), (False, self.record(22, sh) + (self.record(22, chain) if chain else b"") + self.record(22, done)), (True, self.record(22, cke) + self.record(20, b"\1") + self.seal(True, b"finished", 22)), (False, self.record(20, b"\1") + self.seal(False, b"finished", 22))]

    def record(self, kind, body):
        return struct.pack(">BHH", kind, self.version, len(body)) + body

    def aes(self, mode, key, iv, data, aad=b""):
        b = lambda x: F.unhex(F.lit(x.hex()))
        more = (b(aad),) if mode == "GCM" else ()
        return bytes(self.spark.range(1).select(F.aes_encrypt(b(data), b(key), F.lit(mode), F.lit("PKCS" if mode == "CBC" else "DEFAULT"), b(iv), *more).alias("c")).first().c)

    def seal(self, out, plain, kind=23):
        key, iv = self.keys[out]
        mac = b"m" * (10 if 4 in self.exts else self.mode[2])
        seq, self.seq[out] = self.seq[out], self.seq[out] + 1
        if self.mode[0] == "gcm":
            nonce = struct.pack(">Q", seq + 5)
            return self.record(kind, nonce + self.aes("GCM", key, self.gcm_iv[out] + nonce, plain, struct.pack(">QBHH", seq, kind, 0x0303, len(plain)))[12:])
        if self.mode[0] == "rc4":
            self.seen[out] += plain + mac
            return self.record(kind, rc4(key, self.seen[out])[-len(plain + mac) :])
        data = plain + (b"" if 22 in self.exts else mac)
        pad = 15 - len(data) % 16
        data += bytes([pad]) * (pad + 1)
        if self.version > 0x0301:
            iv = hashlib.md5(plain + bytes([seq])).digest()
        elif self.tail[out]:
            iv = self.tail[out]
        body = self.aes("CBC", key, iv, data)[16 : 16 + len(data)]
        self.tail[out] = body[-16:]
        return self.record(kind, (iv if self.version > 0x0301 else b"") + body + (mac if 22 in self.exts else b""))

    def say(self, *said):
        self.turns += [(out, b"".join(self.seal(out, x) for x in plains)) for out, plains in said]
        return self.turns


def test_sessions_of_many_kinds(spark, tmp_path):
    rnd = random.Random(12)
    n, d, p, q = make_key(rnd)
    size = n.bit_length() // 8
    other = make_key(rnd)
    secret = lambda k: b"\3\3" + random.Random(k).randbytes(46)
    padded = lambda m: pow(int.from_bytes(b"\0\2" + b"\x7f" * (size - 3 - len(m)) + b"\0" + m, "big"), 65537, n).to_bytes(size, "big")
    data = hashlib.sha1(b"").digest() + b"\0" * (size - 2 - 40 - 48) + b"\1" + secret(4)
    seed = b"s" * 20
    masked = bytes(a ^ b for a, b in zip(data, keyexchange._mgf(seed, len(data)), strict=True))
    oaep = b"\0" + bytes(a ^ b for a, b in zip(seed, keyexchange._mgf(masked, 20), strict=True)) + masked
    cert = certificate(n)
    sessions = [
        Session(spark, 0x0303, 0x003C, secret(1), padded(secret(1)), cert=cert),
        Session(spark, 0x0301, 0x002F, secret(2), b"idOfTwo!" + b"x" * 120),
        Session(spark, 0x0302, 0x0035, secret(3), b"none", exts=(22,)),
        Session(spark, 0x0303, 0x0005, secret(4), pow(int.from_bytes(oaep, "big"), 65537, n).to_bytes(size, "big"), exts=(23,), cert=cert),
        Session(spark, 0x0303, 0x009C, secret(5), b"idOfFive" + b"y" * 120),
        Session(spark, 0x0303, 0xC027, secret(6), b"none", exts=(4,)),
        Session(spark, 0x0303, 0x0067, secret(7), b"nobody knows", cert=certificate(other[0] + 2)),
    ]
    said = [(True, [b"a question", b"and more of it " * 9]), (False, [b"an answer", b"", b"z" * 40]), (True, [b"bye"])]
    packets = None
    for k, s in enumerate(sessions):
        one = talk(spark, s.say(*said), 443, client_port=41_000 + k)
        packets = one if packets is None else packets.unionByName(one)
    lines = [f"RSA {b'idOfTwo!'.hex()} {secret(2).hex()}", f"RSA {b'idOfFive'.hex()} {secret(5).hex()}"] + [f"CLIENT_RANDOM {sessions[k].cr.hex()} {sessions[k].master.hex()}" for k in (2, 5)]
    log = keysource.key_log(spark.createDataFrame([(x,) for x in lines], "line string"))
    for name, (a, b, c, e) in {"srv.pem": (n, d, p, q), "other.pem": other}.items():
        import base64

        der = tlv(0x30, b"".join(map(integer, (0, a, 65537, b, c, e, b % (c - 1), b % (e - 1), pow(e, -1, c)))))
        (tmp_path / name).write_text(f"-----BEGIN RSA PRIVATE KEY-----\n{base64.encodebytes(der).decode()}-----END RSA PRIVATE KEY-----\n")
    (tmp_path / "junk.pem").write_text("-----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY-----\n")
    keys = keyexchange.private_keys(keysource.pem_keys(spark, str(tmp_path)))
    assert keys.count() == 2
    runs = lasting(runs_of(packets))
    recs = lasting(tls.records(runs))
    hello = lasting(tls.hellos(recs))
    got = {}
    rows = tls.plaintexts(recs, hello, log, keys).join(runs.select("stream", F.greatest("first.src_port", "first.dst_port").alias("port")).distinct(), "stream")
    for r in rows.orderBy("port", "run", "n").collect():
        got.setdefault(r.port - 41_000, []).append((r.side, bytes(r.plain)))
    want = [(int(not out), x) for out, plains in said for x in plains]
    assert {k: v for k, v in got.items()} == dict.fromkeys(range(6), want)


def test_vectors(spark):
    label = bytes.fromhex("a0ba9f936cda311827a6f796ffd5198c")
    out = keyexchange.prf(0x0303, "sha256", bytes.fromhex("9bbe436ba940f017b17652849a71db35"), b"test label", label, 100)
    assert out.hex().startswith("e3f229ba727be17b8d122620557cd453") and len(out) == 100
    one, two = keyexchange._expand("md5", b"ab", b"xs", 40), keyexchange._expand("sha1", b"bc", b"xs", 40)
    assert keyexchange.prf(0x0301, "sha256", b"abc", b"x", b"s", 40) == bytes(a ^ b for a, b in zip(one, two, strict=True))
    assert one[:16] == hmac.digest(b"ab", hmac.digest(b"ab", b"xs", "md5") + b"xs", "md5")
    rows = [("s", 0, k, bytes.fromhex("0102030405"), b"\0" * n) for k, n in enumerate((16, 100, 124, 16))] + [("s", 1, 0, b"Key", b"Plaintext"), ("t", 0, 0, b"Wiki", b"")]
    got = {(r.stream, r.side, r.n): bytes(r.raw) for r in tls._rc4(spark.createDataFrame(rows, "stream string, side int, n int, key binary, body binary")).collect()}
    assert got["s", 0, 0].hex() == "b2396305f03dc027ccc3524a0a1118a8" and got["s", 0, 1][:16].hex() == "6982944f18fc82d589c403a47a0d0919" and got["s", 0, 3].hex() == "28cb1132c96ce286421dcaadb8b69eae"
    assert got["s", 1, 0].hex() == "bbf316e8d940af0ad3" and got["t", 0, 0] == b""


def test_what_is_no_key():
    assert keyexchange.rsa_open(b"\xff" * 8, b"\x10" * 8, b"\3") is None and keyexchange.rsa_open(b"", b"\x10", b"\3") is None
    assert keyexchange.unpadded(b"\0\1abc") == b"\0\1abc" and keyexchange.unpadded(b"\0\2short\0x") == b"\0\2short\0x"
