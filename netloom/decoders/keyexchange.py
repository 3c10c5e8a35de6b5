"""From secrets to master secrets: what a key log says, or what an RSA key opens.

A client's pre-master secret is encrypted for the key of the server's
certificate. Which private key that is, is an equality of moduli, read from
both, so keys and certificates meet in a join. Handshake messages are split
from their records; of a session with an extended master secret all of them up
to the client's key exchange are hashed, in order.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.binary import number
from ..operators.sequence import START
from . import certificates

HANDSHAKE, CHANGE = 22, 20
CLIENT_HELLO, SERVER_HELLO, KEY_EXCHANGE = 1, 2, 16
#: Extensions that change how keys are made or records are sealed.
TRUNCATED_MAC, ENCRYPT_THEN_MAC, EXTENDED_SECRET = 4, 22, 23
TLS_1_2 = 0x0303


def _expand(name: str, secret: bytes, seed: bytes, n: int) -> bytes:
    out, a = b"", seed
    while len(out) < n:
        a = hmac.digest(secret, a, name)
        out += hmac.digest(secret, a + seed, name)
    return out[:n]


def prf(version: int, digest: str, secret: bytes, label: bytes, seed: bytes, n: int) -> bytes:
    """The pseudo-random function of a version: one hash from 1.2 on, before it MD5 and SHA-1 of a half of the secret each, by exclusive or."""
    seed = label + seed
    if version >= TLS_1_2:
        return _expand(digest, secret, seed, n)
    half = (len(secret) + 1) // 2
    one, two = _expand("md5", secret[:half], seed, n), _expand("sha1", secret[len(secret) - half :], seed, n)
    return bytes(x ^ y for x, y in zip(one, two, strict=True))


def session_hash(version: int, digest: str, messages: bytes) -> bytes:
    if version >= TLS_1_2:
        return hashlib.new(digest, messages).digest()
    return hashlib.md5(messages).digest() + hashlib.sha1(messages).digest()


def _mgf(seed: bytes, n: int) -> bytes:
    return b"".join(hashlib.sha1(seed + k.to_bytes(4, "big")).digest() for k in range(-(-n // 20)))[:n]


def unpadded(block: bytes) -> bytes:
    """The message in a decrypted block: of type 2 padding, else of OAEP with SHA-1 and no label, else the block."""
    if block[:2] == b"\0\2" and (end := block.find(b"\0", 2)) >= 10:
        return block[end + 1 :]
    if len(block) >= 42 and block[0] == 0:
        seed = bytes(x ^ y for x, y in zip(block[1:21], _mgf(block[21:], 20), strict=True))
        data = bytes(x ^ y for x, y in zip(block[21:], _mgf(seed, len(block) - 21), strict=True))
        if data[:20] == hashlib.sha1(b"").digest() and (end := data.find(b"\1", 20)) >= 0 and not data[20:end].strip(b"\0"):
            return data[end + 1 :]
    return block


def rsa_open(sealed: bytes, modulus: bytes, exponent: bytes) -> bytes | None:
    """What an RSA private key opens; None for what is no number below its modulus."""
    n = int.from_bytes(modulus, "big")
    c = int.from_bytes(sealed, "big")
    if not sealed or not n or c >= n:
        return None
    return unpadded(pow(c, int.from_bytes(exponent, "big"), n).to_bytes(len(modulus), "big"))


def private_keys(der: DataFrame) -> DataFrame:
    """(path, modulus, exponent) of RSA private keys (path, der), as ``sources.keys.pem_keys`` gives them; others are left out."""
    kind = pa.struct([("modulus", pa.binary()), ("exponent", pa.binary())])

    @F.arrow_udf("struct<modulus:binary,exponent:binary>")
    def parse(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            rows = []
            for data in column.to_pylist():
                try:
                    _, a, b = next(certificates.values(data or b""))
                    fields = [data[s:e].lstrip(b"\0") for t, s, e in certificates.values(data, a, b) if t == certificates.INTEGER]
                    rows.append({"modulus": fields[1], "exponent": fields[3]})  # behind the version: modulus, public and private exponent
                except (ValueError, StopIteration, IndexError):
                    rows.append(None)
            yield pa.array(rows, kind)

    return der.withColumn("k", parse("der")).where("k IS NOT NULL").select("path", "k.modulus", "k.exponent")


def messages(recs: DataFrame) -> DataFrame:
    """(stream, side, run, n, k, version, kind, message) of the handshake messages before each side's change of cipher; one that is longer than its record is left out."""

    @F.arrow_udf("array<binary>")
    def split(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            rows = []
            for body in column.to_pylist():
                out, at = [], 0
                while body and at + 4 <= len(body):
                    end = at + 4 + int.from_bytes(body[at + 1 : at + 4], "big")
                    if end > len(body):
                        break
                    out.append(body[at:end])
                    at = end
                rows.append(out)
            yield pa.array(rows, pa.list_(pa.binary()))

    w = Window.partitionBy("stream", "side").orderBy("n").rowsBetween(START, 0)
    # The bytes of application records tell nothing here, and are not dealt.
    clear = recs.where(F.col("type").isin(CHANGE, HANDSHAKE)).withColumn("__open", F.sum((F.col("type") == CHANGE).cast("int")).over(w)).where((F.col("__open") == 0) & (F.col("type") == HANDSHAKE))
    each = clear.select("stream", "side", "run", "n", "version", F.posexplode(split("body")).alias("k", "message"))
    return each.withColumn("kind", number(F.col("message"), 0, 1).cast("int"))


def exchanges(msgs: DataFrame, digests: DataFrame) -> DataFrame:
    """(stream, version, sealed, rsa_id, extended, encrypt_then_mac, truncated_mac, session_hash) of each stream with a server's hello.

    ``digests`` is (stream, digest), the hash of the suite. ``sealed`` is what
    the client's key exchange holds behind its length, null without one.
    """
    m = F.col("message")
    at = F.lit(42) + number(m, 38, 1)  # behind version, random, session, suite and compression

    @F.arrow_udf("array<int>")
    def kinds(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for datas, places in parts:
            rows = []
            for data, here in zip(datas.to_pylist(), places.to_pylist(), strict=True):
                out = []
                if data and here is not None:
                    end, here = here + 2 + int.from_bytes(data[here : here + 2], "big"), here + 2
                    while here + 4 <= min(end, len(data)):
                        out.append(int.from_bytes(data[here : here + 2], "big"))
                        here += 4 + int.from_bytes(data[here + 2 : here + 4], "big")
                rows.append(out)
            yield pa.array(rows, pa.list_(pa.int32()))

    order = F.struct("run", "n", "k")
    hello = msgs.where(F.col("kind") == SERVER_HELLO).withColumn("ext", kinds(m, at.cast("int")))
    hello = hello.groupBy("stream").agg(F.min_by(F.struct("version", "ext"), order).alias("h"))
    keyed = msgs.where(F.col("kind") == KEY_EXCHANGE).groupBy("stream").agg(F.min_by(F.struct(m.alias("message"), F.struct("run", "n", "k").alias("at")), order).alias("x"))
    # Everything up to the client's key exchange, in order.
    upto = msgs.join(keyed.select("stream", F.col("x.at").alias("last")), "stream").where(order <= F.col("last"))
    said = upto.groupBy("stream").agg(F.expr("listagg(message) WITHIN GROUP (ORDER BY run, n, k)").alias("said"))

    @F.arrow_udf(BinaryType())
    def hashed(version: pa.Array, digest: pa.Array, data: pa.Array) -> pa.Array:
        rows = zip(version.to_pylist(), digest.to_pylist(), data.to_pylist(), strict=True)
        return pa.array([None if None in (v, d, x) else session_hash(v, d, x) for v, d, x in rows], pa.binary())

    out = hello.join(keyed, "stream", "left").join(said, "stream", "left").join(digests, "stream", "left")
    sealed = F.expr("substring(x.message, 7)")
    has = lambda k, name: F.array_contains("h.ext", k).alias(name)
    return out.select(
        "stream", F.col("h.version").alias("version"), sealed.alias("sealed"), F.substring(sealed, 1, 8).alias("rsa_id"), has(EXTENDED_SECRET, "extended"), has(ENCRYPT_THEN_MAC, "encrypt_then_mac"), has(TRUNCATED_MAC, "truncated_mac"),
        hashed("h.version", "digest", "said").alias("session_hash"),
    )


@F.arrow_udf(BinaryType())
def master_secret(version: pa.Array, digest: pa.Array, premaster: pa.Array, client: pa.Array, server: pa.Array, extended: pa.Array, hashed: pa.Array) -> pa.Array:
    """48 bytes from a pre-master secret; null where something is missing."""
    out = []
    for v, d, p, c, s, e, h in zip(*[x.to_pylist() for x in (version, digest, premaster, client, server, extended, hashed)], strict=True):
        if None in (v, d, p, c, s) or (e and h is None):
            out.append(None)
        else:
            out.append(prf(v, d, p, *((b"extended master secret", h) if e else (b"master secret", c + s)), 48))
    return pa.array(out, pa.binary())


@F.arrow_udf(BinaryType())
def opened(sealed: pa.Array, modulus: pa.Array, exponent: pa.Array) -> pa.Array:
    """Pre-master secrets that private keys open; null where one does not."""
    rows = zip(sealed.to_pylist(), modulus.to_pylist(), exponent.to_pylist(), strict=True)
    return pa.array([None if None in r else rsa_open(*r) for r in rows], pa.binary())


def masters(hello: DataFrame, exchange: DataFrame, log: DataFrame, keys: DataFrame | None = None, chains: DataFrame | None = None) -> DataFrame:
    """(stream, master) of each stream whose master secret can be told: by its client random, by the id of its sealed pre-master secret, or by the private key (path, modulus, exponent) of its server's certificate, in that order.

    ``hello`` is (stream, client_random, server_random, digest, ...). Of secrets
    that repeat an id the least counts. Streams that nothing opens have no row.
    """
    first = lambda kind, name: log.where(F.col("kind") == kind).groupBy(F.col("id").alias(name)).agg(F.min("secret").alias("secret"))
    s = hello.select("stream", "client_random", "server_random", "digest").join(exchange, "stream", "left")
    s = s.join(first("CLIENT_RANDOM", "client_random").withColumnRenamed("secret", "told"), "client_random", "left")
    s = s.join(first("RSA", "rsa_id").withColumnRenamed("secret", "before"), "rsa_id", "left")
    if keys is not None and chains is not None:
        leaf = chains.where("first_of_chain").groupBy("stream").agg(F.min("modulus").alias("modulus"))
        held = leaf.join(keys.groupBy("modulus").agg(F.min("exponent").alias("exponent")), "modulus")
        s = s.join(held, "stream", "left").withColumn("before", F.coalesce("before", opened("sealed", "modulus", "exponent")))
    made = master_secret("version", "digest", "before", "client_random", "server_random", "extended", "session_hash")
    return s.select("stream", F.coalesce("told", made).alias("master")).where("master IS NOT NULL")
