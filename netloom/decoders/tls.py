"""TLS: records and hellos as Columns, fingerprints, and decryption of AES-GCM, AES-CBC and RC4 with given secrets and keys.

AES is Spark's own; the pseudo-random function and RC4 run in Python, over batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import fingerprints
from ..functions.binary import aes_cbc, aes_gcm, by_slices, number
from ..operators import filters
from ..operators.gather import in_order
from ..operators.sequence import START
from ..operators.tables import lasting
from . import certificates, keyexchange
from .registry import Options, decoder, made, properties

HANDSHAKE, APPLICATION, CHANGE = 22, 23, 20
#: Suites by number: mode, key bytes, MAC bytes, hash of the pseudo-random function.
SUITES = {
    0x0004: ("rc4", 16, 16, "sha256"),
    0x0005: ("rc4", 16, 20, "sha256"),
    0x002F: ("cbc", 16, 20, "sha256"),
    0x0032: ("cbc", 16, 20, "sha256"),
    0x0033: ("cbc", 16, 20, "sha256"),
    0x0035: ("cbc", 32, 20, "sha256"),
    0x0038: ("cbc", 32, 20, "sha256"),
    0x0039: ("cbc", 32, 20, "sha256"),
    0x003C: ("cbc", 16, 32, "sha256"),
    0x003D: ("cbc", 32, 32, "sha256"),
    0x0040: ("cbc", 16, 32, "sha256"),
    0x0067: ("cbc", 16, 32, "sha256"),
    0x006A: ("cbc", 32, 32, "sha256"),
    0x006B: ("cbc", 32, 32, "sha256"),
    0x009C: ("gcm", 16, 0, "sha256"),
    0x009D: ("gcm", 32, 0, "sha384"),
    0x009E: ("gcm", 16, 0, "sha256"),
    0x009F: ("gcm", 32, 0, "sha384"),
    0xC007: ("rc4", 16, 20, "sha256"),
    0xC009: ("cbc", 16, 20, "sha256"),
    0xC00A: ("cbc", 32, 20, "sha256"),
    0xC011: ("rc4", 16, 20, "sha256"),
    0xC013: ("cbc", 16, 20, "sha256"),
    0xC014: ("cbc", 32, 20, "sha256"),
    0xC023: ("cbc", 16, 32, "sha256"),
    0xC024: ("cbc", 32, 48, "sha384"),
    0xC027: ("cbc", 16, 32, "sha256"),
    0xC028: ("cbc", 32, 48, "sha384"),
    0xC02B: ("gcm", 16, 0, "sha256"),
    0xC02C: ("gcm", 32, 0, "sha384"),
    0xC02F: ("gcm", 16, 0, "sha256"),
    0xC030: ("gcm", 32, 0, "sha384"),
}
#: Bytes of a MAC where it is truncated.
SHORT_MAC = 10


@F.arrow_udf(BinaryType())
def key_block(master: pa.Array, server_random: pa.Array, client_random: pa.Array, digest: pa.Array, version: pa.Array) -> pa.Array:
    """192 bytes of key material of a version; null where something is missing or the hash is not known."""
    rows = zip(*[x.to_pylist() for x in (master, server_random, client_random, digest, version)], strict=True)
    return pa.array([keyexchange.prf(v, d, m, b"key expansion", s + c, 192) if None not in (m, s, c, d, v) and d in hashlib.algorithms_available else None for m, s, c, d, v in rows], pa.binary())


RECORD = "array<struct<at:long,type:int,version:int,body:binary>>"


def _records(column: pa.Array) -> pa.Array:
    rows = []
    for data in column.to_pylist():
        out, at = [], 0
        while data and at + 5 <= len(data):
            n = int.from_bytes(data[at + 3 : at + 5], "big")
            if not 20 <= data[at] <= 23 or data[at + 1] != 3 or at + 5 + n > len(data):
                break
            out.append({"at": at, "type": data[at], "version": data[at + 1] << 8 | data[at + 2], "body": data[at + 5 : at + 5 + n]})
            at += 5 + n
        rows.append(out)
    return pa.array(rows, pa.list_(pa.struct([("at", pa.int64()), ("type", pa.int32()), ("version", pa.int32()), ("body", pa.binary())])))


def records(runs: DataFrame) -> DataFrame:
    """A row for each TLS record of a run: stream, side, run, n (in order within the stream and side), at, type, version, body. A record that is cut ends its run."""

    @F.arrow_udf(RECORD)
    def split(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            yield by_slices(_records, column)

    each = runs.select("stream", "side", "run", "ts_ns", F.posexplode(split("content")).alias("k", "r")).select("stream", "side", "run", "ts_ns", "k", "r.*")
    order = Window.partitionBy("stream", "side").orderBy("run", "k")
    return each.withColumn("n", F.row_number().over(order) - 1).drop("k")


def _numbers(data: Column, at: Column, n: Column, size: int) -> Column:
    """n bytes at a place as numbers of ``size`` bytes each."""
    steps = F.sequence(F.lit(0), F.greatest(F.floor(n / size).cast("int") - 1, F.lit(0)))
    return F.when(n >= size, F.transform(steps, lambda k: number(data, at + k * size, size).cast("int"))).otherwise(F.array().cast("array<int>"))


def _extensions(data: Column, at: Column) -> Column:
    """(kind, at, n) of each extension, read one behind the other until the list's length is used up."""
    total = F.coalesce(number(data, at, 2), F.lit(0).cast("long"))
    kind = "array<struct<kind:int,at:long,n:long>>"
    start = F.struct((at + 2).cast("long").alias("at"), F.array().cast(kind).alias("found"))

    def step(acc: Column, _: Column) -> Column:
        here, n = acc["at"], F.coalesce(number(data, acc["at"] + 2, 2), F.lit(0).cast("long"))
        got = F.struct(number(data, here, 2).cast("int").alias("kind"), (here + 4).alias("at"), n.alias("n"))
        more = here + 4 <= at + 2 + total
        return F.struct(F.when(more, here + 4 + n).otherwise(here).alias("at"), F.when(more, F.concat(acc["found"], F.array(got))).otherwise(acc["found"]).alias("found"))

    most = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(total / 4).cast("int")))
    return F.when(total >= 4, F.aggregate(most, start, step, lambda acc: acc["found"])).otherwise(F.array().cast(kind))


def hellos(recs: DataFrame) -> DataFrame:
    """A row a stream: randoms, the chosen suite, SNI, ja3, ja3s, ja4 and ja4s, from the first hello of each side."""
    b = F.col("body")
    h = recs.where((F.col("type") == HANDSHAKE) & number(b, 0, 1).isin(1, 2)).withColumn("msg", number(b, 0, 1))
    sid = number(b, 38, 1)
    at = F.lit(39) + sid
    is_client = F.col("msg") == 1
    n = F.when(is_client, number(b, at, 2)).otherwise(F.lit(0).cast("long"))
    suites = F.when(is_client, _numbers(b, at + 2, n, 2)).otherwise(F.array(number(b, at, 2).cast("int")))
    comp = F.when(is_client, at + 2 + n + 1 + number(b, at + 2 + n, 1)).otherwise(at + 3)
    h = h.withColumns({"version": number(b, 4, 2).cast("int"), "random": F.substring(b, 7, 32), "suites": suites, "ext_at": comp})
    h = h.withColumn("ext", _extensions(b, F.col("ext_at")))
    of = lambda k: F.try_element_at(F.filter("ext", lambda e: e["kind"] == k), F.lit(1))
    listed = lambda k, skip, size: F.when(of(k).isNotNull(), _numbers(b, of(k)["at"] + skip, of(k)["n"] - skip, size)).otherwise(F.array().cast("array<int>"))
    texted = lambda k, skip, size: F.when(of(k).isNotNull(), F.decode(F.substring(b, (of(k)["at"] + skip + size + 1).cast("int"), number(b, of(k)["at"] + skip, size).cast("int")), "ISO-8859-1"))
    h = h.withColumns({"kinds": F.transform("ext", lambda e: e["kind"]), "sni": texted(0, 3, 2), "alpn": texted(16, 2, 1), "sig": listed(13, 2, 2), "groups": listed(10, 2, 2), "formats": listed(11, 1, 1)})
    # The list of versions, where there is one, tells more than the field: the highest but reserved ones, or the server's one.
    offered = F.when(is_client, F.array_max(fingerprints.without_grease(listed(43, 1, 2)))).otherwise(F.get(listed(43, 0, 2), F.lit(0)))
    h = h.withColumn("best", F.coalesce(offered, F.col("version")))
    c, s = fingerprints, F.col("suites")
    marks = {
        "ja3": c.ja3(F.col("version"), s, F.col("kinds"), F.col("groups"), F.col("formats")),
        "ja4": c.ja4(F.col("best"), F.col("sni"), s, F.col("kinds"), F.col("sig"), F.col("alpn")),
        "ja3s": c.ja3s(F.col("version"), s[0], F.col("kinds")),
        "ja4s": c.ja4s(F.col("best"), s[0], F.col("kinds"), F.col("alpn")),
    }
    h = h.withColumns(marks)
    first = lambda col, msg: F.min_by(F.col(col), F.when(F.col("msg") == msg, F.struct("run", "n"))).alias
    return h.groupBy("stream").agg(
        first("random", 1)("client_random"), first("random", 2)("server_random"), F.min_by(F.col("suites")[0], F.when(F.col("msg") == 2, F.struct("run", "n"))).alias("suite"),
        first("sni", 1)("sni"), first("ja3", 1)("ja3"), first("ja4", 1)("ja4"), first("ja3s", 2)("ja3s"), first("ja4s", 2)("ja4s"), first("side", 1)("client_side"),
    )


def _suite(k: int) -> Column:
    return F.coalesce(*[F.when(F.col("suite") == s, F.lit(v[k])) for s, v in SUITES.items()])


def _rc4(rows: DataFrame) -> DataFrame:
    """``rows`` (stream, side, n, key, body) with ``raw``: each side's records opened one after the other, by one key stream that goes on from record to record."""
    cols = rows.columns
    at = {c: cols.index(c) for c in ("stream", "side", "key", "body")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, box, i, j = None, list(range(256)), 0, 0
        for b in batches:
            out = []
            for stream, side, key, body in zip(*[b.column(k).to_pylist() for k in at.values()], strict=True):
                if (stream, side) != now:
                    now, box, i, j = (stream, side), list(range(256)), 0, 0
                    for k in range(256):
                        j = (j + box[k] + key[k % len(key)]) % 256
                        box[k], box[j] = box[j], box[k]
                    j = 0
                clear = bytearray(len(body))
                for k, x in enumerate(body):
                    i = (i + 1) % 256
                    j = (j + box[i]) % 256
                    box[i], box[j] = box[j], box[i]
                    clear[k] = x ^ box[(box[i] + box[j]) % 256]
                out.append(bytes(clear))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*cols, "raw"])

    dealt = rows.repartition("stream", "side").sortWithinPartitions("stream", "side", "n")
    return dealt.mapInArrow(run, rows.withColumn("raw", F.lit(None).cast("binary")).schema)


def plaintexts(recs: DataFrame, hello: DataFrame, log: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(stream, side, run, n, plain) of application records of TLS 1.0 to 1.2 that a secret in ``log`` or a private key opens; others are left out.

    ``log`` is (kind, id, secret), ``keys`` (path, modulus, exponent); ``recs``
    and ``hello`` should be lasting. GCM records are checked by their tag, with
    the sequence number counted from the side's change of cipher. CBC begins
    with the last block of the record before in 1.0 and with a block of its own
    after that; its MAC is cut off, in front of the padding or behind it all
    where it covers the ciphertext. RC4 goes on from record to record.
    """
    h = hello.withColumns({"mode": _suite(0), "key_n": _suite(1), "mac_n": _suite(2), "digest": _suite(3)}).where("mode IS NOT NULL")
    exchange = keyexchange.exchanges(keyexchange.messages(recs), h.select("stream", "digest"))
    h = h.join(keyexchange.masters(h, exchange, log, keys, None if keys is None else certificates.chains(recs)), "stream")
    h = h.join(exchange.select("stream", "version", "encrypt_then_mac", "truncated_mac"), "stream")
    h = h.withColumn("block", key_block("master", "server_random", "client_random", "digest", "version"))
    w = Window.partitionBy("stream", "side").orderBy("n")
    r = recs.drop("version").repartition("stream").withColumn("open", F.sum((F.col("type") == CHANGE).cast("int")).over(w.rowsBetween(START, 0)))
    r = r.where(f"open > 0 AND type <> {CHANGE}").withColumns({"seq": F.row_number().over(w) - 1, "tail": F.lag(F.substring("body", -16, 16)).over(w)})
    r = r.join(h.select("stream", "client_side", "mode", "key_n", "mac_n", "block", "version", "encrypt_then_mac", "truncated_mac"), "stream")
    is_client = F.col("side") == F.col("client_side")
    at = 2 * F.col("mac_n") + F.when(is_client, 0).otherwise(F.col("key_n"))
    cut = lambda a, n: F.substring(F.col("block"), (a + 1).cast("int"), n)
    iv_n = F.when(F.col("mode") == "gcm", 4).otherwise(16)
    r = r.withColumns({"key": cut(at, F.col("key_n")), "iv": cut(2 * F.col("mac_n") + 2 * F.col("key_n") + F.when(is_client, 0).otherwise(iv_n), iv_n)})
    r = r.withColumn("mac_n", F.when(F.col("truncated_mac") & (F.col("mac_n") > 0), SHORT_MAC).otherwise(F.col("mac_n")))
    stream_ = _rc4(r.where("mode = 'rc4'")).where(F.col("type") == APPLICATION)
    kept = F.octet_length("raw") - F.col("mac_n")
    stream_ = stream_.select("stream", "side", "run", "n", F.when(kept >= 0, F.substring("raw", F.lit(1), kept.cast("int"))).alias("plain"))
    r = r.where((F.col("type") == APPLICATION) & (F.col("mode") != "rc4"))
    size = F.octet_length("body")
    head = F.unhex(F.concat(F.lpad(F.hex("seq"), 16, "0"), F.lit("170303"), F.lpad(F.hex(size - 24), 4, "0")))
    gcm = F.when(F.col("mode") == "gcm", aes_gcm(F.concat("iv", F.substring("body", 1, 8)), F.expr("substring(body, 9)"), F.col("key"), head))
    own_iv = F.col("version") > 0x0301
    behind = F.when(F.col("encrypt_then_mac"), F.col("mac_n")).otherwise(0)
    r = r.withColumns({"sealed": F.substring(F.expr("substring(body, if(version > 769, 17, 1))"), F.lit(1), (size - F.when(own_iv, 16).otherwise(0) - behind).cast("int")), "before": F.when(own_iv, F.substring("body", 1, 16)).otherwise(F.coalesce("tail", "iv"))})
    fits = (F.col("mode") == "cbc") & (F.octet_length("sealed") >= 16) & (F.octet_length("sealed") % 16 == 0)
    r = r.withColumn("raw", F.when(fits, aes_cbc(F.col("sealed"), F.col("key"), F.col("before"))))
    keep = F.octet_length("raw") - number(F.col("raw"), F.octet_length("raw") - 1, 1) - 1 - F.when(F.col("encrypt_then_mac"), 0).otherwise(F.col("mac_n"))
    cbc = F.when(keep >= 0, F.substring("raw", F.lit(1), keep.cast("int")))
    return r.select("stream", "side", "run", "n", F.coalesce(gcm, cbc).alias("plain")).unionByName(stream_).where("plain IS NOT NULL")


def _fits(options: Options) -> Column:
    """Port 443; with ``any_port`` a first record with a sane header that is there as a whole."""
    b, under = F.col("content"), F.col("file_type").isin("tcp", "xor")
    if not options.any_port:
        return under & ((F.col("first.src_port") == 443) | (F.col("first.dst_port") == 443))
    n = number(b, 3, 2)
    sane = number(b, 0, 1).between(20, 23) & (number(b, 1, 1) == 3) & number(b, 2, 1).between(1, 3) & (n <= 0x40FF) & (n + 5 <= F.octet_length(b))
    return under & (F.col("offset") == 0) & (F.octet_length(b) > 5) & sane


def _opened(options: Options) -> Column:
    """Whether rules let a stream be decrypted: all, if there are none."""
    rules = options.rules.get("tls", [])
    return filters.matches(rules, {k: F.try_element_at("props", F.lit(k)) for r in rules for k in r}) if rules else F.lit(True)


@decoder("tls", _fits, whole=lambda o: o.any_port)
def files(runs: DataFrame, options: Options) -> DataFrame:
    """The application data of each stream with a hello, run by run, in the clear where a key is known and rules allow; and its certificates as PEM."""
    recs = lasting(records(runs))
    hello = lasting(hellos(recs))
    plain = recs.where(F.col("type") == APPLICATION).select("stream", "side", "run", "n", F.col("body").alias("part"), F.lit(False).alias("opened"))
    if options.key_log is not None:
        allowed = hello.join(runs.where(_opened(options)).select("stream").distinct(), "stream", "left_semi")
        clear = lasting(plaintexts(recs, allowed, options.key_log, options.private_keys).select("stream", "side", "run", "n", F.col("plain").alias("part"), F.lit(True).alias("opened")))
        plain = plain.join(clear.select("stream").distinct(), "stream", "left_anti").unionByName(clear)
    content = plain.groupBy("stream", "side", "run").agg(in_order("part", "n").alias("content"))
    chain = certificates.chains(recs).where("first_of_chain").select("stream", "ja4x").dropDuplicates(["stream"])
    marks = hello.join(chain, "stream", "left")
    own = properties(protocol=F.lit("tls"), domain=F.col("sni"), ja3=F.col("ja3"), ja3s=F.col("ja3s"), ja4=F.col("ja4"), ja4s=F.col("ja4s"), ja4x=F.col("ja4x"))
    heads = runs.select("stream", "side", "run", "ts_ns", "offset", "first", "missing_data")
    talk = content.join(heads.join(marks, "stream"), ["stream", "side", "run"])
    data = talk.select(*made(F.col("stream"), F.lit("tls"), F.lit("TLS"), F.col("content"), own, run=F.col("run"), offset=F.col("offset"), missing=F.col("missing_data")))
    certs = certificates.chains(recs).withColumnRenamed("ja4x", "own_ja4x").join(heads, ["stream", "side", "run"]).join(marks.withColumn("ja4x", F.lit(None).cast("string")), "stream")
    own = F.map_concat(own, properties(ja4x=F.col("own_ja4x")))
    pems = certs.select(*made(F.col("stream"), F.concat_ws("@", F.lit("certificate"), "side", "place"), F.lit("TLSCertificate"), F.col("pem"), own, offset=F.col("offset") + F.col("at"), is_metadata=F.lit(True)))
    return data.unionByName(pems)
