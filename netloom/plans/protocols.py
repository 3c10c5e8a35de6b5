"""Queries that let the tables talk over protocols, and read the talk back: TLS, XOR, FTP, SSH, DHCP, SMB, and what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..api import Engine
from ..decoders import certificates, dhcp, ftp, keyexchange, smb, ssh, streams, tls
from ..decoders.registry import DECODERS, Options, fixpoint
from ..functions.binary import xor
from ..operators.sequence import START
from ..operators.tables import lasting
from ..registry import query
from ..sources import keys as keysource
from ..sources import pcap, synth
from .captures import PATH, _conv, _ends, _raw, _t, http_talk

PIECE = 32_000  # bytes of a segment


def _b(x: Column | int, size: int, little: bool = False) -> Column:
    """A number as bytes."""
    return F.unhex(synth._n(F.lit(x) if isinstance(x, int) else x, size, little))


def _x(digits: str) -> Column:
    return F.unhex(F.lit(digits))


def _bytes(text: Column | str) -> Column:
    return F.encode(F.lit(text) if isinstance(text, str) else text, "UTF-8")


def _sized(body: Column, size: int = 2) -> Column:
    """A body behind its length."""
    return F.concat(_b(F.octet_length(body), size), body)


def _sha(*of: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", *of).cast("binary"), 256))


def _flows(turns: DataFrame, net: int, port: int, client_port: Column | int = 40000) -> DataFrame:
    """Packets of one TCP flow for each ``n`` of ``turns`` (n, k, out, payload[, ts_us]): a SYN, then what each turn says in segments; the client opens."""
    if "ts_us" not in turns.columns:
        turns = turns.withColumn("ts_us", (F.col("k").cast("long") + 2) * 1_000_000)
    client_port = F.lit(client_port) if isinstance(client_port, int) else client_port
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length("payload") - 1) / PIECE).cast("int"))))
    p = turns.where("octet_length(payload) > 0").withColumn("client_port", client_port).withColumn("piece", cut)
    p = p.withColumn("payload", F.substring(F.col("payload"), F.col("piece") * PIECE + 1, F.lit(PIECE)))
    # What is said is made and dealt once, by flow: the SYN comes out of a flow's first row.
    flow = Window.partitionBy("n").orderBy("out", "k", "piece").rowsBetween(START, Window.unboundedFollowing)
    p = p.withColumns({"opened": F.min("ts_us").over(flow), "place": F.row_number().over(Window.partitionBy("n").orderBy("out", "k", "piece"))})
    way = Window.partitionBy("n", "out").orderBy("k", "piece").rowsBetween(START, -1)
    p = p.withColumn("tcp_seq", F.lit(1000) + F.coalesce(F.sum(F.octet_length("payload")).over(way), F.lit(0)))
    p = p.withColumn("said", F.explode(F.sequence(F.when(F.col("place") == 1, 0).otherwise(1), F.lit(1))))
    its = lambda c, of_syn: F.when(F.col("said") == 0, of_syn).otherwise(F.col(c)).alias(c)
    p = p.select("n", its("k", F.lit(-1)), its("out", F.lit(True)), its("payload", F.lit(b"")), its("ts_us", F.col("opened") - 1000), "client_port", its("piece", F.lit(0)), its("tcp_seq", F.lit(999).cast("long")), F.when(F.col("said") == 0, 2).otherwise(24).alias("tcp_flags"))
    client, server = _ends(F.col("n"), net)
    either = lambda a, b: F.when(F.col("out"), a).otherwise(b)
    return p.select(
        F.concat(F.lit(f"{net}-{port}-"), F.col("n").cast("string")).alias("path"), ((F.col("k").cast("long") + 1) * 1_000_000 + F.col("piece")).alias("frame_no"), F.lit("tcp").alias("l4"), either(client, server).alias("src_ip"), either(server, client).alias("dst_ip"),
        either(F.col("client_port"), F.lit(port)).alias("src_port"), either(F.lit(port), F.col("client_port")).alias("dst_port"), "tcp_seq", "tcp_flags", "payload", "ts_us",
    )


def _packets(flows: DataFrame) -> DataFrame:
    return pcap.dissect(_raw(synth.frames(flows), "frame_no"))


def _runs(flows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Message runs of flows, written once: several steps read them."""
    return lasting(streams.runs(streams.tcp_segments(_packets(flows), tasks)))


def _base(flows: DataFrame) -> DataFrame:
    """The runs of flows as files to decode, written once."""
    return lasting(Engine._tcp(streams.runs(streams.tcp_segments(_packets(flows)))))


def _n(first: str = "first") -> Column:
    """The number of the flow whose endpoints ``first`` has."""
    return _conv(f"{first}.src_ip", f"{first}.dst_ip")


def _turns(df: DataFrame, says: list[tuple[bool, Column]], n: str) -> DataFrame:
    """Turns (n, k, out, payload) of a row each: what its two ends say, in order; what is null is left out."""
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(out).alias("out"), x.cast("binary").alias("payload")) for k, (out, x) in enumerate(says)])
    # The array is a column of its own: code made of the whole of it inside the explode can be too large to be compiled.
    says_ = df.select(F.col(n).cast("long").alias("n"), each.alias("says"))
    return says_.select("n", F.explode_outer("says").alias("s")).select("n", "s.k", "s.out", "s.payload").where("payload IS NOT NULL")


# --- TLS, XOR and what is in them


def _record(kind: int, body: Column) -> Column:
    return F.concat(_b(kind, 1), _x("0303"), _sized(body))


def _handshake(kind: int, body: Column) -> Column:
    return F.concat(_b(kind, 1), _sized(body, 3))


def _hello(n: Column, host: Column, suite: str = "c02f", extensions: str = "0000") -> tuple[Column, Column]:
    """Client and server hello of flow ``n``, with randoms that its number gives."""
    name = _sized(F.concat(_x("00"), _sized(_bytes(host))))
    ext = _sized(F.concat(_x("0000"), _sized(name)))
    ch = F.concat(_x("0303"), _sha(F.lit("c"), n), _x("00"), _x("0002" + suite), _x("0100"), ext)
    sh = F.concat(_x("0303"), _sha(F.lit("s"), n), _x("00"), _x(suite), _x("00"), _x(extensions))
    return _handshake(1, ch), _handshake(2, sh)


def _master(n: Column) -> Column:
    return F.concat(_sha(F.lit("m"), n), F.substring(_sha(F.lit("k"), n), 1, 16))


def _premaster(n: Column) -> Column:
    return F.concat(_x("0303"), _sha(F.lit("p"), n), F.substring(_sha(F.lit("q"), n), 1, 14))


def _tls(df: DataFrame, n: str, host: Column, says: Column, certificate: Column | None = None, rsa: bool = False) -> DataFrame:
    """Turns of a TLS 1.2 session for each row: hellos, finished messages, then ``says`` (array of out and text), a record each, sealed with AES-128-GCM.

    With ``rsa`` the client sends a sealed secret, which begins with the flow's
    number, and the master secret is the extended one.
    """
    df = df.withColumns({"__n": F.col(n).cast("long"), "__says": says})
    if rsa:
        ch, sh = _hello(F.col("__n"), host, "009c", "000400170000")
        exchange = _handshake(16, _sized(F.concat(_b(F.col("__n"), 8), _x("77" * 120))))
        hashed = F.unhex(F.sha2(F.concat(ch, sh, exchange), 256))
        master = keyexchange.master_secret(F.lit(0x0303), F.lit("sha256"), _premaster(F.col("__n")), _sha(F.lit("c"), F.col("__n")), _sha(F.lit("s"), F.col("__n")), F.lit(True), hashed)
        df = df.withColumn("__master", master)
    else:
        ch, sh = _hello(F.col("__n"), host)
        exchange = None
        df = df.withColumn("__master", _master(F.col("__n")))
    df = df.withColumn("__block", tls.key_block(F.col("__master"), _sha(F.lit("s"), F.col("__n")), _sha(F.lit("c"), F.col("__n")), F.lit("sha256"), F.lit(0x0303)))
    fin = F.concat(_record(20, _x("01")), _record(22, _x("00" * 40)))
    server = _record(22, sh) if certificate is None else F.concat(_record(22, sh), _record(22, certificate))
    opening = _turns(df, [(True, _record(22, ch)), (False, server), (True, fin if exchange is None else F.concat(_record(22, exchange), fin)), (False, fin)], "__n")
    cells = df.select("__n", "__block", F.posexplode("__says").alias("pos", "say")).select("__n", "__block", "pos", "say.out", "say.text")
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / 16_000).cast("int")))
    cells = cells.where("octet_length(text) > 0").withColumn("cut", cut).withColumn("text", F.substring(F.col("text"), F.col("cut") * 16_000 + 1, F.lit(16_000)))
    seq = F.row_number().over(Window.partitionBy("__n", "out").orderBy("pos", "cut"))
    cells = cells.withColumns({"seq": seq, "k": F.row_number().over(Window.partitionBy("__n").orderBy("pos", "cut")) + 3})
    key = F.when(F.col("out"), F.substring("__block", 1, 16)).otherwise(F.substring("__block", 17, 16))
    salt = F.when(F.col("out"), F.substring("__block", 33, 4)).otherwise(F.substring("__block", 37, 4))
    nonce = _b(F.col("seq"), 8)
    aad = F.concat(_b(F.col("seq"), 8), _x("170303"), _b(F.octet_length("text"), 2))
    sealed = F.aes_encrypt(F.col("text"), key, F.lit("GCM"), F.lit("DEFAULT"), F.concat(salt, nonce), aad)
    data = cells.withColumn("sealed", sealed).select(F.col("__n").alias("n"), "k", "out", _record(23, F.concat(nonce, F.expr("substring(sealed, 13)"))).alias("payload"))
    return opening.unionByName(data)


def _log(df: DataFrame, n: str) -> DataFrame:
    n_ = F.col(n).cast("long")
    return keysource.key_log(df.select(F.concat_ws(" ", F.lit("CLIENT_RANDOM"), F.hex(_sha(F.lit("c"), n_)), F.hex(_master(n_))).alias("line")))


XOR_KEY = b"\x5a\xa5\x01\x33\x70"


def _hidden(turns: DataFrame) -> DataFrame:
    """Turns as they go over a wire where every stream is hidden by a repeating key."""
    at = F.coalesce(F.sum(F.octet_length("payload")).over(Window.partitionBy("n").orderBy("k").rowsBetween(START, -1)), F.lit(0))
    turn = (F.col("at") % len(XOR_KEY)).cast("int")
    key = F.concat(F.substring(F.lit(XOR_KEY), turn + 1, F.lit(len(XOR_KEY))), F.substring(F.lit(XOR_KEY), F.lit(1), turn))
    return turns.withColumn("at", at).withColumn("key", key).withColumn("payload", xor("payload", "key")).drop("at", "key")


def _said(spark, sf_dir) -> DataFrame:
    """(conv_id, says): the turns of each conversation; the first role's side is the client's."""
    c = _t(spark, sf_dir, "conversations").withColumn("out", F.col("role") == F.min_by("role", "turn").over(Window.partitionBy("conv_id")))
    one = F.struct("turn", "out", _bytes(F.col("text")).alias("text"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("says"))


def _pages_hidden(spark, sf_dir):
    """(runs, options): pages as HTTP in TLS in XOR."""
    pages = http_talk(_t(spark, sf_dir, "pages"))
    says = F.array(F.struct(F.lit(True).alias("out"), F.col("ask").alias("text")), F.struct(F.lit(False).alias("out"), F.col("answer").alias("text")))
    turns = lasting(_tls(pages, "page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1), says))
    keys = spark.createDataFrame([("/keys/xor.key", XOR_KEY)], "path string, key binary")
    options = Options({"xor": [{"dstPort": "443", "keyfile": "xor.key"}]}, keys, _log(pages, "page_id"))
    return _base(_flows(_hidden(turns), 20, 443)), options


@query(
    "fixpoint_xor_tls_http",
    f"""SELECT page_id, 3 AS depth, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS domain, {PATH} AS uri, regexp_extract(regexp_extract({PATH}, '^[^? ;]*', 0), '[^/]*$', 0) AS filename, md5(html) AS body_md5
      FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/]+(/[^#]*)?', 1) AS p FROM pages)""",
)
def fixpoint_xor_tls_http(spark, sf_dir):
    base, options = _pages_hidden(spark, sf_dir)
    rows, _ = fixpoint(base, options)
    m = rows.where("file_type = 'http' AND NOT is_metadata AND name NOT LIKE 'GET%'")
    return m.select(_n().alias("page_id"), "depth", F.col("props")["domain"].alias("domain"), F.col("props")["uri"].alias("uri"), F.col("name").alias("filename"), F.md5("content").alias("body_md5"))


@query(
    "fixpoint_parents",
    "SELECT page_id, unnest(['tcp', 'xor', 'tls', 'http', 'http', 'http']) AS file_type, unnest([true, true, true, false, false, false]) AS parsed, unnest([0, 1, 2, 3, 3, 3]) AS depth, unnest(['tcp', 'xor', 'TLS', 'GET', 'head', 'body']) AS part FROM pages",
)
def fixpoint_parents(spark, sf_dir):
    """Every file of every round, how deep it lies, and whether it was decoded further."""
    base, options = _pages_hidden(spark, sf_dir)
    rows, parsed = fixpoint(base, options)
    rows = rows.groupBy("file").agg(F.first("file_type").alias("file_type"), F.first("depth").alias("depth"), F.first("name").alias("name"), F.first("is_metadata").alias("meta"), F.first("first").alias("first"))
    rows = rows.join(parsed.distinct().withColumn("parsed", F.lit(True)), "file", "left")
    part = F.when(F.col("file_type") != "http", F.col("name")).when(F.startswith("name", F.lit("GET")), "GET").when(F.col("meta"), "head").otherwise("body")
    return rows.select(_n().alias("page_id"), "file_type", F.coalesce("parsed", F.lit(False)).alias("parsed"), "depth", part.alias("part"))


def _conversations_sealed(spark, sf_dir) -> DataFrame:
    return _tls(_said(spark, sf_dir), "conv_id", F.concat(F.lit("host"), F.col("conv_id").cast("string"), F.lit(".test")), F.col("says"))


def _opened(base: DataFrame, options: Options) -> DataFrame:
    """(conv_id, content) of the TLS files in ``base``."""
    rows, _ = fixpoint(base, options, {"tls": DECODERS["tls"]})
    data = rows.where("file_type = 'tls' AND NOT is_metadata")
    return data.groupBy("file").agg(F.first("first").alias("first"), F.expr("listagg(content) WITHIN GROUP (ORDER BY run)").alias("content")).select(_n().alias("conv_id"), "content")


@query("tls_plaintext", "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS plain_md5, CAST(sum(octet_length(encode(text))) AS BIGINT) AS size FROM conversations GROUP BY conv_id")
def tls_plaintext(spark, sf_dir):
    """A TLS session a conversation, opened with the secrets of a key log."""
    out = _opened(_base(_flows(_conversations_sealed(spark, sf_dir), 50, 443)), Options(key_log=_log(_said(spark, sf_dir), "conv_id")))
    return out.select("conv_id", F.md5("content").alias("plain_md5"), F.octet_length("content").cast("long").alias("size"))


@query("tls_rsa_extended", "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS plain_md5 FROM conversations GROUP BY conv_id")
def tls_rsa_extended(spark, sf_dir):
    """Sessions whose pre-master secret the log tells by its id, with an extended master secret over all that was said before."""
    said = _said(spark, sf_dir)
    turns = _tls(said, "conv_id", F.lit("rsa.test"), F.col("says"), rsa=True)
    id_ = F.col("conv_id").cast("long")
    log = keysource.key_log(said.select(F.concat_ws(" ", F.lit("RSA"), F.hex(_b(id_, 8)), F.hex(_premaster(id_))).alias("line")))
    out = _opened(_base(_flows(turns, 50, 443)), Options(key_log=log))
    return out.select("conv_id", F.md5("content").alias("plain_md5"))


@query(
    "tls_rules",
    """SELECT conv_id, CAST(sum(octet_length(encode(text))) + CASE WHEN conv_id % 2 = 1 THEN 0 ELSE 24 * count(*) END AS BIGINT) AS size, CASE WHEN conv_id % 2 = 1 THEN md5(string_agg(text, '' ORDER BY turn)) END AS plain_md5
    FROM conversations WHERE octet_length(encode(text)) > 0 GROUP BY conv_id""",
)
def tls_rules(spark, sf_dir):
    """Rules let the sessions of one client port be opened; the others show what went over the wire."""
    flows = _flows(_conversations_sealed(spark, sf_dir), 50, 443, (F.lit(40000) + F.col("n") % 2).cast("int"))
    base = _base(flows)
    out = _opened(base, Options({"tls": [{"srcPort": "40001", "protocol": "tls"}]}, key_log=_log(_said(spark, sf_dir), "conv_id")))
    return out.select("conv_id", F.octet_length("content").cast("long").alias("size"), F.when(F.col("conv_id") % 2 == 1, F.md5("content")).alias("plain_md5"))


@query("tls_by_content", "SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 <> 0")
def tls_by_content(spark, sf_dir):
    """Sessions on a port of no protocol are found by their records; plain talk on it is not, nor is either without being asked for."""
    said = _said(spark, sf_dir)
    sealed = _conversations_sealed(spark, sf_dir).where("n % 3 <> 0")
    plain = said.where("conv_id % 3 = 0").select(F.col("conv_id").alias("n"), F.posexplode("says").alias("k", "s")).select("n", "k", "s.out", F.col("s.text").alias("payload"))
    base = _base(_flows(sealed.unionByName(plain), 50, 8443))
    found = lambda any_port: fixpoint(base, Options(any_port=any_port), {"tls": DECODERS["tls"]})[0].where("file_type = 'tls'").select(_n().alias("conv_id")).distinct()
    return found(True).join(found(False), "conv_id", "left_anti")


@query(
    "tls_hellos",
    """SELECT conv_id, 'host' || conv_id || '.test' AS sni, 49199 AS suite, md5('771,49199,0,,') AS ja3, md5('771,49199,') AS ja3s, 't12d010100_' || left(sha256('c02f'), 12) || '_' || left(sha256(''), 12) AS ja4, 't120000_c02f_' || left(sha256(''), 12) AS ja4s
    FROM (SELECT DISTINCT conv_id FROM conversations)""",
)
def tls_hellos(spark, sf_dir):
    runs = _runs(_flows(_conversations_sealed(spark, sf_dir), 50, 443))
    h = tls.hellos(tls.records(runs)).join(runs.where("run = 0").select("stream", "first"), "stream")
    return h.select(_n().alias("conv_id"), "sni", F.col("suite").cast("int").alias("suite"), "ja3", "ja3s", "ja4", "ja4s")


def _der(tag: int, body: Column) -> Column:
    """A value with its tag and length; the body is bound to a name, for it nests deep and is looked at more than once."""

    def value(x: Column) -> Column:
        n = F.octet_length(x)
        return F.concat(_b(tag, 1), F.when(n < 128, _b(n, 1)).when(n < 256, F.concat(_x("81"), _b(n, 1))).otherwise(F.concat(_x("82"), _b(n, 2))), x)

    return F.transform(F.array(body), value)[0]


def _name(country: Column, common: Column) -> Column:
    entry = lambda oid, x: _der(0x31, _der(0x30, F.concat(_der(0x06, _x(oid)), _der(0x0C, _bytes(x)))))
    return _der(0x30, F.concat(entry("550406", country), entry("550403", common)))


def _certificate(number: Column, issuer: Column, subject: Column, extensions: list[str], modulus: Column) -> Column:
    """A certificate in DER with an RSA key; its signature is zeros."""
    algorithm = _der(0x30, F.concat(_der(0x06, _x("2a864886f70d01010b")), _x("0500")))
    when = _der(0x30, F.concat(_der(0x17, F.lit(b"240101000000Z")), _der(0x17, F.lit(b"340101000000Z"))))
    rsa = _der(0x30, F.concat(_der(0x02, F.concat(_x("00"), modulus)), _der(0x02, _x("010001"))))
    key = _der(0x30, F.concat(_der(0x30, F.concat(_der(0x06, _x("2a864886f70d010101")), _x("0500"))), _der(0x03, F.concat(_x("00"), rsa))))
    exts = _der(0xA3, _der(0x30, F.concat(*[_der(0x30, F.concat(_der(0x06, _x(e)), _der(0x04, _x("3000")))) for e in extensions])))
    inner = _der(0x30, F.concat(_der(0xA0, _x("020102")), _der(0x02, _b(number, 4)), algorithm, issuer, when, subject, key, exts))
    return _der(0x30, F.concat(inner, algorithm, _der(0x03, _x("00" + "00" * 32))))


def _digits(modulus: Column) -> Column:
    """The digits of a modulus of 32 bytes: a number that is read back has no zeros before it."""
    return F.lpad(F.lower(F.hex(modulus)), 64, "0")


@query(
    "certificate_chains",
    """WITH c AS (SELECT s_suppkey, 0 AS place, s_name AS subject, n_name AS issuer, '551d11,551d0f' AS ext FROM supplier JOIN nation ON n_nationkey = s_nationkey
      UNION ALL SELECT s_suppkey, 1, n_name, r_name, '551d13' FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
    SELECT s_suppkey AS suppkey, place, subject AS subject_name, issuer AS issuer_name, left(sha256('550406,550403'), 12) || '_' || left(sha256('550406,550403'), 12) || '_' || left(sha256(ext), 12) AS ja4x,
      sha256(place || ':' || s_suppkey) AS modulus, true AS same, (place = 0) AS first_of_chain FROM c""",
)
def certificate_chains(spark, sf_dir):
    """Each supplier's server shows its certificate and that of its nation; as PEM and back they are the same bytes."""
    s = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = F.col("s_suppkey").cast("long")
    modulus = lambda place: _sha(F.lit(place), n)
    leaf = _certificate(n, _name(F.lit("XX"), F.col("n_name")), _name(F.lit("XX"), F.col("s_name")), ["551d11", "551d0f"], modulus("0"))
    root = _certificate(n, _name(F.lit("XX"), F.col("r_name")), _name(F.lit("XX"), F.col("n_name")), ["551d13"], modulus("1"))
    chain = _handshake(11, _sized(F.concat(_sized(leaf, 3), _sized(root, 3)), 3))
    turns = _tls(s, "s_suppkey", F.col("s_name"), F.array().cast("array<struct<out:boolean,text:binary>>"), chain)
    runs = _runs(_flows(turns, 70, 443))
    c = certificates.chains(tls.records(runs)).join(runs.where("run = 0").select("stream", "first"), "stream")
    same = certificates.from_pem(F.decode("pem", "UTF-8")) == F.col("der")
    return c.select(_n().alias("suppkey"), F.col("place").cast("int").alias("place"), "subject_name", "issuer_name", "ja4x", _digits(F.col("modulus")).alias("modulus"), same.alias("same"), "first_of_chain")


@query("xor_streams", "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS clear_md5 FROM conversations GROUP BY conv_id")
def xor_streams(spark, sf_dir):
    said = _said(spark, sf_dir).select(F.col("conv_id").alias("n"), F.posexplode("says").alias("k", "s")).select("n", "k", "s.out", F.col("s.text").alias("payload"))
    base = _base(_flows(_hidden(said.where("octet_length(payload) > 0")), 50, 7777))
    keys = spark.createDataFrame([("/keys/xor.key", XOR_KEY)], "path string, key binary")
    rows, _ = fixpoint(base, Options({"xor": [{"dstPort": "7777", "keyfile": "other/xor.key"}]}, keys), {"xor": DECODERS["xor"]})
    return rows.where("file_type = 'xor'").groupBy("file").agg(F.first("first").alias("first"), F.expr("listagg(content) WITHIN GROUP (ORDER BY run)").alias("content")).select(_n().alias("conv_id"), F.md5("content").alias("clear_md5"))


# --- FTP


def _ftp(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(control, data): each document is stored under its language; documents talk one after the other, and ports come again."""
    d = _t(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("lang", F.coalesce("lang", F.lit("none")))
    port = 20_000 + F.col("doc_id") % 10_000
    pasv = F.concat(F.lit("227 Entering Passive Mode (10,0,0,2,"), F.floor(port / 256).cast("string"), F.lit(","), (port % 256).cast("string"), F.lit(")\r\n"))
    line = lambda *x: _bytes(F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x], F.lit("\r\n")))
    says = [(False, line("220 hi")), (True, line("USER u", F.col("source"))), (False, line("331 who")), (True, line("PASS p", F.col("doc_id"))), (False, line("230 in")), (True, line("CWD ", F.col("lang"))), (False, line("250 ok"))]
    says += [(True, line("PASV")), (False, _bytes(pasv)), (True, line("STOR d", F.col("doc_id"), ".txt")), (False, line("150 go")), (True, line("QUIT")), (False, line("221 bye"))]
    d = d.withColumn("source", F.coalesce("source", F.lit("")))
    start = F.col("n") * 100_000_000
    control = _turns(d, says, "doc_id").withColumn("ts_us", start + F.col("k") * 100_000)
    data = d.select(F.col("doc_id").cast("long").alias("n"), F.lit(0).alias("k"), F.lit(True).alias("out"), _bytes(F.col("text")).alias("payload"), port.cast("int").alias("port")).withColumn("ts_us", start + 950_000)
    data = _flows(data.drop("port"), 50, 1).withColumn("dst_port", (20_000 + _conv("src_ip", "dst_ip") % 10_000).cast("int")).withColumn("path", F.concat(F.lit("data-"), "path"))
    return _flows(control, 50, 21), data


def _talk(spark, sf_dir) -> DataFrame:
    """The runs of the control connections."""
    control = _ftp(spark, sf_dir)[0]
    return _runs(control, streams.tasks(control))


@query(
    "ftp_files",
    """SELECT doc_id, 'STOR' AS verb, '/FILES_FROM_51.0.0.0/' || coalesce(lang, 'none') || '/d' || doc_id || '.txt' AS path, md5(text) AS content_md5, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE octet_length(encode(text)) > 0""",
)
def ftp_files(spark, sf_dir):
    """Data streams under the paths that their commands name."""
    control, data = _ftp(spark, sf_dir)
    runs = _runs(control.unionByName(data))
    whole = runs.groupBy("stream").agg(F.min("ts_ns").alias("ts_ns"), F.sum(F.octet_length("content")).cast("long").alias("size"), F.first("first").alias("first"))
    moved = ftp.data_files(ftp.control(runs), whole.select("stream", "ts_ns", "size", "first.src_port", "first.dst_port"))
    content = runs.join(moved.select("stream").distinct(), "stream", "left_semi").groupBy("stream").agg(F.expr("listagg(content) WITHIN GROUP (ORDER BY run)").alias("content"))
    m = moved.join(content, "stream").join(whole.select("stream", "first"), "stream")
    return m.select(_n().alias("doc_id"), "verb", "path", F.md5("content").alias("content_md5"), "size")


@query(
    "ftp_log",
    """SELECT doc_id, md5('[<] 220 hi' || chr(13) || chr(10) || '[>] USER u' || coalesce(source, '') || chr(13) || chr(10) || '[<] 331 who' || chr(13) || chr(10) || '[>] PASS p' || doc_id || chr(13) || chr(10) || '[<] 230 in' || chr(13) || chr(10)
      || '[>] CWD ' || coalesce(lang, 'none') || chr(13) || chr(10) || '[<] 250 ok' || chr(13) || chr(10) || '[>] PASV' || chr(13) || chr(10) || '[<] 227 Entering Passive Mode (10,0,0,2,' || ((20000 + doc_id % 10000) // 256) || ',' || ((20000 + doc_id % 10000) % 256) || ')' || chr(13) || chr(10)
      || '[>] STOR d' || doc_id || '.txt' || chr(13) || chr(10) || '[<] 150 go' || chr(13) || chr(10) || '[>] QUIT' || chr(13) || chr(10) || '[<] 221 bye' || chr(13) || chr(10)) AS log_md5 FROM documents""",
)
def ftp_log(spark, sf_dir):
    runs = _talk(spark, sf_dir)
    return ftp.log(runs).join(runs.where("run = 0").select("stream", "first"), "stream").select(_n().alias("doc_id"), F.md5(F.encode("content", "ISO-8859-1")).alias("log_md5"))


@query("ftp_credentials", "SELECT doc_id, 'USER u' || coalesce(source, '') || chr(10) || 'PASS p' || doc_id || chr(10) AS credentials FROM documents")
def ftp_credentials(spark, sf_dir):
    runs = _talk(spark, sf_dir)
    return ftp.credentials(runs).join(runs.where("run = 0").select("stream", "first"), "stream").select(_n().alias("doc_id"), F.col("content").alias("credentials"))


@query(
    "ftp_commands",
    """SELECT doc_id, c.k AS place, c.verb, c.argument, c.code, c.port, c.cwd FROM documents, LATERAL (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k, unnest(['USER', 'PASS', 'CWD', 'PASV', 'STOR', 'QUIT']) AS verb,
      unnest(['u' || coalesce(source, ''), 'p' || doc_id, coalesce(lang, 'none'), NULL, 'd' || doc_id || '.txt', NULL]) AS argument, unnest([331, 230, 250, 227, 150, 221]) AS code,
      unnest([NULL, NULL, NULL, NULL, 20000 + doc_id % 10000, 20000 + doc_id % 10000]) AS port, unnest(['', '', '', '/' || coalesce(lang, 'none'), '/' || coalesce(lang, 'none'), '/' || coalesce(lang, 'none')]) AS cwd) c""",
)
def ftp_commands(spark, sf_dir):
    """Commands with their answers, the data port in force and the directory before each."""
    runs = _talk(spark, sf_dir)
    c = ftp.directories(ftp.control(runs)).join(runs.where("run = 0").select("stream", "first"), "stream")
    place = F.row_number().over(Window.partitionBy("stream").orderBy("run")) - 1
    return c.select(_n().alias("doc_id"), place.cast("int").alias("place"), "verb", "argument", "code", F.col("port").cast("long").alias("port"), "cwd")


# --- DHCP and SSH


@query(
    "dhcp_requests",
    """SELECT c_custkey AS custkey, 'REQ-' || c_custkey AS filename, 'DHCP Request' AS message, c_name AS host, '10.' || (c_custkey // 65536) % 256 || '.' || (c_custkey // 256) % 256 || '.' || c_custkey % 256 AS wanted,
      '02:00:' || lower(right('0' || hex((c_custkey // 16777216) % 256), 2)) || ':' || lower(right('0' || hex((c_custkey // 65536) % 256), 2)) || ':' || lower(right('0' || hex((c_custkey // 256) % 256), 2)) || ':' || lower(right('0' || hex(c_custkey % 256), 2)) AS mac FROM customer""",
)
def dhcp_requests(spark, sf_dir):
    """A request for an address from each customer."""
    c = _t(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("long")
    head = F.concat(_x("01010600"), _b(key, 4), _x("00" * 20), _x("0200"), _b(key, 4), _x("00" * 10), _x("00" * 192), _x("63825363"))
    options = F.concat(_x("350103"), _x("0c"), _sized(_bytes(F.col("c_name")), 1), _x("32040a"), _b(key % (1 << 24), 3), _x("ff"))
    client, server = _ends(key, 80)
    p = c.select(F.lit("dhcp").alias("path"), key.alias("frame_no"), F.lit("udp").alias("l4"), client.alias("src_ip"), server.alias("dst_ip"), F.lit(68).alias("src_port"), F.lit(67).alias("dst_port"), F.lit(0).cast("long").alias("tcp_seq"), F.lit(0).alias("tcp_flags"), F.concat(head, options).alias("payload"), F.lit(1_000_000).cast("long").alias("ts_us"))
    m = dhcp.messages(_packets(p))
    got = lambda path: F.get_json_object("content", path)
    return m.select(_conv("src_ip", "dst_ip").alias("custkey"), "filename", got("$.Options['DHCP Message Type']").alias("message"), got("$.Options['Host Name']").alias("host"), got("$.Options['Requested IP Address']").alias("wanted"), got("$['Client MAC Address']").alias("mac"))


def _ssh(spark, sf_dir) -> DataFrame:
    """Runs of an SSH session a supplier: names, lists, new keys, then its name five times from both sides."""
    s = _t(spark, sf_dir, "supplier")
    lists = lambda kex, mac: F.concat(*[_sized(_bytes(x), 4) for x in (kex, F.lit("rsa"), F.lit("aes-out"), F.lit("aes-in"), mac, F.concat(mac, F.lit("-in")), F.lit("none"), F.lit("zlib"), F.lit(""), F.lit(""))])
    packet = lambda body: F.concat(_b(F.octet_length(body) + 1, 4), _x("00"), body)
    kexinit = lambda kex, mac: packet(F.concat(_x("14"), _x("63" * 16), lists(kex, mac), _x("00" * 5)))
    newkeys = packet(_x("15"))
    hidden = F.concat(F.lit(b"\xff\xff\xff\xff"), _bytes(F.repeat("s_name", F.lit(5))))
    kex, mac = F.concat(F.lit("kex"), F.col("s_nationkey").cast("string")), F.concat(F.lit("mac"), F.col("s_suppkey").cast("string"))
    says = [(False, F.concat(_bytes(F.concat(F.lit("SSH-2.0-"), "s_name")), _x("0d0a"))), (True, F.concat(F.lit(b"SSH-2.0-client\r\n"), kexinit(kex, mac)))]
    says += [(False, F.concat(kexinit(kex, mac), newkeys)), (True, F.concat(newkeys, hidden)), (False, hidden)]
    return _runs(_flows(_turns(s, says, "s_suppkey"), 70, 22))


@query(
    "ssh_handshakes",
    """SELECT s_suppkey AS suppkey, side, CASE WHEN side = 0 THEN 'SSH-2.0-client' ELSE 'SSH-2.0-' || s_name END AS ident,
      md5('kex' || s_nationkey || ';' || CASE WHEN side = 0 THEN 'aes-out;mac' || s_suppkey || ';none' ELSE 'aes-in;mac' || s_suppkey || '-in;zlib' END) AS hassh FROM supplier, (SELECT unnest([0, 1]) AS side)""",
)
def ssh_handshakes(spark, sf_dir):
    runs = _ssh(spark, sf_dir)
    h = ssh.handshakes(runs).join(runs.where("run = 0").select("stream", "first"), "stream")
    return h.select(_n().alias("suppkey"), F.when(F.col("is_client"), 0).otherwise(1).alias("side"), "ident", "hassh")


@query("ssh_payloads", "SELECT s_suppkey AS suppkey, run, 'SSH-' || run AS name, md5(unhex('FFFFFFFF' || hex(encode(repeat(s_name, 5))))) AS content_md5 FROM supplier, (SELECT unnest([3, 4]) AS run)")
def ssh_payloads(spark, sf_dir):
    """What each run holds behind the change of keys."""
    runs = _ssh(spark, sf_dir)
    e = DECODERS["ssh"].decode(Engine._tcp(runs).withColumn("stream", F.col("file")), Options())
    return e.select(_n().alias("suppkey"), F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("run"), "name", F.md5("content").alias("content_md5"))


# --- SMB

T1601 = 116_444_736_000_000_000
#: The last whole day that a file time holds.
LAST_DAY = ((1 << 63) - T1601) // 864_000_000_000 - 1


def _smb(command: int, mid: Column | int, body: Column, response: bool = False, tree: int = 1) -> Column:
    head = F.concat(_x("fe534d424000000000000000"), _b(command, 2, True), _x("0100"), _b(int(response), 4, True), _x("00000000"), _b(mid, 8, True), _x("00000000"), _b(tree, 4, True), _x("4d" + "00" * 7), _x("00" * 16))
    return F.concat(head, body)


def _framed(message: Column) -> Column:
    return F.concat(_x("00"), _sized(message, 3))


def _utf16(text: Column) -> Column:
    return F.encode(text, "UTF-16LE")


def _opening(path: Column, handle: Column, times: list[Column], share: str = "docs") -> list[tuple[bool, Column]]:
    """What connects a share and opens a file there."""
    tree = _utf16(F.lit(f"\\\\srv\\{share}"))
    n = lambda x: _b(F.octet_length(x), 2, True)
    says = [(True, _framed(_smb(3, 1, F.concat(_x("0900000048"), _x("00"), n(tree), tree), tree=0))), (False, _framed(_smb(3, 1, _x("1000" + "0100" + "00" * 12), True)))]
    name = _utf16(path)
    says.append((True, _framed(_smb(5, 2, F.concat(_x("3900"), _x("00" * 42), _x("7800"), n(name), _x("00" * 8), name)))))
    created = F.concat(_x("59000000"), _x("01000000"), *[_b(t, 8, True) for t in times], _x("00" * 16), _x("20000000"), _x("00000000"), handle, _x("00" * 8))
    return [*says, (False, _framed(_smb(5, 2, created, True)))]


def _written(spark, sf_dir, port: int, before: list[tuple[bool, Column]]) -> DataFrame:
    """Turns of an SMB connection a conversation: its file is opened, then each turn is written over it from the beginning."""
    c = _t(spark, sf_dir, "conversations")
    heads = c.select("conv_id").distinct()
    handle = F.concat(_b(F.col("conv_id"), 8), _x("66" * 8))
    opening = _turns(heads, [*before, *_opening(F.concat(F.lit("dir\\c"), F.col("conv_id").cast("string"), F.lit(".txt")), handle, [F.lit(T1601 + 10_000_000)] * 4)], "conv_id")
    data = _bytes(F.col("text"))
    mid = F.col("turn") + 10
    write = _framed(_smb(9, mid, F.concat(_x("31007000"), _b(F.octet_length(data), 4, True), _x("00" * 8), handle, _x("00" * 16), data)))
    wrote = _framed(_smb(9, mid, F.concat(_x("11000000"), _b(F.octet_length(data), 4, True), _x("00" * 8)), True))
    each = F.array(F.struct((F.col("turn") * 2 + 10).alias("k"), F.lit(True).alias("out"), write.alias("payload")), F.struct((F.col("turn") * 2 + 11).alias("k"), F.lit(False).alias("out"), wrote.alias("payload")))
    rows = c.select(F.col("conv_id").alias("n"), F.explode(each).alias("s")).select("n", F.col("s.k").cast("int").alias("k"), "s.out", "s.payload")
    return _flows(opening.unionByName(rows), 60, port)


VERSIONS = """WITH t AS (SELECT conv_id, turn, text, CASE WHEN lag(text) OVER w IS DISTINCT FROM text THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    v AS (SELECT conv_id, turn, text, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS version FROM t),
    g AS (SELECT conv_id, version, min(turn) AS first, max(turn) AS last, any_value(text) AS text FROM v GROUP BY conv_id, version)
    SELECT conv_id, CAST(version AS INTEGER) AS version, '/docs/dir/c' || conv_id || '.txt' || CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN '@' || CAST(version AS BIGINT) ELSE '' END AS name, md5(text) AS content_md5,
      (first * 2 + 13) * 1000000000 AS ts_ns, CASE WHEN last > first THEN (last * 2 + 13) * 1000000000 END AS last_access FROM g"""


def _read_back(flows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exchanges, operations, told times) of SMB flows, each written once."""
    ex = lasting(smb.exchanges(smb.messages(_runs(flows))))
    return ex, lasting(smb.operations(ex)), lasting(smb.told(ex))


def _versions(flows: DataFrame) -> DataFrame:
    _, ops, told = _read_back(flows)
    v = smb.names(smb.versions(ops, told))
    return v.select(F.regexp_extract("path", r"c(-?\d+)\.txt", 1).cast("long").alias("conv_id"), F.col("version").cast("int").alias("version"), "name", F.md5("content").alias("content_md5"), "ts_ns", "last_access")


@query("smb_versions", VERSIONS)
def smb_versions(spark, sf_dir):
    """Every turn is a version of its conversation's file; neighbours that say the same are one, with the time of the last."""
    return _versions(_written(spark, sf_dir, 445, []))


@query("smb_after_session_setup", VERSIONS)
def smb_after_session_setup(spark, sf_dir):
    """The same on port 139, behind the request for a session and its answer."""
    return _versions(_written(spark, sf_dir, 139, [(True, _x("81000044" + "20" * 68)), (False, _x("82000000"))]))


@query(
    "smb_log",
    """SELECT conv_id, '[>] TREE_CONNECT' || chr(10) || '[<] TREE_CONNECT' || chr(10) || '[>] CREATE' || chr(10) || '[<] CREATE' || chr(10) || repeat('[>] WRITE' || chr(10) || '[<] WRITE' || chr(10), count(*)) AS log FROM conversations GROUP BY conv_id""",
)
def smb_log(spark, sf_dir):
    base = Engine._tcp(_runs(_written(spark, sf_dir, 445, [])))
    out = DECODERS["smbcontrol"].decode(base.withColumn("stream", F.col("file")), Options())
    return out.select(_n().alias("conv_id"), F.decode("content", "UTF-8").alias("log"))


#: Packets of a connection of ``_times``.
TALK = 13


def _times(spark, sf_dir, tasks: int | None = None) -> DataFrame:
    """Turns of an SMB connection a customer: a file is opened, asked for, set and closed, with a day more each time; the server's clock is ahead."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"))
    # Customers are dealt while they are numbers alone, however few files they lie in; what is said of each stays where it is.
    c = c.repartition(tasks or spark.sparkContext.defaultParallelism, "c_custkey")
    key = F.col("c_custkey")
    # What lies beyond the last day that the field holds is told as that last one.
    day = lambda d, h: F.least(key * 10 + d, F.lit(LAST_DAY)) * 864_000_000_000 + (T1601 + h * 36_000_000_000)
    four = lambda d: [day(d, h) for h in range(4)]
    handle = F.concat(_b(key, 8), _x("77" * 8))
    skew = F.lit(T1601) + (2 + key % 100) * 10_000_000
    says = [(True, _framed(_smb(0, 0, F.concat(_x("24000100"), _x("00" * 32)), tree=0))), (False, _framed(_smb(0, 0, F.concat(_x("4100010011030000"), _x("00" * 32), _b(skew, 8, True), _x("00" * 8)), True, tree=0)))]
    says += _opening(F.concat(F.lit("t"), F.col("c_custkey").cast("string")), handle, four(0))
    basic = F.concat(*[_b(t, 8, True) for t in four(1)], _x("20000000"))
    says += [(True, _framed(_smb(16, 3, F.concat(_x("29000104"), _x("c8000000"), _x("00" * 16), handle)))), (False, _framed(_smb(16, 3, F.concat(_x("09004800"), _b(36, 4, True), basic), True)))]
    given = F.concat(*[_b(t, 8, True) for t in four(2)], _x("20000000"))
    says += [(True, _framed(_smb(17, 4, F.concat(_x("21000104"), _b(36, 4, True), _x("60000000"), _x("00" * 4), handle, given)))), (False, _framed(_smb(17, 4, _x("0200"), True)))]
    says += [(True, _framed(_smb(6, 5, F.concat(_x("18000100"), _x("00" * 4), handle)))), (False, _framed(_smb(6, 5, F.concat(_x("3c000100"), _x("00" * 4), *[_b(t, 8, True) for t in four(3)]), True)))]
    return _flows(_turns(c, says, "c_custkey"), 60, 445)


@query(
    "smb_told_times",
    """SELECT c_custkey AS custkey, '/docs/t' || c_custkey AS path, (k * 2 + 7) * 1000000000 AS at, (c_custkey * 10 + k) * 86400000000000 AS b, (c_custkey * 10 + k) * 86400000000000 + 3600000000000 AS a, (c_custkey * 10 + k) * 86400000000000 + 7200000000000 AS m,
      (c_custkey * 10 + k) * 86400000000000 + 10800000000000 AS c, (c_custkey % 100) * 1000000000 AS skew FROM customer, (SELECT CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS k)""",
)
def smb_told_times(spark, sf_dir):
    """One file's times from four messages: the answers to Create, a query and Close, and a setting; and the skew that the negotiation tells."""
    n = -(-_t(spark, sf_dir, "customer").count() * TALK // streams.PACKETS)
    tasks = n if n > spark.sparkContext.defaultParallelism else None
    ex = lasting(smb.exchanges(smb.messages(_runs(_times(spark, sf_dir, tasks), tasks))))
    told = smb.told(ex)
    own = F.regexp_extract("path", r"t(\d+)$", 1).cast("long")
    ahead = smb.skews(ex).join(ex.where("command = 0").select("stream", F.regexp_extract("stream", r"60-445-(\d+)-", 1).cast("long").alias("custkey")), "stream")
    return told.withColumn("custkey", own).join(ahead, "custkey").select("custkey", "path", "at", "a", "m", "c", "b", "skew")


@query(
    "smb_directory_entries",
    """WITH l AS (SELECT p_partkey, p_name, p_size, p_partkey % (SELECT count(*) FROM supplier) + 1 AS s FROM part)
    SELECT s AS suppkey, p_partkey AS partkey, '/docs/' || p_name || ' ' || p_partkey AS path, CASE WHEN s % 6 <> 5 THEN CAST(p_size AS BIGINT) END AS size, CASE WHEN s % 6 <> 5 THEN p_size % 2 = 0 END AS is_directory,
      CASE WHEN s % 6 <> 5 THEN 116444736000000000 + p_partkey * 10000000 END AS mtime FROM l""",
)
def smb_directory_entries(spark, sf_dir):
    """Parts as entries of their supplier's directory, in six layouts by turns."""
    n = _t(spark, sf_dir, "supplier").count()
    parts = _t(spark, sf_dir, "part").withColumns({"s": F.col("p_partkey") % n + 1, "file": F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))})
    parts = parts.withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in (37, 1, 2, 3, 38, 12)]), ((F.col("s") % 6) + 1).cast("int")))
    name, t = _utf16(F.col("file")), _b(F.lit(T1601) + F.col("p_partkey") * 10_000_000, 8, True)
    attributes = F.when(F.col("p_size") % 2 == 0, 16).otherwise(32)
    head = F.concat(t, t, t, t, _b(F.col("p_size"), 8, True), _x("00" * 8), _b(attributes, 4, True), _b(F.octet_length(name), 4, True))
    at = F.element_at(F.create_map(*[F.lit(x) for kv in smb.NAME_AT.items() for x in kv]), F.col("kind"))
    fill = F.unhex(F.repeat(F.lit("00"), (at - 64).cast("int")))
    bare = F.concat(_x("00000000"), _b(F.octet_length(name), 4, True), name)
    parts = parts.withColumn("body", F.when(F.col("kind") == 12, bare).otherwise(F.concat(_x("00000000"), head, fill, name)))
    # Entries begin at multiples of eight.
    parts = parts.withColumn("body", F.concat(F.col("body"), F.unhex(F.repeat(F.lit("00"), F.pmod(-(F.octet_length("body") + 4), F.lit(8))))))
    w = Window.partitionBy("s").orderBy("p_partkey")
    parts = parts.withColumn("last", F.lead("p_partkey").over(w).isNull()).withColumn("entry", F.concat(F.when(F.col("last"), _x("00000000")).otherwise(_b(F.octet_length("body") + 4, 4, True)), F.col("body")))
    # A supplier's few parts are one answer.
    lists = parts.groupBy("s", "kind").agg(F.expr("listagg(entry) WITHIN GROUP (ORDER BY p_partkey)").alias("data"))
    handle = F.concat(_b(F.col("s"), 8), _x("64" * 8))
    says = _opening(F.lit(""), handle, [F.lit(T1601 + 10_000_000)] * 4)
    says += [(True, _framed(_smb(14, 3, F.concat(_x("2100"), _b(F.col("kind"), 1), _x("00"), _x("00000000"), handle, _x("00" * 8))))), (False, _framed(_smb(14, 3, F.concat(_x("09004800"), _b(F.octet_length("data"), 4, True), F.col("data")), True)))]
    ex, _, _ = _read_back(_flows(_turns(lists, says, "s"), 60, 445))
    listed = smb.listed(ex)
    return listed.select(F.regexp_extract("stream", r"60-445-(\d+)-", 1).cast("long").alias("suppkey"), F.regexp_extract("path", r" (\d+)$", 1).cast("long").alias("partkey"), "path", "size", "is_directory", "mtime")

