"""Queries that make captures of the tables, read them back and decode them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..decoders import dns, http, streams
from ..functions import binary
from ..functions.text import url_host
from ..operators import gather, tree
from ..registry import query
from ..sources import pcap, synth

#: Flows to a capture file: files, not flows, are the unit that is read by a task.
FLOWS = 64


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _address(n: Column, net: int) -> Column:
    return F.concat_ws(".", F.lit(str(net)), F.shiftright(n, 16) % 256, F.shiftright(n, 8) % 256, n % 256)


def _ends(n: Column, net: int) -> tuple[Column, Column]:
    """The addresses of client and server of flow ``n``: its low 24 bits, and the 24 above them."""
    n = n.cast("long")
    return _address(n, net), _address(F.shiftright(n, 24), net + 1)


def _raw(p: DataFrame, frame_no: str) -> DataFrame:
    """Packets with ``path``, ``ts_us`` and ``frame`` as the rows that a walk over captures would give, in none of which they are packed."""
    return p.select("path", F.col(frame_no).cast("long").alias("frame_no"), (F.col("ts_us") * 1000).alias("ts_ns"), F.lit(0).cast("long").alias("at"), "frame")


def conversation_packets(spark, sf_dir) -> DataFrame:
    """One TCP flow a conversation: a SYN, then a segment a turn; the first role's side opens it."""
    c = _t(spark, sf_dir, "conversations").withColumn("payload", F.col("text").cast("binary"))
    w = Window.partitionBy("conv_id")
    first = F.min_by("role", "turn").over(w)
    c = c.withColumn("out", F.col("role") == first)
    way = Window.partitionBy("conv_id", "out").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("tcp_seq", F.lit(4294967000) + F.col("conv_id") % 1000 + F.coalesce(F.sum(F.octet_length("payload")).over(way), F.lit(0)))
    syn = c.groupBy("conv_id").agg(F.min("turn").alias("turn")).select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit(True).alias("out"), (F.lit(4294966999) + F.col("conv_id") % 1000).alias("tcp_seq"), F.lit(b"").alias("payload"), F.lit(2).alias("tcp_flags"))
    p = c.select("conv_id", "turn", "out", "tcp_seq", "payload", F.lit(24).alias("tcp_flags")).unionByName(syn)
    client, server = _ends(F.col("conv_id"), 10)
    either = lambda a, b: F.when(F.col("out"), a).otherwise(b)
    return p.select(
        F.concat(F.lit("conv-"), F.lpad(F.floor(F.col("conv_id") / FLOWS).cast("string"), 9, "0"), F.lit(".pcap")).alias("path"),
        "conv_id",
        "turn",
        F.lit("tcp").alias("l4"),
        either(client, server).alias("src_ip"),
        either(server, client).alias("dst_ip"),
        either(F.lit(40000), F.lit(8000)).alias("src_port"),
        either(F.lit(8000), F.lit(40000)).alias("dst_port"),
        "tcp_seq",
        "tcp_flags",
        "payload",
        ((F.col("turn") + 1) * 1_000_000 + F.col("conv_id") * 10).alias("ts_us"),
    )


def _whole(segments: DataFrame) -> DataFrame:
    pieces = segments.withColumn("piece", F.concat(gather.zeros(F.col("missing")), F.col("part")))
    return pieces.groupBy("stream").agg(F.first("first").alias("f"), gather.in_order("piece", "pos").alias("c"), (F.max("missing") > 0).alias("missing_data"))


def _conv(client: str, server: str) -> Column:
    """The number of the flow that ``_ends`` gave these addresses."""
    bits = lambda ip: F.aggregate(F.slice(F.split(ip, r"\."), 2, 3), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    return bits(server) * (1 << 24) + bits(client)


CONVERSATION = "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS content_md5, octet_length(encode(string_agg(text, '' ORDER BY turn))) AS size FROM conversations GROUP BY conv_id"


def _told(whole: DataFrame) -> DataFrame:
    out = F.col("f.dst_port") == 8000
    client, server = F.when(out, F.col("f.src_ip")).otherwise(F.col("f.dst_ip")), F.when(out, F.col("f.dst_ip")).otherwise(F.col("f.src_ip"))
    return whole.withColumns({"ip": client, "far": server}).select(_conv("ip", "far").alias("conv_id"), F.md5("c").alias("content_md5"), F.octet_length("c").cast("long").alias("size"))


@query("pcap_conversation_roundtrip", CONVERSATION)
def pcap_conversation_roundtrip(spark, sf_dir):
    files = synth.pcap(synth.frames(conversation_packets(spark, sf_dir)), ["turn", "conv_id"])
    return _told(_whole(streams.tcp_segments(pcap.packets(files))))


@query("pcapng_equals_pcap", CONVERSATION)
def pcapng_equals_pcap(spark, sf_dir):
    files = synth.pcapng(synth.frames(conversation_packets(spark, sf_dir)), ["turn", "conv_id"])
    return _told(_whole(streams.tcp_segments(pcap.packets(files))))


@query("pcap_shuffled_roundtrip", CONVERSATION.replace("string_agg(text, '' ORDER BY turn)", "string_agg(text, '' ORDER BY role = first_role DESC, turn)").replace("FROM conversations", "FROM (SELECT *, arg_min(role, turn) OVER (PARTITION BY conv_id) AS first_role FROM conversations)"))
def pcap_shuffled_roundtrip(spark, sf_dir):
    """Each side's segments in reverse order, the opening side's first, every one sent twice, over two captures."""
    p = conversation_packets(spark, sf_dir)
    client = F.col("dst_port") == 8000
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    place = F.when(F.col("tcp_flags") == 2, -1).when(client, last - F.col("turn")).otherwise(100_000 + last - F.col("turn"))
    p = p.withColumn("place", place).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    p = p.where("again = 0 OR tcp_flags <> 2").withColumn("path", F.concat(F.lit("part-"), F.when(client, "0").otherwise("1"), F.col("path")))
    files = synth.pcap(synth.frames(p.withColumn("ts_us", F.col("place") + 2_000_000)), ["place", "again", "conv_id"])
    return _told(_whole(streams.tcp_segments(pcap.packets(files))))


@query(
    "pcap_gap_padding",
    """WITH o AS (SELECT *, role = arg_min(role, turn) OVER (PARTITION BY conv_id) AS way FROM conversations),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, way ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id, way) AS n FROM o)
    SELECT conv_id, CAST(sum(octet_length(encode(text))) AS BIGINT) AS size, max(CASE WHEN k = 2 AND n > 2 THEN 1 ELSE 0 END) = 1 AS missing_data FROM t WHERE NOT (k = 2 AND n = 2) GROUP BY conv_id""",
)
def pcap_gap_padding(spark, sf_dir):
    """Each side's second segment is lost: zeros stand for it where a later one shows that it is missing."""
    p = conversation_packets(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy("conv_id", "src_port").orderBy("tcp_flags", "turn"))
    p = p.withColumn("k", F.when(F.col("tcp_flags") == 2, 0).otherwise(k - F.max((F.col("tcp_flags") == 2).cast("int")).over(Window.partitionBy("conv_id", "src_port")))).where("k <> 2").drop("k")
    whole = _whole(streams.tcp_segments(pcap.packets(synth.pcap(synth.frames(p), ["turn", "conv_id"]))))
    out = F.col("f.dst_port") == 8000
    client, server = F.when(out, F.col("f.src_ip")).otherwise(F.col("f.dst_ip")), F.when(out, F.col("f.dst_ip")).otherwise(F.col("f.src_ip"))
    return whole.withColumns({"ip": client, "far": server}).select(_conv("ip", "far").alias("conv_id"), F.octet_length("c").cast("long").alias("size"), "missing_data")


@query(
    "pcap_message_breaks",
    """SELECT conv_id, row_number() OVER w - 1 AS run, CAST(coalesce(sum(octet_length(encode(text))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM (
      SELECT conv_id, min(turn) AS turn, string_agg(text, '' ORDER BY turn) AS text FROM (
        SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM (SELECT *, CASE WHEN lag(CASE WHEN role = fr THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM CASE WHEN role = fr THEN 1 ELSE 0 END THEN 0 ELSE 1 END AS new
          FROM (SELECT *, arg_min(role, turn) OVER (PARTITION BY conv_id) AS fr FROM conversations))) GROUP BY conv_id, r) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def pcap_message_breaks(spark, sf_dir):
    segments = streams.tcp_segments(pcap.packets(synth.pcap(synth.frames(conversation_packets(spark, sf_dir)), ["turn", "conv_id"])))
    b = streams.breaks(segments).join(streams.streams(segments).select("stream", "src_ip", "dst_ip", "dst_port"), "stream")
    out = F.col("dst_port") == 8000
    client, server = F.when(out, F.col("src_ip")).otherwise(F.col("dst_ip")), F.when(out, F.col("dst_ip")).otherwise(F.col("src_ip"))
    return b.withColumns({"ip": client, "far": server}).select(_conv("ip", "far").alias("conv_id"), F.col("run").cast("long").alias("run"), F.col("offset").cast("long").alias("offset"))


def http_talk(pages: DataFrame) -> DataFrame:
    """``pages`` with ``ask`` and ``answer``: a GET and its answer a page; bodies go plain, gzipped, deflated, chunked, or chunked and gzipped by turns."""
    p = pages.withColumn("body", F.col("html").cast("binary")).withColumn("k", F.col("page_id") % 5)
    coded = F.coalesce(binary.gzip(F.when(F.col("k").isin(1, 4), F.col("body"))), binary.deflate(F.when(F.col("k") == 2, F.col("body"))), F.col("body"))
    p = p.withColumn("c", coded).withColumn("c", F.coalesce(binary.chunk(F.when(F.col("k").isin(3, 4), F.col("c"))), F.col("c")))
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^#]*)?", 1), " ", "%20")
    ask = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), url_host(F.col("url")), F.lit("\r\nAccept-Language: en-US,en\r\n\r\n")).cast("binary")
    coding = F.when(F.col("k").isin(1, 4), "Content-Encoding: gzip\r\n").when(F.col("k") == 2, "Content-Encoding: deflate\r\n").otherwise("")
    length = F.when(F.col("k").isin(3, 4), F.lit("Transfer-Encoding: chunked\r\n")).otherwise(F.concat(F.lit("Content-Length: "), F.octet_length("c").cast("string"), F.lit("\r\n")))
    answer = F.concat(F.concat(F.lit("HTTP/1.1 200 OK\r\n"), coding, length, F.lit("\r\n")).cast("binary"), F.col("c"))
    return p.withColumns({"answer": answer, "ask": ask})


def http_packets(spark, sf_dir) -> DataFrame:
    """One TCP flow a page, with its GET and its answer."""
    syn = F.struct(F.lit(0).alias("n"), F.lit(True).alias("out"), F.lit(99).alias("seq"), F.lit(2).alias("flags"), F.lit(b"").alias("payload"), F.lit(0).alias("cut"))
    get = F.struct(F.lit(1).alias("n"), F.lit(True).alias("out"), F.lit(100).alias("seq"), F.lit(24).alias("flags"), F.col("ask").alias("payload"), F.lit(0).alias("cut"))
    size = 32_000
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("answer") - 1) / size).cast("int")), lambda k: F.struct((k + 2).alias("n"), F.lit(False).alias("out"), (k * size + 500).alias("seq"), F.lit(24).alias("flags"), F.substring(F.col("answer"), k * size + 1, F.lit(size)).alias("payload"), k.alias("cut")))
    each = http_talk(_t(spark, sf_dir, "pages")).select("page_id", F.explode(F.concat(F.array(syn, get), cuts)).alias("s"))
    client, server = _ends(F.col("page_id"), 20)
    either = lambda a, b: F.when(F.col("s.out"), a).otherwise(b)
    return each.select(
        F.concat(F.lit("http-"), F.lpad(F.floor(F.col("page_id") / FLOWS).cast("string"), 9, "0"), F.lit(".pcap")).alias("path"),
        "page_id",
        F.col("s.n").alias("n"),
        F.lit("tcp").alias("l4"),
        either(client, server).alias("src_ip"),
        either(server, client).alias("dst_ip"),
        either(F.lit(50000), F.lit(80)).alias("src_port"),
        either(F.lit(80), F.lit(50000)).alias("dst_port"),
        F.col("s.seq").cast("long").alias("tcp_seq"),
        F.col("s.flags").alias("tcp_flags"),
        F.col("s.payload").alias("payload"),
        (F.col("page_id") * 1000 + F.col("s.n")).alias("ts_us"),
    )


def http_messages(spark, sf_dir) -> DataFrame:
    files = synth.pcap(synth.frames(http_packets(spark, sf_dir)), ["page_id", "n"])
    return http.messages(streams.runs(streams.tcp_segments(pcap.packets(files))))


PATH = "CASE WHEN p = '' THEN '/' ELSE replace(p, ' ', '%20') END"


@query(
    "pcap_http_pages",
    f"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS domain, {PATH} AS uri, regexp_extract(regexp_extract({PATH}, '^[^? ;]*', 0), '[^/]*$', 0) AS filename, md5(html) AS body_md5
      FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/]+(/[^#]*)?', 1) AS p FROM pages)""",
)
def pcap_http_pages(spark, sf_dir):
    m = http_messages(spark, sf_dir).where("NOT is_request")
    return m.select(_conv("dst_ip", "src_ip").alias("page_id"), "domain", "uri", "filename", F.md5("body").alias("body_md5"))


def dns_packets(spark, sf_dir) -> DataFrame:
    """A query for the address of each distinct host of the pages."""
    h = _t(spark, sf_dir, "pages").select(url_host(F.col("url")).alias("host")).distinct()
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lpad(F.hex(F.octet_length(x).cast("long")), 2, "0"), F.hex(x.cast("binary"))))
    ask = F.unhex(F.concat(F.lit("f76f01000001000000000000"), F.array_join(labels, ""), F.lit("0000010001")))
    n = F.pmod(F.xxhash64("host"), F.lit(1 << 24))
    return h.select(F.lit("dns.pcap").alias("path"), "host", F.lit("udp").alias("l4"), _address(n, 30).alias("src_ip"), F.lit("9.9.9.9").alias("dst_ip"), F.lit(33000).alias("src_port"), F.lit(53).alias("dst_port"), F.lit(0).cast("long").alias("tcp_seq"), F.lit(0).alias("tcp_flags"), ask.alias("payload"), F.lit(1_000_000).cast("long").alias("ts_us"))


@query("pcap_dns_hosts", "SELECT DISTINCT 'REQ-28663' AS filename, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, 'A' AS type, 'IN' AS class FROM pages")
def pcap_dns_hosts(spark, sf_dir):
    raw = _raw(synth.frames(dns_packets(spark, sf_dir)).withColumn("n", F.lit(0)), "n")
    m = dns.messages(pcap.dissect(raw))
    got = lambda k: F.get_json_object("content", f"$.Queries[0].{k}").alias(k if k != "name" else "host")
    return m.select("filename", got("name"), got("type"), got("class"))


@query(
    "pcap_udp_sessions",
    """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
    s AS (SELECT user_id, event_id, us, k, 0 AS session, us AS anchor FROM o WHERE k = 1
      UNION ALL SELECT o.user_id, o.event_id, o.us, o.k, CASE WHEN o.us - s.anchor >= 21600000000 THEN s.session + 1 ELSE s.session END,
        CASE WHEN o.us - s.anchor >= 21600000000 THEN o.us ELSE s.anchor END FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS datagrams, min(us) AS anchor_us FROM s GROUP BY user_id, session""",
)
def pcap_udp_sessions(spark, sf_dir):
    return event_sessions(_t(spark, sf_dir, "events"))


def event_sessions(e: DataFrame) -> DataFrame:
    """Sessions of events as datagrams, a flow a user; of datagrams of one time that with the lesser event_id comes first."""
    client, server = _ends(F.col("user_id"), 40)
    p = e.select(F.lit("events.pcap").alias("path"), "event_id", F.lit("udp").alias("l4"), client.alias("src_ip"), server.alias("dst_ip"), F.lit(7000).alias("src_port"), F.lit(7001).alias("dst_port"), F.lit(0).cast("long").alias("tcp_seq"), F.lit(0).alias("tcp_flags"), F.col("props").cast("binary").alias("payload"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    s = streams.udp_sessions(pcap.dissect(_raw(synth.frames(p), "event_id")), 6 * 3600)
    return s.groupBy(_conv("src_ip", "dst_ip").alias("user_id"), "session").agg(F.count(F.lit(1)).alias("datagrams"), F.expr("min(anchor) div 1000").alias("anchor_us"))


def conversation_tree(spark, sf_dir) -> DataFrame:
    """Conversations as a capture, scanned, reassembled, and grouped by protocol and port into a tree."""
    files = synth.pcap(synth.frames(conversation_packets(spark, sf_dir)), ["turn", "conv_id"])
    s = streams.streams(streams.tcp_segments(pcap.packets(files))).withColumn("protocol", F.lit("tcp"))
    s = s.withColumn("dst_port", F.col("dst_port").cast("string"))
    return tree.levels(s, ["protocol", "dst_port"], {"files": F.count(F.lit(1)), "bytes": F.sum("size"), "modified_ns": F.max("ts_ns"), "changed_ns": F.min("ts_ns")})


#: A file a conversation, with the time of its first segment that has bytes, that of its first turn.
query(
    "conversation_tree",
    """WITH f AS (SELECT conv_id, (min(turn) + 1) * 1000000 + conv_id * 10 AS us, sum(octet_length(encode(text))) AS bytes FROM conversations GROUP BY conv_id)
    SELECT CAST(CASE WHEN grouping(protocol) = 1 THEN 0 WHEN grouping(dst_port) = 1 THEN 1 ELSE 2 END AS INTEGER) AS depth, protocol, dst_port,
      count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(max(us) * 1000 AS BIGINT) AS modified_ns, CAST(min(us) * 1000 AS BIGINT) AS changed_ns
    FROM (SELECT *, 'tcp' AS protocol, '8000' AS dst_port FROM f) GROUP BY ROLLUP (protocol, dst_port)""",
)(conversation_tree)
