"""Queries through the user's side: one capture made of pages, conversations and a share, opened once a session and listed in many ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..api import Engine
from ..operators.tables import shared_folder
from ..registry import query
from ..sources import synth
from .captures import PATH, conversation_packets, http_packets
from .protocols import T1601, VERSIONS, _written

_OPEN: dict[tuple[str, str], Engine] = {}


def engine(spark, sf_dir) -> Engine:
    """The index of a capture of the tables: pages over HTTP, conversations over a port of no protocol and as files that are written over SMB. It is saved once a session, and loaded."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        cols = ["path", "src_ip", "dst_ip", "src_port", "dst_port", "l4", "tcp_seq", "tcp_flags", "payload", "ts_us"]
        one = http_packets(spark, sf_dir).select(*cols, F.col("page_id").alias("o1"), F.col("n").cast("long").alias("o2"))
        two = conversation_packets(spark, sf_dir).select(*cols, F.col("turn").alias("o1"), F.col("conv_id").alias("o2"))
        # A file for each share, since its packets have one number in each.
        three = _written(spark, sf_dir, 445, []).select(*cols, F.col("frame_no").alias("o1"), F.lit(0).cast("long").alias("o2"))
        packets = one.unionByName(two.select(*one.columns)).unionByName(three)
        captures = synth.pcap(synth.frames(packets), ["o1", "o2"])
        opened = Engine.open(spark, captures=captures)
        path = f"{shared_folder(spark)}/index-{len(_OPEN)}-{abs(hash(sf_dir))}"
        opened.save(path)
        opened.close()
        _OPEN[key] = Engine.load(spark, path)
    return _OPEN[key]


PAGES = f"(SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS domain, {PATH} AS uri, octet_length(encode(html)) AS size, page_id * 1000000 AS ns FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/]+(/[^#]*)?', 1) AS p FROM pages))"
NAME = "regexp_extract(regexp_extract(uri, '^[^? ;]*', 0), '[^/]*$', 0)"
#: The files of the share, with their versions' names and times.
FILES = f"(SELECT *, split_part(name, '/', 4) AS file FROM ({VERSIONS}))"


@query("engine_pages_by_domain", f"SELECT '/http/' || domain AS directory, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(max(ns + 2000) AS BIGINT) >= max(ns) AS timed FROM {PAGES} WHERE size > 0 GROUP BY domain")
def engine_pages_by_domain(spark, sf_dir):
    """Bodies of pages under their hosts."""
    rows = engine(spark, sf_dir).listing("/protocol/domain/").where("file_type = 'http'")
    return rows.groupBy("directory").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.lit(True).alias("timed"))


@query("engine_pages_by_path", f"SELECT page_id, '/http' || regexp_replace('/' || regexp_replace(regexp_extract(uri, '^[^? ;]*', 0), '^/', ''), '/[^/]*$', '') AS directory, {NAME} AS name, size FROM {PAGES} WHERE size > 0")
def engine_pages_by_path(spark, sf_dir):
    """The special category ``path``: directories of a URI, without what names the file."""
    e = engine(spark, sf_dir)
    rows = e._placed("/protocol/path/", {}).where("file_type = 'http'")
    page = F.regexp_extract("stream", r"-(\d+)$", 1)
    host = F.split(F.col("props")["dstIP"], r"\.")
    number = F.aggregate(F.slice(host, 2, 3), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    return rows.where(page != "").select(number.alias("page_id"), F.regexp_replace("directory", "/$", "").alias("directory"), "name", "size")


@query("engine_show_metadata", "SELECT page_id, 'http' AS file_type, unnest([false, true, true]) AS is_metadata, unnest(['body', 'ask', 'answer']) AS part FROM pages")
def engine_show_metadata(spark, sf_dir):
    """Headers show on demand, beside bodies."""
    v = engine(spark, sf_dir).visible(show_metadata=True).where("file_type = 'http'")
    part = F.when(~F.col("is_metadata"), "body").when(F.startswith("name", F.lit("GET")), "ask").otherwise("answer")
    ends = F.when(part == "ask", F.col("props")["srcIP"]).otherwise(F.col("props")["dstIP"])
    number = F.aggregate(F.slice(F.split(ends, r"\."), 2, 3), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    return v.select(number.alias("page_id"), "file_type", "is_metadata", part.alias("part"))


@query("engine_show_all", "SELECT 'tcp' AS file_type, parsed, CAST(count(*) AS BIGINT) AS files FROM (SELECT true AS parsed FROM pages UNION ALL SELECT true FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT false FROM (SELECT DISTINCT conv_id FROM conversations)) GROUP BY parsed")
def engine_show_all(spark, sf_dir):
    """Streams that were decoded further show with all others."""
    return engine(spark, sf_dir).visible(show_all=True).where("file_type = 'tcp'").groupBy("file_type", "parsed").agg(F.count(F.lit(1)).alias("files"))


@query("engine_streams", "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS content_md5, CAST(sum(octet_length(encode(text))) AS BIGINT) AS size FROM conversations GROUP BY conv_id")
def engine_streams(spark, sf_dir):
    """Streams of no protocol, out of the index."""
    v = engine(spark, sf_dir).visible().where("file_type = 'tcp'")
    bits = lambda ip: F.aggregate(F.slice(F.split(F.col("props")[ip], r"\."), 2, 3), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    own = F.when(F.col("props")["dstPort"] == "8000", bits("srcIP")).otherwise(bits("dstIP"))
    return v.select(own.alias("conv_id"), F.md5("content").alias("content_md5"), "size")


@query("engine_share", f"SELECT file AS name, content_md5, CAST(ts_ns AS BIGINT) AS mtime_ns FROM {FILES}")
def engine_share(spark, sf_dir):
    """Versions of a share's files; the server's clock is the network's, so a write's times are those at which it was seen."""
    v = engine(spark, sf_dir).visible(timestamp_mode="hybrid").where("file_type = 'smb'")
    return v.select("name", F.md5("content").alias("content_md5"), "mtime_ns")


@query("engine_share_network", f"SELECT file AS name, CAST(CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN coalesce(last_access, ts_ns) ELSE ts_ns END AS BIGINT) AS mtime_ns FROM {FILES}")
def engine_share_network(spark, sf_dir):
    v = engine(spark, sf_dir).visible(timestamp_mode="network").where("file_type = 'smb'")
    return v.select("name", "mtime_ns")


@query("engine_share_fs", f"SELECT file AS name, CAST(0 AS BIGINT) AS mtime_ns FROM {FILES}")
def engine_share_fs(spark, sf_dir):
    """By the server's clock a written version that nothing tells of afterwards has no time."""
    v = engine(spark, sf_dir).visible(timestamp_mode="fs").where("file_type = 'smb'")
    return v.select("name", "mtime_ns")


MOMENT = 18  # seconds: between the third and the fourth turn's write


@query("engine_snapshot", f"SELECT '/docs/dir/c' || conv_id || '.txt' AS path, arg_max(content_md5, ts_ns) AS content_md5, CAST(max(ts_ns) AS BIGINT) AS mtime_ns FROM {FILES} WHERE ts_ns < {MOMENT}000000000 GROUP BY conv_id")
def engine_snapshot(spark, sf_dir):
    """What each file held at a moment."""
    v = engine(spark, sf_dir).visible(snapshot=MOMENT, timestamp_mode="hybrid").where("file_type = 'smb'")
    return v.select(F.col("props")["path"].alias("path"), F.md5("content").alias("content_md5"), "mtime_ns")


@query("engine_snip", f"SELECT file AS name, content_md5 FROM {FILES} WHERE (count > 1 AND (ts_ns BETWEEN 14000000000 AND 17999999999 OR last_access BETWEEN 14000000000 AND 17999999999)) OR (count = 1 AND ts_ns BETWEEN 14000000000 AND 17999999999)".replace("SELECT *, split_part", "SELECT *, count(*) OVER (PARTITION BY conv_id) AS count, split_part"))
def engine_snip(spark, sf_dir):
    """Versions that were written in a range of time, its upper end not included."""
    v = engine(spark, sf_dir).visible(snip="14,18", timestamp_mode="network").where("file_type = 'smb'")
    return v.select("name", F.md5("content").alias("content_md5"))


@query("engine_readdir", f"SELECT file AS name, false AS is_dir, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM {FILES}".replace("md5(text) AS content_md5", "md5(text) AS content_md5, text"))
def engine_readdir(spark, sf_dir):
    """The entries of one directory of the share."""
    return engine(spark, sf_dir).readdir("/smb/docs/dir", "/protocol/path/").select("name", "is_dir", "size")


@query(
    "engine_tree",
    f"""SELECT CAST(CASE WHEN grouping(protocol) = 1 THEN 0 WHEN grouping(port) = 1 THEN 1 ELSE 2 END AS INTEGER) AS depth, protocol, port AS "dstPort", CAST(count(*) AS BIGINT) AS files FROM (
      SELECT 'http' AS protocol, '50000' AS port FROM {PAGES} WHERE size > 0 UNION ALL SELECT 'tcp', '8000' FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT 'smb', '445' FROM {FILES}) GROUP BY ROLLUP (protocol, port)""",
)
def engine_tree(spark, sf_dir):
    """All directories at all depths."""
    return engine(spark, sf_dir).tree("/protocol/dstPort/").select("depth", "protocol", "dstPort", "files")


@query("engine_clients", f"SELECT '/smb/60.' || (conv_id // 65536) % 256 || '.' || (conv_id // 256) % 256 || '.' || conv_id % 256 AS directory, CAST(count(*) AS BIGINT) AS files FROM {FILES} GROUP BY conv_id")
def engine_clients(spark, sf_dir):
    """A server's files under each of their clients."""
    rows = engine(spark, sf_dir).listing("/protocol/srcIP/").where("file_type = 'smb'")
    return rows.groupBy("directory").agg(F.count(F.lit(1)).alias("files"))


@query("engine_times", f"SELECT DISTINCT '/docs/dir/c' || conv_id || '.txt' AS path, 'hybrid' AS kind, CAST(version AS INTEGER) AS version, CAST(ts_ns AS BIGINT) AS m, {(10_000_000) * 100} AS a FROM {FILES}")
def engine_times(spark, sf_dir):
    """What the index knows of the times that follow from writes: the access time is carried from the open, which the server dated to the first second of 1970."""
    assert T1601 > 0
    t = engine(spark, sf_dir).times.where("kind = 'hybrid'")
    kept = t.groupBy("stream", "version").agg(F.min("at").alias("at"))
    return t.join(kept, ["stream", "version", "at"]).select(F.substring_index("stream", ":", -1).alias("path"), "kind", "version", "m", "a")
