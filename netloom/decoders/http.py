"""HTTP messages out of stream runs, as Columns; only the content codings run in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binary, fingerprints
from ..functions.text import uri_filename
from ..operators.filters import is_http
from ..operators.sequence import START
from .registry import Options, decoder, made, properties

#: The methods of a request.
METHODS = ("GET", "HEAD", "POST", "PUT", "DELETE", "TRACE", "OPTIONS", "CONNECT", "PATCH")


def field(head: Column, name: str) -> Column:
    """The value of the first header field of a name, in any case; null without one."""
    return F.nullif(F.regexp_extract(head, rf"(?is)\r\n{name}:[ \t]*([^\r\n]*?)[ \t]*\r\n", 1), F.lit(""))


def messages(runs: DataFrame) -> DataFrame:
    """A row for each run that is a request or a response with a whole header.

    A response has the file name, host and URI of the request before it, until a
    response with a body has come. Endpoints are swapped in responses. ``body``
    is decoded: chunks first, then gzip or deflate, by exact names.
    """
    at = F.locate("\r\n\r\n", F.col("__text"))
    df = runs.withColumn("__text", F.decode("content", "ISO-8859-1")).withColumn("__h", at).where("__h > 0")
    df = df.withColumn("head", F.substring(F.col("__text"), F.lit(1), F.col("__h") + 3))
    line = F.regexp_extract("head", "^([^\r\n]*)", 1)
    request = line.rlike(f"^({'|'.join(METHODS)}) [^ ]+ HTTP/(0\\.9|1\\.0|1\\.1)$")
    response = line.rlike(r"^HTTP/(1\.0|1\.1) [1-5][0-9]{2}( |$)")
    df = df.where(request | response).withColumns({"is_request": request, "body_raw": F.expr("substring(content, __h + 4)")})
    part = lambda k: F.when(F.col("is_request"), F.split(line, " ")[k])
    names = F.transform(F.slice(F.split("head", "\r\n"), F.lit(2), F.size(F.split("head", "\r\n"))), lambda x: F.split(x, ":")[0])
    own = {
        "method": part(0),
        "uri": part(1),
        "domain": F.when(F.col("is_request"), F.coalesce(field(F.col("head"), "host"), F.lit(""))),
        "status": F.when(~F.col("is_request"), F.split(line, " ")[1].cast("int")),
        "ja4h": F.when(
            F.col("is_request"),
            fingerprints.ja4h(F.split(line, " ")[0], F.split(line, " ")[2], F.filter(names, lambda x: x != ""), field(F.col("head"), "cookie"), field(F.col("head"), "referer"), field(F.col("head"), "accept-language")),
        ),
    }
    df = df.withColumns(own)
    chunked = ~F.col("is_request") & F.coalesce(field(F.col("head"), "transfer-encoding") == "chunked", F.lit(False))
    coding = F.when(~F.col("is_request"), field(F.col("head"), "content-encoding"))
    df = df.withColumns({"chunked": chunked, "coding": F.when(coding.isin("gzip", "deflate"), coding)})
    plain = F.coalesce(binary.unchunk(F.when(F.col("chunked"), F.col("body_raw"))), F.col("body_raw"))
    df = df.withColumn("__b", plain)
    df = df.withColumn("body", F.coalesce(binary.gunzip(F.when(F.col("coding") == "gzip", F.col("__b"))), binary.inflate(F.when(F.col("coding") == "deflate", F.col("__b"))), F.col("__b")))
    before = Window.partitionBy("stream").orderBy("run").rowsBetween(START, -1)
    asked = F.struct("uri", "domain", "ja4h", "method")
    counts = F.col("is_request") | (F.octet_length("body") > 0)
    last = F.last(F.when(counts, F.struct(F.col("is_request").alias("r"), asked.alias("a"))), ignorenulls=True).over(before)
    df = df.withColumn("__last", last)
    from_last = lambda c: F.when(F.col("is_request"), F.col(c)).otherwise(F.coalesce(F.when(F.col("__last.r"), F.col("__last.a")[c]), F.lit("")))
    df = df.withColumns({c: from_last(c) for c in ("uri", "domain", "ja4h")})
    name = uri_filename(F.col("uri"))
    named = F.when(F.col("is_request"), F.concat_ws("-", "method", F.nullif(name, F.lit("")))).otherwise(name)
    ends = {a: F.when(F.col("side") == 0, F.col("first")[a]).otherwise(F.col("first")[b]) for a, b in (("src_ip", "dst_ip"), ("dst_ip", "src_ip"), ("src_port", "dst_port"), ("dst_port", "src_port"))}
    return df.withColumns({"filename": named, **ends}).select(
        "stream", "run", "ts_ns", "is_request", "method", "status", "domain", "uri", "filename", "ja4h", *ends, "missing_data", "head", "body_raw", "body", "offset"
    )


@decoder("http", lambda o: is_http(F.decode(F.substring("content", 1, 16), "ISO-8859-1")))
def files(runs: DataFrame, options: Options) -> DataFrame:
    """The header of each message as metadata, and its body where it has one."""
    m = messages(runs).join(runs.select("stream", "run", "first"), ["stream", "run"])
    own = properties(protocol=F.lit("http"), srcIP=F.col("src_ip"), dstIP=F.col("dst_ip"), srcPort=F.col("src_port"), dstPort=F.col("dst_port"), domain=F.col("domain"), uri=F.col("uri"), ja4h=F.col("ja4h"))
    parts = F.array(F.struct(F.lit(True).alias("meta"), F.encode("head", "ISO-8859-1").alias("c")), F.struct(F.lit(False).alias("meta"), F.col("body").alias("c")))
    each = m.withColumn("own", own).withColumn("p", F.explode(parts)).where("p.meta OR octet_length(p.c) > 0")
    suffix = F.concat(F.lit("http@"), F.col("offset").cast("string"), F.when(F.col("p.meta"), ".meta").otherwise(""))
    return each.select(*made(F.col("stream"), suffix, F.col("filename"), F.col("p.c"), F.col("own"), offset=F.col("offset"), is_metadata=F.col("p.meta"), missing=F.col("missing_data")))
