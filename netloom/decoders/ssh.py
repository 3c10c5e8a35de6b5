"""SSH handshakes: identification lines, the lists of a key exchange as Columns, and their fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binary import number
from ..functions.fingerprints import hassh
from ..operators.sequence import START
from .registry import Options, decoder, made, properties

KEXINIT, NEWKEYS = 20, 21
#: The name lists of a key exchange in their order.
LISTS = ("kex", "host_key", "enc_out", "enc_in", "mac_out", "mac_in", "comp_out", "comp_in")


def _lists(payload: Column) -> Column:
    """The ten name lists' first eight, read one behind the other from the byte after the cookie."""
    start = F.struct(F.lit(17).cast("long").alias("at"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, _: Column) -> Column:
        n = F.coalesce(number(payload, acc["at"], 4), F.lit(0).cast("long"))
        text = F.decode(F.substring(payload, (acc["at"] + 5).cast("int"), F.least(n, F.octet_length(payload)).cast("int")), "ISO-8859-1")
        return F.struct((acc["at"] + 4 + n).alias("at"), F.concat(acc["found"], F.array(text)).alias("found"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(LISTS))), start, step, lambda acc: acc["found"])


def handshakes(runs: DataFrame) -> DataFrame:
    """(stream, side, ident, hassh): of each side of an SSH connection; ``hassh`` of the client's or the server's lists.

    The key exchange may follow its identification in the same run or begin a later one.
    """
    r = runs.where((F.col("first.src_port") == 22) | (F.col("first.dst_port") == 22)).withColumn("text", F.decode("content", "ISO-8859-1"))
    ident = F.nullif(F.regexp_extract("text", r"^(SSH-[^\r\n]*)\r?\n", 1), F.lit(""))
    skip = F.when(ident.isNotNull(), F.locate("\n", F.col("text"))).otherwise(0)
    r = r.withColumns({"ident": ident, "skip": skip})
    f = F.col("content")
    is_kex = number(f, F.col("skip") + 5, 1) == KEXINIT
    r = r.withColumn("lists", F.when(is_kex, _lists(F.expr("substring(content, skip + 6)"))))
    # Side 0 opened the connection; a server's lists are those of its own direction.
    client = F.col("side") == F.when(F.col("first.dst_port") == 22, 0).otherwise(1)
    pick = lambda c, s: F.when(client, F.col("lists")[LISTS.index(c)]).otherwise(F.col("lists")[LISTS.index(s)])
    mark = F.when(F.col("lists").isNotNull(), hassh(F.col("lists")[0], pick("enc_out", "enc_in"), pick("mac_out", "mac_in"), pick("comp_out", "comp_in")))
    r = r.withColumn("hassh", mark)
    return r.groupBy("stream", "side").agg(F.min_by("ident", F.when(F.col("ident").isNotNull(), F.col("run"))).alias("ident"), F.min_by("hassh", F.when(F.col("hassh").isNotNull(), F.col("run"))).alias("hassh"), F.max(client).alias("is_client"))


def encrypted(runs: DataFrame) -> DataFrame:
    """(stream, side, run, content): what each run holds behind its side's NEWKEYS; runs of the handshake alone are left out."""

    @F.arrow_udf("struct<at:long,closed:boolean>")
    def handshake(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            rows = []
            for data in column.to_pylist():
                at, closed = 0, False
                data = data or b""
                if data.startswith(b"SSH-"):
                    at = data.find(b"\n") + 1 or len(data)
                while not closed and at + 6 <= len(data):
                    closed = data[at + 5] == NEWKEYS
                    at += 4 + int.from_bytes(data[at : at + 4], "big")
                rows.append({"at": min(at, len(data)), "closed": closed})
            yield pa.array(rows, pa.struct([("at", pa.int64()), ("closed", pa.bool_())]))

    r = runs.select("stream", "side", "run", "content", handshake("content").alias("h"))
    # The run with NEWKEYS is the first that closes its side's handshake; those behind it are encrypted from their first byte.
    first = F.min(F.when(F.col("h.closed"), F.col("run"))).over(Window.partitionBy("stream", "side").rowsBetween(START, Window.unboundedFollowing))
    r = r.withColumn("at", F.when(F.col("run") > first, 0).when(F.col("run") == first, F.col("h.at")))
    return r.select("stream", "side", "run", F.expr("substring(content, cast(at AS int) + 1)").alias("content")).where("octet_length(content) > 0")


@decoder("ssh", lambda o: (F.col("file_type") == "tcp") & ((F.col("first.src_port") == 22) | (F.col("first.dst_port") == 22)))
def files(runs: DataFrame, options: Options) -> DataFrame:
    """A file for the encrypted bytes of each run, with the fingerprints of both ends."""
    marks = handshakes(runs).groupBy("stream").agg(F.max(F.when(F.col("is_client"), F.col("hassh"))).alias("hassh"), F.max(F.when(~F.col("is_client"), F.col("hassh"))).alias("hassh_server"))
    heads = runs.select("stream", "side", "run", "ts_ns", "offset", "first", "missing_data")
    each = encrypted(runs).join(heads, ["stream", "side", "run"]).join(marks, "stream")
    turned = lambda a, b: F.when(F.col("side") == 0, F.col("first")[a]).otherwise(F.col("first")[b])
    own = properties(
        protocol=F.lit("ssh"), hassh=F.col("hassh"), hasshServer=F.col("hassh_server"), srcIP=turned("src_ip", "dst_ip"), dstIP=turned("dst_ip", "src_ip"), srcPort=turned("src_port", "dst_port"), dstPort=turned("dst_port", "src_port")
    )
    name = F.concat(F.lit("SSH-"), F.col("run").cast("string"))
    return each.select(*made(F.col("stream"), F.concat_ws("@", F.lit("ssh"), "run"), name, F.col("content"), own, offset=F.col("offset"), missing=F.col("missing_data")))
