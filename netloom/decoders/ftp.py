"""FTP control connections as rows: commands, their answers, data ports, directories, and the data streams that they announce."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.joins import first_interval
from ..operators.sequence import START
from .registry import Options, decoder, made, properties

#: Commands that move data, and those whose data is a listing.
TRANSFERS = ("RETR", "STOR", "APPE", "STOU")
LISTINGS = ("LIST", "NLST", "MLSD")


def control(runs: DataFrame) -> DataFrame:
    """A row for each command of a control connection: stream, run, verb, argument, code, message, port, t0, t1.

    The answer is the next run, if it begins with a code. ``t1`` is the time of
    the run after the answer, or a second after the answer. ``port`` is the data
    port in force: that of the latest PASV or EPSV answer, or PORT command.
    """
    r = runs.where((F.col("first.src_port") == 21) | (F.col("first.dst_port") == 21)).withColumn("t", F.decode("content", "ISO-8859-1"))
    w = Window.partitionBy("stream").orderBy("run")
    answer = F.lead("t").over(w)
    r = r.withColumns({"answer": answer, "ta": F.lead("ts_ns").over(w), "tb": F.lead("ts_ns", 2).over(w)})
    line = F.trim(F.regexp_replace("t", r"[ \n\r\t]+$", ""))
    r = r.withColumns({"line": line, "code": text.response_code(F.coalesce("answer", F.lit("")))})
    passive = F.when(F.col("t").startswith("227"), text.port_of_pair(F.col("t"))).when(F.col("t").startswith("229"), text.port_of_bars(F.col("t")))
    active = F.when(F.upper("line").startswith("PORT "), text.port_of_pair(F.col("line")))
    r = r.withColumn("port", F.last(F.coalesce(passive, active), ignorenulls=True).over(w.rowsBetween(START, 0)))
    r = r.where(text.response_code(F.col("t")) == 0)
    return r.select(
        "stream",
        "run",
        F.upper(F.split("line", " ")[0]).alias("verb"),
        F.when(F.locate(" ", F.col("line")) > 0, F.substring_index(F.expr("substring(line, locate(' ', line) + 1)"), "\r", 1)).alias("argument"),
        F.when(F.col("code") > 0, F.col("code")).alias("code"),
        F.when(F.col("code") > 0, F.regexp_replace("answer", r"^\d{3}[ -]", "")).alias("message"),
        "port",
        F.col("ts_ns").alias("t0"),
        F.coalesce("tb", F.col("ta") + 1_000_000_000, "ts_ns").alias("t1"),
        F.col("first.src_ip").alias("client_ip"),
        F.col("first.dst_ip").alias("server_ip"),
    )


def log(runs: DataFrame) -> DataFrame:
    """(stream, content): the control connection as text, each line with its direction; the server speaks first."""
    r = runs.where((F.col("first.src_port") == 21) | (F.col("first.dst_port") == 21))
    line = text.prefixed(F.decode("content", "ISO-8859-1"), "[<] ")
    other = text.prefixed(F.decode("content", "ISO-8859-1"), "[>] ")
    r = r.select("stream", "run", F.when(F.col("run") % 2 == 0, line).otherwise(other).alias("x"))
    return r.groupBy("stream").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "x"))), lambda s: s["x"]), "").alias("content"))


def directories(commands: DataFrame) -> DataFrame:
    """``commands`` with ``cwd``, the directory before each. Relative paths compose, so it is a fold in order, one pass over sorted rows."""
    cols = commands.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cwd = None, ""
        for b in batches:
            out = []
            for stream, verb, arg, code in zip(*[b.column(cols.index(c)).to_pylist() for c in ("stream", "verb", "argument", "code")], strict=True):
                if stream != now:
                    now, cwd = stream, ""
                out.append(cwd)
                if code == 250 and verb == "CWD" and arg:
                    cwd = arg.rstrip("/") if arg.startswith("/") else f"{cwd}/{arg}".rstrip("/")
                elif code == 250 and verb == "CDUP":
                    cwd = cwd.rpartition("/")[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*cols, "cwd"])

    return commands.repartition("stream").sortWithinPartitions("stream", "run").mapInArrow(run, commands.withColumn("cwd", F.lit("")).schema)


def data_files(commands: DataFrame, streams: DataFrame, slot_ns: int = 60_000_000_000) -> DataFrame:
    """Data streams with the command that announced them: same data port, begun within the command's time; the first such command."""
    moving = directories(commands).where(F.col("verb").isin(*TRANSFERS, *LISTINGS) & F.col("port").isNotNull())
    slots = moving.select("port", F.col("t0").alias("lo"), F.col("t1").alias("hi"), F.struct("t0", "stream", "run").alias("order"), "verb", "argument", "cwd", "server_ip", F.col("stream").alias("control"))
    ports = F.explode(F.array_distinct(F.array("dst_port", "src_port")))
    points = streams.withColumn("port", ports).select("stream", "port", "ts_ns", "size")
    hit = first_interval(points, slots, ["port"], "ts_ns", "lo", "hi", "order", slot_ns)
    path = F.when(F.col("argument").startswith("/"), F.col("argument")).otherwise(F.concat_ws("/", "cwd", "argument"))
    return hit.withColumn("path", F.concat(F.lit("/FILES_FROM_"), "server_ip", F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))).select("stream", "control", "verb", "path", "size", "ts_ns")


def mlsd(listing) -> DataFrame:
    """``listing`` (path, content text) as rows (path, name, is_dir, modified), one a line with facts; times are UTC."""
    lines = listing.select("path", F.explode(F.split("content", "\r?\n")).alias("line")).where(F.col("line").contains("; "))
    return lines.select(
        "path", text.fact_name(F.col("line")).alias("name"), (F.lower(text.fact(F.col("line"), "type")) == "dir").alias("is_dir"), F.try_to_timestamp(text.fact(F.col("line"), "modify"), F.lit("yyyyMMddHHmmss")).alias("modified")
    )


@decoder("ftpcontrol", lambda o: (F.col("file_type") == "tcp") & ((F.col("first.src_port") == 21) | (F.col("first.dst_port") == 21)))
def files(runs: DataFrame, options: Options) -> DataFrame:
    """The talk of a control connection, and the names and passwords that it gave."""
    heads = runs.groupBy("stream").agg(F.min("ts_ns").alias("ts_ns"), F.first("first").alias("first"), F.max("missing_data").alias("missing_data"))
    texts = log(runs).withColumn("name", F.lit(".control")).unionByName(credentials(runs).withColumn("name", F.lit(".credentials")))
    suffix = F.concat(F.lit("ftp"), F.col("name"))
    return texts.join(heads, "stream").select(*made(F.col("stream"), suffix, F.col("name"), F.encode("content", "ISO-8859-1"), properties(protocol=F.lit("ftpcontrol")), is_metadata=F.lit(True), missing=F.col("missing_data")))


def credentials(runs: DataFrame) -> DataFrame:
    """(stream, content): the arguments of USER and PASS, a line each, in their order."""
    c = control(runs).where("verb IN ('USER', 'PASS') AND argument IS NOT NULL")
    line = F.struct("run", F.concat_ws(" ", "verb", "argument").alias("x"))
    return c.groupBy("stream").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda s: s["x"]), "\n"), F.lit("\n")).alias("content"))
