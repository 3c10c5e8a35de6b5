"""SMB2 connections as rows: messages, requests with their responses, shares, file handles, and the versions of files that reads and writes show.

Framing is told in Python, one run at a time; fields are Columns, and every
correlation is a join on (connection, message id), (connection, tree) or
(connection, file id).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binary import number
from ..functions.times import EPOCH, TICKS, filetime_seconds
from ..operators.clocks import SECOND, assigned, server_time, synthesized
from ..operators.gather import in_order
from ..operators.sequence import START, append_versions
from ..operators.tables import lasting
from .registry import Options, decoder, made, properties

#: Commands by number, from 0.
COMMANDS = [
    "NEGOTIATE",
    "SESSION_SETUP",
    "LOGOFF",
    "TREE_CONNECT",
    "TREE_DISCONNECT",
    "CREATE",
    "CLOSE",
    "FLUSH",
    "READ",
    "WRITE",
    "LOCK",
    "IOCTL",
    "CANCEL",
    "ECHO",
    "QUERY_DIRECTORY",
    "CHANGE_NOTIFY",
    "QUERY_INFO",
    "SET_INFO",
    "OPLOCK_BREAK",
]
NEGOTIATE, TREE_CONNECT, CREATE, CLOSE, READ, WRITE, QUERY_DIRECTORY, QUERY_INFO, SET_INFO = 0, 3, 5, 6, 8, 9, 14, 16, 17
#: Classes of information about a file that begin with its four times, and where names are in a directory's entries, by class (12 has names alone).
TIMED = (4, 18, 34)
NAME_AT = {1: 64, 2: 68, 3: 94, 12: 12, 37: 104, 38: 80}
#: The kinds of frames that set up or keep a session below SMB.
SESSION = (0x81, 0x82, 0x83, 0x84, 0x85)
#: Fixed value: most tenths of microseconds that are nanoseconds in 64 bits.
MOST = ((1 << 63) - 1) // 100
CHAINED = "F" * 32  # the file id of "the file of the command before"


def _le(at: int, n: int, of: str = "msg") -> Column:
    return number(F.col(of), at, n, little=True)


def _hex(at: int, n: int, of: str = "msg") -> Column:
    return F.hex(F.substring(F.col(of), at + 1, n))


def filetime(ticks: Column) -> Column:
    """Tenths of microseconds since 1601 as a timestamp of whole seconds; null for 0."""
    return F.timestamp_seconds(filetime_seconds(ticks))


def command_name(number_: Column) -> Column:
    """The name of a command; UNKNOWN for a number without one."""
    return F.coalesce(F.get(F.array(*[F.lit(c) for c in COMMANDS]), number_), F.lit("UNKNOWN"))


def _text(of: str, at: Column, n: Column) -> Column:
    return F.decode(F.substring(F.col(of), (at + 1).cast("int"), n.cast("int")), "UTF-16LE")


def messages(runs: DataFrame) -> DataFrame:
    """A row for each SMB2 message, chained ones apart: stream, side, run, n, ts_ns, command, is_response, status, message_id, tree_id, session_id, msg."""
    kind = pa.list_(pa.binary())

    @F.arrow_udf("array<binary>")
    def split(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            rows = []
            for data in column.to_pylist():
                out, at = [], 0
                while data and at + 4 <= len(data):
                    if data[at] in SESSION:
                        at += 4 + int.from_bytes(data[at + 2 : at + 4], "big")
                        continue
                    if data[at]:  # the next message with its frame is looked for
                        found = data.find(b"\xfeSMB", at + 4)
                        if found < 0:
                            break
                        at = found - 4 if data[found - 4] == 0 else found + 4
                        continue
                    size = int.from_bytes(data[at + 1 : at + 4], "big")
                    frame, at = data[at + 4 : at + 4 + size], at + 4 + size
                    while len(frame) >= 64 and frame[:4] == b"\xfeSMB":
                        step = int.from_bytes(frame[20:24], "little")
                        out.append(frame[:step] if step else frame)
                        frame = frame[step:] if 64 <= step < len(frame) else b""
                rows.append(out)
            yield pa.array(rows, kind)

    each = runs.select("stream", "side", "run", "ts_ns", F.concat_ws(":", "first.dst_ip", "first.dst_port").alias("server"), F.col("first.src_ip").alias("client_ip"), F.posexplode(split("content")).alias("n", "msg"))
    return each.select(
        "*", _le(12, 2).cast("int").alias("command"), (_le(16, 4) % 2 == 1).alias("is_response"), _le(8, 4).alias("status"), _hex(24, 8).alias("message_id"), _le(36, 4).alias("tree_id"), _hex(40, 8).alias("session_id")
    )


def log(msgs: DataFrame) -> DataFrame:
    """(stream, run, n, line): one line a message, with its direction."""
    name = F.try_element_at(F.array(*map(F.lit, COMMANDS)), F.col("command") + 1)
    line = F.concat(F.when(F.col("is_response"), "[<] ").otherwise("[>] "), F.coalesce(name, F.concat(F.lit("UNKNOWN_"), F.col("command").cast("string"))))
    return msgs.select("stream", "run", "n", line.alias("line"))


def exchanges(msgs: DataFrame) -> DataFrame:
    """Requests with their responses: same connection, message id and command; an unanswered request has nulls."""
    # Messages are made and dealt once; of several answers the first counts.
    w = Window.partitionBy("stream", "message_id", "command").orderBy("run", "n").rowsBetween(START, Window.unboundedFollowing)
    answer = F.first(F.when(F.col("is_response") & F.col("command").isNotNull(), F.struct("msg", "status", "ts_ns")), ignorenulls=True).over(w)
    both = msgs.withColumn("answer", answer).where("NOT is_response").withColumnRenamed("msg", "req")
    return both.select(*[c for c in both.columns if c not in ("status", "answer")], F.col("answer.msg").alias("rsp"), F.col("answer.status").alias("answer_status"), F.col("answer.ts_ns").alias("answer_ns"))


def trees(ex: DataFrame) -> DataFrame:
    """(stream, session_id, tree_id, share): the name of each connected share, without its server."""
    t = ex.where(f"command = {TREE_CONNECT} AND answer_status = 0")
    path = _text("req", _le(68, 2, "req"), _le(70, 2, "req"))
    return t.select("stream", "session_id", _le(36, 4, "rsp").alias("tree_id"), F.substring_index(path, "\\", -1).alias("share")).dropDuplicates(["stream", "session_id", "tree_id"])


def opens(ex: DataFrame) -> DataFrame:
    """(stream, file_id, path, is_directory, times, told): each handle that a Create gave, with its times' bytes; a tree without a name is treeId_<n>."""
    c = ex.where(f"command = {CREATE} AND answer_status = 0")
    name = F.translate(_text("req", _le(108, 2, "req"), _le(110, 2, "req")), "\\", "/")
    c = c.join(trees(ex), ["stream", "session_id", "tree_id"], "left")
    share = F.coalesce("share", F.concat(F.lit("treeId_"), F.col("tree_id").cast("string")))
    at = {"btime": 72, "atime": 80, "mtime": 88, "ctime": 96}
    return c.select(
        "stream", "server", "client_ip", "message_id", _hex(128, 16, "rsp").alias("file_id"), F.concat(F.lit("/"), share, F.when(name != "", F.concat(F.lit("/"), name)).otherwise("")).alias("path"),
        (F.shiftright(_le(120, 4, "rsp"), 4) % 2 == 1).alias("is_directory"), F.col("answer_ns").alias("opened_ns"), F.substring("rsp", 73, 32).alias("told"), *[filetime(_le(a, 8, "rsp")).alias(k) for k, a in at.items()],
    )


def _named(rows: DataFrame, handles: DataFrame) -> DataFrame:
    """``rows`` with a file_id, with the path and handle that it stands for: a chained command names no file, it means that of the Create before it."""
    held = handles.select("stream", "file_id", F.col("message_id").alias("m"), "path", "is_directory", "opened_ns").dropDuplicates(["stream", "file_id"])
    chained = rows.where(F.col("file_id") == CHAINED).drop("file_id").join(held.withColumnRenamed("m", "created"), ["stream", "created"])
    plain = rows.where(F.col("file_id") != CHAINED).drop("created").join(held.drop("m"), ["stream", "file_id"])
    return plain.unionByName(chained.select(*plain.columns))


def _answered(ex: DataFrame, *commands: int) -> DataFrame:
    """Exchanges of some commands that succeeded, each with the latest Create before it in its connection."""
    w = Window.partitionBy("stream").orderBy("run", "n").rowsBetween(START, -1)
    before = F.last(F.when(F.col("command") == CREATE, F.col("message_id")), ignorenulls=True).over(w)
    # Only these commands and Creates are dealt.
    return ex.where(F.col("command").isin(CREATE, *commands)).withColumn("created", before).where(F.col("command").isin(*commands) & (F.col("answer_status") == 0))


def operations(ex: DataFrame) -> DataFrame:
    """Reads and writes that were answered: stream, server, path, op, pos, len, data, ts_ns, client_ip, and the connection's skew."""
    io = _answered(ex, READ, WRITE).withColumn("file_id", _hex(80, 16, "req"))
    both = _named(io, opens(ex)).join(skews(ex), "stream", "left")
    read = F.col("command") == READ
    data = F.when(read, F.substring(F.col("rsp"), (_le(66, 1, "rsp") + 1).cast("int"), _le(68, 4, "rsp").cast("int"))).otherwise(F.substring(F.col("req"), (_le(66, 2, "req") + 1).cast("int"), _le(68, 4, "req").cast("int")))
    both = both.withColumn("data", data)
    return both.select(
        "stream", "server", "path", F.when(read, "read").otherwise("write").alias("op"), _le(72, 8, "req").alias("pos"), F.octet_length("data").cast("long").alias("len"), "data", F.col("answer_ns").alias("ts_ns"), "client_ip", "run", "n", F.coalesce("skew", F.lit(0).cast("long")).alias("skew")
    )


def skews(ex: DataFrame) -> DataFrame:
    """(stream, skew): by how many whole seconds, in nanoseconds, a server's clock is ahead, told by its first answer to a negotiation."""
    n = ex.where(f"command = {NEGOTIATE} AND rsp IS NOT NULL").select("stream", "run", "n", "ts_ns", unix_ns(_le(104, 8, "rsp")).alias("told")).where("told IS NOT NULL")
    first = n.groupBy("stream").agg(F.min_by(F.struct("told", "ts_ns"), F.struct("run", "n")).alias("x"))
    return first.select("stream", (((F.col("x.told") - F.col("x.ts_ns")) / SECOND).cast("long") * SECOND).alias("skew"))


def unix_ns(ticks: Column) -> Column:
    """Tenths of microseconds since 1601 as nanoseconds since 1970; null for 0, and for what 64 bits of nanoseconds can't say."""
    since = ticks - EPOCH * TICKS
    # The bound is asked for beforehand: try_multiply raises and catches an error for each time beyond it.
    return F.when((ticks > 0) & since.between(-MOST, MOST), since * 100)


ENTRIES = "array<struct<name:string,btime:long,atime:long,mtime:long,ctime:long,size:long,attributes:long>>"


def _entries(kind: Column, data: Column) -> Column:
    """The entries of a directory, read one behind the other by the offset that each gives of the next; a class without times has names alone."""
    fields = pa.list_(pa.struct([("name", pa.string()), *[(c, pa.int64()) for c in ("btime", "atime", "mtime", "ctime", "size", "attributes")]]))

    @F.arrow_udf(ENTRIES)
    def walk(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for kinds, datas in parts:
            rows = []
            for k, x in zip(kinds.to_pylist(), datas.to_pylist(), strict=True):
                out, at, begin = [], 0, NAME_AT.get(k)
                while x and begin and at + begin <= len(x):
                    number_ = lambda a, n: int.from_bytes(x[at + a : at + a + n], "little")  # noqa: B023, E731
                    n = number_(8 if k == 12 else 60, 4)
                    if at + begin + n > len(x):
                        break
                    told = {} if k == 12 else {"btime": number_(8, 8), "atime": number_(16, 8), "mtime": number_(24, 8), "ctime": number_(32, 8), "size": number_(40, 8), "attributes": number_(56, 4)}
                    out.append({"name": x[at + begin : at + begin + n].decode("utf-16le", "replace")} | {c: v if v < 1 << 63 else None for c, v in told.items()})
                    step = number_(0, 4)
                    if not step:
                        break
                    at += step
                rows.append(out)
            yield pa.array(rows, fields)

    return walk(kind, data)


def listed(ex: DataFrame, handles: DataFrame | None = None) -> DataFrame:
    """(stream, server, client_ip, path, ts_ns, btime, atime, mtime, ctime, size, is_directory) of every entry of the directories that were asked for; . and .. are left out.

    ``handles`` are what ``opens`` gives, where they were told already.
    """
    q = _answered(ex, QUERY_DIRECTORY).withColumn("file_id", _hex(72, 16, "req"))
    data = F.substring(F.col("rsp"), (_le(66, 2, "rsp") + 1).cast("int"), _le(68, 4, "rsp").cast("int"))
    q = _named(q, opens(ex) if handles is None else handles).select("stream", "server", "client_ip", F.col("path").alias("directory"), "answer_ns", F.explode(_entries(_le(66, 1, "req").cast("int"), data)).alias("e")).where("e.name NOT IN ('.', '..', '')")
    return q.select("stream", "server", "client_ip", F.concat("directory", F.lit("/"), "e.name").alias("path"), F.col("answer_ns").alias("ts_ns"), "e.btime", "e.atime", "e.mtime", "e.ctime", "e.size", (F.shiftright("e.attributes", 4) % 2 == 1).alias("is_directory"))


def told(ex: DataFrame) -> DataFrame:
    """(server, path, at, a, m, c, b, client_ip, is_directory): every time that a server, or a client that sets it, tells of a file.

    They come with the answers to Create, Close and queries for information, with settings of it, and with the
    entries of directories. Where access, write or change time is 0 nothing is told: the row has nulls, and stands for the path alone.
    """
    keep = ["server", "path", "client_ip", "is_directory", "answer_ns"]
    # Handles are met four times: they are told once.
    o = lasting(opens(ex).select("stream", "message_id", "file_id", "server", "client_ip", "path", "is_directory", "opened_ns", "told"))
    command, level = F.col("command"), _le(67, 1, "req")
    asks = (command == CLOSE) | ((_le(66, 1, "req") == 1) & F.when(command == QUERY_INFO, level.isin(*TIMED)).otherwise(level == 4))
    by = lambda closed, asked, given: F.when(command == CLOSE, closed).when(command == QUERY_INFO, asked).otherwise(given)
    four = lambda of, at: F.substring(F.col(of), (at + 1).cast("int"), F.lit(32))
    rows = _answered(ex, CLOSE, QUERY_INFO, SET_INFO).where(asks).select(
        "stream", "created", "server", "client_ip", "answer_ns", by(_hex(72, 16, "req"), _hex(88, 16, "req"), _hex(80, 16, "req")).alias("file_id"),
        by(four("rsp", F.lit(72)), four("rsp", _le(66, 2, "rsp")), four("req", _le(72, 2, "req"))).alias("told"),
    )
    made_ = o.withColumn("answer_ns", F.col("opened_ns"))
    rows = made_.select(*keep, "told").unionByName(_named(rows, o.drop("told")).select(*keep, "told"))
    rows = rows.select(*keep, *[_le(8 * k, 8, "told").alias(c) for k, c in enumerate(("btime", "atime", "mtime", "ctime"))])
    rows = rows.unionByName(listed(ex, o).withColumnRenamed("ts_ns", "answer_ns").select(*rows.columns))
    whole = (F.col("atime") > 0) & (F.col("mtime") > 0) & (F.col("ctime") > 0)
    when = lambda c, name: F.when(whole, F.coalesce(unix_ns(F.col(c)), F.lit(0))).alias(name)
    return rows.select(*keep[:4], F.col("answer_ns").alias("at"), when("atime", "a"), when("mtime", "m"), when("ctime", "c"), when("btime", "b"))


def versions(ops: DataFrame, fs: DataFrame | None = None) -> DataFrame:
    """(server, path, version, ts_ns, last_access, is_read, fs_time, hybrid_time, size, content, client_ips): a version begins at offset 0 and grows by what fits its end.

    Reads and writes of a file make one row of versions, in the order of their
    times: by the server's clock, by what it told (``fs``, as ``told`` gives
    it), and when they were seen. Neighbours of equal bytes are one, the
    earliest; its clients are those of all, and ``last_access`` is when the
    latest of the others was seen.
    """
    key = ["server", "path"]
    grown = append_versions(ops, key, ["ts_ns", "stream", "run", "n"], "pos", "len").where("applied = 1")
    order = F.struct("ts_ns", "stream", "run", "n")
    v = grown.groupBy(*key, "version").agg(
        F.min("ts_ns").alias("at"), F.min_by("skew", order).alias("skew"), F.max_by(F.col("op") == "read", order).alias("is_read"), F.max("size").alias("size"),
        in_order("data", "ts_ns, stream, run, n").alias("content"), F.collect_set("client_ip").alias("ips"),
    )
    v = server_time(v, fs.where("a IS NOT NULL"), key) if fs is not None else v.withColumn("fs_time", F.lit(None).cast("long"))
    v = v.withColumns({"hybrid_time": F.col("at") + F.col("skew"), "sum": F.sha2("content", 256)})
    w = Window.partitionBy(*key).orderBy("hybrid_time", F.coalesce("fs_time", F.lit(0)), "at", "version")
    v = v.withColumns({"island": F.coalesce((F.lag("sum").over(w) != F.col("sum")).cast("int"), F.lit(1)), "rank": F.row_number().over(w)})
    v = v.withColumn("island", F.sum("island").over(w.rowsBetween(START, 0)) - 1)
    first = F.min_by(F.struct("at", "is_read", "fs_time", "hybrid_time", "size", "content"), "rank")
    v = v.groupBy(*key, F.col("island").alias("version")).agg(first.alias("f"), F.max("at").alias("latest"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ips")))).alias("client_ips"))
    access = F.when(F.col("latest") > F.col("f.at"), F.col("latest"))
    return v.select(*key, "version", F.col("f.at").alias("ts_ns"), access.alias("last_access"), "f.is_read", "f.fs_time", "f.hybrid_time", "f.size", "f.content", "client_ips")


def entries(vers: DataFrame, ops: DataFrame, fs: DataFrame) -> DataFrame:
    """(server, path, kind, at, a, m, c, b, version): the times of files, told and that follow from reads and writes, each with the version it belongs to."""
    key = ["server", "path"]
    begun = append_versions(ops.drop("data", "client_ip"), key, ["ts_ns", "stream", "run", "n"], "pos", "len").where("applied = 1 AND pos = 0")
    acts = begun.select(*key, F.col("ts_ns").alias("at"), (F.col("op") == "read").alias("is_read"), "skew")
    known = fs.where("a IS NOT NULL")
    return assigned(vers.select(*key, "version", F.col("ts_ns").alias("at"), "is_read"), known, synthesized(acts, known, key), key)


def names(vers: DataFrame) -> DataFrame:
    """``vers`` with ``name``: the path, and @ with the version's number where a file has several."""
    many = F.count(F.lit(1)).over(Window.partitionBy("server", "path")) > 1
    return vers.withColumn("name", F.when(many, F.concat("path", F.lit("@"), F.col("version").cast("string"))).otherwise(F.col("path")))


def fits(options: Options) -> Column:
    """Port 445, or 139 behind the set-up of a session; with ``any_port`` a first frame that holds a message."""
    b = F.col("content")
    port = lambda p: (F.col("first.src_port") == p) | (F.col("first.dst_port") == p)
    message = (F.octet_length(b) > 68) & (number(b, 0, 1) == 0) & (number(b, 0, 4) != 0) & F.hex(F.substring(b, 5, 4)).isin("FE534D42", "FF534D42")
    told = port(445) | port(139)
    return (F.col("file_type") == "tcp") & ((told | ((F.col("offset") == 0) & message)) if options.any_port else told)


@decoder("smbcontrol", fits, whole=lambda o: o.any_port)
def files(runs: DataFrame, options: Options) -> DataFrame:
    """The talk of each connection as text, a line a message."""
    lines = log(messages(runs)).groupBy("stream").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "n", "line"))), lambda x: x["line"]), "\n").alias("text"))
    heads = runs.groupBy("stream").agg(F.min("ts_ns").alias("ts_ns"), F.first("first").alias("first"), F.max("missing_data").alias("missing_data"))
    text = F.encode(F.concat("text", F.lit("\n")), "UTF-8")
    return lines.join(heads, "stream").select(*made(F.col("stream"), F.lit("smbcontrol"), F.lit("SMB.control"), text, properties(protocol=F.lit("smb")), is_metadata=F.lit(True), missing=F.col("missing_data")))
