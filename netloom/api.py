"""The user's side: open captures, list them as a tree by any properties, look at one file, save and load an index."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .decoders import dhcp, dns, ftp, http, keyexchange, smb, ssh, streams, tls, xor  # noqa: F401  decoders register themselves
from .decoders.registry import DECODERS, FIRST, RUN, Decoder, Options, fixpoint, properties
from .functions import times
from .operators import files as fileops
from .operators import clocks, filters, gather, tree
from .operators.sequence import START
from .operators.tables import forget, lasting
from .sources import keys as keysource
from .sources import pcap

FORMAT = 4
PROPERTIES = ["protocol", "srcIP", "dstIP", "srcPort", "dstPort", "domain", "uri", "path", "ja3", "ja3s", "ja4", "ja4s", "ja4h", "ja4x", "hassh", "hasshServer"]
FILE = "stream string, file_type string, name string, ts_ns long, first_packet_no long, start long, size long, is_metadata boolean, parsed boolean, missing_data boolean, content binary, is_read boolean, fs_ns long, hybrid_ns long, last_access long, props map<string,string>"
TIMES = "stream string, kind string, at long, a long, m long, c long, b long, version int"
#: Files of servers: their paths are directories, and they may have several clients and versions.
SERVED = ["smb", "ftp"]
#: The columns of a file beside those of FILE that only decoding needs.
_RUN = [c.split()[0] for c in RUN.split(", ")]
#: Most streams whose ids are sent to all tasks.
SENT = 100_000


class Engine:
    """Captures as virtual files.

    ``files`` is one DataFrame, a row a virtual file, partitioned by nothing;
    ``tree`` and ``ls`` are queries over it. Files of SMB servers are a row a
    version, and one more for the file alone; ``times`` has what is known of
    their times.
    """

    def __init__(self, files: DataFrame, times: DataFrame, sortby: str = "/protocol/", tables: tuple[DataFrame, ...] = ()):
        self.files, self.times, self.sortby, self._tables = files, times, sortby, tables

    def close(self) -> None:
        """Removes the tables that decoding wrote; ``files`` can't be read after that. A saved index stays."""
        forget(*self._tables)
        self._tables = ()

    @staticmethod
    def _ends() -> Column:
        return properties(**{k: F.col("first")[c] for k, c in (("srcIP", "src_ip"), ("dstIP", "dst_ip"), ("srcPort", "src_port"), ("dstPort", "dst_port"))})

    @staticmethod
    def _tcp(runs: DataFrame) -> DataFrame:
        """The runs of streams as RUN rows."""
        fixed = {"file": F.col("stream"), "file_type": F.lit("tcp"), "parent": F.lit(None).cast("string"), "depth": F.lit(0), "name": F.lit("tcp"), "is_metadata": F.lit(False), "first": F.col("first").cast(FIRST)}
        kind = F.coalesce(filters.application(F.lit("tcp"), F.col("first.src_port"), F.col("first.dst_port")), F.lit("tcp"))
        props = F.map_concat(properties(protocol=kind), Engine._ends())
        return runs.withColumns(fixed).withColumns({"props": props, "run": F.col("run").cast("int")}).select(*_RUN)

    @staticmethod
    def _udp(packets: DataFrame) -> DataFrame:
        """The datagrams of sessions as RUN rows, a run a datagram; a session goes from the end that spoke first to the other."""
        s = streams.udp_sessions(packets)
        w = Window.partitionBy("path", "flow", "session")
        order = w.orderBy("ts_ns", "frame_no")
        one = F.struct("path", "frame_no", "ts_ns", "src_ip", "src_port", "dst_ip", "dst_port").cast(FIRST)
        s = s.withColumns({"one": one, "run": (F.row_number().over(order) - 1).cast("int"), "offset": F.coalesce(F.sum(F.octet_length("payload")).over(order.rowsBetween(START, -1)), F.lit(0)).cast("long")})
        s = s.withColumn("opening", F.first("one").over(order))
        fixed = {"file": F.concat_ws("-", "path", "flow", "session"), "file_type": F.lit("udp"), "parent": F.lit(None).cast("string"), "depth": F.lit(0), "name": F.lit("udp"), "is_metadata": F.lit(False), "missing_data": F.lit(False)}
        s = s.withColumns(fixed).withColumns({"stream": F.col("file"), "first": F.col("opening"), "side": (F.col("src_ip") != F.col("opening.src_ip")).cast("int"), "content": F.col("payload")})
        known = filters.application(F.lit("udp"), F.col("first.src_port"), F.col("first.dst_port"))
        s = s.withColumn("props", F.map_concat(properties(protocol=F.coalesce(known, F.lit("udp"))), Engine._ends()))
        return s.withColumn("first", F.col("one")).select(*_RUN)

    @staticmethod
    def _whole(rows: DataFrame, parsed: DataFrame) -> DataFrame:
        """RUN rows as files. Only streams and what keeps their runs are put together; all others are one run."""
        done = parsed.select("file").distinct().withColumn("done", F.lit(True))
        number = F.when(F.col("depth") == 0, F.col("first.frame_no"))
        # Dealt by file once: what was decoded meets all rows before those of a file are put together.
        rows = rows.withColumn("number", number).join(done, "file", "left")
        many = F.col("file_type").isin("tcp", "udp", "xor", "tls") & ~F.col("is_metadata")
        order = F.struct("run", "side")
        together = rows.where(many).groupBy("file", "file_type", "done").agg(
            F.first("stream").alias("stream"), F.first("name").alias("name"), F.min("ts_ns").alias("ts_ns"), F.min_by("number", order).alias("number"), F.min("offset").alias("offset"),
            gather.in_order("content", "run, side").alias("content"), F.max("missing_data").alias("missing_data"), F.first("is_metadata").alias("is_metadata"), F.first("props").alias("props"),
        )
        every = together.unionByName(rows.where(~many).select(*together.columns))
        return every.select(
            "stream", "file_type", "name", "ts_ns", F.col("number").alias("first_packet_no"), F.col("offset").alias("start"), F.octet_length("content").cast("long").alias("size"),
            "is_metadata", F.coalesce("done", F.lit(False)).alias("parsed"), "missing_data", "content", "props",
        )

    @staticmethod
    def _served(base: DataFrame, options: Options) -> tuple[DataFrame, DataFrame, DataFrame, tuple[DataFrame, ...]]:
        """(files, times, parsed, tables): what servers hold, told from all connections together: versions of SMB files with their times, and the data streams of FTP."""
        runs = base.where("file_type = 'tcp'")
        talk = runs.where(smb.fits(options))
        if options.any_port:
            talk = runs.join(talk.select("file").distinct(), "file", "left_semi")
        ex = lasting(smb.exchanges(smb.messages(talk)))
        ops, told = lasting(smb.operations(ex)), lasting(smb.told(ex))
        v = lasting(smb.versions(ops, told))
        stream = F.concat_ws(":", "server", "path")
        times = smb.entries(v, ops, told).select(stream.alias("stream"), "kind", "at", "a", "m", "c", "b", F.col("version").cast("int").alias("version"))
        name, no = F.substring_index("path", "/", -1).alias("name"), F.lit(False)
        props = properties(protocol=F.lit("smb"), dstIP=F.substring_index("server", ":", 1), dstPort=F.substring_index("server", ":", -1), srcIP=F.array_join("client_ips", ","), path=F.col("path"))
        one = v.select(
            stream.alias("stream"), F.lit("smb").alias("file_type"), name, "ts_ns", F.lit(None).cast("long").alias("first_packet_no"), F.col("version").cast("long").alias("start"), F.octet_length("content").cast("long").alias("size"), no.alias("is_metadata"),
            no.alias("parsed"), no.alias("missing_data"), "content", "is_read", F.col("fs_time").alias("fs_ns"), F.col("hybrid_time").alias("hybrid_ns"), "last_access", props.alias("props"),
        )
        known = told.groupBy("server", "path").agg(F.min("at").alias("ts_ns"), F.array_sort(F.collect_set("client_ip")).alias("client_ips"))
        alone = known.select(
            stream.alias("stream"), F.lit("smb").alias("file_type"), name, "ts_ns", F.lit(None).cast("long").alias("first_packet_no"), F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("is_metadata"),
            no.alias("parsed"), no.alias("missing_data"), F.lit(b"").alias("content"), props.alias("props"),
        )
        one = one.unionByName(alone, allowMissingColumns=True)
        heads = runs.groupBy("stream").agg(F.min("ts_ns").alias("ts_ns"), F.sum(F.octet_length("content")).cast("long").alias("size"), F.first("first").alias("first"), F.max("missing_data").alias("missing_data"))
        whole = heads.select("stream", "ts_ns", "size", "first.src_port", "first.dst_port")
        moved = lasting(ftp.data_files(ftp.control(runs), whole))
        # Few streams are sent to all tasks, so that the bytes of the others are not dealt for them.
        named = moved.select("stream").distinct()
        bytes_ = runs.join(F.broadcast(named) if moved.count() <= SENT else named, "stream", "left_semi").groupBy("stream").agg(gather.in_order("content", "run").alias("content"))
        d = moved.drop("size", "ts_ns").join(bytes_, "stream").join(heads, "stream")
        props = F.map_concat(properties(protocol=F.lit("ftp"), path=F.col("path"), command=F.col("verb")), Engine._ends())
        two = d.select(
            "stream", F.lit("ftp").alias("file_type"), F.substring_index("path", "/", -1).alias("name"), "ts_ns", F.lit(None).cast("long").alias("first_packet_no"), F.lit(0).cast("long").alias("start"), F.octet_length("content").cast("long").alias("size"),
            no.alias("is_metadata"), no.alias("parsed"), "missing_data", "content", props.alias("props"),
        )
        return one.unionByName(two, allowMissingColumns=True), times, moved.select(F.col("stream").alias("file")), (ex, ops, told, v, moved)

    @staticmethod
    def open(
        spark: SparkSession, path: str | None = None, captures: DataFrame | None = None, suffix: str = "", rules: dict | None = None, xor_keys: DataFrame | None = None, key_log: DataFrame | None = None, keys: str | list[str] | None = None,
        config: str | None = None, check_non_default_ports: bool = False, decoders: dict[str, Decoder] | None = None, most_rounds: int = 16,
    ) -> Engine:
        """Of a path, or of captures (path, content) that are a DataFrame already.

        ``rules`` are decode rules by decoder, as a configuration has them;
        ``key_log`` (column line) is read beside the secrets that captures carry.
        ``keys`` are key files or folders of such: lines of key logs, XOR keys
        and RSA private keys. ``config`` is the text of a configuration, whose rules, key files
        and order of listing count where the arguments give none. What decoders
        find is offered to all decoders again, up to ``most_rounds`` deep;
        ``decoders`` are used in place of all that are registered. With
        ``check_non_default_ports`` contents tell TLS and SMB, not ports.
        """
        told = keysource.config(config) if config else {"sortby": "/protocol/", "keyfiles": [], "rules": {}}
        rules = rules or told["rules"]
        places = [*([keys] if isinstance(keys, str) else keys or []), *told["keyfiles"]]
        private_keys = None
        if places:
            lines = spark.read.text(places).select(F.col("value").alias("line"))
            key_log = lines if key_log is None else key_log.select("line").unionByName(lines)
            xor_keys = xor_keys if xor_keys is not None else keysource.xor_keys(spark, places)
            private_keys = keyexchange.private_keys(keysource.pem_keys(spark, places))
        source = captures if captures is not None else pcap.captures(spark, path, suffix)
        log = pcap.secrets(source).select("line")
        log = keysource.key_log(log if key_log is None else log.unionByName(key_log.select("line")))
        options = Options(rules or {}, xor_keys, log, private_keys, check_non_default_ports)
        # Read by several jobs, so written once; a lost executor costs no second walk over the captures.
        packets = lasting(pcap.packets(source))
        base = lasting(Engine._tcp(streams.runs(streams.tcp_segments(packets, streams.tasks(packets)))).unionByName(Engine._udp(packets)))
        rows, parsed = fixpoint(base, options, DECODERS if decoders is None else decoders, most_rounds)
        served, times, moved, tables = Engine._served(base, options)
        order = [c.split()[0] for c in FILE.split(", ")]
        files = lasting(served.unionByName(Engine._whole(rows, parsed.unionByName(moved)), allowMissingColumns=True).select(*order))
        times = lasting(times)
        forget(packets, base, *tables)
        return Engine(files, times, told["sortby"], (files, times))

    def visible(self, show_metadata: bool = False, show_all: bool = False, snip: str | tuple[int | None, int | None] = (None, None), snapshot: str | int | None = None, timestamp_mode: str = "hybrid") -> DataFrame:
        """The files that show, with the times that they show (atime_ns, mtime_ns, ctime_ns): metadata and parsed parents on demand.

        ``snip`` is a range of network times (ns, or the option's text ``a,b``).
        Of SMB files all versions show that were begun or accessed there, or
        with ``snapshot`` (seconds since 1970, or yyyy-MM-ddTHH:mm:ssZ) the one
        that was the last at that moment, by the clock that ``timestamp_mode``
        names (network, fs or hybrid), which also tells the times that show.
        By the network's clock a snapshot outside of the time of capture counts
        for nothing. Other files show the time at which they were seen.
        """
        lo, hi = times.snip_ns(snip) if isinstance(snip, str) else snip
        every = self.files.withColumn("shown", F.struct(*[F.col("ts_ns").alias(t) for t in "amc"]))
        at = [None if x is None else F.lit(x) for x in (lo, hi)]
        others = every.where("file_type <> 'smb'").where(filters.visible(F.col("is_metadata"), F.col("parsed"), filters.snip(F.col("ts_ns"), *at), show_metadata, show_all))
        served = every.where("file_type = 'smb'")
        moment = times.moment_ns(snapshot)
        if moment is not None and timestamp_mode == "network":
            seen = served.agg(F.min("ts_ns").alias("first"), F.max(F.greatest("ts_ns", F.coalesce("last_access", "ts_ns"))).alias("last")).first()
            moment = moment if seen["first"] is not None and seen["first"] <= moment <= seen["last"] else None
        versions = served.where("NOT is_metadata").select("stream", F.col("start").cast("int").alias("version"), F.col("ts_ns").alias("at"), "is_read", F.col("fs_ns").alias("fs_time"), F.col("hybrid_ns").alias("hybrid_time"), "last_access")
        rows = clocks.shown(versions, self.times, ["stream"], timestamp_mode, (lo, hi), moment, show_metadata)
        rows = rows.where(F.lit(show_metadata) | ~F.col("is_metadata")).select("stream", F.coalesce("version", F.lit(-1)).cast("long").alias("start"), "is_metadata", F.struct("a", "m", "c").alias("shown"))
        found = served.drop("shown", "is_metadata").join(rows, ["stream", "start"])
        if moment is None:
            many = F.col("start") >= 0
            counts = versions.groupBy("stream").agg((F.count(F.lit(1)) > 1).alias("many"))
            found = found.join(counts, "stream", "left").withColumn("name", F.when(many & F.col("many"), F.concat("name", F.lit("@"), F.col("start").cast("string"))).otherwise(F.col("name"))).drop("many")
        out = others.unionByName(found)
        return out.select("*", *[F.col("shown")[t].alias(f"{t}time_ns") for t in "amc"]).drop("shown")

    def _placed(self, sortby: str | None, show: dict) -> DataFrame:
        """Visible files with ``directory``. A file of several clients is under each of them; ``path`` stands for the directories of a path or URI."""
        keys = [k for k in (self.sortby if sortby is None else sortby).split("/") if k]
        df = self.visible(**show)
        if "srcIP" in keys:
            df = df.withColumn("__client", F.explode_outer(F.split(F.try_element_at("props", F.lit("srcIP")), ",")))
        prop = lambda k: F.nullif(F.try_element_at("props", F.lit(k)), F.lit(""))
        where = F.coalesce(prop("path"), F.regexp_extract(prop("uri"), "^[^? ;]*", 0))
        inner = F.array_join(tree.path_parts(F.regexp_replace(where, "[^/]*$", "")), "/")

        def part(k: str) -> Column:
            if k == "path":
                return F.when(where.isNull(), tree.MISSING).otherwise(F.nullif(inner, F.lit("")))
            return F.coalesce(F.nullif(F.col("__client"), F.lit("")) if k == "srcIP" else prop(k), F.lit(tree.MISSING))

        return df.withColumn("directory", F.concat(F.lit("/"), F.array_join(F.array(*map(part, keys)), "/")) if keys else F.lit("/"))

    def listing(self, sortby: str | None = None, **show) -> DataFrame:
        """(directory, display_name, size, ts_ns, stream, file_type, start, is_metadata): each visible file under its property directories.

        Of files with one name in one directory the first stays, by time, stream and place.
        """
        from .functions.text import display_name

        df = self._placed(sortby, show)
        number = F.when(F.col("file_type").isin("tcp", "udp"), F.col("first_packet_no")).otherwise(F.col("start"))
        suffix = F.when(F.col("is_metadata"), ".meta").otherwise("")
        name = F.when(F.col("file_type").isin(SERVED), F.col("name")).otherwise(display_name(F.col("stream"), number, F.col("missing_data"), F.col("name"), suffix))
        rows = df.select("directory", name.alias("display_name"), "size", F.col("mtime_ns").alias("ts_ns"), "stream", "file_type", "start", "is_metadata")
        return fileops.best(rows, ["directory", "display_name"], F.struct("ts_ns", "stream", "file_type", "start", "is_metadata"))

    def readdir(self, directory: str = "/", sortby: str | None = None, **show) -> DataFrame:
        """(name, is_dir, size, ts_ns) of what lies directly in a directory: directories first, then files, each by name; a directory's size is the number of files directly in it."""
        here = "/" + "/".join(tree_part for tree_part in directory.split("/") if tree_part)
        rows = self.listing(sortby, **show)
        files = rows.where(F.col("directory") == here).select(F.col("display_name").alias("name"), F.lit(False).alias("is_dir"), "size", "ts_ns")
        below = here if here.endswith("/") else here + "/"
        under = rows.where(F.startswith("directory", F.lit(below)) & (F.col("directory") != here)).withColumn("rest", F.substr("directory", F.lit(len(below) + 1)))
        subdirs = under.groupBy(F.substring_index("rest", "/", 1).alias("name")).agg(F.count_if(~F.contains("rest", F.lit("/"))).alias("size"), F.max("ts_ns").alias("ts_ns"))
        return subdirs.select("name", F.lit(True).alias("is_dir"), "size", "ts_ns").unionByName(files).orderBy(F.desc("is_dir"), "name")

    def getattr(self, path: str, sortby: str | None = None, **show) -> dict | None:
        """What a path is: is_dir, size (of a directory the files directly in it), blocks of 512 bytes, ts_ns; None if there is no such path."""
        here = "/" + "/".join(x for x in path.split("/") if x)
        parent, _, name = here.rpartition("/")
        rows = self.listing(sortby, **show)
        file = rows.where((F.col("directory") == (parent or "/")) & (F.col("display_name") == name)).select("size", fileops.blocks(F.col("size")).alias("blocks"), "ts_ns").first()
        if file:
            return {"is_dir": False, **file.asDict()}
        inside = rows.where((F.col("directory") == here) | F.startswith("directory", F.lit(here.rstrip("/") + "/")))
        found = inside.agg(F.count_if(F.col("directory") == here).alias("size"), F.max("ts_ns").alias("ts_ns"), F.count(F.lit(1)).alias("all")).first()
        return {"is_dir": True, "size": found["size"], "blocks": 0, "ts_ns": found.ts_ns} if found["all"] or here == "/" else None

    def tree(self, sortby: str | None = None, **show) -> DataFrame:
        """Every directory at every depth: files below it, and the greatest and least of their times."""
        keys = [k for k in (self.sortby if sortby is None else sortby).split("/") if k]
        df = self.visible(**show).select("atime_ns", "mtime_ns", "ctime_ns", "file_type", *[F.try_element_at("props", F.lit(k)).alias(k) for k in keys])
        # Of files as they were seen a directory changed with the first; of files of servers each time is the greatest.
        changed = F.greatest(F.min(F.when(F.col("file_type") != "smb", F.col("ctime_ns"))), F.max(F.when(F.col("file_type") == "smb", F.col("ctime_ns"))))
        return tree.levels(df, keys, {"files": F.count(F.lit(1)), "accessed_ns": F.max("atime_ns"), "modified_ns": F.max("mtime_ns"), "changed_ns": changed})

    def ls(self, directory: str, sortby: str | None = None, offset: int = 0, limit: int | None = None, **show) -> DataFrame:
        """One directory's files, by name; with ``limit`` a page of so many."""
        return tree.page(self.listing(sortby, **show).where(F.col("directory") == directory), ["display_name"], offset, limit)

    def cat(self, stream: str, file_type: str, start: int = 0, offset: int = 0, length: int | None = None) -> bytes | None:
        """The bytes of one file, from an offset on, all or ``length`` of them; None if there is no such file."""
        at = self.files.where((F.col("stream") == stream) & (F.col("file_type") == file_type) & (F.col("start") == start) & ~F.col("is_metadata"))
        row = at.select(F.substring("content", offset + 1, (1 << 31) - 1 if length is None else length).alias("b")).first()
        return None if row is None else bytes(row.b)

    def save(self, path: str) -> None:
        """Writes the index: the files by type, and what the index is."""
        self.files.write.mode("overwrite").partitionBy("file_type").parquet(f"{path}/files")
        self.times.write.mode("overwrite").parquet(f"{path}/times")
        spark = self.files.sparkSession
        spark.createDataFrame([(json.dumps({"format": FORMAT, "sortby": self.sortby}),)], "value string").write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Engine:
        """Of a saved index; one of another format is an error."""
        meta = json.loads(spark.read.text(f"{path}/meta").first().value)
        if meta.get("format") != FORMAT:
            raise ValueError(f"index format {meta.get('format')}, not {FORMAT}")
        return Engine(spark.read.schema(FILE).parquet(f"{path}/files"), spark.read.schema(TIMES).parquet(f"{path}/times"), meta.get("sortby", "/protocol/"))

    @staticmethod
    def same_captures(stored: DataFrame, given: DataFrame) -> bool:
        """Whether every stored capture (path, length) is among those given, by base name and size."""
        name = lambda df: df.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").cast("long").alias("length"))
        return name(stored).join(name(given), ["name", "length"], "left_anti").isEmpty()
