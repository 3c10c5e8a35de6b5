"""Captures of any size, read in byte ranges by many tasks, and bytes of captures by place.

A range begins anywhere, so its first record is looked for: a place from which
a chain of headers makes sense. That may be deceived, by a capture inside a
capture for one, so ranges are held against each other: a file's first range is
known to be right, and where one range's last record ends the next must have
found its first. Those that have not walk again from the right place, until
all fit. Packets are numbered by sums over ranges.

Files are opened by ``pyarrow.fs``, for any store that it knows.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import forget, lasting, running
from .pcap import ENHANCED, FRAMES, INTERFACE, PCAP_MICRO, PCAP_NANO, PCAPNG, SECRETS, SIMPLE, Resolution

#: Headers in a row that must make sense where a record is looked for, and the longest record that does.
CHAIN, LONGEST = 12, 1 << 20
#: Kinds of blocks of the second format.
BLOCKS = {INTERFACE, 2, SIMPLE, 4, 5, ENHANCED, 9, SECRETS, 0x0BAD, 0x40000BAD, 0x0A0D0D0A}

RANGES = "path string, start long, end long, size long"


def ranges(spark: SparkSession, path: str, suffix: str = "", size: int = 128 << 20) -> DataFrame:
    """(path, start, end, size): the files of a path cut every ``size`` bytes; an empty file gives none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path", F.col("length").alias("size"))
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / size)))
    start = F.col("nth") * size
    return files.where("size > 0").select("path", "size", nth.alias("nth")).select("path", start.alias("start"), F.least(start + size, F.col("size")).alias("end"), "size")


class Reader:
    """A file seen through one buffer that moves forward: reads near each other are one read of the store."""

    def __init__(self, path: str, size: int, ahead: int = 4 << 20):
        store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.file, self.size, self.ahead, self.at, self.data = store.open_input_file(name), size, ahead, 0, b""

    def read(self, at: int, n: int) -> bytes:
        """The bytes at a place, fewer at the end of the file."""
        if at < self.at or at + n > self.at + len(self.data):
            self.at = at
            self.data = self.file.read_at(max(0, min(max(n, self.ahead), self.size - at)), at) if at < self.size else b""
        return self.data[at - self.at : at - self.at + n]

    def close(self) -> None:
        self.file.close()


Step = Callable[[int], int | None]


def _first_format(w: Reader) -> tuple[Step, Step]:
    """For the first format: the place behind the record at a place, or None where there can be none; and the same where only a record that makes sense will do."""
    head = w.read(0, 24)
    unit = 1_000_000 if head[:4] == PCAP_MICRO else 1_000_000_000
    most = min(struct.unpack_from("<I", head, 16)[0] or LONGEST, LONGEST) if len(head) == 24 else LONGEST

    def step(at: int, strict: bool = False) -> int | None:
        h = w.read(at, 16)
        if len(h) < 16:
            return None
        _, sub, held, full = struct.unpack("<IIII", h)
        sane = not strict or (sub < unit and 0 < held <= max(most, 1) and held <= full <= LONGEST)
        return at + 16 + held if sane and at + 16 + held <= w.size else None

    return step, lambda at: step(at, True)


def _second_format(w: Reader) -> tuple[Step, Step]:
    def step(at: int, strict: bool = False) -> int | None:
        h = w.read(at, 8)
        if len(h) < 8:
            return None
        kind, n = struct.unpack("<II", h)
        if n < 12 or n % 4 or at + n > w.size or (strict and (kind not in BLOCKS or n > LONGEST + 64 or w.read(at + n - 4, 4) != h[4:])):
            return None
        return at + n

    return step, lambda at: step(at, True)


def _walker(w: Reader) -> tuple[Step, Step, int] | None:
    """How to step from record to record, how where it is not known that there is one, and where the first is; None for formats that are not known."""
    magic = w.read(0, 4)
    if magic in (PCAP_MICRO, PCAP_NANO):
        return *_first_format(w), 24
    return (*_second_format(w), 0) if magic == PCAPNG else None


def _found(step: Step, start: int, end: int, size: int) -> int | None:
    """The first place of a range from which a chain of records makes sense, to its end or that of the file."""
    for at in range(start, end):
        here: int | None = at
        for _ in range(CHAIN):
            here = step(here)
            if here is None or here == size:
                break
        if here is not None:
            return at
    return None


def _places(rows: DataFrame) -> DataFrame:
    """``rows`` (path, start, end, size, given) with ``first``, where the range's first record is, ``behind``, where the next range's is (null where the file's walk ends), ``stop``, the place behind the last record here, and how many packets there are."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, start, end, size, given in zip(*[c.to_pylist() for c in b.columns], strict=True):
                w = Reader(path, size)
                found = _walker(w)
                first = behind = stop = None
                n = 0
                if found:
                    step, strict, begin = found
                    first = given if given is not None else begin if start == 0 else _found(strict, start, end, size)
                    behind = stop = first
                    while behind is not None and behind < end:
                        behind = step(behind)
                        if behind is not None:  # else no record can be here, and the file's walk ends
                            n += _is_packet(w, stop, begin)
                            stop = behind
                w.close()
                out.append((path, start, end, size, first, behind, stop, n))
            kinds = [pa.string(), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["path", "start", "end", "size", "first", "behind", "stop", "packets"])

    tasks = rows.select("path", "start", "end", "size", F.col("given").cast("long").alias("given"))
    return tasks.mapInArrow(walk, RANGES + ", first long, behind long, stop long, packets long")


def _is_packet(w: Reader, at: int, begin: int) -> int:
    return 1 if begin else int(struct.unpack("<I", w.read(at, 4))[0] in (ENHANCED, SIMPLE))


def placed(cuts: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``cuts`` (path, start, end, size) with first, behind, stop and packets, all held against each other. Lasting.

    Where no next record exists (the walk ended, or one record reaches beyond
    the range) later ranges of the file have no first record, or begin behind
    that record.
    """
    now = lasting(_places(cuts.withColumn("given", F.lit(None))))
    for _ in range(most_rounds):
        w = Window.partitionBy("path").orderBy("start")
        # Where the walk of the range before ended; past an empty range that is what was handed to it.
        told = now.withColumns({"want": F.lag("behind").over(w), "n": F.row_number().over(w)})
        wrong = told.where("n > 1 AND NOT (want <=> first) AND NOT (want IS NULL AND first IS NULL)")
        if wrong.isEmpty():
            return now
        # The first wrong range of each file is surely wrong; those behind it are looked at again after it.
        at = wrong.groupBy("path").agg(F.min("start").alias("bad"))
        again = told.join(at, "path").where("start = bad")
        ended = again.where("want IS NULL").select("path", "bad")
        fixed = _places(again.where("want IS NOT NULL").select("path", "start", "end", "size", F.col("want").alias("given")))
        rest = now.join(at, "path", "left").where("bad IS NULL OR start <> bad").drop("bad")
        dead = now.join(ended, "path").where("start >= bad").select("path", "start", "end", "size", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("behind"), F.lit(None).cast("long").alias("stop"), F.lit(0).cast("long").alias("packets"))
        kept = rest.join(dead.select("path", "start"), ["path", "start"], "left_anti")
        after = lasting(kept.select(*now.columns).unionByName(fixed).unionByName(dead))
        forget(now)
        now = after
    raise RuntimeError("ranges of a capture do not fit together")


def frames(spark: SparkSession, path: str, suffix: str = "", size: int = 128 << 20) -> DataFrame:
    """(path, frame_no, ts_ns, at, frame), as ``pcap.frames`` gives them, of captures of any size: a task reads a range of ``size`` bytes."""
    told = placed(ranges(spark, path, suffix, size))
    count = told.where("packets > 0").select("path", F.floor(F.col("start") / size).alias("k"), "start", "first", "stop", "packets", F.col("size").alias("whole"))
    count = count.join(running(count, ["path"], "k", "packets"), ["path", "k"]).select("path", "first", "stop", "whole", F.col("before").cast("long").alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["path", "frame_no", "ts_ns", "at", "frame"]
        for b in batches:
            for name, first, stop, whole, before in zip(*[c.to_pylist() for c in b.columns], strict=True):
                w = Reader(name, whole)
                out, held = [], 0
                for k, row in enumerate(_packets(w, first, stop)):
                    out.append((name, before + k, *row))
                    held += len(row[2])
                    if len(out) == 2000 or held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, held = [], 0
                w.close()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return count.mapInArrow(read, FRAMES)


def _packets(w: Reader, at: int, behind: int) -> Iterator[tuple[int, int, bytes]]:
    """(time in ns, place, frame) of the packets between two places."""
    step, _, begin = _walker(w)  # type: ignore[misc]
    if begin:
        unit = 1000 if w.read(0, 4) == PCAP_MICRO else 1
        while at < behind:
            sec, sub, n, _ = struct.unpack("<IIII", w.read(at, 16))
            yield sec * 1_000_000_000 + sub * unit, at + 16, w.read(at + 16, n)
            at += 16 + n
        return
    # Interfaces are told before the packets of a section; those of the first section count for ranges behind it.
    known = Resolution()
    here = 0
    while here < at and (after := step(here)) is not None:
        kind = struct.unpack("<I", w.read(here, 4))[0]
        if kind in (ENHANCED, SIMPLE):
            break
        known.see(kind, w.read(here, after - here))
        here = after
    while at < behind:
        block = w.read(at, struct.unpack("<I", w.read(at + 4, 4))[0])
        kind = struct.unpack_from("<I", block)[0]
        known.see(kind, block)
        if kind == ENHANCED and len(block) >= 32:
            interface, high, low, held = struct.unpack_from("<IIII", block, 8)
            yield known.ns(interface, (high << 32) | low), at + 28, block[28 : 28 + held]
        elif kind == SIMPLE and len(block) >= 16:
            yield 0, at + 12, block[12 : 12 + min(struct.unpack_from("<I", block, 8)[0], len(block) - 16)]
        at += len(block)


def bytes_at(places: DataFrame, path: str = "path", at: str = "at", length: str = "length", name: str = "content") -> DataFrame:
    """``places`` with ``name``: the bytes of a capture at a place, fewer where it ends; null for nulls and negative numbers.

    Places are dealt by file and stretch, and read in order there, so that those near each other are one read.
    """
    cols = places.columns
    i = [cols.index(c) for c in (path, at, length)]
    rows = places.repartition(F.col(path), F.floor(F.col(at) / (64 << 20))).sortWithinPartitions(path, at)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple[str, Reader] | None = None
        for b in batches:
            out = []
            for p, a, n in zip(*[b.column(k).to_pylist() for k in i], strict=True):
                if None in (p, a, n) or a < 0 or n < 0:
                    out.append(None)
                    continue
                if open_ is None or open_[0] != p:
                    if open_:
                        open_[1].close()
                    store, f = fs.FileSystem.from_uri(p) if "://" in p or p.startswith("file:") else (fs.LocalFileSystem(), p)
                    open_ = (p, Reader(p, store.get_file_info(f).size))
                out.append(open_[1].read(a, n))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*cols, name])

    return rows.mapInArrow(read, places.select("*", F.lit(None).cast("binary").alias(name)).schema)
