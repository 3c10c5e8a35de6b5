"""Media columns: ISO base media files in a binary column, and what a walk of their boxes tells.

``wrap`` stores a payload losslessly as an uncompressed 8-bit mono sound track:
samples of one byte, in chunks of 64 bytes, with every 64th chunk's first
sample marked as a sync sample. ``probe`` walks the nested boxes of any such
file, decodes the sample tables (sizes, chunk offsets, samples a chunk,
durations, sync samples, and those of movie fragments) and gives codec, duration
and the byte ranges of the keyframes. It never reads inside the payload, only
its place. Durations are those of the media; edit lists and composition times
change neither bytes nor keyframes and are not applied.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
RATE = 8000
SYNC = 64  # blocks from one sync sample to the next

#: The boxes that hold boxes.
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def wrap_bytes(payload: bytes) -> bytes:
    """A file with one 'raw ' track whose samples are the payload's bytes; its length is a multiple of BLOCK."""
    n = len(payload)
    chunks = n // BLOCK
    sync = (np.arange(0, chunks, SYNC) * BLOCK + 1).astype(">u4")
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp42")

    def movie(first: int) -> bytes:
        offsets = (np.arange(chunks, dtype=np.uint64) * BLOCK + np.uint64(first)).astype(">u8").tobytes()
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">3I", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
            _full(b"stsc", struct.pack(">4I", 1, 1, BLOCK, 1)),
            _full(b"stsz", struct.pack(">2I", 1, n)),
            _full(b"co64", struct.pack(">I", chunks), offsets),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">4I2H", 0, 0, RATE, n, 0x55C4, 0)),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"sound\0"),
            _box(b"minf", _full(b"smhd", struct.pack(">2H", 0, 0)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _full(b"tkhd", struct.pack(">5I8x4H", 0, 0, 1, 0, n, 0, 0, 0x100, 0), MATRIX, struct.pack(">2I", 0, 0), flags=7)
        return _box(b"moov", _full(b"mvhd", struct.pack(">4IIH10x", 0, 0, RATE, n, 0x10000, 0x100), MATRIX, b"\0" * 24, struct.pack(">I", 2)), _box(b"trak", track, media))

    size = len(movie(0))
    return head + movie(len(head) + size + 16) + struct.pack(">I4sQ", 1, b"mdat", 16 + n) + payload


@dataclass
class Track:
    """What the boxes of one track say: samples have an offset and a size each, in decoding order."""

    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray

    def ranges(self) -> list[tuple[int, int]]:
        """The byte ranges (start, end) of the keyframes."""
        at = self.offsets[self.keys]
        return list(zip(at.tolist(), (at + self.sizes[self.keys]).tolist(), strict=True))


def boxes(data) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end) of the content of every box, parents before what they hold, to any depth; leaves a box where sizes don't fit."""
    open_ = [((), 0, len(data))]
    while open_:
        path, lo, hi = open_.pop()
        if lo + 8 > hi:
            continue
        size, kind = struct.unpack_from(">I4s", data, lo)
        start = lo + 8
        if size == 1 and lo + 16 <= hi:
            size, start = struct.unpack_from(">Q", data, lo + 8)[0], lo + 16
        end = hi if size == 0 else lo + size
        if end > hi or end < start:
            continue
        # Only the last few names matter, and a path of any depth must not grow.
        here = (*path[-7:], kind)
        yield here, start, end
        open_.append((path, end, hi))
        if kind in PARENTS:
            open_.append((here, start, end))


def _table(data, at: int, dtype: str, columns: int = 1, skip: int = 4) -> np.ndarray:
    n = struct.unpack_from(">I", data, at + skip)[0]
    return np.frombuffer(data, dtype, n * columns, at + skip + 4).astype(np.int64).reshape(-1, columns)


def _samples(data, t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(offsets, sizes, keys, ticks) of the sample tables of a track."""
    fixed, count = struct.unpack_from(">2I", data, t[b"stsz"] + 4)
    if fixed * count > len(data):
        raise ValueError("more samples than bytes")
    sizes = np.full(count, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", count, t[b"stsz"] + 12).astype(np.int64)
    chunk = (_table(data, t[b"co64"], ">u8") if b"co64" in t else _table(data, t[b"stco"], ">u4"))[:, 0]
    runs = _table(data, t[b"stsc"], ">u4", 3)
    each = np.zeros(len(chunk), np.int64)
    for (first, per, _), last in zip(runs.tolist(), [*(runs[1:, 0] - 1).tolist(), len(chunk)], strict=False):
        each[first - 1 : last] = per
    until = np.cumsum(each)
    if count > (until[-1] if len(until) else 0):
        raise ValueError("samples without a chunk")
    of_chunk = np.searchsorted(until, np.arange(count), side="right")
    before = np.cumsum(sizes) - sizes
    offsets = chunk[of_chunk] + before - before[(until - each)[of_chunk]]
    keys = _table(data, t[b"stss"], ">u4")[:, 0] - 1 if b"stss" in t else np.arange(count)
    if len(keys) and (keys.min() < 0 or keys.max() >= count):
        raise ValueError("a keyframe that is no sample")
    ticks = _table(data, t[b"stts"], ">u4", 2)
    return offsets, sizes, keys, int((ticks[:, 0] * ticks[:, 1]).sum())


def _fragment(data, moof: int, header: int, run: int, defaults: tuple[int, int, int], at: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(offsets, sizes, keys, ticks, end) of one run (trun) of a fragment; ``at`` is where the run before it ended."""
    flags, _ = struct.unpack_from(">II", data, header)
    place, base = header + 8, moof
    if flags & 0x1:
        base, place = struct.unpack_from(">Q", data, place)[0], place + 8
    place += 4 if flags & 0x2 else 0
    known = list(defaults)
    for k, bit in enumerate((0x8, 0x10, 0x20)):
        if flags & bit:
            known[k], place = struct.unpack_from(">I", data, place)[0], place + 4
    how, count = struct.unpack_from(">II", data, run)
    place = run + 8
    if how & 0x1:
        at, place = base + struct.unpack_from(">i", data, place)[0], place + 4
    elif at is None:
        at = base
    first = None
    if how & 0x4:
        first, place = struct.unpack_from(">I", data, place)[0], place + 4
    given = [bit for bit in (0x100, 0x200, 0x400, 0x800) if how & bit]
    if not given and count > len(data):
        raise ValueError("more samples than bytes")
    rows = np.frombuffer(data, ">u4", count * len(given), place).astype(np.int64).reshape(count, len(given))
    column = lambda bit, default: rows[:, given.index(bit)] if bit in given else np.full(count, default, np.int64)
    duration, sizes, marks = (column(bit, d) for bit, d in zip((0x100, 0x200, 0x400), known, strict=True))
    marks = marks.copy()
    if first is not None and count:
        marks[0] = first
    offsets = at + np.cumsum(sizes) - sizes
    return offsets, sizes, np.flatnonzero(marks & 0x10000 == 0), int(duration.sum()), int(at + sizes.sum())


def tracks(data) -> list[Track]:
    """The tracks of a file. Tables that are missing, cut short or at odds with the file leave a track out."""
    found: list[dict] = []
    runs: list[tuple[int, int, int]] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    moof = header = None
    for path, start, end in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({})
        elif found and b"trak" in path:
            found[-1].setdefault(kind, start)
        elif kind == b"moof":
            moof = start - 8
        elif kind == b"tfhd":
            header = start
        elif kind == b"trun" and moof is not None and header is not None and start + 8 <= end:
            runs.append((moof, header, start))
        elif kind == b"trex" and start + 24 <= end:
            track, _, *known = struct.unpack_from(">5I", data, start + 4)
            defaults[track] = tuple(known)
    out = []
    for t in found:
        try:
            at = t[b"mdhd"]
            scale, duration = struct.unpack_from(">IQ" if data[at] else ">II", data, at + (20 if data[at] else 12))
            number = struct.unpack_from(">I", data, t[b"tkhd"] + (20 if data[t[b"tkhd"]] else 12))[0]
            codec = bytes(data[t[b"stsd"] + 12 : t[b"stsd"] + 16]).decode("latin-1").strip()
            parts, after, last = [_samples(data, t)], None, None
            for moof, header, run in runs:
                if struct.unpack_from(">I", data, header + 4)[0] != number:
                    continue
                *part, after = _fragment(data, moof, header, run, defaults.get(number, (0, 0, 0)), after if last == header else None)
                parts.append(tuple(part))
                last = header
            counts = np.cumsum([0, *(len(p[1]) for p in parts)])
            offsets, sizes = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            if len(offsets) and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
                raise ValueError("a sample outside of the file")
            keys = np.concatenate([p[2] + n for p, n in zip(parts, counts, strict=False)]).astype(np.int64)
            out.append(Track(codec, scale, sum(p[3] for p in parts) or duration, offsets, sizes, keys))
        except (KeyError, struct.error, ValueError, IndexError, OverflowError):
            continue
    return out


def payload(data, track: Track) -> bytes:
    """The samples of a track, one behind the other. Samples of neighbouring places are read as one."""
    joins = np.flatnonzero(track.offsets[1:] != track.offsets[:-1] + track.sizes[:-1]) + 1
    firsts, lasts = np.concatenate([[0], joins]), np.concatenate([joins - 1, [len(track.offsets) - 1]])
    if not len(track.offsets):
        return b""
    return b"".join(bytes(data[s:e]) for s, e in zip(track.offsets[firsts].tolist(), (track.offsets[lasts] + track.sizes[lasts]).tolist(), strict=True))


def wrap(text):
    """Column: the media file of a text's UTF-8 bytes, with bytes 0 behind them up to a positive multiple of BLOCK. Null: as empty."""

    @F.arrow_udf("binary")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            rows = []
            for x in column:
                b = x.as_buffer()
                b = b.to_pybytes() if b is not None else b""
                rows.append(wrap_bytes(b + b"\0" * (-len(b) % BLOCK or (0 if b else BLOCK))))
            yield pa.array(rows, pa.binary())

    return of(F.col(text) if isinstance(text, str) else text)


TRACK = "struct<codec:string,duration_ms:long,samples:long,keyframes:array<struct<start:long,end:long>>>"


def _told(track: Track) -> dict:
    return {
        "codec": track.codec,
        "duration_ms": track.duration * 1000 // max(1, track.timescale),
        "samples": len(track.sizes),
        "keyframes": [{"start": s, "end": e} for s, e in track.ranges()],
    }


def probe(media):
    """Column: codec, duration, samples and keyframe byte ranges of the first track. Null, and files without one: null."""
    kind = pa.struct([("codec", pa.string()), ("duration_ms", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    @F.arrow_udf(TRACK)
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            rows = []
            for x in column:
                t = tracks(x.as_buffer().to_pybytes()) if x.is_valid else []
                rows.append(_told(t[0]) if t else None)
            yield pa.array(rows, kind)

    return of(F.col(media) if isinstance(media, str) else media)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, media, track) for every row of ``docs``; repeated and null ids stay, other columns are ignored."""
    made = docs.select(F.col(id_col), wrap(text_col).alias("media"))
    return made.withColumn("track", probe("media"))


DIGEST = "struct<payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string>"


def read_back(media):
    """Column: digests of a stored file and of the payload that its sample tables lead to, and its first track's features as text.

    Null, and files without a track: null.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    @F.arrow_udf(DIGEST)
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            rows = []
            for x in column:
                data = x.as_buffer().to_pybytes() if x.is_valid else b""
                track = next(iter(tracks(data)), None)
                if track is None:
                    rows.append(None)
                    continue
                own = payload(memoryview(data), track)
                told = _told(track)
                keys = ",".join(f"{k['start']}-{k['end']}" for k in told["keyframes"])
                feature = f"codec={told['codec']};ms={told['duration_ms']};samples={told['samples']};keys={keys}"
                rows.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            yield pa.StructArray.from_arrays([pa.array([r and r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names, mask=pa.array([r is None for r in rows], pa.bool_()))

    return of(F.col(media) if isinstance(media, str) else media)
