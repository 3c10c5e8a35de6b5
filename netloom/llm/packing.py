"""Best-fit packing of token pieces into sequences.

Texts are tokenised where they are read. Words repeat, so ids are found once
for each distinct word of a block and looked up after that; the ids are those
that the tokenizer gives for the whole text. Only the pieces' measures travel
to the packing tasks (their ids too, where asked for).

A packing task is bounded-space online best-fit: a fixed number of sequences is
open at a time; a piece goes to the open sequence that it leaves the least room
in, or to a new one; when too many are open, the fullest closes first. Which
amounts of room exist among the open sequences is one bitset, so the best fit
is its lowest set bit at or above the piece's length. Tasks get about
``task_tokens`` tokens each, in an order fixed by the pieces themselves, so a
task that runs again packs alike.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE, OPEN, END_ID = 4096, 512, 1
TASK_TOKENS = 16_000_000
CACHE = 300_000  # words and parts held by one Python worker; at that size the cache starts anew

#: The steps before the model that ``Words.ids`` takes by itself, as a tokenizer file states them.
KNOWN_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Characters for which the two steps above the model (composing and lower-casing) and the classes of
#: letters and digits are known to be those of the tokenizer: ASCII and the letters of Latin-1.
_PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x7eÀ-ÖØ-öø-ÿ]*")


def _asks_for_known_steps(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    return all(given.get(k) == v for k, v in KNOWN_STEPS.items())


class Words:
    """Token ids of whole texts, the tokenizer's own; fast for one that never joins characters across white space (KNOWN_STEPS)."""

    _held: dict[str, Words] = {}

    @classmethod
    def of(cls, path: str) -> Words:
        """The one instance of this process, so that a worker keeps what it has learned from task to task."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        #: Whether the file asks for just the steps that ``ids`` takes by itself; otherwise whole texts go to the tokenizer.
        self.known = _asks_for_known_steps(path)
        self.model = self.whole.model
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printed]
        self.char = {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(rest)}
        #: Tokens that stand for themselves wherever they are in a text; texts with one are left to the tokenizer.
        self.added = tuple(t.content.lower() for t in self.whole.get_added_tokens_decoder().values())
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            text = part if part.isascii() and part.isprintable() else "".join([self.char[b] for b in part.encode()])
            got = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
            if len(self.parts) >= CACHE:
                self.parts.clear()
            self.parts[part] = got
        return got

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        plain = _PLAIN.fullmatch(text)
        if not plain:
            text = unicodedata.normalize("NFC", text)
            plain = _PLAIN.fullmatch(text)
        small = text.lower()
        if not self.known or not plain or any(t in small for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = small.split()
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = b"".join([self._part(p) for p in _PARTS.findall(w)])
            out = b"".join([known[w] for w in words])
            if len(known) >= CACHE:
                known.clear()
            return out


@dataclass(frozen=True)
class Tokenized:
    """How texts become ids: the vocabulary file, and the id put behind each document."""

    path: str
    end_id: int = END_ID


def pieces(docs: DataFrame, how: Tokenized, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]) for every piece of every row.

    A null text counts as empty: one piece, the end id alone. Rows that repeat
    an id each give their own pieces. Other columns are ignored. Texts of more
    than ``size`` ids are cut every ``size`` ids; the last piece may be shorter.
    """
    end = np.array([how.end_id], "<u4").tobytes()
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    kinds = "piece:int,start:long,length:long,ids_crc32:long"
    if with_ids:
        fields, kinds = [*fields, ("ids", pa.binary())], kinds + ",ids:binary"

    @F.arrow_udf(f"array<struct<{kinds}>>")
    def cut(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words.of(how.path)
        for column in parts:
            offsets, rows = [0], []
            for x in column:
                ids = words.ids(x.as_py() or "") + end
                for k in range(0, len(ids), 4 * size):
                    part = ids[k : k + 4 * size]
                    rows.append((k // (4 * size), k // 4, len(part) // 4, zlib.crc32(part), part))
                offsets.append(len(rows))
            arrays = [pa.array([r[n] for r in rows], kind) for n, (_, kind) in enumerate(fields)]
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, [n for n, _ in fields]))

    each = docs.select(F.col(id_col), F.explode(cut(F.col(text_col))).alias("p"))
    return each.select(id_col, "p.*")


class BestFit:
    """Open sequences by the room that they have left."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bits = 0  # bit r is set if a sequence with room r is open
        self.by_room: dict[int, list[int]] = {}
        self.count = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """The sequence for a piece of ``length`` and its offset there."""
        length = max(0, length or 0)
        if length > self.size:
            self.made += 1
            return self.made - 1, 0
        above = self.bits >> length
        if above:
            room = length + (above & -above).bit_length() - 1
            at = self._take(room)
        else:
            if self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
                self.count -= 1
            room, at = self.size, self.made
            self.made += 1
            self.count += 1
        left = room - length
        if left:
            self.by_room.setdefault(left, []).append(at)
            self.bits |= 1 << left
        else:
            self.count -= 1
        return at, self.size - room

    def _take(self, room: int) -> int:
        held = self.by_room[room]
        at = held.pop()
        if not held:
            self.bits &= ~(1 << room)
        return at


def best_fit(measured: DataFrame, size: int = SEQUENCE, open_bins: int = OPEN, task_tokens: int = TASK_TOKENS, length_col: str = "length") -> DataFrame:
    """``measured`` with sequence_id (unique, any numbers) and offset (place in the sequence, gapless from 0).

    ``measured`` is read twice: for the sum of lengths, and to deal its rows to tasks by a
    hash of the whole row, so that neither repeated ids nor a hot source gather
    in one. An empty table gives an empty table. A null or negative length
    counts as 0; a piece longer than ``size`` has a sequence of its own.
    """
    total = measured.agg(F.coalesce(F.sum(length_col), F.lit(0))).first()[0]
    tasks = max(1, -(-int(total) // task_tokens))
    order = F.xxhash64(*measured.columns)
    at = measured.columns.index(length_col)
    schema = measured.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bins = BestFit(size, open_bins)
        for b in batches:
            placed = [bins.put(n) for n in b.column(at).to_pylist()]
            more = [pa.array([base + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=schema.names)

    dealt = measured.withColumn("__o", order).repartition(tasks, "__o").sortWithinPartitions("__o", *measured.columns).drop("__o")
    return dealt.mapInArrow(pack, schema)


def pack(docs: DataFrame, how: Tokenized, size: int = SEQUENCE, open_bins: int = OPEN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs``, each with its sequence and its offset there."""
    from .components import lasting

    return best_fit(lasting(pieces(docs, how, size, id_col, text_col, with_ids)), size, open_bins)
