"""Token ids as Parquet: documents in order of their id, a list of ids a row, written so that a reader can take a part.

Documents are dealt to files by ranges of their id and sorted there, encoded
where they are written, and each row tells how many ids are before it in its
file. Row groups and pages are small, ids have a dictionary (a vocabulary fits
one), ids of documents and counts are delta-coded, and every page has its
least and greatest document in the page index, so a read of a few documents
reads a few pages, and a read of counts reads no ids. Where a document starts
among all ids is its place in its file and the sum of the files before.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .components import running, shared_folder

END_ID = 0
ROW_GROUP, PAGE = 32 << 20, 256 << 10
CACHE = 600_000  # parts of texts held by one Python worker; at that size the cache starts anew

#: The step before the model for which ``ByteWords`` finds units by itself, as a tokenizer file states it.
KNOWN_STEPS = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None}
#: Characters whose classes (white space, letter, digit, other) are known to be those of the tokenizer: ASCII and the letters of Latin-1.
_PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x7eÀ-ÖØ-öø-ÿ]*")
#: Where the tokenizer cuts texts of such characters.
_PARTS = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s")


class ByteWords:
    """Ids of whole texts, the tokenizer's own: those of words are found once and kept."""

    _held: dict[str, ByteWords] = {}

    @classmethod
    def of(cls, path: str) -> ByteWords:
        """The one instance of this process, so that a worker keeps what it has learned from task to task."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        #: Whether the file asks for just the steps that ``ids`` takes by itself; otherwise whole texts go to the tokenizer.
        self.known = all(given.get(k) == v for k, v in KNOWN_STEPS.items())
        #: Tokens that stand for themselves wherever they are in a text; texts with one are left to the tokenizer.
        self.added = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.model = self.whole.model
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printed]
        self.char = {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.ascii = {b: c for b, c in self.char.items() if b < 128}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        printed = part.translate(self.ascii) if part.isascii() else "".join([self.char[b] for b in part.encode()])
        return array("I", [t.id for t in self.model.tokenize(printed)]).tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.known or not _PLAIN.fullmatch(text) or any(t in text for t in self.added):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        parts, known = _PARTS.findall(text), self.parts
        if len(known) >= CACHE:
            known.clear()
        for p in set(parts).difference(known):
            known[p] = self._part(p)
        if len(parts) < 2:
            return b"".join([known[p] for p in parts])
        return b"".join(itemgetter(*parts)(known))


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, part, before, n_tokens, ids[, meta]) of every row, in ascending doc_id order over and within partitions; nulls come first.

    ``part`` is the number of the partition and ``before`` the number of ids
    before the document in it; ``meta`` has the columns that ``metadata``
    names. Rows of one id are told apart by their place in the input, so many
    of them spread over partitions too.
    """
    meta = [F.struct(*[F.col(c) for c in metadata]).alias("meta")] if metadata else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *meta).withColumn("__n", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), F.col("__n")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__n")
    end = np.array([end_id], "<u4").tobytes()
    schema = rows.select("doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("array<int>").alias("ids"), *(["meta"] if metadata else [])).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words, done = TaskContext.get().partitionId(), ByteWords.of(tokenizer), 0
        for b in batches:
            texts = b.column(1)
            at = 0
            while at < len(texts):
                # Batches of ids end after a few million, so that long texts do not add up.
                got, size, first = [], 0, at
                while at < len(texts) and size < 4 << 20:
                    got.append(words.ids(texts[at].as_py() or "") + end)
                    size += len(got[-1]) // 4
                    at += 1
                counts = np.array([len(x) // 4 for x in got], np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(got), "<i4")))
                own = [pa.array(np.full(len(got), part), pa.int32()), pa.array(done + offsets[:-1], pa.int64()), pa.array(counts, pa.int64()), ids]
                done += int(offsets[-1])
                held = b.slice(first, len(got))
                yield pa.RecordBatch.from_arrays([held.column(0), *own, *([held.column(2)] if metadata else [])], names=schema.names)

    return rows.mapInArrow(encode, schema)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, row_group: int = ROW_GROUP, page: int = PAGE, compression: str = "snappy", **columns) -> None:
    """Writes ``encoded`` rows to a folder of Parquet files, one or more a partition.

    A null text counts as empty: the end id alone. Rows that repeat an id are
    rows each, and an empty table is a folder without rows. A text of any
    length is one list. Other columns are left out unless ``metadata`` names
    them, and may have any names.
    """
    rows = encoded(docs, tokenizer, end_id, **columns)
    options = {"parquet.block.size": row_group, "parquet.page.size": page, "parquet.dictionary.page.size": 1 << 20, "parquet.writer.version": "v2", "compression": compression}
    # Sizes are looked at after few rows, so that long documents do not add up in one group or page.
    options |= {"parquet.block.size.row.check.min": 8, "parquet.page.size.row.check.min": 8}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "before", "n_tokens")}
    rows.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read(spark: SparkSession, path: str, *columns: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Columns of the files (all, if none is named) and of documents from ``first`` to ``last``: both reach the scan, so other columns and pages are not read."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.select(*columns) if columns else rows


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): the ids in all files before each part; reads parts and counts alone."""
    sums = read(spark, path, "part", "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return running(sums, [], "part", "n").withColumnRenamed("before", "base")


@F.arrow_udf(LongType())
def crc32(ids: pa.Array) -> pa.Array:
    """The unsigned crc32 of lists of ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False).tobytes())
    at = ids.offsets.to_pylist()
    return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, all of them read from the files."""
    rows = read(spark, path, "doc_id", "part", "before", "ids").select("doc_id", "part", "before", F.size("ids").cast("long").alias("n_tokens"), crc32("ids").alias("ids_crc32"))
    # There are as many parts as partitions wrote, so the table of their starts is small.
    start: Column = F.col("base") + F.col("before")
    return rows.join(F.broadcast(starts(spark, path)), "part").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own for files, in the shared folder that the session names."""
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4()}"
