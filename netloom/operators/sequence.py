"""Ordered-sequence operators: breaks, runs, carried state, sessions, versions.

Windows are partitioned by the caller's key. ``anchored_sessions`` and
``append_versions`` fold in order; they run as grouped state over sorted Arrow
batches, so a key of any length passes through in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = Window.unboundedPreceding


def direction_breaks(df: DataFrame, key: list[str], order: list[str], side: str, length: str) -> DataFrame:
    """The rows at which the talking side changes, with the byte offset there: (key, order, side, offset)."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.coalesce(F.sum(length).over(w.rowsBetween(START, -1)), F.lit(0)).cast("long")
    changed = ~F.col(side).eqNullSafe(F.lag(side).over(w)) | (F.row_number().over(w) == 1)
    return df.withColumns({"offset": before, "__c": changed}).where("__c").select(*key, *order, side, "offset")


def message_runs(breaks: DataFrame, key: list[str], total: DataFrame) -> DataFrame:
    """Each break with its run number and length; the last run ends where the stream does. ``total``: (key, size)."""
    w = Window.partitionBy(*key).orderBy("offset")
    return (
        breaks.join(total, key)
        .withColumns({"run": F.row_number().over(w) - 1, "length": F.coalesce(F.lead("offset").over(w), F.col("size")) - F.col("offset")})
        .drop("size")
    )


def carry_last(df: DataFrame, key: list[str], order: list[str], what: Column, name: str, inclusive: bool = False) -> DataFrame:
    """``name``: the latest value of ``what`` that is not null, in the rows before (or up to) each row."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(START, 0 if inclusive else -1)
    return df.withColumn(name, F.last(what, ignorenulls=True).over(w))


def running_offset(df: DataFrame, key: list[str], order: list[str], length: Column, name: str = "offset") -> DataFrame:
    """``name``: the sum of ``length`` over the rows before."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(START, -1)
    return df.withColumn(name, F.coalesce(F.sum(length).over(w), F.lit(0).cast("long")))


def islands(df: DataFrame, key: list[str], order: list[str], what: str) -> DataFrame:
    """One row for each run of equal values of ``what``: (key, island, what, first, last, n); ``order`` is one column here."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = (~F.col(what).eqNullSafe(F.lag(what).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    numbered = df.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(START, 0)))
    return numbered.groupBy(*key, "island", what).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n"))


def _fold(df: DataFrame, key: list[str], order: list[str], schema, begin, step, reads: list[str]) -> DataFrame:
    """A fold in order within each key, as one pass over partitions that hold whole keys, sorted.

    ``step(state, row) -> (state, out)``; the state begins anew with each key and lives across batches.
    A row has the columns ``reads``; others pass as they are.
    """
    cols = df.columns
    at = [cols.index(c) for c in (*key, *reads)]
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, begin()
        for b in batches:
            out = []
            for row in zip(*[b.column(i).to_pylist() for i in at], strict=True):
                here = row[:n]
                if here != now:
                    now, state = here, begin()
                state, made = step(state, dict(zip(reads, row[n:], strict=True)))
                out.append(made)
            extra = [pa.array([o[k] for o in out], pa.int64()) for k in range(len(schema))]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*cols, *schema])

    more = df.select("*", *[F.lit(0).cast("long").alias(s) for s in schema]).schema
    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, more)


def anchored_sessions(df: DataFrame, key: list[str], micros: str, width: int, tie: str) -> DataFrame:
    """Sessions measured from their start: a row that comes ``width`` or more after the start of its session begins a new one.

    Adds session (from 0) and anchor. ``micros`` is a long column.
    """

    def step(state, row):
        number, anchor = state
        if anchor is None or row[micros] - anchor >= width:
            number, anchor = number + 1, row[micros]
        return (number, anchor), (number, anchor)

    return _fold(df, key, [micros, tie], ["session", "anchor"], lambda: (-1, None), step, [micros])


def append_versions(df: DataFrame, key: list[str], order: list[str], offset: str, length: str) -> DataFrame:
    """Writes to a file as versions: one at offset 0 begins a version, one at the present size grows it, any other is ignored.

    Adds version (from 0), size after the write, and applied (0 or 1).
    """

    def step(state, row):
        version, size = state
        if row[offset] == 0:
            version, size, ok = version + 1, row[length], 1
        elif version >= 0 and row[offset] == size:
            size, ok = size + row[length], 1
        else:
            ok = 0
        return (version, size), (version, size, ok)

    return _fold(df, key, order, ["version", "size", "applied"], lambda: (-1, 0), step, [offset, length])
