"""What a table of files needs beside joins: sets, ids within a type, clocks, blocks, and names that occur once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import whole_seconds
from .tables import running


def without(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``rows`` whose key is not among ``others``: files that were not decoded further, or not replaced."""
    return rows.join(others.select(*key).distinct(), key, "left_anti")


def among(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``rows`` whose key is among ``others``: files of captures that are given."""
    return rows.join(others.select(*key).distinct(), key, "left_semi")


def members(rows: DataFrame, key: list[str], member: str) -> DataFrame:
    """Each member of each key once. The set is kept as rows, so a key with many members is no one row."""
    return rows.select(*key, member).distinct()


def best(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The first row of each key by ``order``: pre-aggregated, so that no window holds a key's rows."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("__m")).select(*key, *[F.col("__m")[c].alias(c) for c in rest])


def first_opening(locks: DataFrame, keys: DataFrame, on: list[str], key: str) -> DataFrame:
    """``locks`` with the least ``key`` of those that fit, told by equal marks ``on`` (as a modulus tells the private key of a certificate); locks without one are left out."""
    return locks.join(keys.groupBy(*on).agg(F.min(key).alias(key)), on)


def once_named(rows: DataFrame, directory: str, name: str, order: str) -> DataFrame:
    """(directory, name, order, copies): of files with one name in one directory the first, and how many there were."""
    return rows.groupBy(directory, name).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))


def numbered(rows: DataFrame, kind: str, order: str, number: str = "file_id", width: int = 4096) -> DataFrame:
    """``rows`` with ids from 0 within each kind, by ``order`` (a number of its own for each row).

    A kind may hold most rows, so ranks are sums over small cells of ``order`` and over blocks of these, then within them.
    """
    rows = rows.withColumn("__cell", F.floor(F.col(order) / width))
    sums = rows.groupBy(kind, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    sums = running(sums, [kind], "__cell", "__n").withColumnRenamed("before", "__before")
    within = F.row_number().over(Window.partitionBy(kind, "__cell").orderBy(order))
    ranked = rows.withColumn("__within", within).join(sums, [kind, "__cell"])
    return ranked.withColumn(number, F.col("__before") + F.col("__within") - 1).drop("__cell", "__within", "__before")


def window(rows: DataFrame, by: list[str], at: str, moment: Column) -> DataFrame:
    """(by, first, last, covers): the time range of each group, and whether it reaches a moment."""
    return rows.groupBy(*by).agg(F.min(at).alias("first"), F.max(at).alias("last"), (F.max(at) >= moment).alias("covers"))


def clocks(network: DataFrame, fs: DataFrame, key: list[str]) -> DataFrame:
    """(key, network, fs, hybrid): when a file was seen, what its server said, and the later of both."""
    return network.join(fs, key).withColumn("hybrid", F.greatest("network", "fs"))


def by_clock(mode: str, network: Column, fs: Column) -> Column:
    """The time of a file by one of the three clocks; where the server said nothing, when it was seen."""
    return {"network": network, "fs": F.coalesce(fs, network), "hybrid": F.greatest(network, fs)}[mode]


def skew(server: Column, seen: Column) -> Column:
    """Whole seconds (down) by which a server's clock is ahead, from microseconds."""
    return whole_seconds(server - seen)


def blocks(size: Column, of: int = 512) -> Column:
    """How many blocks a file takes."""
    return F.ceil(size / of)


def padded(size: Column, to: int = 8) -> Column:
    """``size`` up to the next multiple."""
    return (F.floor((size + to - 1) / to) * to).cast("long")
