"""Correlation joins: as-of, intervals with the first match, fallback look-ups, unions by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: list[str], at: str, values: list[str], forward: bool = False) -> DataFrame:
    """``left`` with the values of the nearest row of ``right`` at or before (``forward``: at or after) its time; null if none.

    Both sides are put in one order and the values carried along, so a left row never multiplies.
    """
    fields = [F.col(v) for v in values]
    one = left.select("*", F.lit(None).cast(right.select(F.struct(at, *fields).alias("v")).schema["v"].dataType).alias("__v"), F.lit(1 if not forward else 0).alias("__s"))
    two = right.select(*key, at, F.struct(at, *fields).alias("__v"), F.lit(0 if not forward else 1).alias("__s"))
    both = one.unionByName(two, allowMissingColumns=True).withColumn("__left", F.col("__v").isNull())
    w = Window.partitionBy(*key).orderBy(at, "__s")
    if forward:
        near = F.first("__v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        near = F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__n", near).where("__left")
    return out.select(*left.columns, F.col("__n")[at].alias(f"near_{at}"), *[F.col("__n")[v].alias(f"near_{v}") for v in values])


def first_interval(points: DataFrame, slots: DataFrame, key: list[str], at: str, lo: str, hi: str, order: str, width: int) -> DataFrame:
    """``points`` with the first (by ``order``) slot of their key that holds them, ends included; points without one are left out.

    Times are longs. Every slot lies in two or three cells of a size that fits
    it (``width`` times a power of two), however long it is; a point meets the
    slots of its own cell of each size that occurs. Equal points are told once
    and stay as many as they were. Columns of points must be comparable.
    """
    size = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col(hi) - F.col(lo), F.lit(1)) / width))).cast("int")
    slots = slots.where(F.col(lo) <= F.col(hi)).withColumn("__size", size)
    cell = lambda c: F.floor(F.col(c) / (F.lit(width) * F.pow(F.lit(2.0), F.col("__size")))).cast("long")
    cells = slots.withColumn("__cell", F.explode(F.sequence(cell(lo), cell(hi))))
    sizes = sorted(r["__size"] for r in slots.select("__size").distinct().collect())  # at most 64
    mine = points.columns
    once = points.groupBy(*mine).agg(F.count(F.lit(1)).alias("__copies"))
    probes = once.withColumn("__size", F.explode(F.array(*[F.lit(k) for k in sizes]).cast("array<int>"))).withColumn("__cell", cell(at))
    met = probes.join(cells, [*key, "__size", "__cell"]).where((F.col(lo) <= F.col(at)) & (F.col(at) <= F.col(hi)))
    w = Window.partitionBy(*mine).orderBy(order)
    first = met.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    return first.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).drop("__r", "__cell", "__size", "__copies", "__copy")


def lookup(left: DataFrame, right: DataFrame, key: str, value: str, default: Column, name: str) -> DataFrame:
    """``left`` with ``name``: the value of its key in ``right`` (one row a key), or the default."""
    r = right.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    return left.join(r, left[key] == r["__k"], "left").withColumn(name, F.coalesce("__v", default)).drop("__k", "__v")


def either_way(left: DataFrame, known: DataFrame, a: str, b: str, ka: str, kb: str) -> DataFrame:
    """Rows of ``left`` whose pair (a, b) is a known pair in either order."""
    turned = known.select(F.col(ka).alias(a), F.col(kb).alias(b)).unionByName(known.select(F.col(kb).alias(a), F.col(ka).alias(b))).distinct()
    return left.join(turned, [a, b], "left_semi")


def union_first(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """The union of ``parts``; where a key comes more than once, the row of the earliest part (then the least row) stays."""
    every = None
    for k, p in enumerate(parts):
        p = p.withColumn("__p", F.lit(k))
        every = p if every is None else every.unionByName(p)
    rest = [c for c in parts[0].columns if c not in key]
    best = every.groupBy(*key).agg(F.min(F.struct("__p", *rest)).alias("m"))
    return best.select(*key, *[F.col("m")[c].alias(c) for c in rest])


def latest(df: DataFrame, key: list[str], at: str, before: Column, tie: str) -> DataFrame:
    """The last row of each key with a time strictly before a moment: a snapshot."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), F.desc(tie))
    return df.where(F.col(at) < before).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
