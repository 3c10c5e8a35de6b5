"""Content by reference: rows point at byte ranges of other rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zeros(n: Column) -> Column:
    """n bytes 0."""
    return F.unhex(F.repeat(F.lit("00"), n.cast("int")))


def in_order(part: str, order: str) -> Column:
    """Aggregate: the bytes of a column's values one behind the other, by ``order``."""
    return F.coalesce(F.expr(f"listagg({part}) WITHIN GROUP (ORDER BY {order})"), F.lit(b""))


def gather(files: DataFrame, parents: DataFrame, key: str, fragments: str, parent_key: str, content: str) -> DataFrame:
    """(key, content): the byte ranges (id, start, length; start from 0) of ``fragments`` in order, cut out of the parents.

    A range that lies beyond its parent gives what is there.
    """
    each = files.select(key, F.posexplode(fragments).alias("pos", "f"))
    p = parents.select(F.col(parent_key).alias("__id"), F.col(content).alias("__c"))
    cut = each.join(p, F.col("f.id") == F.col("__id")).select(
        key, "pos", F.substring(F.col("__c"), (F.col("f.start") + 1).cast("int"), F.col("f.length").cast("int")).alias("part")
    )
    return cut.groupBy(key).agg(in_order("part", "pos").alias(content))
