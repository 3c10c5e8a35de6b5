"""Hierarchies: grouping by any list of properties, all levels in one pass, and paths with their ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "PROP_NOT_AVAIL"


def levels(df: DataFrame, keys: list[str], aggregates: dict[str, Column], missing: str = MISSING) -> DataFrame:
    """Every directory of the tree that grouping by ``keys`` in order makes: (depth, keys, aggregates).

    A missing property is a directory of its own. Keys below a directory's depth are null.
    """
    filled = df.withColumns({k: F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit(missing)) for k in keys})
    bits = F.grouping_id()
    depth = F.lit(len(keys)) - F.bit_count(bits)
    return filled.rollup(*keys).agg(depth.cast("int").alias("depth"), *[c.alias(n) for n, c in aggregates.items()])


def path_parts(path: str) -> Column:
    """The parts of a path between slashes, empty ones left out."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def closure(df: DataFrame, path: str) -> DataFrame:
    """(dir, parent, depth): every ancestor directory of every path, the root not among them, each once."""
    parts = df.select(path_parts(path).alias("p")).where(F.size("p") > 0)
    upto = parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    join = lambda n: F.concat(F.lit("/"), F.array_join(F.slice("p", 1, n), "/"))
    return upto.select(join(F.col("depth")).alias("dir"), join(F.col("depth") - 1).alias("parent"), "depth").distinct()


def page(df: DataFrame, order: list[str], offset: int, limit: int | None = None) -> DataFrame:
    """A page of a listing: ``limit`` rows (all, without one) from ``offset`` on."""
    rest = df.orderBy(*order).offset(offset)
    return rest if limit is None else rest.limit(limit)
