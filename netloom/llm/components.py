"""What the operators share: connected components, and the library's lasting results, joins that split hot keys and prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import HOT_KEYS, HOT_ROWS, forget, free_name, lasting, meet, running, scratch, shared_folder  # noqa: F401  the operators take them from here


def _least(edges: DataFrame, with_self: bool) -> DataFrame:
    """(u, m, n) for every u of ``edges``: the least of its neighbours, or of these and itself, and how many there are."""
    least: Column = F.min("v")
    return edges.groupBy("u").agg((F.least(least, F.col("u")) if with_self else least).alias("m"), F.count(F.lit(1)).alias("n"))


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the least node of its component. Self-links and repeats do no harm.

    Each round points every node at the least of its neighbours (large star),
    then joins the neighbours of a node to their least (small star). Minima are
    pre-aggregated, and the links of hubs meet them where they are (see
    ``meet``), so a hub costs no task more than its share. The state is written
    out each round.
    """
    now = lasting(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        n, mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if n == 0 or (n, mark) == seen:
            break
        seen = (n, mark)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = lasting(_least(both, True))
        large = meet(both, least, ["u"], "n", 2 * n).where("v > u")
        large = lasting(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lower = lasting(_least(large, False))
        small = meet(large, lower, ["u"], "n", n)
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = lasting(small.select("e.u", "e.v").where("u != v").distinct())
        forget(now, least, large, lower)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.groupBy(F.col("v").alias("root")).agg(F.lit(None)).select(F.col("root").alias("node"), "root")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
