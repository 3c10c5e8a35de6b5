"""Mixing sources to target weights by Poisson replication.

A source with share s of the corpus and target weight w is repeated w / s times
on average. Each document's number of copies is drawn by inverting a Poisson
distribution of that mean at a point that a hash of the document's id and text
and the seed give, so a rerun draws alike and no random state is kept. Documents are
exploded by their count and shuffled globally: dealt by a hash of document and
copy, and ordered by it within each partition.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import free_name, lasting, meet


@dataclass(frozen=True)
class Mix:
    """``weights``: of the sources by name, in any unit; a source without one gets ``other``.

    Shares are of characters, or of rows with ``by_rows``. ``size`` is the size
    of the mix as a multiple of the corpus. Up to ``broadcast_sources`` sources
    their rates are sent to all tasks; beyond, only those of sources with many rows are.
    """

    weights: dict[str, float] = field(default_factory=dict)
    other: float = 1.0
    size: float = 1.0
    by_rows: bool = False
    seed: int = 4
    broadcast_sources: int = 10_000


def rates(docs: DataFrame, mix: Mix = Mix(), source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, rows, amount, rate): the mean number of copies of each source's documents.

    A null source is a source of its own, named null. A source whose rows have
    no characters has rate 0.
    """
    amount = F.count(F.lit(1)) if mix.by_rows else F.coalesce(F.sum(F.char_length(text_col)), F.lit(0))
    per = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("rows"), amount.cast("double").alias("amount"))
    weight = F.lit(float(mix.other))
    for name, w in sorted(mix.weights.items()):
        weight = F.when(F.col("source") == name, float(w)).otherwise(weight)
    per = per.withColumn("weight", F.when(F.col("amount") > 0, weight).otherwise(0.0))
    per = lasting(per)  # a row a source
    whole = per.agg(F.sum("amount").alias("amount"), F.sum("weight").alias("weight")).first()
    if not whole.weight:
        return per.select("source", "rows", "amount", F.lit(0.0).alias("rate"))
    rate = F.lit(float(mix.size)) * F.col("weight") / F.lit(whole.weight) * F.lit(whole.amount) / F.col("amount")
    return per.select("source", "rows", "amount", F.when(F.col("amount") > 0, rate).otherwise(0.0).alias("rate"))


#: Running probabilities of all sources together that are sent to all tasks, 8 bytes each.
MOST_STEPS = 1_000_000
#: Copies that one row makes at a time where a source's rate is large.
BLOCK = 4096


def steps(per: DataFrame) -> DataFrame:
    """(source, first, cdf) of ``per`` (source, rate): the running probabilities P(N <= first), P(N <= first + 1), ... of a Poisson distribution.

    They go so far that the next is 1 in doubles, and begin so late that those
    before are below the least point but 0 that can be drawn: some
    24 * sqrt(rate) of them, in rows until the last step. From 0 on they are
    summed from logarithms; from a later beginning each probability comes from
    Stirling's series with the deviation taken apart, so that a large mean
    loses nothing to cancellation.
    """
    r, k = F.col("rate"), F.col("k").cast("double")
    wide = 12 * F.sqrt(r) + 20
    rows = per.where("rate > 0").select("source", "rate", F.greatest(F.lit(0), F.floor(r - wide)).cast("long").alias("first"), F.ceil(r + wide).cast("long").alias("last"))
    rows = rows.select("source", "rate", "first", F.explode(F.sequence("first", "last")).alias("k"))
    by = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = F.sum(F.when(F.col("k") == 0, -r).otherwise(F.log(r) - F.log(k))).over(by)
    off = k - r
    direct = off - k * F.log1p(off / r) - 0.5 * F.log(2 * math.pi * k) - (1 / (12 * k) - 1 / (360 * k * k * k))
    rows = rows.withColumn("log", F.when(F.col("first") == 0, summed).otherwise(direct)).withColumn("c", F.sum(F.exp("log")).over(by))
    lists = rows.groupBy("source", "first").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("x")).select("source", "first", F.transform("x", lambda x: x["c"]).alias("cdf"))
    return lists.unionByName(per.where("NOT rate > 0").select("source", F.lit(0).cast("long").alias("first"), F.array(F.lit(1.0)).alias("cdf")))


def _reached(cdf: str, u: str) -> Column:
    """How many numbers of ``cdf``, which ascends, are at most ``u``: by bisection."""
    halve = lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc).otherwise(
        F.when(F.get(F.col(cdf), F.shiftright(acc["lo"] + acc["hi"], 1)) <= F.col(u), F.struct((F.shiftright(acc["lo"] + acc["hi"], 1) + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(
            F.struct(acc["lo"].alias("lo"), F.shiftright(acc["lo"] + acc["hi"], 1).alias("hi"))
        )
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(F.lit(0).alias("lo"), F.size(cdf).alias("hi")), halve, lambda acc: acc["lo"])


def point(id_col: str, text_col: str, seed: int) -> Column:
    """A number from [0, 1) that the id, the text and the seed give: the first 52 bits of an MD5."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix_sources(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str = "copy") -> DataFrame:
    """The rows of ``docs``, each as often as drawn, with the number of the copy from 0, in shuffled order.

    Rows that repeat an id and a text are drawn alike; rows of one id with different texts are drawn apart. Null
    ids and texts count as empty, a null source as a source. Other columns are carried along, whatever their names;
    only a column of the name ``copy_col`` is replaced.
    """
    u, n, k, order, source, first, cdf, name, rows = (free_name(docs, x) for x in ("__u", "__n", "__k", "__o", "__source", "__first", "__cdf", "__name", "__rows"))
    known = rates(docs, mix, source_col, text_col)
    sized = known.select(F.col("source").alias(source), F.col("rows").alias(rows))
    per = steps(known).withColumnsRenamed({"source": source, "first": first, "cdf": cdf})
    per = lasting(per.join(sized.withColumnRenamed(source, name), F.col(source).eqNullSafe(F.col(name))).drop(name))
    far, sources, size, far_sources, total = per.where(F.col(first) > 0), *per.agg(F.count_if(F.col(first) == 0), F.sum(F.when(F.col(first) == 0, F.size(cdf))), F.count_if(F.col(first) > 0), F.sum(rows)).first()
    near = per.where(F.col(first) == 0)
    given = docs.withColumn(u, point(id_col, text_col, mix.seed))
    if sources <= mix.broadcast_sources and (size or 0) <= MOST_STEPS:
        drawn = given.join(F.broadcast(near.drop(rows)), docs[source_col].eqNullSafe(near[source]))
    else:
        # Many sources: those with many rows are still sent to where their rows are, the others are dealt.
        told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(name)
        drawn = meet(given.select("*", told(source_col)), near.select("*", told(source)), [name], rows, total).drop(name, rows)
    drawn = drawn.withColumn(n, F.size(F.filter(cdf, lambda c: c <= F.col(u)))).drop(cdf, source, first)
    copies = drawn.where(F.col(n) > 0).withColumn(copy_col, F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(n)
    if far_sources:
        # Sources with many copies of a document have few characters: only their documents go to a join without broadcast, and are copied in blocks.
        if far_sources <= mix.broadcast_sources:
            names = far.select(F.col(source).alias(name))
            given = given.join(F.broadcast(names), docs[source_col].eqNullSafe(names[name]), "left_semi")
        drawn = given.join(far.drop(rows).hint("shuffle_merge"), docs[source_col].eqNullSafe(far[source]))
        drawn = drawn.withColumn(n, F.when(F.col(u) > 0, F.col(first) + _reached(cdf, u)).otherwise(F.lit(0))).drop(cdf, source, first)
        blocks = drawn.where(F.col(n) > 0).withColumn(k, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / BLOCK)))).repartition(u, k)
        each = F.sequence((F.col(k) * BLOCK).cast("int"), (F.least(F.col(n), (F.col(k) + 1) * BLOCK) - 1).cast("int"))
        copies = copies.unionByName(blocks.withColumn(copy_col, F.explode(each)).drop(n, k))
    copies = copies.withColumn(order, F.xxhash64(u, copy_col, F.lit(mix.seed))).drop(u)
    return copies.repartition(order).sortWithinPartitions(order, *[c for c in (id_col, copy_col) if c in copies.columns]).drop(order)
