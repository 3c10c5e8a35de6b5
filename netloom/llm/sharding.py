"""Sharding by balanced label propagation, in built-in functions, joins and windows over small buckets.

Documents with equal texts are linked. Where documents of a group are is all
that matters of them, since they are alike, so the state of the propagation is
a row for each group and shard with the number of the group's documents there,
whatever the number of documents. Every document begins in a shard that its
hash chooses. In each round every group is joined with the shard, among those
with room, that holds most of its documents; those in shards that hold no more
move there as far as the quota of that shard lets them, large groups first.
Every move adds to the sum of the squares of what groups have in shards. Rounds
go on until neither that sum grows nor the number of cut links (shards of a
group beyond its first) falls by more than a thousandth.

Large groups go first, while the small ones are not placed yet, since no quota
has room for them afterwards. In the end each shard gets its exact number of
documents (the law ``rows``: counts at most one apart): shards that hold more
than that give up whole groups, the smallest first, which fill the room of the
others in the order of their groups; documents without a link fill the places
that are left.

Ranks and running sums are sums over small buckets, then within them. No window
spans a shard or a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import forget, lasting, meet, running


@dataclass(frozen=True)
class Plan:
    """``slack``: how far over its even share a shard may grow while documents move. ``large``: the share of a shard from which on a group is large."""

    shards: int = 16
    slack: float = 0.10
    large: float = 1 / 16
    seed: int = 8
    bucket_rows: int = 20_000


def _even(total: int, k: int, plan: Plan) -> int:
    """The number of documents of shard ``k`` under the law ``rows``."""
    return total // plan.shards + (k < total % plan.shards)


def _by_shard(shard: Column, values: dict[int, int]) -> Column:
    """The value of a shard, of a few."""
    return F.element_at(F.array(*[F.lit(int(values.get(k, 0))).cast("long") for k in range(max(values) + 1)]), shard + 1)


def _loads(blocks: DataFrame, plan: Plan) -> dict[int, int]:
    """Documents of each shard: a row a shard."""
    found = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return {k: found.get(k, 0) for k in range(plan.shards)}


def _summed(rows: DataFrame, by: str, order: Column, total: int, plan: Plan) -> DataFrame:
    """``rows`` (grp, shard, n, ...) with __sum, the sum of n up to the row's own within ``by``: by ``order`` (from 0 to 63), then by a hash of the group.

    Groups are dealt by their hash to buckets of about ``bucket_rows`` rows.
    """
    parts = max(64, -(-total // plan.bucket_rows))
    rows = rows.withColumn("__b", order.cast("long") * parts + F.pmod(F.xxhash64("grp", F.lit(plan.seed)), F.lit(parts)))
    below = running(rows.groupBy(by, "__b").agg(F.sum("n").alias("s")), [by], "__b", "s")
    within = F.sum("n").over(Window.partitionBy(by, "__b").orderBy("grp", "shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("__within", within).join(below, [by, "__b"]).withColumn("__sum", F.col("before") + F.col("__within")).drop("__b", "__within", "before")


def _small_last(n: str) -> Column:
    """Larger numbers first, from 0 to 63, in steps of a factor of two."""
    return 63 - F.least(F.lit(63), F.floor(F.log2(F.greatest(F.col(n), F.lit(1)).cast("double"))).cast("int"))


def _merged(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("grp", "shard").agg(F.sum("n").alias("n"))


def _round(blocks: DataFrame, room: dict[int, int], rows: int, plan: Plan) -> DataFrame:
    """``blocks`` (grp, shard, n) after one round of moves; ``room`` is what each shard takes at most."""
    # Up the order: documents in it, then a hash, so that equal shards of a group have one order.
    at = F.struct(F.col("n"), F.xxhash64("grp", "shard", F.lit(plan.seed)).alias("tie"), F.col("shard"))
    open_ = blocks.where(_by_shard(F.col("shard"), room) > 0)
    best = open_.groupBy("grp").agg(F.max(at).alias("best"))
    asked = blocks.join(best, "grp").where("best.n >= n AND best.shard != shard").select("grp", "shard", "n", F.col("best.shard").alias("to"), F.col("best.n").alias("there"))
    asked = _summed(asked, "to", _small_last("there"), rows, plan)
    fit = F.col("n") - F.greatest(F.lit(0), F.col("__sum") - _by_shard(F.col("to"), room))
    moved = asked.select("grp", "shard", "to", F.greatest(fit, F.lit(0)).alias("n")).where("n > 0")
    gone = moved.select("grp", "shard", (-F.col("n")).alias("n")).unionByName(moved.select("grp", F.col("to").alias("shard"), "n"))
    return _merged(blocks.select("grp", "shard", "n").unionByName(gone)).where("n > 0")


def propagate(blocks: DataFrame, capacity: dict[int, int], held: dict[int, int], plan: Plan = Plan()) -> DataFrame:
    """``blocks`` (grp, shard, n) after rounds until they change (nearly) nothing any more.

    ``capacity`` is the most documents of a shard, of which it has ``held``
    others already. The result is lasting.
    """
    now, before = lasting(blocks), None
    while True:
        rows, groups, squares = now.agg(F.count(F.lit(1)), F.count_distinct("grp"), F.sum(F.col("n").cast("double") * F.col("n"))).first()
        cut = rows - groups
        if not cut or before is not None and cut >= 0.999 * before[0] and squares <= 1.001 * before[1]:
            return now
        before = cut, squares
        load = _loads(now, plan)
        after = lasting(_round(now, {k: max(0, capacity[k] - held[k] - load[k]) for k in load}, rows, plan))
        forget(now)
        now = after


def _dealt(room: dict[int, int], plan: Plan) -> Column:
    """The shard that a hash chooses, as often as it has room."""
    whole = max(1, sum(room.values()))
    point, until, shard = F.pmod(F.xxhash64("id", "rn", F.lit(plan.seed)), F.lit(whole)), 0, F.lit(plan.shards - 1)
    edges = []
    for k in range(plan.shards):
        until += room[k]
        edges.append((until, k))
    for until, k in reversed(edges):
        shard = F.when(point < until, F.lit(k)).otherwise(shard)
    return shard


def _settled(blocks: DataFrame, capacity: dict[int, int], rows: int, plan: Plan) -> DataFrame:
    """``blocks`` with no shard over ``capacity``: whole groups go first, the smallest first, and fill the others' room in the order of a hash."""
    load = _loads(blocks, plan)
    over = {k: max(0, load[k] - capacity[k]) for k in load}
    if not any(over.values()):
        return blocks
    whole = blocks.groupBy("grp").agg(F.sum("n").alias("members"))
    leaving = blocks.where(_by_shard(F.col("shard"), over) > 0).join(whole, "grp")
    # A group that is in one shard loses no link when it goes whole; parts of others follow.
    order = F.when(F.col("n") == F.col("members"), F.least(F.lit(31), F.floor(F.log2(F.col("n").cast("double"))).cast("int"))).otherwise(32 + F.least(F.lit(31), F.floor(F.log2(F.col("n").cast("double"))).cast("int")))
    leaving = _summed(leaving, "shard", order, rows, plan)
    go = F.greatest(F.lit(0), F.col("n") - F.greatest(F.lit(0), F.col("__sum") - _by_shard(F.col("shard"), over)))
    leaving = lasting(leaving.select("grp", "shard", go.alias("n")).where("n > 0"))
    placed = _summed(leaving.withColumn("all", F.lit(0)), "all", F.lit(0), rows, plan)
    # What leaves is a line of documents; the room of the shards, one behind the other, cuts it.
    cuts, until = [], 0
    for k in range(plan.shards):
        free = max(0, capacity[k] - load[k])
        cuts.append(F.struct(F.lit(k).alias("shard"), F.lit(until).cast("long").alias("lo"), F.lit(until + free).cast("long").alias("hi")))
        until += free
    placed = placed.select("grp", (F.col("__sum") - F.col("n")).alias("lo"), F.col("__sum").alias("hi"), F.explode(F.array(*cuts)).alias("to"))
    share = F.least("hi", "to.hi") - F.greatest("lo", "to.lo")
    placed = placed.select("grp", F.col("to.shard").alias("shard"), share.alias("n")).where("n > 0")
    gone = leaving.select("grp", "shard", (-F.col("n")).alias("n")).unionByName(placed)
    return lasting(_merged(blocks.select("grp", "shard", "n").unionByName(gone)).where("n > 0"))


def _ranked(rows: DataFrame, by: list[str], buckets: Column, order: list[str], plan: Plan) -> DataFrame:
    """``rows`` with __rank, gapless from 0 within ``by``, by a hash of ``order`` and then by it; ``buckets``: over how many buckets the rows of ``by`` go."""
    rows = rows.withColumn("__h", F.xxhash64(*order, F.lit(plan.seed)))
    rows = rows.withColumn("__b", F.pmod(F.shiftrightunsigned("__h", 20), buckets))
    below = running(rows.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("s")), by, "__b", "s")
    within = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", *order))
    return rows.withColumn("__within", within).join(below, [*by, "__b"]).withColumn("__rank", F.col("before") + F.col("__within") - 1).drop("__h", "__b", "before", "__within")


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rn, id, size, crc, grp): rn tells rows apart that are alike in all else."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rn"),
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.md5(text.cast("binary")).alias("grp"),
    )
    return lasting(rows)


def shard(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    size is the text's UTF-8 bytes and one more, text_crc32 its CRC-32; a null
    text counts as empty, and null texts are linked with empty ones. Rows that
    repeat an id are rows of their own. grown_shard is null under this law.
    Other columns are ignored. An empty table gives an empty table.
    """
    rows = _groups(docs, id_col, text_col)
    total = rows.count()
    even = {k: _even(total, k, plan) for k in range(plan.shards)}
    groups = lasting(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    least = max(2, int(plan.large * total / plan.shards))
    linked_rows, large_rows = groups.agg(F.coalesce(F.sum("members"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("members") >= least, F.col("members"))), F.lit(0))).first()
    linked = lasting(meet(rows, groups, ["grp"], "members", total))
    lone = rows.join(groups.select("grp"), "grp", "left_anti")

    # Large groups find their shards first, then the others, which begin where room is. Large groups need no slack where others leave as much.
    capacity = {k: int((1 + plan.slack) * even[k]) + 1 for k in even}
    tight = {k: max(even[k], capacity[k] - (total - large_rows) // plan.shards) for k in even}
    none = dict.fromkeys(even, 0)
    begun = lambda rows, room: _merged(rows.select("grp", _dealt(room, plan).cast("int").alias("shard"), F.lit(1).cast("long").alias("n")))
    large = propagate(begun(linked.where(F.col("members") >= least), tight), tight, none, plan)
    held = _loads(large, plan)
    small = propagate(begun(linked.where(F.col("members") < least), {k: max(0, even[k] - held[k]) for k in even}), capacity, held, plan)
    blocks = _settled(lasting(large.unionByName(small)), even, total, plan)

    # The documents of a group go to its shards in the order of their ranks, and their places are one behind the other.
    load = _loads(blocks, plan)
    placed = _summed(blocks, "shard", F.lit(0), total, plan)
    upto = F.sum("n").over(Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a row a shard
    placed = placed.select("grp", upto.alias("hi"), "n", "shard", (F.col("__sum") - F.col("n")).alias("first"))
    homes = placed.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("hi", "n", "shard", "first"))).alias("homes")).join(groups, "grp")
    each = max(64, min(plan.bucket_rows, total // 1000))  # so that no bucket is more than a small share of all rows
    ranked = _ranked(linked, ["grp"], F.ceil(F.col("members") / each), ["id", "rn"], plan).drop("members")
    ranked = meet(lasting(ranked), homes, ["grp"], "members", total)
    home = F.filter("homes", lambda h: h["hi"] > F.col("__rank"))[0]
    kept = ranked.withColumn("home", home).select("id", "size", "crc", "home.shard", (F.col("home.first") + F.col("__rank") - (F.col("home.hi") - F.col("home.n"))).alias("slot"))

    # Documents without a link fill what is free, shard after shard.
    lone = _ranked(lone.withColumn("all", F.lit(0)), ["all"], F.lit(max(64, -(-total // plan.bucket_rows))), ["grp", "id", "rn"], plan)
    shard_of, slot, until = F.lit(None).cast("int"), F.lit(None).cast("long"), total - linked_rows
    for k in reversed(range(plan.shards)):
        first = until - (even[k] - load[k])
        here = (F.col("__rank") >= first) & (F.col("__rank") < until)
        shard_of = F.when(here, F.lit(k)).otherwise(shard_of)
        slot = F.when(here, F.col("__rank") - first + load[k]).otherwise(slot)
        until = first
    done = kept.unionByName(lone.select("id", "size", "crc", shard_of.alias("shard"), slot.alias("slot")))
    return done.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def cut_links(placed: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row: links (documents of a group beyond its first) and cut (shards of a group beyond its first); ``groups``: (id_col, grp)."""
    per = placed.join(groups, id_col).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shard").alias("s"))
    return per.agg(F.sum(F.col("n") - 1).alias("links"), F.sum(F.col("s") - 1).alias("cut"))
