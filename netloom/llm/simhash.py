"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits over the three-word shingles of a text. Two
fingerprints link at ``radius`` 3 or fewer differing bits. Every distinct
fingerprint emits all 65 variants within half that radius (0 or 1 flipped bits):

* Two fingerprints at distance 1 or 2 share a variant. All that meet on one
  variant lie within one bit of it, so within two bits of each other: a bucket
  has at most 65 members, all of them linked, and a star on its smallest member
  keeps every link without listing the pairs.
* At distance 3 no variant is shared, but one variant of each differs in a
  single bit, so they agree in one half of 32 bits. Variants are therefore
  dealt again by their halves, and pairs that meet there are verified. Halves
  whose members are already in one component are left out. Where many meet on
  one half the same is done once more within it: the other half emits its
  variants, one side all within two bits and the other within one, so a crowd
  on one half is never multiplied out either.

Copies share a fingerprint and are folded before anything is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forget, free_name, lasting, meet, scratch
from .words import blocks, shingle_hashes

SHINGLE, RADIUS = 3, 3
U = np.uint64
LANES = U(0x0101010101010101)


def _fingerprints(texts: list[bytes], n: int) -> np.ndarray:
    hashes, offsets = shingle_hashes(texts, n)
    size = np.diff(offsets)
    some = np.flatnonzero(size)
    out = np.zeros(len(texts), U)
    if not len(some):
        return out
    # Counters of eight bits, eight to a word: they hold sums of up to 255 hashes, so longer texts are cut.
    text = np.repeat(np.arange(len(texts)), size)
    cut = np.flatnonzero((np.arange(len(hashes)) - offsets[text]) % 255 == 0)
    votes = np.empty((len(texts), 64), np.int64)
    owner = np.searchsorted(cut, offsets[some])
    for k in range(8):
        sums = np.add.reduceat((hashes >> U(k)) & LANES, cut).view(np.uint8).reshape(-1, 8)
        votes[some, k::8] = np.add.reduceat(sums.astype(np.int64), owner, axis=0)
    bits = votes[some] * 2 > size[some, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint(text, n: int = SHINGLE):
    """Column: the SimHash of a text as a long (bit pattern). Null and empty texts, and those without a word: 0."""

    @F.arrow_udf("long")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            got = [_fingerprints(b, n) for b in blocks(texts)]
            yield pa.array(np.concatenate(got).view(np.int64) if got else [], pa.int64())

    return of(F.col(text) if isinstance(text, str) else text)


def _flips(value, bits):
    """``value`` and its variants with one of ``bits`` flipped."""
    return F.transform(F.array(F.lit(0).cast("long"), *[F.lit(b).cast("long") for b in bits]), lambda m: value.bitwiseXOR(m))


def _signed(k: int) -> int:
    return (1 << k) - (1 << 64 if k == 63 else 0)


#: Fingerprints whose variants one task makes.
TASK_PRINTS = 16_384
#: Pairs that may be verified on one half; where there would be more, variants of the other half are dealt.
HALF_PAIRS = 65_536
#: Halves that are sent to all tasks, 16 bytes each; beyond, they are met by a shuffle.
SENT_HALVES = 1_000_000


def _near(dealt: DataFrame) -> DataFrame:
    """(a, b): links that join all fingerprints which share a variant of one flipped bit."""
    balls = dealt.select("fp", F.explode(_flips(F.col("fp"), [_signed(k) for k in range(64)])).alias("variant"))
    # At most 65 distinct fingerprints lie within one bit of a variant, so this list is bounded.
    met = balls.groupBy("variant").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b").distinct()


def _far(held: DataFrame) -> DataFrame:
    """(a, b): links between parts of ``held`` (fp, part) with fingerprints at most RADIUS bits apart, of which one half differs in at most one bit."""
    # The key of a half: its 32 bits, with bit 32 telling which half it is. ``way`` is the flipped bit, 0 for none.
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32).bitwiseOR(1 << 32)
    stored = held.select("fp", "part", F.explode(F.array(low, high)).alias("key"))
    ways = F.array(*[F.lit(m).cast("long") for m in (0, *(1 << k for k in range(32)))])
    probe = lambda half: F.transform(ways, lambda m: F.struct(half.bitwiseXOR(m).alias("key"), m.alias("way")))
    probes = held.select("fp", "part", F.explode(F.concat(probe(low), probe(high))).alias("x")).select("fp", "part", "x.key", "x.way")
    # Halves at which fingerprints of several parts meet, with how many are stored and how many come. A fingerprint comes to its own halves without a flip.
    own = F.count_if(F.col("way") == 0)
    halves = probes.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), own.alias("kept"), F.count(F.lit(1)).alias("come"))
    halves = lasting(halves.where("lo < hi AND kept > 0").select("key", "kept", "come"))
    n, total = halves.agg(F.count(F.lit(1)), F.coalesce(F.sum("come"), F.lit(0))).first()
    if n <= SENT_HALVES:
        halves_sent = F.broadcast(halves)
        probes, stored = probes.join(halves_sent, "key"), stored.join(halves_sent, "key")
    else:
        probes, stored = meet(probes, halves, ["key"], "come", total), meet(stored, halves, ["key"], "kept", total)
    probes, stored = lasting(probes), lasting(stored)
    crowd = F.col("kept") * F.col("come") > HALF_PAIRS
    few = _paired(probes.where(~crowd), stored.where(~crowd), ["key"])
    # Within a crowd pairs are sought by the other half: one side within one bit of a variant, the other within what is left of the radius.
    other = F.when(F.col("key") >= F.lit(1 << 32), F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    ones = [1 << k for k in range(32)]
    near, wide = _flips(other, ones), _flips(other, [*ones, *(a | b for i, a in enumerate(ones) for b in ones[:i])])
    come = probes.where(crowd).withColumn("variant", F.explode(F.when(F.col("way") == 0, wide).otherwise(near)))
    kept = stored.where(crowd).withColumn("variant", F.explode(near))
    far = lasting(few.unionByName(_paired(come, kept, ["key", "variant"])).distinct())
    forget(halves, probes, stored)
    return far


def _paired(come: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): the parts of verified pairs that meet on ``keys``."""
    there = kept.select(*keys, F.col("fp").alias("fp2"), F.col("part").alias("part2"))
    close = (F.col("part") != F.col("part2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS)
    return come.join(there.hint("merge"), keys).where(close).select(F.least("part", "part2").alias("a"), F.greatest("part", "part2").alias("b")).distinct()


def components_of(prints: DataFrame) -> DataFrame:
    """``prints`` has distinct longs ``fp``; returns (fp, root) for those with a link, root the least fp of the component."""
    prints = lasting(prints)
    tasks = max(1, -(-prints.count() // TASK_PRINTS))
    first = lasting(connected_components(_near(prints.repartition(tasks, "fp")), "a", "b"))
    held = prints.join(first.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("part"))
    second = lasting(connected_components(_far(lasting(held.repartition(tasks, "fp"))), "a", "b"))
    over = second.select(F.col("node").alias("part"), F.col("root").alias("top"))
    # A part that only the second round links has no row in the first.
    alone = over.join(first.select(F.col("root").alias("part")).distinct(), "part", "left_anti").select(F.col("part").alias("fp"), "part", "top")
    sizes = first.groupBy(F.col("root").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    more = meet(first.select(F.col("node").alias("fp"), F.col("root").alias("part")), sizes.join(over, "part", "left"), ["part"], "n", first.count())
    return more.select("fp", F.coalesce("top", "part").alias("root")).unionByName(alone.select("fp", F.col("top").alias("root")))


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, root, component_id) for every row."""
    with scratch() as tables:
        rows = tables.keep(lasting(docs.select(F.col(id_col).alias("id"), fingerprint(text_col).alias("fp"))))
        least = lasting(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")))
        linked = lasting(components_of(least.select("fp")))
        least = lasting(least.join(linked, "fp", "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")))
        top = least.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints"))
        named = tables.keep(lasting(meet(least, top, ["root"], "prints", least.count()).select("fp", "root", "component_id", "copies")))
    # Copies without number share a fingerprint.
    return meet(rows, named, ["fp"], "copies", rows.count()).select("id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    component_id is the least id reachable over links of at most three bits,
    the row's own included. Null and empty texts have fingerprint zero and are
    linked like any other. Rows that repeat an id each stay; a null id is never
    a component's id unless all ids there are null. Other columns are ignored.
    """
    return _labelled(docs, id_col, text_col).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component a row with its least id stays.

    Where several rows of a component have that id (repeated rows, or nothing
    but null ids), any one of them stays. Columns are those of ``docs``, of
    whatever names. An empty table stays empty.
    """
    found = _labelled(docs, id_col, text_col)
    head = F.col("id").eqNullSafe(F.col("component_id"))
    i, root, fp, n, j, f2 = (free_name(docs, x) for x in ("__i", "__root", "__fp", "__n", "__j", "__f2"))
    ids = lasting(found.groupBy(F.col("id").alias(i)).agg(F.count(F.lit(1)).alias(n), F.count_if(head).alias("__heads")).where("__heads > 0").select(i, n))
    same = docs[id_col].eqNullSafe(ids[i])
    once = docs.join(ids.where(F.col(n) == 1), same, "left_semi")
    if ids.where(F.col(n) > 1).isEmpty():
        return once
    # Ids that come more than once: the text tells which of their rows is meant.
    pairs = found.where(head).select(F.col("id").alias(j), F.col("fp").alias(f2), F.col("root").alias(root)).distinct()
    again = docs.join(ids.where(F.col(n) > 1), same, "left_semi").withColumn(fp, fingerprint(text_col))
    again = again.join(pairs, again[id_col].eqNullSafe(pairs[j]) & (again[fp] == pairs[f2])).dropDuplicates([j, root])
    return once.unionByName(again.select(*docs.columns))
