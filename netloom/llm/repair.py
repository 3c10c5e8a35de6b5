"""Conversations put into order: roles that alternate, no blank or repeated turns, by the cheapest edits.

A conversation's roles and faults are a string, its signature: one character a
row. What is cheapest depends on the signature alone, so each distinct one is
solved once, by a recursion over its halves whose steps are kept, and the
audit (one letter an edit) joins back to the conversations that have it. A
last passage replays the edits over the rows.

Signatures are made of rows without their texts: these are put in order by
ranges over all conversations, so that a conversation that holds a third of
all rows is cut by many tasks into stretches, which then are one character a
row. Only rows that stay travel with their texts, once each, and are passed
over row by row; a conversation's hash is a chain over its rows, so they meet
in one task, which holds one of them at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .components import forget, lasting, meet

#: What an edit costs, and what a truncated row costs that is not deleted.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: Kinds of roles by their initial (user, assistant, system, any other), faults of a row, and the states of an output: nothing yet, or its last role.
ROLES, NONE, BLANK, DUPLICATE, TRUNCATED = "uas?", 0, 1, 2, 3
EMPTY, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
#: Where a user's or an assistant's row leads, and what an output may end with at what cost to go.
NEXT = (USER, USER, ASSISTANT, USER)
END = (0, 2 * INSERT, INSERT, 0)
STRETCH = 1 << 16  # rows in a stretch of a signature
SPACE = r"[^\x20\x09-\x0D]"

SOLVED = StructType([StructField("audit", StringType()), *[StructField(c, LongType()) for c in ("cost", "blank", "duplicate", "truncated", "illegal")]])


def _code(role: int, fault: int) -> str:
    return chr(65 + 4 * role + fault)


def _edits(code: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits that use up a row, letters in ASCII order."""
    role, fault = divmod(ord(code) - 65, 4)
    out = [("D", DELETE, state)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = CUT_OFF if fault == TRUNCATED else 0
    if role == 2 and state == EMPTY:
        out.append(("K", KEEP + more, SYSTEM))
    elif (role, NEXT[state]) in ((0, USER), (1, ASSISTANT)):
        out.append(("K", KEEP + more, NEXT[state]))
    out.append(("R", REROLE + more, NEXT[state]))
    return out


def _with_inserts(go: list[int]) -> list[int]:
    """Costs to go where rows may be inserted first; two inserts behind a user's or an assistant's row lead back to it."""
    u, a = min(go[USER], INSERT + go[ASSISTANT]), min(go[ASSISTANT], INSERT + go[USER])
    return [min(go[EMPTY], INSERT + u), min(go[SYSTEM], INSERT + u), u, a]


@lru_cache(1 << 18)
def costs(block: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """What must be paid from each state before ``block``, given what from each behind it: the least of the four, and each above that.

    Costs differ by a few inserts at most, so few vectors occur and equal blocks meet equal ones again.
    """
    if len(block) == 1:
        go = _with_inserts([min(c + after[to] for _, c, to in _edits(block, s)) for s in range(4)])
        least = min(go)
        return least, tuple(g - least for g in go)
    half = 1 << (len(block) - 1).bit_length() - 1
    late, between = costs(block[half:], after)
    early, before = costs(block[:half], between)
    return early + late, before


@lru_cache(1 << 16)
def letters(block: str, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The edits over ``block`` from a state, and the state behind it: the ASCII-least of the cheapest.

    In a state no two edits have one letter, so the first letter of those that cost the least decides.
    """
    if len(block) == 1:
        base, before = costs(block, after)
        out = ""
        while True:
            left = base + before[state]
            fit = [(x, to, True) for x, c, to in _edits(block, state) if c + after[to] == left]
            if INSERT + base + before[NEXT[state]] == left:
                fit.append(("I", NEXT[state], False))
            letter, state, used = min(fit)
            out += letter
            if used:
                return out, state
    half = 1 << (len(block) - 1).bit_length() - 1
    one, state = letters(block[:half], state, costs(block[half:], after)[1])
    two, state = letters(block[half:], state, after)
    return one + two, state


def solve(signature: str) -> tuple[str, int, int, int, int, int]:
    """(audit, cost, blank, duplicate, truncated, illegal) of a signature."""
    if not signature:
        return "", 0, 0, 0, 0, 0
    base, before = costs(signature, END)
    audit, state = letters(signature, EMPTY, END)
    audit += {USER: "I", SYSTEM: "II"}.get(state, "")
    faults = [(ord(c) - 65) % 4 for c in signature]
    roles = [(ord(c) - 65) // 4 for c in signature]
    good = {(2, 0), (0, 1), (1, 0)}
    illegal = sum((a, b) not in good for a, b in zip(roles, roles[1:], strict=False))
    return audit, base + before[EMPTY], faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal


@F.arrow_udf(SOLVED)
def _solved(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in parts:
        rows = [solve(x.as_py()) for x in column]
        kinds = [pa.string(), *[pa.int64()] * 5]
        yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], SOLVED.names)


def damage(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text): ``turns`` after damage that a crc32 of id and turn deals out; a null is one space there, in roles and in texts."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.pmod(F.crc32(F.concat(spaced(id_col), F.lit(":"), spaced(turn_col)).cast("binary")), F.lit(20))
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(spaced(text_col), "[.!?]", "")).otherwise(spaced(text_col))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.when(way == 4, "user").otherwise(spaced(role_col)).alias("role"), text.alias("text"), way.alias("__w"))
    return rows.where("__w <> 0").withColumn("__c", F.explode(F.when(F.col("__w") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__w", "__c")


def _key(conv_id: str = "conv_id") -> Column:
    """A conversation's id as text; one that is null is a conversation too."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("")).alias("k")


def _order() -> list[Column]:
    """Rows of a conversation: by turn, nulls first, and of one turn by role and the text's hash."""
    return [F.asc_nulls_first("turn"), F.col("role"), F.col("th")]


def _faulty(rows: DataFrame) -> DataFrame:
    """(k, turn, role, th, n, code, again): each distinct row once, how often it comes, its character, and that of its repetitions."""
    last = F.regexp_extract("text", f"({SPACE})[\\x20\\x09-\\x0D]*$", 1)
    each = rows.select(_key(), "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("th"), last.alias("last"))
    fault = F.when(F.col("last") == "", BLANK).when(~F.col("last").isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    each = lasting(each.select("k", "turn", "role", "th", fault.alias("fault")).groupBy("k", "turn", "role", "th", "fault").agg(F.count(F.lit(1)).alias("n")))
    early = each.groupBy("k", "role", "th").agg(F.min("turn").alias("t1"), F.max(F.col("turn").isNull()).alias("null1"), F.count(F.lit(1)).alias("rows"))
    early = lasting(early.where("rows > 1"))  # all others are the first of their role and text
    total = each.count()
    met = meet(each, early, ["k", "role", "th"], "rows", total)
    first = F.when(F.col("null1"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("t1"))
    met = met.withColumn("fault", F.when(F.coalesce(first, F.lit(False)) | (F.col("fault") == BLANK), F.col("fault")).otherwise(DUPLICATE)).select(*each.columns)
    single = each.join(early, ["k", "role", "th"], "left_anti")
    kind = F.lit(3)
    for k, c in enumerate(ROLES[:3]):
        kind = F.when(F.substring("role", 1, 1) == c, k).otherwise(kind)
    code = lambda fault: F.char((F.lit(65) + 4 * kind + fault).cast("long"))
    again = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    out = lasting(met.unionByName(single.select(*each.columns)).select("k", "turn", "role", "th", "n", code(F.col("fault")).alias("code"), code(again).alias("again")))
    forget(each, early)
    return out


def signatures(faulty: DataFrame) -> DataFrame:
    """(k, signature): the characters of a conversation's rows in order.

    Rows are sorted by ranges over all conversations; a task gives stretches, and only these meet.
    """
    order = [F.col("k"), *_order()]
    rows = faulty.select("k", "turn", "role", "th", "n", "code", "again").repartitionByRange(*order).sortWithinPartitions(*order)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held, size, out = None, None, [], 0, []
        names = ["k", "turn", "role", "th", "nth", "piece"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string()]
        nth = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)
                out.clear()

        for b in batches:
            for k, turn, role, th, n, code, again in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and (k != now or size >= STRETCH):
                    out.append((now, *first, nth, "".join(held)))
                    nth, held, size = nth + 1, [], 0
                if not held:
                    now, first = k, (turn, role, th)
                held.append(code)
                size += 1
                n -= 1
                while n > 0:
                    step = min(n, STRETCH)
                    held.append(again * step)
                    size, n = size + step, n - step
            if len(out) >= 2000:
                yield from flush()
        if held:
            out.append((now, *first, nth, "".join(held)))
        yield from flush()

    pieces = rows.mapInArrow(stretches, "k string, turn long, role string, th binary, nth long, piece string")
    whole = F.expr("listagg(piece) WITHIN GROUP (ORDER BY turn ASC NULLS FIRST, role, th, nth)")
    return pieces.groupBy("k").agg(whole.alias("signature"))


def audits(rows: DataFrame) -> DataFrame:
    """(k, signature, gaps, audit, cost, blank, duplicate, truncated, illegal) of each conversation that has rows.

    Each distinct signature is solved once; conversations of a signature that
    many have meet its audit where they are. Turns that are null count as no
    turn; the gaps of a conversation are the turns between its least and its
    greatest that no row has. An empty table gives an empty table.
    """
    faulty = _faulty(rows)
    turns = faulty.groupBy("k", "turn").agg(F.lit(1).alias("one")).groupBy("k").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    signed = lasting(signatures(faulty).join(turns, "k"))
    distinct = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("conversations"))
    solved = lasting(distinct.withColumn("__s", _solved("signature")).select("signature", "conversations", "__s.*"))
    out = lasting(meet(signed, solved, ["signature"], "conversations", signed.count()).drop("conversations"))
    forget(faulty, signed, solved)
    return out


def _stay(rows: DataFrame) -> DataFrame:
    """(k, turn, role, th, text): the rows of which some may stay, each role and text of a conversation once, where it comes first."""
    said = rows.where(F.regexp_like("text", F.lit(SPACE)))
    each = said.groupBy(_key(), "role", "text").agg(F.min("turn").alias("t1"), F.max(F.col("turn").isNull()).alias("null1"))
    return each.select("k", F.when(~F.col("null1"), F.col("t1")).alias("turn"), "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("th"), "text")


def _replay(stream: Iterator[tuple]) -> Iterator[tuple[str, str | None, str | None]]:
    """(k, role, text) of the repaired rows of conversations that come as an audit and then their rows; (k, None, None) ends each."""
    now = None
    todo: Iterator[str] = iter(())
    codes: Iterator[str] = iter(())
    state = EMPTY
    for k, kind, signature, audit, role, text in stream:
        if kind == 0:
            if now is not None:
                yield from _rest(now, todo, codes, state)
            now, todo, codes, state = k, iter(audit or ""), iter(signature or ""), EMPTY
            continue
        for letter in todo:
            if letter == "I":
                state = NEXT[state]
                yield k, "user" if state == USER else "assistant", ""
                continue
            if (ord(next(codes)) - 65) % 4 in (BLANK, DUPLICATE):
                continue  # such rows are deleted, and do not come
            if letter == "R":
                state = NEXT[state]
                yield k, "user" if state == USER else "assistant", text
            elif letter == "K":
                state = SYSTEM if state == EMPTY and role.startswith("s") else NEXT[state]
                yield k, role, text
            break
    if now is not None:
        yield from _rest(now, todo, codes, state)


def _rest(k: str, todo: Iterator[str], codes: Iterator[str], state: int) -> Iterator[tuple]:
    for letter in todo:
        if letter == "I":
            state = NEXT[state]
            yield k, "user" if state == USER else "assistant", ""
    yield k, None, None


def _replayed(rows: DataFrame, audited: DataFrame, schema: str, told) -> DataFrame:
    """``told(repaired rows) -> batches`` over whole conversations, an audit before the rows of each."""
    head = audited.select("k", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("th"), "signature", "audit", F.lit("").alias("text"))
    body = _stay(rows).select("k", F.lit(1).alias("kind"), "turn", "role", "th", F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("audit"), "text")
    every = head.unionByName(body).repartition("k").sortWithinPartitions("k", "kind", *_order()).select("k", "kind", "signature", "audit", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for b in batches for row in zip(*[map(lambda x: x.as_py(), c) for c in b.columns], strict=True))
        yield from told(_replay(stream))

    return every.mapInArrow(run, schema)


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(k, place, role, text): the rows of each conversation after the edits of its audit, numbered from 0."""

    def told(stream: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out, place, size = [], 0, 0
        kinds = [("k", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]
        for k, role, text in stream:
            if role is None:
                place = 0
                continue
            out.append((k, place, role, text))
            place, size = place + 1, size + len(text)
            if len(out) >= 5000 or size >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    return _replayed(rows, audited, "k string, place long, role string, text string", told)


def hashes(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(k, repaired_sha256): of each conversation's repaired ``role:text`` rows with line feeds between, passed over row by row."""

    def told(stream: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out, h, sep = [], hashlib.sha256(), b""
        names = ["k", "repaired_sha256"]
        for k, role, text in stream:
            if role is not None:
                h.update(sep + f"{role}:{text}".encode())
                sep = b"\n"
                continue
            out.append((k, h.hexdigest()))
            h, sep = hashlib.sha256(), b""
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(2)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(2)], names)

    return _replayed(rows, audited, "k string, repaired_sha256 string", told)


def digest(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conv_id of ``turns``, whose rows after damage are ``rows``: gaps, faults, illegal neighbours, cost, audit and the hash of the repaired rows.

    A null id is a conversation as well. A conversation without rows has
    zeros, an empty audit and the hash of nothing. Repeated rows are
    duplicates. Rows of one turn are in order by role and the text's hash.
    """
    audited = audits(rows)
    told = audited.drop("signature").join(hashes(rows, audited), "k")
    every = turns.select("conv_id").groupBy("conv_id").agg(F.lit(1).alias("one")).select(_key(), "conv_id")
    out = every.join(told, "k", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
