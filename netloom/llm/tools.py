"""Tool-call linking for chat data, in DataFrame functions only.

Calls and results meet by identifier in a hash join, calls are put in an order
in which each comes after those that it needs, arguments are checked against
the tools' schemas, and every message becomes one line of canonical JSON: keys
sorted, no white space, numbers as they are.

The order is topological: a call's position is 0 if it needs no other, else one
more than the highest position that it needs. Nothing is gathered by
conversation: a message is a row throughout, and its place is (position, turn).
So a conversation of any length costs no task more than its share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, forget, lasting, meet, running, scratch

#: JSON types by the first word of a variant's SQL type.
TYPES = {
    "STRING": "string",
    "BIGINT": "integer",
    "DECIMAL": "number",
    "DOUBLE": "number",
    "BOOLEAN": "boolean",
    "OBJECT": "object",
    "ARRAY": "array",
    "VOID": "null",
}
MOST_TOOLS = 10_000
#: Calls of a conversation that one row holds while their levels are found.
BLOCK = 256


def canonical(x: Column) -> Column:
    """A struct, map or array as canonical JSON."""
    return F.to_json(F.parse_json(F.to_json(x)))


def _rounds(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(call_id, position): 0 for a call that needs none of ``edges``, else one more than the highest that it needs.

    Every round gives a position to the calls whose needs all have one. Calls on a circle, or behind one, have no row.
    """
    open_ = lasting(edges)
    done = calls.select("call_id").join(open_.select("call_id").distinct(), "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("position"))
    done = fresh = lasting(done)
    level = 0
    while not open_.isEmpty():
        level += 1
        # Of what is open, needs that got their place in the last round go; calls without another are next.
        left = open_.join(fresh.select(F.col("call_id").alias("need")), "need", "left_anti")
        ready = open_.select("call_id").distinct().join(left.select("call_id").distinct(), "call_id", "left_anti")
        fresh = lasting(ready.select("call_id", F.lit(level).cast("long").alias("position")))
        if fresh.isEmpty():
            break
        open_ = lasting(left)
        done = lasting(done.unionByName(fresh))
    return done


def _blocks(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(call_id, level) where every one of ``edges`` (call_id, need) leads to an earlier turn of the call's conversation.

    A conversation's calls are numbered by turn and taken in blocks of BLOCK.
    A round settles one block of every conversation: what its calls need
    outside has a level already, and within the block one fold in the order of
    turns finds the rest. So rounds are as many as the longest conversation
    has blocks, and no row holds more than a block.
    """
    cell = F.floor(F.coalesce("turn", F.lit(0)) / BLOCK).cast("long")
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")
    rows = calls.select("call_id", conv, "turn", cell.alias("cell"))
    sums = rows.groupBy("conv", "cell").agg(F.count(F.lit(1)).alias("n"))
    least = sums.groupBy("conv").agg(F.min("cell").alias("c0"))
    sums = sums.join(least, "conv").withColumn("bucket", F.col("cell") - F.col("c0"))
    before = running(sums, ["conv"], "bucket", "n").join(least, "conv").select("conv", (F.col("bucket") + F.col("c0")).alias("cell"), "before")
    within = F.row_number().over(Window.partitionBy("conv", "cell").orderBy("turn", "call_id")) - 1
    rows = rows.withColumn("at", within).join(before, ["conv", "cell"]).withColumn("at", F.col("at") + F.col("before"))
    rows = lasting(rows.select("call_id", "conv", F.floor(F.col("at") / BLOCK).alias("block"), (F.col("at") % BLOCK).cast("int").alias("place")))
    of = rows.select(F.col("call_id").alias("need"), F.col("block").alias("need_block"), F.col("place").alias("need_place"))
    asked = edges.join(of.join(edges.groupBy("need").agg(F.count(F.lit(1)).alias("uses")), "need"), "need")
    asked = lasting(asked.join(rows.select("call_id", "block"), "call_id").select("call_id", "block", "need", "need_block", "need_place"))
    known, done = rows.limit(0).select("call_id", F.lit(0).cast("long").alias("least")), []
    for b in range((rows.agg(F.max("block")).first()[0] or 0) + 1):
        mine = rows.where(F.col("block") == b)
        inner = asked.where((F.col("block") == b) & (F.col("need_block") == b)).groupBy("call_id").agg(F.collect_list("need_place").alias("inner"))
        each = mine.join(inner, "call_id", "left").join(known, "call_id", "left")
        one = F.struct("place", F.coalesce("inner", F.array().cast("array<int>")).alias("inner"), F.coalesce("least", F.lit(0).cast("long")).alias("least"), "call_id")
        lists = each.groupBy("conv").agg(F.array_sort(F.collect_list(one)).alias("xs"))
        step = lambda acc, x: F.concat(acc, F.array(F.greatest(x["least"], F.coalesce(F.array_max(F.transform(x["inner"], lambda i: F.get(acc, i))), F.lit(-1).cast("long")) + 1)))
        found = F.aggregate("xs", F.array().cast("array<bigint>"), step)
        settled = lists.select(F.explode(F.arrays_zip(F.transform("xs", lambda x: x["call_id"]).alias("call_id"), found.alias("level"))).alias("z")).select("z.call_id", "z.level")
        settled = lasting(settled)
        done.append(settled)
        # What calls of later blocks now know of those that they need.
        more = asked.where((F.col("need_block") == b) & (F.col("block") > b)).join(settled.withColumnRenamed("call_id", "need"), "need").select("call_id", (F.col("level") + 1).alias("least"))
        known = lasting(known.unionByName(more).groupBy("call_id").agg(F.max("least").alias("least")))
    return reduce(DataFrame.unionByName, done)


def _edges(calls: DataFrame) -> DataFrame:
    """(call_id, need, need_turn, late) for each need that is a call; late unless it is an earlier turn of the same conversation."""
    at = calls.select(F.col("call_id").alias("need"), F.col("conv_id").alias("__conv"), F.col("turn").alias("need_turn"))
    asked = lasting(calls.select("call_id", "conv_id", "turn", F.explode(F.array_distinct("needs")).alias("need")))
    # Any number of calls may need the same one.
    edges = meet(asked, at.join(asked.groupBy("need").agg(F.count(F.lit(1)).alias("uses")), "need"), ["need"], "uses", asked.count())
    early = F.col("conv_id").eqNullSafe(F.col("__conv")) & F.coalesce(F.col("need_turn") < F.col("turn"), F.lit(False))
    return lasting(edges.select("call_id", "need", "need_turn", (~early).alias("late")))


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of distinct calls (call_id, conv_id, turn, needs): the topological level, 0 if it needs none.

    A need that the latest need of a call has too adds nothing to its level.
    Where that leaves each call one need, and an earlier turn of its
    conversation, levels are depths in a forest and found by pointer doubling,
    in as many rounds as the longest chain has binary digits. Groups of
    connected calls in which some call has more needs take as many rounds as
    their longest conversation has blocks of BLOCK calls. Those with late
    needs take rounds as many as their longest chain. Needs that are no call are ignored.
    Calls on a circle, or behind one, have no row.
    """
    edges = _edges(calls)
    up = lasting(edges.groupBy("call_id").agg(F.max(F.struct("need_turn", "need"))["need"].alias("up")))
    other = edges.join(up, "call_id").where("need != up")
    wide = other.join(edges.select(F.col("call_id").alias("up"), "need"), ["up", "need"], "left_anti")
    late = lasting(edges.where("late").select(F.explode(F.array("call_id", "need")).alias("node")).distinct())
    wide = lasting(wide.select(F.col("call_id").alias("node")).distinct())
    found = []
    if not late.isEmpty() or not wide.isEmpty():
        group = lasting(connected_components(edges, "call_id", "need"))
        of = lambda ends: lasting(group.join(group.join(ends, "node").select("root").distinct(), "root", "left_semi").select(F.col("node").alias("call_id")).unionByName(ends.select(F.col("node").alias("call_id"))).distinct())
        bad = of(late)
        many = lasting(of(wide).join(bad, "call_id", "left_anti"))
        pick = lambda ids: (calls.join(ids, "call_id", "left_semi"), edges.join(ids, "call_id", "left_semi").select("call_id", "need"))
        if not bad.isEmpty():
            found.append(_rounds(*pick(bad)).withColumnRenamed("position", "level"))
        if not many.isEmpty():
            found.append(_blocks(*pick(many)))
        calls = calls.join(bad, "call_id", "left_anti").join(many, "call_id", "left_anti")
    now = lasting(calls.select("call_id").join(up, "call_id", "left").withColumn("level", F.col("up").isNotNull().cast("long")))
    while n := now.where("up IS NOT NULL").count():
        # Every pointer leaps to where the call that it points at points; that call's own way is added. In the end all of a group point at one.
        over = now.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        open_ = now.where("up IS NOT NULL")
        leapt = meet(open_, over.join(open_.groupBy("up").agg(F.count(F.lit(1)).alias("uses")), "up"), ["up"], "uses", n)
        leapt = leapt.select("call_id", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"))
        after = lasting(now.where("up IS NULL").unionByName(leapt))
        forget(now)
        now = after
    return reduce(DataFrame.unionByName, found, now.select("call_id", "level"))


def _checked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``doc``, the arguments as a variant, and ``problems``, what is wrong with them by ``types`` and ``required``, sorted.

    The arguments are parsed once, and each value's type is told once.
    """
    rows = rows.withColumn("doc", F.try_parse_json("arguments"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT")), F.lit(False))
    values = F.from_json(F.when(is_object, F.col("arguments")), "map<string,variant>")
    rows = rows.withColumn("kinds", F.transform_values(values, lambda k, v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)))
    kind_of = lambda k: F.element_at("kinds", k)
    right = lambda k, want: F.reduce(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in TYPES.items()]), F.lit(False), lambda ok, t: ok | ((t["a"] == kind_of(k)) & ((t["b"] == want) | ((want == "number") & (t["b"] == "integer")))))
    given = F.map_keys("kinds")
    absent = F.array_except("required", given)
    strange = F.array_except(given, F.map_keys("types"))
    wrong = F.filter(F.array_intersect(given, F.map_keys("types")), lambda k: ~right(k, F.element_at("types", k)))
    say = lambda what, keys: F.transform(keys, lambda k: F.concat(F.lit(what), k))
    found = F.array_sort(F.concat(say("missing:", absent), say("type:", wrong), say("unknown:", strange)))
    problems = F.when(F.col("types").isNull(), F.array(F.lit("tool"))).when(F.col("kinds").isNull(), F.array(F.lit("arguments"))).otherwise(found)
    return rows.withColumn("problems", F.when(F.col("copies").isNotNull(), problems).otherwise(F.array().cast("array<string>"))).drop("kinds")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame, every: bool = False, at: str = "position") -> DataFrame:
    """One row for each call, and one for each result that names no call; with ``every``, one also for each further row.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), needs
    (array<string>). ``results``: conv_id, turn, call_id, content. ``schemas``:
    name, param, type (of JSON), required. Returns conv_id, turn, call_id,
    name, position (see ``levels``; ``at`` names the column, and the key in the
    JSON), status, problems (array), result_turn, copies, json.

    A tool's row without a param says that the tool is there; of rows that
    repeat a param the least type counts, and it is required if any says so.
    Rows without a name are ignored.

    Calls that repeat an identifier count as one, the first by conversation and
    turn, and ``copies`` tells how many calls there were; of results the first
    counts. Null identifiers link to nothing: such calls are ``unnamed``.
    status: unnamed, orphan (a result without a call), cycle (no order exists),
    invalid (see problems), open (no result), linked. Invalid JSON is a
    problem, not an error. Other columns are ignored.

    Without ``every``, further calls and results of an identifier and results
    without one have no row. With it each has its own: the further ones with
    status ``repeat`` and their ``rank`` from 2 (a column more, and in the
    JSON), results without an identifier with status ``unnamed``. A row of a
    result has its turn as result_turn and no copies.
    """
    place = ["conv_id", "turn"]
    named = calls.where(F.col("call_id").isNotNull())
    one = lambda df, cols: df.groupBy("call_id").agg(F.min(F.struct(*place, *cols)).alias("m"), F.count(F.lit(1)).alias("copies"))
    first = one(named.withColumn("needs", F.coalesce("needs", F.array().cast("array<string>"))), ["name", "arguments", "needs"])
    first = lasting(first.select("call_id", "copies", "m.*"))
    got = one(results.where(F.col("call_id").isNotNull()), ["content"])
    if every:
        got = lasting(got)
    many = got.where("copies > 1").select("call_id")
    got = got.select("call_id", F.col("m.conv_id").alias("result_conv"), F.col("m.turn").alias("result_turn"), F.col("m.content").alias("content"))
    with scratch() as tables:
        order = tables.keep(lasting(levels(first.select("call_id", "conv_id", "turn", "needs")).withColumnRenamed("level", at)))
    params = schemas.where("name IS NOT NULL").groupBy("name", "param").agg(F.min("type").alias("type"), F.max("required").alias("required"))
    tools = params.groupBy("name").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("param").isNotNull(), F.struct("param", "type")))).alias("types"),
        F.sort_array(F.collect_list(F.when(F.col("required"), F.col("param")))).alias("required"),
    )
    tools = lasting(tools)

    joined = first.join(got.hint("shuffle_hash"), "call_id", "full").join(order, "call_id", "left")
    called = F.col("copies").isNotNull()
    joined = joined.withColumns({"conv_id": F.coalesce("conv_id", "result_conv"), "turn": F.coalesce("turn", "result_turn")})
    unnamed = calls.where(F.col("call_id").isNull()).select(*place, "call_id", "name", "arguments", F.lit(1).cast("long").alias("copies"))
    rows = joined.select(*place, "call_id", "copies", "name", "arguments", at, "result_turn", "content").unionByName(unnamed, allowMissingColumns=True)
    if every:
        # Only identifiers that repeat are ranked.
        ranked = lambda df, ids, cols: df.join(ids, "call_id", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("call_id").orderBy(*place, *cols))).where("rank > 1")
        calls2 = ranked(named.withColumn("needs", F.coalesce("needs", F.array().cast("array<string>"))), first.where("copies > 1").select("call_id"), ["name", "arguments", "needs"])
        calls2 = calls2.select(*place, "call_id", "name", "arguments", F.lit(1).cast("long").alias("copies"), "rank")
        results2 = ranked(results, many, ["content"]).unionByName(results.where(F.col("call_id").isNull()), allowMissingColumns=True)
        results2 = results2.select(*place, "call_id", F.col("turn").alias("result_turn"), "content", "rank")
        rows = rows.unionByName(calls2, allowMissingColumns=True).unionByName(results2, allowMissingColumns=True)
    else:
        rows = rows.withColumn("rank", F.lit(None).cast("int"))
    if tools.count() <= MOST_TOOLS:
        rows = rows.join(F.broadcast(tools), "name", "left")
    else:
        rows = lasting(rows)
        uses = tools.join(rows.groupBy("name").agg(F.count(F.lit(1)).alias("uses")), "name")
        others = rows.join(tools.select("name"), "name", "left_anti")
        rows = meet(rows, uses, ["name"], "uses", rows.count()).drop("uses").unionByName(others, allowMissingColumns=True)
    rows = _checked(rows)
    status = (
        F.when(F.col("rank").isNotNull(), "repeat")
        .when(F.col("call_id").isNull(), "unnamed")
        .when(~called, "orphan")
        .when(F.col(at).isNull(), "cycle")
        .when(F.size("problems") > 0, "invalid")
        .when(F.col("result_turn").isNull(), "open")
        .otherwise("linked")
    )
    rows = rows.withColumn("status", status)
    body = F.struct(
        F.coalesce("doc", F.to_variant_object(F.array("arguments"))).alias("arguments"),
        F.col("call_id").alias("id"),
        "name",
        at,
        "rank",
        F.col("content").alias("result"),
        "status",
    )
    more = ["rank"] if every else []
    return rows.select(*place, "call_id", "name", at, "status", "problems", "result_turn", "copies", *more, canonical(body).alias("json"))


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chat turns (conv_id, turn, role, text) as calls and results.

    A user's turn calls ``answer`` and a system turn calls ``instruct``; any
    other turn is the result of the turn before it. A call needs those of turn
    0 and of the two turns before it that are calls. Arguments are the text and the turn:
    as a string where the number of characters is a multiple of 7, and with
    that number where it is a multiple of 5, so that some arguments break the
    schemas. Turns without a conversation or a number have no identifier.
    """
    ident = lambda turn: F.md5(F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string")).cast("binary"))
    turn = F.col("turn")
    asks = F.col("role").isin("user", "system")
    text = F.coalesce("text", F.lit(""))
    n = F.char_length(text)
    given = [text.alias("prompt"), F.when(n % 7 != 0, turn).alias("turn"), F.when(n % 5 == 0, n).alias("n_chars")]
    arguments = F.when(n % 7 == 0, F.to_json(F.struct(given[0], turn.cast("string").alias("turn"), given[2]))).otherwise(F.to_json(F.struct(*given)))
    calls = messages.where(asks).select(
        "conv_id", "turn", ident(turn).alias("call_id"), F.when(F.col("role") == "user", "answer").otherwise("instruct").alias("name"), arguments.alias("arguments"),
        F.when(turn > 0, F.array(ident(F.lit(0)), ident(turn - 1), ident(turn - 2))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    results = messages.where(~F.coalesce(asks, F.lit(False))).select("conv_id", "turn", ident(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


#: The tools of ``turns_as_calls``; ``instruct`` asks for a tone that no call gives.
TURN_TOOLS = [
    ("answer", "prompt", "string", True),
    ("answer", "turn", "integer", True),
    ("instruct", "prompt", "string", True),
    ("instruct", "turn", "integer", True),
    ("instruct", "tone", "string", True),
]
