"""Queries over the relational operators, each with the SQL that says what it must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..decoders import smb
from ..functions import binary, fingerprints, text, times
from ..operators import files, filters, gather, joins, sequence, tree
from ..registry import query


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _events(spark, sf_dir) -> DataFrame:
    """Events as packets: a flow, a side, a length, and microseconds."""
    e = _t(spark, sf_dir, "events")
    return e.withColumns({"us": _micros("ts"), "side": F.col("event_type").isin("click", "view"), "len": F.length("props").cast("long")})


EVENTS = "(SELECT *, epoch_us(ts) AS us, event_type IN ('click', 'view') AS side, CAST(length(props) AS BIGINT) AS len FROM events)"


# --- trees


@query(
    "sortby_tree",
    """SELECT grouping_id_depth AS depth, r_name, n_name, c_mktsegment, files, first_id, last_id FROM (
      SELECT 3 - (grouping(r_name) + grouping(n_name) + grouping(c_mktsegment)) AS grouping_id_depth, r_name, n_name, c_mktsegment,
        count(*) AS files, min(c_custkey) AS first_id, max(c_custkey) AS last_id
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment))""",
)
def sortby_tree(spark, sf_dir):
    c, n, r = (_t(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    files = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return tree.levels(files, ["r_name", "n_name", "c_mktsegment"], {"files": F.count(F.lit(1)), "first_id": F.min("c_custkey"), "last_id": F.max("c_custkey")})


@query(
    "sortby_missing_sentinel",
    """SELECT lang, quality, count(*) AS files FROM (SELECT lang, coalesce(CAST(quality AS VARCHAR), 'PROP_NOT_AVAIL') AS quality
      FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang, quality""",
)
def sortby_missing_sentinel(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return tree.levels(d, ["lang", "quality"], {"files": F.count(F.lit(1))}).where("depth = 2").select("lang", "quality", "files")


@query(
    "tree_times",
    """SELECT 2 - (grouping(event_type) + grouping(user_id)) AS depth, event_type, user_id, files, modified, changed FROM (
      SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, ts FROM events) GROUP BY ROLLUP (event_type, user_id) """.replace(
        "files, modified, changed", "count(*) AS files, max(ts) AS modified, min(ts) AS changed"
    ),
)
def tree_times(spark, sf_dir):
    return tree.levels(_t(spark, sf_dir, "events"), ["event_type", "user_id"], {"files": F.count(F.lit(1)), "modified": F.max("ts"), "changed": F.min("ts")})


@query(
    "server_tree_times",
    """SELECT 2 - (grouping(seg) + grouping(pri)) AS depth, seg, pri, max(o_orderdate) AS accessed, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS modified,
      max(o_orderdate) FILTER (WHERE o_orderstatus = 'O') AS changed FROM (SELECT c_mktsegment AS seg, o_orderpriority AS pri, o_orderdate, o_orderstatus
      FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ROLLUP (seg, pri)""",
)
def server_tree_times(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    of = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderdate")))
    o = o.select(F.col("c_mktsegment").alias("seg"), F.col("o_orderpriority").alias("pri"), "o_orderdate", "o_orderstatus")
    return tree.levels(o, ["seg", "pri"], {"accessed": F.max("o_orderdate"), "modified": of("F"), "changed": of("O")})


@query(
    "path_closure",
    """WITH p AS (SELECT DISTINCT list_filter(string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/'), lambda x: x <> '') AS l FROM pages),
    e AS (SELECT DISTINCT l[1:k] AS d, k FROM (SELECT l, unnest(range(1, len(l) + 1)) AS k FROM p))
    SELECT '/' || array_to_string(d, '/') AS dir, '/' || array_to_string(d[1:k-1], '/') AS parent, k AS depth FROM e""",
)
def path_closure(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("p"))
    return tree.closure(p, "p").withColumn("depth", F.col("depth").cast("long"))


@query("dir_page", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 50 OFFSET 100")
def dir_page(spark, sf_dir):
    return tree.page(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 100, 50)


@query("path_dedup", "SELECT source, md5(text) AS name, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY source, md5(text)")
def path_dedup(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("source", F.md5(F.col("text").cast("binary")).alias("name"), "doc_id")
    return files.once_named(d, "source", "name", "doc_id")


# --- sequences


@query(
    "direction_breaks",
    f"""SELECT user_id, ts, event_id, side, "offset" FROM (SELECT *, CAST(coalesce(sum(len) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
      lag(side) OVER w AS before FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE before IS DISTINCT FROM side""",
)
def direction_breaks(spark, sf_dir):
    return sequence.direction_breaks(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "side", "len")


@query(
    "message_runs",
    f"""WITH b AS (SELECT user_id, ts, event_id, side, "offset" FROM (SELECT *, CAST(coalesce(sum(len) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
      lag(side) OVER w AS before FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE before IS DISTINCT FROM side),
    t AS (SELECT user_id, CAST(sum(length(props)) AS BIGINT) AS size FROM events GROUP BY user_id)
    SELECT user_id, side, "offset", row_number() OVER w - 1 AS run, coalesce(lead("offset") OVER w, size) - "offset" AS length
    FROM b JOIN t USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY "offset")""",
)
def message_runs(spark, sf_dir):
    e = _events(spark, sf_dir)
    runs = sequence.message_runs(direction_breaks(spark, sf_dir), ["user_id"], e.groupBy("user_id").agg(F.sum("len").alias("size")))
    return runs.select("user_id", "side", "offset", F.col("run").cast("long"), "length")


@query(
    "anchored_sessions",
    f"""WITH RECURSIVE o AS (SELECT user_id, event_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM {EVENTS}),
    s AS (SELECT user_id, event_id, us, k, 0 AS session, us AS anchor FROM o WHERE k = 1
      UNION ALL SELECT o.user_id, o.event_id, o.us, o.k, CASE WHEN o.us - s.anchor >= 43200000000 THEN s.session + 1 ELSE s.session END,
        CASE WHEN o.us - s.anchor >= 43200000000 THEN o.us ELSE s.anchor END FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)
    SELECT user_id, event_id, CAST(session AS BIGINT) AS session, anchor FROM s""",
)
def anchored_sessions(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_id", "us")
    return sequence.anchored_sessions(e, ["user_id"], "us", 12 * 3600 * 1_000_000, "event_id").drop("us")


@query(
    "stream_concat",
    "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS content_md5, sum(length(text)) AS size, min(turn) AS first_turn, arg_min(role, turn) AS initiator FROM conversations GROUP BY conv_id",
)
def stream_concat(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "")
    return c.groupBy("conv_id").agg(
        F.md5(whole.cast("binary")).alias("content_md5"), F.sum(F.char_length("text")).alias("size"), F.min("turn").alias("first_turn"), F.min_by("role", "turn").alias("initiator")
    )


@query(
    "inherit_request",
    """SELECT conv_id, turn, md5(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS request FROM conversations""",
)
def inherit_request(spark, sf_dir):
    c = sequence.carry_last(_t(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("text")), "r")
    return c.select("conv_id", "turn", F.md5(F.col("r").cast("binary")).alias("request"))


@query(
    "request_response",
    """SELECT a.conv_id, a.turn, b.turn AS answer_turn, length(b.text) AS answer_chars, c.turn AS next_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
      LEFT JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 2 WHERE a.role = 'user' AND b.role = 'assistant'""",
)
def request_response(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _t(spark, sf_dir, "conversations")
    after = {f"{n}{k}": F.lead(n, k).over(w) for n, k in (("turn", 1), ("role", 1), ("text", 1), ("turn", 2))}
    c = c.withColumns(after).where("role = 'user' AND role1 = 'assistant' AND turn1 = turn + 1")
    return c.select("conv_id", "turn", F.col("turn1").alias("answer_turn"), F.char_length("text1").cast("long").alias("answer_chars"), F.col("turn2").alias("next_turn"))


@query(
    "running_offsets",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM lineitem""",
)
def running_offsets(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return sequence.running_offset(l, ["l_orderkey"], order, F.col("l_quantity").cast("long")).select("l_orderkey", "l_linenumber", "l_partkey", "offset")


@query(
    "version_islands",
    """SELECT user_id, event_type, CAST(island AS BIGINT) AS island, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (
      SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM (
        SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL""",
)
def version_islands(spark, sf_dir):
    v = sequence.islands(_t(spark, sf_dir, "events"), ["user_id"], ["ts"], "event_type")
    return v.withColumn("island", F.col("island").cast("long"))


@query(
    "version_files",
    """WITH i AS (SELECT user_id, event_type, CAST(island AS BIGINT) AS island, min(ts) AS first FROM (
      SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM (
        SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, event_type, island)
    SELECT user_id, first, event_type || CASE WHEN count(*) OVER (PARTITION BY user_id, event_type) > 1 THEN '@' || (row_number() OVER (PARTITION BY user_id, event_type ORDER BY first) - 1) ELSE '' END AS name FROM i""",
)
def version_files(spark, sf_dir):
    v = sequence.islands(_t(spark, sf_dir, "events"), ["user_id"], ["ts"], "event_type")
    per = Window.partitionBy("user_id", "event_type")
    number = F.row_number().over(per.orderBy("first")) - 1
    name = F.when(F.count(F.lit(1)).over(per) > 1, F.concat("event_type", F.lit("@"), number.cast("string"))).otherwise(F.col("event_type"))
    return v.select("user_id", "first", name.alias("name"))


WRITES = """(SELECT file, op, CASE WHEN op % 3 = 1 THEN 0 WHEN l_returnflag = 'R' THEN 7
  ELSE CAST(coalesce(sum(len) OVER (PARTITION BY file, (op - 1) // 3 ORDER BY op ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS pos, len
  FROM (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS op, CAST(l_quantity AS BIGINT) AS len, l_returnflag FROM lineitem))"""


@query(
    "append_versions",
    f"""WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY op) AS k FROM {WRITES}),
    s AS (SELECT file, op, k, CASE WHEN pos = 0 THEN 0 ELSE -1 END AS version, CASE WHEN pos = 0 THEN len ELSE 0 END AS size, CASE WHEN pos = 0 THEN 1 ELSE 0 END AS applied FROM w WHERE k = 1
      UNION ALL SELECT w.file, w.op, w.k, CASE WHEN w.pos = 0 THEN s.version + 1 ELSE s.version END,
        CASE WHEN w.pos = 0 THEN w.len WHEN s.version >= 0 AND w.pos = s.size THEN s.size + w.len ELSE s.size END,
        CASE WHEN w.pos = 0 OR (s.version >= 0 AND w.pos = s.size) THEN 1 ELSE 0 END FROM s JOIN w ON w.file = s.file AND w.k = s.k + 1)
    SELECT file, CAST(op AS BIGINT) AS op, CAST(version AS BIGINT) AS version, CAST(size AS BIGINT) AS size, CAST(applied AS BIGINT) AS applied FROM s""",
)
def append_versions(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    l = _t(spark, sf_dir, "lineitem").withColumn("op", F.row_number().over(order).cast("long"))
    l = l.select(F.col("l_orderkey").alias("file"), "op", F.col("l_quantity").cast("long").alias("len"), "l_returnflag")
    w = Window.partitionBy("file", F.floor((F.col("op") - 1) / 3)).orderBy("op").rowsBetween(Window.unboundedPreceding, -1)
    pos = F.when(F.col("op") % 3 == 1, F.lit(0)).when(F.col("l_returnflag") == "R", F.lit(7)).otherwise(F.coalesce(F.sum("len").over(w), F.lit(0)))
    l = l.withColumn("pos", pos.cast("long")).drop("l_returnflag")
    return sequence.append_versions(l, ["file"], ["op"], "pos", "len").drop("pos", "len")


@query(
    "carry_state",
    """SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS port FROM events""",
)
def carry_state(spark, sf_dir):
    e = sequence.carry_last(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.floor("value").cast("long")), "port", True)
    return e.select("user_id", "event_id", "port")


# --- joins


@query(
    "asof_prev",
    f"""SELECT a.event_id, b.event_id AS near_event_id, b.us AS near_us FROM {EVENTS} a ASOF LEFT JOIN (SELECT user_id, event_id, us FROM {EVENTS} WHERE event_type = 'purchase') b
      ON a.user_id = b.user_id AND a.us >= b.us WHERE a.event_type <> 'purchase'""",
)
def asof_prev(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_id", "us", "event_type")
    out = joins.asof(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"), ["user_id"], "us", ["event_id"])
    return out.select("event_id", "near_event_id", "near_us")


@query(
    "asof_next",
    f"""SELECT a.event_id, b.event_id AS near_event_id, b.us AS near_us FROM {EVENTS} a ASOF LEFT JOIN (SELECT user_id, event_id, us FROM {EVENTS} WHERE event_type = 'purchase') b
      ON a.user_id = b.user_id AND a.us <= b.us WHERE a.event_type <> 'purchase'""",
)
def asof_next(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_id", "us", "event_type")
    out = joins.asof(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"), ["user_id"], "us", ["event_id"], forward=True)
    return out.select("event_id", "near_event_id", "near_us")


@query(
    "interval_slot",
    f"""SELECT event_id, slot_id FROM (SELECT p.event_id, s.event_id AS slot_id, row_number() OVER (PARTITION BY p.event_id ORDER BY s.event_id) AS r FROM {EVENTS} p JOIN {EVENTS} s
      ON p.user_id = s.user_id AND s.event_type = 'purchase' AND p.us BETWEEN s.us AND s.us + 21600000000 WHERE p.event_type <> 'purchase') WHERE r = 1""",
)
def interval_slot(spark, sf_dir):
    e = _events(spark, sf_dir)
    slots = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("slot_id"), F.col("us").alias("lo"), (F.col("us") + 21_600_000_000).alias("hi"))
    points = e.where("event_type <> 'purchase'").select("user_id", "event_id", "us")
    return joins.first_interval(points, slots, ["user_id"], "us", "lo", "hi", "slot_id", 21_600_000_000).select("event_id", "slot_id")


@query("key_lookup", "SELECT d.doc_id, coalesce('q' || CAST(quality AS VARCHAR), 'treeId_' || d.doc_id) AS tree FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def key_lookup(spark, sf_dir):
    l = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("v"))
    d = _t(spark, sf_dir, "documents").select("doc_id")
    return joins.lookup(d.withColumnRenamed("doc_id", "k"), l, "k", "v", F.concat(F.lit("treeId_"), F.col("k").cast("string")), "tree").withColumnRenamed("k", "doc_id")


@query(
    "theta_keys",
    "SELECT s_suppkey, n_nationkey FROM (SELECT s_suppkey, n_nationkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY n_nationkey) AS r FROM supplier JOIN nation ON (s_suppkey * 7 + n_nationkey) % 11 = 3) WHERE r = 1",
)
def theta_keys(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.pmod(3 - F.col("s_suppkey") * 7, F.lit(11)).alias("mark"))
    n = _t(spark, sf_dir, "nation").select("n_nationkey", F.pmod(F.col("n_nationkey").cast("long"), F.lit(11)).alias("mark"))
    return files.first_opening(s, n, ["mark"], "n_nationkey").drop("mark")


@query(
    "both_directions",
    """SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, s_nationkey AS a, c_custkey, c_nationkey AS b FROM supplier JOIN customer ON s_suppkey = c_custkey) x
      WHERE EXISTS (SELECT 1 FROM nation WHERE (n_nationkey = a AND n_regionkey = b) OR (n_nationkey = b AND n_regionkey = a))""",
)
def both_directions(spark, sf_dir):
    pairs = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "customer"), F.col("s_suppkey") == F.col("c_custkey"))
    pairs = pairs.select("s_suppkey", "c_custkey", F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"))
    return joins.either_way(pairs, _t(spark, sf_dir, "nation"), "a", "b", "n_nationkey", "n_regionkey").select("s_suppkey", "c_custkey")


@query("anti_parsed", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_parsed(spark, sf_dir):
    return files.without(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), ["doc_id"])


@query("semi_known", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0)")
def semi_known(spark, sf_dir):
    return files.among(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels").where("toxic = 0"), ["doc_id"])


@query("client_sets", "SELECT o_orderpriority, o_custkey FROM (SELECT DISTINCT o_orderpriority, o_custkey FROM orders)")
def client_sets(spark, sf_dir):
    return files.members(_t(spark, sf_dir, "orders"), ["o_orderpriority"], "o_custkey")


@query(
    "union_first_wins",
    """SELECT k, CAST(d AS TIMESTAMP) AS d, src FROM (SELECT k, d, src, row_number() OVER (PARTITION BY k ORDER BY p, d) AS r FROM (
      SELECT l_orderkey AS k, l_shipdate AS d, 'line' AS src, 0 AS p FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT o_orderkey, o_orderdate, 'order', 1 FROM orders)) WHERE r = 1""",
)
def union_first_wins(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("d"), F.lit("line").alias("src"))
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"), F.lit("order").alias("src"))
    return joins.union_first([l, o], ["k"])


@query("replaced_minus", "SELECT doc_id, lang FROM documents EXCEPT SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def replaced_minus(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    return files.without(d, _t(spark, sf_dir, "labels").where("quality = 1"), ["doc_id"]).distinct()


# --- versions and times


@query(
    "snapshot_latest",
    """SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01') WHERE r = 1""",
)
def snapshot_latest(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return joins.latest(o, ["o_custkey"], "o_orderdate", F.lit("1995-06-01").cast(o.schema["o_orderdate"].dataType), "o_orderkey")


@query(
    "timestamp_modes",
    """SELECT o_orderkey, o_orderdate AS network, max(l_shipdate) AS fs, greatest(o_orderdate, max(l_shipdate)) AS hybrid FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate""",
)
def timestamp_modes(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("fs"))
    return files.clocks(_t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("network")), l, ["o_orderkey"])


@query(
    "hybrid_skew",
    """WITH f AS (SELECT l_orderkey, min(l_shipdate) AS first FROM lineitem GROUP BY 1) SELECT o_orderkey, (epoch_us(first) - epoch_us(o_orderdate)) // 1000000 AS skew_s, first AS hybrid FROM orders JOIN f ON o_orderkey = l_orderkey""",
)
def hybrid_skew(spark, sf_dir):
    f = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first"))
    j = _t(spark, sf_dir, "orders").join(f, "o_orderkey")
    return j.select("o_orderkey", files.skew(_micros("first"), _micros("o_orderdate")).alias("skew_s"), F.col("first").alias("hybrid"))


@query("capture_window", "SELECT event_type, min(ts) AS first, max(ts) AS last, max(ts) >= TIMESTAMP '2024-01-30' AS covers FROM events GROUP BY event_type")
def capture_window(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return files.window(e, ["event_type"], "ts", F.lit("2024-01-30").cast(e.schema["ts"].dataType))


@query("file_ids", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS file_id FROM events")
def file_ids(spark, sf_dir):
    return files.numbered(_t(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id")


# --- filters


@query("snip_inclusive", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 06:00:00'")
def snip_inclusive(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    at = lambda s: F.lit(s).cast(e.schema["ts"].dataType)
    return e.where(filters.snip(F.col("ts"), at("2024-01-05"), at("2024-01-12 06:00:00"))).select("event_id")


@query("snip_exclusive", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def snip_exclusive(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    at = lambda s: F.lit(s).cast(e.schema["ts"].dataType)
    return e.where(filters.snip(F.col("ts"), at("2024-01-05"), at("2024-01-12"), closed=False)).select("event_id")


@query("decode_rules", "SELECT event_id, (event_type = 'click' AND user_id = 7) OR (event_type = 'purchase') OR (user_id = 3 AND event_type = 'view') AS decode FROM events")
def decode_rules(spark, sf_dir):
    rules = [{"type": "click", "user": "7"}, {"type": "purchase"}, {"user": "3", "type": "view"}]
    props = {"type": F.col("event_type"), "user": F.col("user_id").cast("string")}
    return _t(spark, sf_dir, "events").select("event_id", filters.matches(rules, props).alias("decode"))


@query(
    "visibility",
    "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 0 AND toxic IS NULL AND n_chars BETWEEN 100 AND 5000",
)
def visibility(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return d.where(filters.visible(F.coalesce(F.col("quality") == 0, F.lit(False)), F.col("toxic").isNotNull(), filters.snip(F.col("n_chars"), F.lit(100), F.lit(5000)))).select("doc_id")


@query(
    "method_detect",
    "SELECT doc_id, regexp_matches(m, '^(GET|HEAD|POST|PUT|DELETE|TRACE|OPTIONS|CONNECT|PATCH|HTTP)') AND length(m) >= 7 AS http FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'GET /' WHEN 1 THEN 'HTTP/1.1' WHEN 2 THEN 'PUT' ELSE '' END || text AS m FROM documents)",
)
def method_detect(spark, sf_dir):
    start = F.element_at(F.array(F.lit("GET /"), F.lit("HTTP/1.1"), F.lit("PUT"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "documents").select("doc_id", filters.is_http(F.concat(start, F.col("text"))).alias("http"))


@query(
    "port_protocol",
    """SELECT event_id, CASE WHEN NOT side AND (sp = 53 OR dp = 53) THEN 'dns' WHEN NOT side AND sp IN (67, 68) THEN 'dhcp' WHEN side AND (sp = 22 OR dp = 22) THEN 'ssh' WHEN side AND (sp = 21 OR dp = 21) THEN 'ftpcontrol'
      WHEN side AND (sp = 443 OR dp = 443) THEN 'tls' WHEN side AND (sp = 445 OR dp = 445) THEN 'smb' END AS protocol FROM (
      SELECT *, [53, 67, 68, 22, 21, 443, 445, 80][CAST(event_id % 8 AS INT) + 1] AS sp, [53, 22, 443, 1000, 2000][CAST(user_id % 5 AS INT) + 1] AS dp FROM """
    + EVENTS
    + ")",
)
def port_protocol(spark, sf_dir):
    pick = lambda v, c: F.element_at(F.array(*map(F.lit, v)), (F.col(c) % len(v) + 1).cast("int"))
    e = _events(spark, sf_dir)
    return e.select("event_id", filters.application(F.when(F.col("side"), "tcp").otherwise("udp"), pick([53, 67, 68, 22, 21, 443, 445, 80], "event_id"), pick([53, 22, 443, 1000, 2000], "user_id")).alias("protocol"))


# --- scalar functions


@query("uri_filename", "SELECT page_id, regexp_extract(regexp_extract(url, '^[^? ;]*', 0), '[^/]*$', 0) AS name FROM pages")
def uri_filename(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.uri_filename(F.col("url")).alias("name"))


@query(
    "uri_dirs",
    """SELECT page_id, CAST(unnest(range(0, len(l))) AS BIGINT) AS pos, unnest(l) AS part FROM (
      SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS l FROM pages)""",
)
def uri_dirs(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").withColumn("p", text.url_path(F.col("url")))
    return p.select("page_id", F.posexplode(tree.path_parts("p")).alias("pos", "part")).withColumn("pos", F.col("pos").cast("long"))


@query("host_domain", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS domain FROM pages")
def host_domain(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.url_host(F.col("url")).alias("domain"))


@query(
    "display_name",
    """SELECT event_id, user_id || '-' || event_id || CASE WHEN value > 50 THEN '_0PAD' ELSE '' END || '_' || event_type || CASE WHEN side THEN '.meta' ELSE '' END AS name FROM """ + EVENTS,
)
def display_name(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("event_id", text.display_name(F.col("user_id"), F.col("event_id"), F.col("value") > 50, F.col("event_type"), F.when(F.col("side"), ".meta").otherwise("")).alias("name"))


@query("hex_roundtrip", "SELECT doc_id, lower(hex(encode(text))) AS hex, md5(text) AS back FROM documents")
def hex_roundtrip(spark, sf_dir):
    h = F.lower(F.hex(F.col("text").cast("binary")))
    return _t(spark, sf_dir, "documents").select("doc_id", h.alias("hex"), F.md5(F.unhex(h)).alias("back"))


@query("hex_roundtrip_text", "SELECT doc_id, lower(hex(encode(text))) AS hex, md5(text) AS back FROM documents")
def hex_roundtrip_text(spark, sf_dir):
    """As ``hex_roundtrip``, over whole texts."""
    h = F.lower(F.hex(F.col("text").cast("binary")))
    return _t(spark, sf_dir, "documents").select("doc_id", h.alias("hex"), F.md5(F.unhex(h)).alias("back"))


@query("filetime", "SELECT o_orderkey, (epoch_us(o_orderdate) // 1000000 + 11644473600) * 10000000 + 1234567 AS filetime, epoch_us(o_orderdate) // 1000000 AS seconds, epoch_us(o_orderdate) // 1000 AS millis FROM orders")
def filetime(spark, sf_dir):
    ft = times.to_filetime(times.whole_seconds(_micros("o_orderdate")), 1_234_567)
    return _t(spark, sf_dir, "orders").select("o_orderkey", ft.alias("filetime"), times.filetime_seconds(ft).alias("seconds"), F.floor(_micros("o_orderdate") / 1000).cast("long").alias("millis"))


@query("blocks", "SELECT doc_id, CAST(ceil(n_chars / 512.0) AS BIGINT) AS blocks, (n_chars + 7) // 8 * 8 AS padded FROM documents")
def blocks(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", files.blocks(F.col("n_chars")).alias("blocks"), files.padded(F.col("n_chars")).alias("padded"))


@query("pasv_port", "SELECT event_id, CAST((event_id * 37 % 65536) AS INT) AS port FROM events")
def pasv_port(spark, sf_dir):
    p = (F.col("event_id") * 37) % 65536
    say = F.format_string("227 Entering Passive Mode (10,0,0,%d,%d,%d).", F.col("user_id") % 255, F.floor(p / 256), p % 256)
    return _t(spark, sf_dir, "events").select("event_id", text.port_of_pair(say).alias("port"))


@query("epsv_port", "SELECT event_id, CAST((event_id * 41 % 65536) AS INT) AS port, 229 AS code FROM events")
def epsv_port(spark, sf_dir):
    say = F.format_string("229 Entering Extended Passive Mode (|||%d|)", (F.col("event_id") * 41) % 65536)
    return _t(spark, sf_dir, "events").select("event_id", text.port_of_bars(say).alias("port"), text.response_code(say).alias("code"))


@query(
    "mlsd_facts",
    "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS modified, o_orderstatus = 'F' AS is_dir, 'order ' || o_orderkey AS name FROM orders",
)
def mlsd_facts(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "dir").otherwise("file")
    line = F.concat(F.lit("Type="), kind, F.lit(";Modify="), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit(";UNIX.mode=0644; order "), F.col("o_orderkey").cast("string"))
    o = _t(spark, sf_dir, "orders")
    modified = F.to_timestamp_ntz(text.fact(F.col("line"), "modify"), F.lit("yyyyMMddHHmmss"))
    return o.withColumn("line", line).select("o_orderkey", modified.alias("modified"), (F.lower(text.fact(F.col("line"), "type")) == "dir").alias("is_dir"), text.fact_name(F.col("line")).alias("name"))


@query("enum_names", "SELECT event_id, CASE event_type WHEN 'click' THEN 'TREE_CONNECT' WHEN 'view' THEN 'CREATE' WHEN 'purchase' THEN 'CLOSE' ELSE 'UNKNOWN' END AS command FROM events")
def enum_names(spark, sf_dir):
    numbers = {"click": smb.TREE_CONNECT, "view": smb.CREATE, "purchase": smb.CLOSE}
    number = F.lit(-1)
    for kind, n in numbers.items():
        number = F.when(F.col("event_type") == kind, n).otherwise(number)
    return _t(spark, sf_dir, "events").select("event_id", smb.command_name(number).alias("command"))


@query(
    "fingerprint_sorted",
    """SELECT doc_id, substr(sha256(array_to_string(list_sort(w), ',')), 1, 12) AS part, array_to_string(list_transform(w, lambda x: lpad(lower(to_hex(CAST(length(x) AS BIGINT))), 4, '0')), ',') AS hex4
      FROM (SELECT doc_id, string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ') AS w FROM documents)""",
)
def fingerprint_sorted(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " ").alias("w"))
    return d.select("doc_id", fingerprints.part(F.array_join(F.array_sort("w"), ",")).alias("part"), fingerprints.hex4(F.transform("w", lambda x: F.char_length(x))).alias("hex4"))


@query(
    "fingerprint_sorted_text",
    """SELECT doc_id, substr(sha256(array_to_string(list_sort(w), ',')), 1, 12) AS part, array_to_string(list_transform(w, lambda x: lpad(lower(to_hex(CAST(length(x) AS BIGINT))), 4, '0')), ',') AS hex4
      FROM (SELECT doc_id, string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ') AS w FROM documents)""",
)
def fingerprint_sorted_text(spark, sf_dir):
    """As ``fingerprint_sorted``, over whole texts."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " ").alias("w"))
    return d.select("doc_id", fingerprints.part(F.array_join(F.array_sort("w"), ",")).alias("part"), fingerprints.hex4(F.transform("w", lambda x: F.char_length(x))).alias("hex4"))


@query("hassh_like", "SELECT p_partkey, md5(p_name || ';' || p_brand || ';' || p_type || ';none') AS hassh FROM part")
def hassh_like(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", fingerprints.hassh(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit("none")).alias("hassh"))


@query("first_match", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r = 1")
def first_match(spark, sf_dir):
    return files.best(_t(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey"), ["p_brand"], F.struct(-F.col("p_size"), "p_partkey")).drop("p_size")


# --- content round trips


IDENTITY = "SELECT doc_id, md5(text) AS content_md5, octet_length(encode(text)) AS size FROM documents"


def _same(df: DataFrame, content) -> DataFrame:
    return df.select("doc_id", F.md5(content).alias("content_md5"), F.octet_length(content).cast("long").alias("size"))


def _bytes(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("c"))


@query("fragment_gather", IDENTITY)
def fragment_gather(spark, sf_dir):
    d = _bytes(spark, sf_dir)
    cuts = F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("c") - 1, F.lit(0)) / 1000).cast("int"))
    frags = F.transform(cuts, lambda k: F.struct(F.col("doc_id").alias("id"), (k * 1000).cast("long").alias("start"), F.lit(1000).cast("long").alias("length")))
    return _same(gather.gather(d.select("doc_id", frags.alias("fragments")), d, "doc_id", "fragments", "doc_id", "c"), F.col("c"))


@query("xor_roundtrip", IDENTITY)
def xor_roundtrip(spark, sf_dir):
    key = F.unhex(F.lit("deadbeef42"))
    return _same(_bytes(spark, sf_dir), binary.xor(binary.xor(F.col("c"), key), key))


@query("aes_cbc_roundtrip", IDENTITY)
def aes_cbc_roundtrip(spark, sf_dir):
    key, iv = F.unhex(F.lit("2b7e151628aed2a6abf7158809cf4f3c")), F.unhex(F.lit("000102030405060708090a0b0c0d0e0f"))
    d = _bytes(spark, sf_dir).withColumn("ct", F.aes_encrypt("c", key, F.lit("CBC"), F.lit("PKCS"), iv))
    plain = binary.aes_cbc(F.expr("substring(ct, 17)"), key, iv)  # with the padding still on
    return _same(d, F.substring(plain, F.lit(1), F.octet_length("c")))


@query("aes_gcm_roundtrip", IDENTITY)
def aes_gcm_roundtrip(spark, sf_dir):
    key, nonce, aad = F.unhex(F.lit("2b7e151628aed2a6abf7158809cf4f3c")), F.unhex(F.lit("000102030405060708090a0b")), F.unhex(F.lit("170303"))
    d = _bytes(spark, sf_dir).withColumn("ct", F.aes_encrypt("c", key, F.lit("GCM"), F.lit("DEFAULT"), nonce, aad))
    return _same(d, binary.aes_gcm(nonce, F.expr("substring(ct, 13)"), key, aad))


@query("gzip_roundtrip", IDENTITY)
def gzip_roundtrip(spark, sf_dir):
    return _same(_bytes(spark, sf_dir), binary.gunzip(binary.gzip("c")))


@query("deflate_roundtrip", IDENTITY)
def deflate_roundtrip(spark, sf_dir):
    return _same(_bytes(spark, sf_dir), binary.inflate(binary.deflate("c")))


@query("chunked_roundtrip", IDENTITY)
def chunked_roundtrip(spark, sf_dir):
    return _same(_bytes(spark, sf_dir), binary.unchunk(binary.chunk("c")))
