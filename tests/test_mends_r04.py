"""Mends of round 4: tests for each finding."""

from pyspark.sql import functions as F

from netloom.decoders import smb
from netloom.functions.binary import number
from netloom.operators.tables import lasting
from netloom.plans import protocols as plans


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_times_beyond_what_a_field_holds_are_told(spark, tmp_path):
    """At 6 GB customers have numbers of some 5,400,000; times that nanoseconds since 1970 can't say are 0, as they were below."""
    keys = [0, 1, 10_674, 10_675, 10_676, 899_999, 1_054_042, 1_054_043, 2_200_000, 5_399_999, 10**15]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    hour, last = 3_600_000_000_000, (1 << 63) - 1
    ns = lambda key, k, h: t if (t := (key * 10 + k) * 24 * hour + h * hour) <= last else 0
    want = [(key, f"/docs/t{key}", (k * 2 + 7) * 10**9, *[ns(key, k, h) for h in (1, 2, 3, 0)], key % 100 * 10**9) for key in keys for k in range(4)]
    got = plans.smb_told_times(spark, str(tmp_path)).select("custkey", "path", "at", "a", "m", "c", "b", "skew").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_times_beyond_nanoseconds_are_null_without_an_error_for_each(spark):
    since = 116_444_736_000_000_000
    ticks = [0, 1, since - smb.MOST - 1, since - smb.MOST, since, since + smb.MOST, since + smb.MOST + 1, (1 << 63) - 1, None]
    want = [None if not t or abs(t - since) > smb.MOST else (t - since) * 100 for t in ticks]
    told = spark.createDataFrame(list(enumerate(ticks)), "k int, t long").select("k", smb.unix_ns(F.col("t")).alias("ns"))
    assert [r.ns for r in told.orderBy("k").collect()] == want
    assert "try_multiply" not in _plan(told)


def test_little_numbers_take_no_regular_expression(spark):
    data = [bytes(range(240, 256)), b"\xff" * 7 + b"\x7f" + b"\0" * 8, b"\0" * 7 + b"\x80", b"\x01\x02\x03", b"", None]
    sizes = [(at, n) for at in (0, 1, 3) for n in range(1, 9)]
    df = spark.createDataFrame(list(enumerate(data)), "k int, b binary").select("k", *[number(F.col("b"), at, n, little=True).alias(f"x{at}_{n}") for at, n in sizes])
    value = lambda b, at, n: None if b is None or len(b) < at + n or (x := int.from_bytes(b[at : at + n], "little")) >= 1 << 63 else x
    assert [list(r)[1:] for r in df.orderBy("k").collect()] == [[value(b, at, n) for at, n in sizes] for b in data]
    assert "regexp_replace" not in _plan(df)


def test_messages_are_dealt_once_to_meet_their_answers(spark):
    row = lambda run, command, answer, mid, said: ("s", 0, run, 0, run, "h:1", "c", command, answer, 0, mid, 1, "A", said)
    said = [row(0, 5, False, "1", b"ask"), row(1, 5, True, "1", b"first"), row(2, 5, True, "1", b"second"), row(3, 6, False, "1", b"other"), row(4, None, True, "2", b"?"), row(5, None, False, "2", b"??"), row(6, 18, True, "F", b"unasked"), row(7, 8, None, "3", b"cut")]
    schema = "stream string, side int, run int, n int, ts_ns long, server string, client_ip string, command int, is_response boolean, status long, message_id string, tree_id long, session_id string, msg binary"
    ex = smb.exchanges(lasting(spark.createDataFrame(said, schema)))
    assert _plan(ex).count("Exchange hashpartitioning") == 1
    assert sorted((bytes(r.req), r.rsp and bytes(r.rsp), r.answer_status, r.answer_ns) for r in ex.collect()) == [(b"??", None, None, None), (b"ask", b"first", 0, 1), (b"other", None, None, None)]


def test_what_is_said_is_made_once(spark):
    flows = plans._times(spark, "/root/testdata/sf0.001")
    text = _plan(flows)
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert flows.count() == customers * plans.TALK and flows.where("tcp_flags = 2 AND octet_length(payload) = 0 AND tcp_seq = 999").count() == customers
