"""Mends of round 3: a test for each finding."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from netloom.api import Engine
from netloom.decoders import certificates, keyexchange, registry, smb, streams
from netloom.functions import binary
from netloom.operators import clocks
from netloom.operators.tables import lasting
from netloom.plans import clocks as clock_plans
from netloom.plans import protocols as plans


def test_a_modulus_that_begins_with_zeros_keeps_its_digits(spark):
    n = spark.range(1, 1000).withColumn("want", F.sha2(F.concat(F.lit("0:"), F.col("id").cast("string")).cast("binary"), 256)).where("want LIKE '00%'")
    name = plans._name(F.lit("XX"), F.lit("a"))
    der = plans._certificate(F.col("id"), name, name, ["551d13"], plans._sha(F.lit("0"), F.col("id")))
    rows = n.select("want", plans._digits(certificates.parsed(der)["modulus"]).alias("got")).collect()
    assert rows and all(r.got == r.want for r in rows)


def test_entries_and_versions_are_dealt_by_file_once(spark):
    told = spark.range(40).select((F.col("id") % 4).alias("f"), F.col("id").alias("at"), *[F.col("id").alias(t) for t in clocks.TIMES])
    acts = spark.range(20).select((F.col("id") % 4).alias("f"), (F.col("id") * 2).alias("at"), (F.col("id") % 2 == 0).alias("is_read"), F.lit(0).alias("skew"))
    versions = acts.select("f", "at", "is_read", F.lit(0).alias("version"))
    deals = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert deals(clocks.server_time(acts, told, ["f"])) == 1
    assert deals(clocks.assigned(versions, told, told, ["f"])) == 1


def test_batches_are_read_some_rows_at_a_time():
    seen = []
    column = pa.array([bytes([k % 256]) * 3 for k in range(1000)], pa.binary())
    out = binary.by_slices(lambda c: seen.append(len(c)) or c, column)
    assert out.equals(column) and max(seen) == 256 and sum(seen) == 1000
    assert binary.by_slices(lambda c: c, column[:0]).equals(column[:0])
    assert binary.xor.func(column, pa.array([b"\x01"] * 1000, pa.binary())).to_pylist() == [bytes([k % 256 ^ 1]) * 3 for k in range(1000)]


def test_control_and_data_connections_are_written_once_together(spark, monkeypatch):
    made = []

    def stop(*_):
        raise StopIteration

    monkeypatch.setattr(plans, "lasting", lambda df: made.append(df) or df)
    monkeypatch.setattr(plans.ftp, "data_files", stop)
    with pytest.raises(StopIteration):
        plans.ftp_files(spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def _deals(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def _some_packets(spark, n=60):
    ends = [F.lit("1.1.1.1").alias("src_ip"), F.lit("2.2.2.2").alias("dst_ip"), (F.col("id") % 12).cast("int").alias("src_port"), F.lit(80).alias("dst_port")]
    return spark.range(n).select(F.lit("p").alias("path"), F.col("id").alias("frame_no"), F.lit("tcp").alias("l4"), *ends, (F.floor(F.col("id") / 12) * 2).alias("tcp_seq"), F.lit(24).alias("tcp_flags"), F.lit(b"ab").alias("payload"), F.col("id").alias("ts_ns"), F.lit(0).alias("payload_at"))


def test_bytes_of_runs_are_dealt_once(spark):
    assert _deals(streams.runs(streams.tcp_segments(_some_packets(spark)))) == 1


def test_more_packets_are_put_in_order_by_more_tasks(spark, monkeypatch):
    packets = _some_packets(spark)
    assert streams.tasks(packets) is None
    monkeypatch.setattr(streams, "PACKETS", 5)
    assert streams.tasks(packets) == 12
    segments = streams.tcp_segments(packets, 12)
    assert segments.rdd.getNumPartitions() == 12
    assert streams.runs(segments).select("content").distinct().collect() == [(b"ab" * 5,)]


def test_a_round_of_one_decoder_is_written_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(registry, "lasting", lambda df: made.append(df) or lasting(df))
    base = lasting(Engine._tcp(streams.runs(streams.tcp_segments(_some_packets(spark)))))
    half = registry.Decoder("half", lambda o: F.octet_length("content") > 6, lambda runs, o: runs.select(*registry.made(F.col("stream"), F.lit("h"), F.lit("h"), F.substring("content", 1, 6), registry.properties(a=F.lit("b")))), lambda o: False)
    rows, parsed = registry.fixpoint(base, registry.Options(), {"half": half})
    assert len(made) == 1 and rows.where("file_type = 'half' AND props['a'] = 'b' AND props['srcIP'] = '1.1.1.1'").count() == 12 and parsed.count() == 12


def test_handshakes_are_read_without_application_records(spark):
    recs = spark.range(4).select(F.lit("s").alias("stream"), F.lit(0).alias("side"), F.lit(0).alias("run"), F.col("id").alias("n"), F.lit(771).alias("version"), F.lit(23).alias("type"), F.lit(b"x").alias("body"))
    dealt = lasting(recs).transform(keyexchange.messages)._jdf.queryExecution().executedPlan().toString()
    assert " IN (20,22)" in dealt[dealt.index("Exchange") :]


def test_only_creates_and_what_is_asked_for_are_dealt(spark):
    ex = spark.range(4).select(F.lit("s").alias("stream"), F.lit(0).alias("run"), F.col("id").alias("n"), F.lit(9).alias("command"), F.col("id").alias("message_id"), F.lit(0).alias("answer_status"), F.lit(b"x").alias("req"))
    dealt = smb._answered(lasting(ex), smb.CLOSE)._jdf.queryExecution().executedPlan().toString()
    assert " IN (5,6)" in dealt[dealt.index("Exchange") :]


def test_contents_of_files_are_dealt_by_file_once(spark):
    base = lasting(Engine._tcp(streams.runs(streams.tcp_segments(_some_packets(spark)))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Engine._whole(base, lasting(base.select("file").limit(3)))
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in text.splitlines() if "Exchange hashpartitioning(file" in x and "file_type" in x.split("hashpartitioning")[1].split(")")[0]]
        assert plan.where("parsed").count() == 3 and plan.count() == 12
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _operations(spark, seed):
    """Told entries and operations of files, some of one time."""
    rnd = random.Random(seed)
    t = lambda: rnd.randrange(40) * clocks.SECOND // 2
    fs = [(f"f{k}", t(), *[rnd.choice([None, t(), t(), t()]) for _ in range(4)]) for k in range(150) for _ in range(rnd.choice([0, 1, 3, 12]))]
    ops = [(f"f{k}", t(), rnd.random() < 0.5, rnd.choice([0, -1, 3]) * clocks.SECOND, rnd.choice([None, t()])) for k in range(150) for _ in range(rnd.choice([0, 1, 2, 7]))]
    fs, ops = [*fs, ("f0", None, 1, 1, 1, 1)], [*ops, ("f0", None, True, 0, None)]
    return spark.createDataFrame(fs, "f string, at long, a long, m long, c long, b long"), spark.createDataFrame(ops, "f string, at long, is_read boolean, skew long, last_access long")


@pytest.mark.parametrize("mode", clocks.MODES)
def test_what_shows_of_operations_is_what_the_steps_one_by_one_show(spark, mode):
    fs, ops = _operations(spark, 11)
    acts = ops.where("at IS NOT NULL").groupBy("f", "at").agg(F.max(F.struct("is_read", "skew", "last_access")).alias("x")).select("f", "at", "x.*")
    number = (F.row_number().over(Window.partitionBy("f").orderBy("at")) - 1).alias("version")
    versions = clocks.server_time(acts, fs, ["f"]).select("f", number, "at", "is_read", "fs_time", (F.col("at") + F.col("skew")).alias("hybrid_time"), "last_access").cache()
    entries = clocks.assigned(versions, fs, clocks.synthesized(acts, fs, ["f"]), ["f"]).cache()
    s, seen = clocks.SECOND, set()
    order = lambda df: sorted(map(tuple, df.select("f", "version", "a", "m", "c", "is_metadata").collect()), key=str)
    for snapshot, lo, hi, metadata in [(None, None, None, False), (None, 4 * s, 9 * s, False), (None, None, 9 * s, True), (6 * s, None, None, False), (12 * s, 4 * s, 9 * s, False), (0, None, None, False)]:
        want = order(clocks.shown(versions, entries, ["f"], mode, (lo, hi), snapshot, metadata))
        assert order(clocks.shown_by_operations(ops, fs, ["f"], mode, (lo, hi), snapshot, metadata, tasks=3)) == want, (snapshot, lo, hi, metadata)
        seen |= {(r[1] is None, r[5]) for r in want}
    assert seen == {(True, True), (False, False)}


def test_nothing_told_and_nothing_done(spark):
    fs, ops = _operations(spark, 5)
    none = [clocks.shown_by_operations(ops.limit(0), fs.limit(0), ["f"], mode, tasks=tasks).count() for mode in clocks.MODES for tasks in (None, 2)]
    assert none == [0] * 6
    alone = clocks.shown_by_operations(ops, fs.limit(0), ["f"], snapshot=None)
    assert alone.count() == ops.where("at IS NOT NULL").select("f", "at").distinct().count() and alone.where("a <> 0 OR is_metadata").count() == 0


def test_a_listing_by_the_servers_clock_deals_told_times_once(spark):
    fs, ops = _operations(spark, 5)
    fs, ops = lasting(fs), lasting(ops)
    assert _deals(clocks.shown_by_operations(ops, fs, ["f"], "fs", snapshot=9)) == 1
    assert _deals(clocks.shown_by_operations(ops, fs, ["f"], "fs")) == 1


def test_a_listing_by_the_networks_clock_deals_times_of_sight_alone(spark):
    fs, ops = _operations(spark, 5)
    plan = clocks.shown_by_operations(lasting(ops), lasting(fs), ["f"], "network", (1, 9))
    assert _deals(plan) == 1
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in text and "ReadSchema: struct<f:string,at:bigint>" in text


def test_more_lines_are_dealt_to_more_tasks(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    assert clock_plans._tasks(spark, sf) is None
    want = sorted(map(tuple, clock_plans._listing(spark, sf, "hybrid", (clock_plans.LO, clock_plans.HI)).collect()))
    monkeypatch.setattr(clock_plans, "ROWS", 600)
    n = clock_plans._tasks(spark, sf)
    assert n > 10
    plan = clock_plans._listing(spark, sf, "hybrid", (clock_plans.LO, clock_plans.HI))
    text = plan._jdf.queryExecution().executedPlan().toString()
    deals = [x.split("hashpartitioning(f#")[1] for x in text.splitlines() if "Exchange hashpartitioning(f#" in x]
    assert len(deals) == 2 and all(f", {n})" in x and "REPARTITION_BY_NUM" in x for x in deals)
    assert sorted(map(tuple, plan.collect())) == want
