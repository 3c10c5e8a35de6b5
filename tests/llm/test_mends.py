"""Clashing names, many needs, rare sources, large crowds, tables that go, and the pipeline on rows of every kind."""

import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netloom.llm import components, mixing, simhash, token_files, tools
from netloom.operators import tables

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def kept_tables(spark):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables.shared_folder(spark))
    return len(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path))


def test_keep_one_leaves_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "one two three four", "k"), (1, "one two three four", "k"), (1, "other words are here", "l"), (2, "one two three four", "m"), (None, None, None)], "doc_id long, text string, __fp string")
    docs = docs.withColumns({c: F.lit("x") for c in ("__i", "__root", "__n", "__f", "__id", "id", "fp", "component_id", "__heads")})
    out = simhash.keep_one(docs).collect()
    assert sorted((r.doc_id or 0, r.text or "", r["__fp"] or "") for r in out) == [(0, "", ""), (1, "one two three four", "k"), (1, "other words are here", "l")]
    assert {r["__root"] for r in out} == {"x"} and simhash.keep_one(docs.limit(0)).count() == 0


def test_calls_with_two_needs_each(spark, monkeypatch):
    """A thousand calls, each with two needs that know nothing of each other, over blocks; and a late need elsewhere."""
    monkeypatch.setattr(tools, "BLOCK", 64)
    rnd = random.Random(4)
    rows = []
    for conv, n in ((1, 1000), (2, 7), (None, 40)):
        for i in range(n):
            needs = [f"{conv}:{a}:{k}" for k in range(2) for a in {max(0, i - rnd.randint(1, 90))}] if i else []
            rows += [(f"{conv}:{i}:{k}", conv, i - 5, needs) for k in range(2)]
    rows += [("p", 9, 1, ["q", "s"]), ("q", 9, 2, []), ("s", 9, 0, [])]
    needs = {r[0]: r[3] for r in rows}
    want = {}
    for c, ns in [*((r[0], r[3]) for r in rows if r[1] != 9), ("q", []), ("s", []), ("p", ["q", "s"])]:
        want[c] = 1 + max([want[n] for n in ns], default=-1)
    began = time.time()
    got = {r.call_id: r.level for r in tools.levels(spark.createDataFrame(rows, "call_id string, conv_id long, turn long, needs array<string>")).collect()}
    assert got == want and len(needs) == len(got) and max(want.values()) > 20
    assert time.time() - began < 90


def test_mixing_beyond_broadcasts(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 40}" if i % 3 else "hot", 0) for i in range(3000)] + [(9, "abc", "en", None, 0), (10, None, "en", "", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"__name": F.lit(1), "__rows": F.lit(2)})
    count = lambda mix: Counter((r.doc_id, r.copy, r["__name"], r["__rows"]) for r in mixing.mix_sources(docs, mix).collect())
    one, two = count(mixing.Mix()), count(mixing.Mix(broadcast_sources=3))
    assert one == two and len(one) > 2000


def test_a_rare_source_moves_no_other_rows(spark):
    docs = spark.createDataFrame([(i, "word " * 400, "en", "big", 0) for i in range(2000)] + [(5000, "abc", "en", "rare", 0)], DOCS)
    plan = mixing.mix_sources(docs)._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and plan.index("LeftSemi") > 0
    assert mixing.mix_sources(docs).where("source = 'rare'").count() > 10_000


def test_simhash_beyond_what_is_sent(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SENT_HALVES", 0)
    monkeypatch.setattr(simhash, "HALF_PAIRS", 20)
    rnd = random.Random(6)
    base = [rnd.getrandbits(64) for _ in range(30)]
    prints = {b ^ (1 << i) ^ (1 << j) ^ (1 << k) for b in base for i, j, k in [rnd.sample(range(64), 3) for _ in range(12)]} | set(base)
    prints |= {(7 << 32) | x for x in range(60)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    root = {p: p for p in signed}
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = defaultdict(set)
    for p in signed:
        groups[find(p)].add(p)
    got = defaultdict(set)
    for r in simhash.components_of(spark.createDataFrame([(p,) for p in signed], "fp long")).collect():
        got[r.root].add(r.fp)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_tables_go(spark):
    docs = spark.createDataFrame([(i, f"some words of a text {i % 7}", "en", "s", 0) for i in range(40)], DOCS)
    before = kept_tables(spark)
    simhash.near_duplicates(docs).count()
    assert kept_tables(spark) - before == 2  # the two that the result reads
    with tables.scratch() as made:
        out = made.keep(tables.lasting(simhash.keep_one(docs)))
    assert out.count() == 7 and kept_tables(spark) - before == 3
    components.forget(out)


def test_pipeline_on_rows_of_every_kind(spark, tmp_path):
    rnd = random.Random(3)
    prose = lambda n: " ".join("".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    rows = [(i, prose(60), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(70, None, None, None, None), (71, "", "en", "s1", 0), (None, "text without id and more words", "en", "s1", 0), (72, prose(60_000), "en", "s2", 0)]
    rows += [rows[3], rows[3], (80, rows[4][1], "de", "s2", 0), (81, f"{rows[5][1]} password=hunter22x", "en", "s0", 0)]
    rows += [(i, prose(20) + " vile grubs mar all", "en", "s0", 0) for i in range(100, 110)]
    clash = ("__fp", "__i", "__root", "__heads", "copy", "score", "toxic", "piece", "spans", "fp")
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in clash})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(i, 0, 1) for i in range(100, 110)] + [(None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = kept_tables(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert kept_tables(spark) - before == 1
    fill = Counter()
    for r in out.collect():
        fill[r.sequence_id] += r.length
    assert fill and max(fill.values()) <= 4096
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, now, str(tmp_path)).cache()
        assert kept.columns == docs.columns and kept.where(" OR ".join(f"`{c}` <> 'x' OR `{c}` IS NULL" for c in clash)).isEmpty(), name
        if name == "simhash_near_dedup":
            assert max(Counter(r.text for r in kept.collect()).values()) == 1
        if name == "secret_scan":
            assert kept.where("text LIKE '%hunter22x%'").isEmpty()
        now = kept
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_folders_of_tokens_are_in_the_shared_folder(spark):
    assert token_files.new_folder(spark).startswith(tables.shared_folder(spark))


@pytest.fixture(autouse=True)
def _no_open_block():
    yield
    assert not tables.scratch._open
