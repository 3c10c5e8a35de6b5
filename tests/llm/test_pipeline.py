"""The pipeline on the smallest tables: what each stage keeps, and the queries that SQL expresses."""

import datetime
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from netloom.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plain(v):
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    r = con.execute(queries.ORACLE_SQL[name])
    have = [d[0] for d in r.description]
    assert sorted(have) == cols
    want = sorted(tuple(plain(row[have.index(c)]) for c in cols) for row in r.fetchall())
    assert sorted(tuple(plain(x[c]) for c in cols) for x in df.collect()) == want


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "secret_scan", "source_mixing", "best_fit_packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, DATA).cache()
        seen[name] = docs.count()
        if name != names[-1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name in ("toxicity", "simhash_near_dedup", "secret_scan"):
            assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    assert seen["secret_scan"] == seen["simhash_near_dedup"] <= seen["toxicity"] <= 200
    fill = defaultdict(int)
    for r in docs.collect():
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096
