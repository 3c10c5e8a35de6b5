"""A training corpus from ``documents``: toxic texts go, one of each group of near copies stays, secrets are covered, sources are mixed and the rest is packed.

Each stage is (spark, docs, sf_dir) -> DataFrame and reads nothing but the rows
that the stage before it kept, and the labels for the first. All but the last
return the columns of ``documents``, and columns beside them, of any name.

Null and empty texts are not toxic, are near copies of each other, hold no
secret, are never repeated where their source has no characters, and are one
piece of one token. A null id is an id of its own; rows that repeat are near
copies. Of rows that tie, one stays. A stage of an empty table is empty. Tables
that a stage made for itself, and the rows it was given, are removed when its
result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import mixing, packing, secrets, simhash, toxicity
from netloom.llm.components import forget, free_name, lasting, scratch
from netloom.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression-distance classifier calls toxic go; it learns from the labelled rows of its own input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHash fingerprints the row with the least id stays."""
    return simhash.keep_one(docs)


def cover_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by a mark; all rows stay."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to equal weights by Poisson replication, in shuffled order; a document may come more than once, or not at all."""
    copy = free_name(docs, "copy")
    return mixing.mix_sources(docs, copy_col=copy).drop(copy)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, each with its sequence of at most 4096 tokens and its place there."""
    return packing.pack(docs, packing.Tokenized(vocabulary()))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", cover_secrets),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before it kept."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with scratch() as tables:
            docs = tables.keep(lasting(stage(spark, before, sf_dir)))
        if k:
            forget(before)
        before = docs
    return docs
