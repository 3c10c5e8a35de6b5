"""Streams hidden by a repeating key: rules say which, and the key file each rule names gives the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binary import xor
from ..operators.filters import matches
from .registry import Options, decoder, made, properties


def decode(streams: DataFrame, rules: list[dict[str, str]], keys: DataFrame, key=lambda key: key) -> DataFrame:
    """``streams`` (with content and the rules' properties) that a rule fits, decoded with the first such rule's key.

    ``rules`` are conjunctions of properties and a ``keyfile``; ``keys`` is (path, key), a small table of key files.
    A stream whose key file is not there is left out. ``key`` may turn the key for a row whose bytes do not begin a stream.
    """
    chosen = F.lit(None).cast("string")
    for rule in reversed(rules):
        own = {k: v for k, v in rule.items() if k != "keyfile"}
        chosen = F.when(matches([own], {k: F.col(k) for k in own}), rule["keyfile"]).otherwise(chosen)
    k = keys.select(F.substring_index("path", "/", -1).alias("__file"), F.col("key").alias("__key"))
    hit = streams.withColumn("__want", F.substring_index(chosen, "/", -1)).join(k, F.col("__want") == F.col("__file"))
    hit = hit.withColumn("key", F.col("__key")).withColumn("__key", key(F.col("key")))
    return hit.withColumn("content", xor("content", "__key")).drop("__want", "__file", "__key", "key")


def _rules(options: Options) -> list[dict[str, str]]:
    return options.rules.get("xor", []) if options.xor_keys is not None else []


def _fits(options: Options):
    own = [{k: v for k, v in r.items() if k != "keyfile"} for r in _rules(options)]
    return F.col("file_type").isin("tcp", "udp") & matches(own, {k: F.try_element_at("props", F.lit(k)) for r in own for k in r})


@decoder("xor", _fits)
def files(runs: DataFrame, options: Options) -> DataFrame:
    """A file with the same runs, in the clear; a run's key begins where its place in the file says."""
    rules = _rules(options)
    flat = runs.withColumns({k: F.try_element_at("props", F.lit(k)) for r in rules for k in r if k != "keyfile"})
    n = F.octet_length("key")
    turn = (F.col("offset") % n).cast("int")
    keys = options.xor_keys.where("octet_length(key) > 0").select("path", "key")
    hit = decode(flat, rules, keys, key=lambda key: F.concat(F.substring(key, turn + 1, n), F.substring(key, F.lit(1), turn)))
    return hit.select(*made(F.col("stream"), F.lit("xor"), F.lit("xor"), F.col("content"), properties(protocol=F.lit("xor")), run=F.col("run"), offset=F.col("offset"), missing=F.col("missing_data")))
