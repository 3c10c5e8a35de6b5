"""Key material as small tables, and decode rules."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def key_log(lines: DataFrame) -> DataFrame:
    """(kind, id, secret) of the lines (column ``line``) of a TLS key log: client randoms with master secrets, RSA ids with pre-master secrets.

    Lines of other kinds, comments and lines that are no hexadecimal numbers are left out.
    """
    p = F.split(F.trim("line"), r"\s+")
    k = lines.select(F.get(p, F.lit(0)).alias("kind"), F.unhex(F.get(p, F.lit(1))).alias("id"), F.unhex(F.get(p, F.lit(2))).alias("secret"))
    return k.where(F.col("kind").isin("CLIENT_RANDOM", "RSA") & F.col("id").isNotNull() & F.col("secret").isNotNull())


def xor_keys(spark: SparkSession, path: str) -> DataFrame:
    """(path, key) of files with a line ``XOR_KEY <hex>``."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", "^XOR_KEY ([0-9A-Fa-f]+)", 1).alias("h"))
    return t.where("h <> ''").select("path", F.unhex("h").alias("key"))


def pem_keys(spark: SparkSession, path: str) -> DataFrame:
    """(path, der) of files with an RSA private key."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", "(?s)-----BEGIN RSA PRIVATE KEY-----(.*?)-----END", 1).alias("b"))
    return t.where("b <> ''").select("path", F.unbase64(F.regexp_replace("b", r"\s", "")).alias("der"))


def config(text: str) -> dict:
    """A TOML configuration as a dictionary: sortby, keyfiles (always a list), and decode rules by decoder."""
    raw = tomllib.loads(text)
    files = raw.get("keys", {}).get("keyfiles", [])
    return {
        "sortby": raw.get("general", {}).get("sortby", "/protocol/"),
        "keyfiles": [files] if isinstance(files, str) else files,
        "rules": {k: v.get("properties", []) for k, v in raw.get("decode", {}).items()},
    }
