"""The queries of this subpackage, by name, and their DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import infill, licenses, media, mixing, packing, quality, repair, secrets, sharding, simhash, token_files, tools, toxicity


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_documents(spark, sf_dir)))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.classify(docs, toxicity.train(docs, labels))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources to equal weights, in a mix as large as the corpus; the texts are part of the result."""
    mixed = mixing.mix_sources(_documents(spark, sf_dir))
    return mixed.select("doc_id", F.col("copy").cast("long").alias("copy"), "source", "lang", "n_chars", "text")


#: The same draws: shares, rates and the running probabilities of each source, then each document's place among them.
OP4_SQL = """
WITH per AS (
  SELECT source, count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS amount FROM documents GROUP BY source
), rate AS (
  SELECT source, CASE WHEN amount > 0 THEN 1.0 / sum(CASE WHEN amount > 0 THEN 1.0 ELSE 0.0 END) OVER () * sum(amount) OVER () / amount ELSE 0.0 END AS r FROM per
), logs AS (
  SELECT source, k, CASE WHEN r > 0 THEN -r + sum(CASE WHEN k = 0 THEN 0.0 ELSE ln(r) - ln(CAST(k AS DOUBLE)) END) OVER (PARTITION BY source ORDER BY k) END AS l
  FROM (SELECT source, r, unnest(range(0, CAST(ceil(r + 12 * sqrt(r) + 20) AS BIGINT) + 1)) AS k FROM rate)
), cdf AS (
  SELECT source, k, coalesce(sum(exp(l)) OVER (PARTITION BY source ORDER BY k), 1.0) AS c FROM logs
), steps AS (
  SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source
), drawn AS (
  SELECT d.*, len(list_filter(cs, lambda c: c <= CAST(CAST('0x' || substr(md5('4:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)) AS m
  FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, unnest(range(0, m)) AS copy, source, lang, n_chars, text FROM drawn WHERE m > 0
"""


def _turns_linked(spark: SparkSession, sf_dir: str, at: str) -> DataFrame:
    calls, results = tools.turns_as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    schemas = spark.createDataFrame(tools.TURN_TOOLS, "name string, param string, type string, required boolean")
    return tools.link(calls, results, schemas, every=True, at=at).drop("rank").withColumn("problems", F.array_join("problems", ","))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all conversations as calls and results, linked, in topological order, checked and serialised."""
    return _turns_linked(spark, sf_dir, "position")


OP5_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text, length(text) AS n, md5(conv_id || ':' || turn) AS id, md5(conv_id || ':' || (turn - 1)) AS before1 FROM conversations
), calls AS (
  SELECT *, CASE WHEN role = 'user' THEN 'answer' ELSE 'instruct' END AS name,
    concat_ws(',', CASE WHEN role = 'system' THEN 'missing:tone' END, CASE WHEN n % 7 = 0 THEN 'type:turn' END, CASE WHEN n % 5 = 0 THEN 'unknown:n_chars' END) AS problems
  FROM m WHERE role IN ('user', 'system')
), edges AS (
  SELECT c.id, n.id AS need FROM calls c JOIN calls n ON c.conv_id = n.conv_id AND n.turn < c.turn AND (n.turn = 0 OR n.turn >= c.turn - 2)
), depth AS (
  SELECT id, 0 AS level FROM calls WHERE id NOT IN (SELECT id FROM edges)
  UNION SELECT e.id, d.level + 1 FROM edges e JOIN depth d ON e.need = d.id
), lvl AS (
  SELECT id, max(level) AS level FROM depth GROUP BY id
), results AS (
  SELECT conv_id, turn, before1 AS id, text FROM m WHERE role NOT IN ('user', 'system')
), told AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.id, r.id) AS call_id, c.name, l.level AS position,
    CASE WHEN c.id IS NULL THEN 'orphan' WHEN c.problems <> '' THEN 'invalid' WHEN r.id IS NULL THEN 'open' ELSE 'linked' END AS status,
    coalesce(c.problems, '') AS problems, r.turn AS result_turn, CASE WHEN c.id IS NOT NULL THEN 1 END AS copies, c.id AS called, c.n, c.text AS asked, r.text AS got, r.id AS answered
  FROM calls c FULL JOIN results r ON c.id = r.id LEFT JOIN lvl l ON l.id = c.id
)
SELECT conv_id, turn, call_id, name, position, status, problems, result_turn, copies,
  '{"arguments":' || CASE WHEN called IS NULL THEN '[null]' ELSE
    '{' || CASE WHEN n % 5 = 0 THEN '"n_chars":' || n || ',' ELSE '' END || '"prompt":' || to_json(asked) || ',"turn":' || CASE WHEN n % 7 = 0 THEN '"' || turn || '"' ELSE '' || turn END || '}' END
  || ',"id":' || to_json(call_id)
  || CASE WHEN called IS NULL THEN '' ELSE ',"name":' || to_json(name) || ',"position":' || position END
  || CASE WHEN answered IS NULL THEN '' ELSE ',"result":' || to_json(got) END || ',"status":"' || status || '"}' AS json
FROM told
"""


def op5_tool_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op5_tool_calls``, with the position under the name ``level``."""
    return _turns_linked(spark, sf_dir, "level")


#: In canonical JSON the key ``level`` comes before ``name``.
OP5_LEVELS_SQL = OP5_SQL.replace("l.level AS position", "l.level").replace("name, position, status", "name, level, status").replace(
    """',"name":' || to_json(name) || ',"position":' || position END""", """',"level":' || level || ',"name":' || to_json(name) END"""
)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _documents(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), media.wrap("text").alias("media"))
    return stored.withColumn("told", media.read_back("media")).select("doc_id", "n_bytes", "told.*")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), packing.Tokenized(vocabulary()))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair.digest(turns, repair.damage(turns))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as Parquet in the session's shared folder, and what the files say."""
    path = token_files.new_folder(spark)
    token_files.write(_documents(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"))
    return token_files.digest(spark, path)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.fill_in_middle(_documents(spark, sf_dir)))


#: Lines as a list, cut at the two places that the hash of the id gives.
OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), e AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e
), g AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM g
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_licenses": op2_licenses,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_tool_calls": op5_tool_calls,
    "op5_tool_levels": op5_tool_levels,
    "op6_simhash": op6_simhash,
    "op7_media": op7_media,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_repair": op11_repair,
    "op12_token_files": op12_token_files,
    "op13_infill": op13_infill,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": OP4_SQL,
    "op5_tool_calls": OP5_SQL,
    "op5_tool_levels": OP5_LEVELS_SQL,
    "op13_infill": OP13_SQL,
}
