"""The queries opN_<name> of this subpackage and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.plans.scratch import scratch_path

from . import binary_output, embedding_dedup, langid, line_dedup, minhash, mixing, oracles, packing, quality, secrets, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("row.doc_id", langid.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.METRICS, "base_failed", "kept")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.labelled_pages(pages, _table(spark, sf_dir, "labels")))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), max_repeats=2.0)
    return found.select("row.doc_id", "row.source", "n_tokens", "epoch", "block", "place")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_key_chars=1)
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


_OP7_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
k AS (SELECT doc_id, ls, list_transform(ls, lambda x: translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ks FROM d),
f AS (SELECT key FROM (SELECT DISTINCT doc_id, unnest(ks) AS key FROM k) WHERE key <> '' GROUP BY key HAVING count(*) >= 10),
a AS (SELECT coalesce(list(key), []) AS shared FROM f),
o AS (SELECT doc_id, ls, list_transform(list_filter(list_zip(ls, ks), lambda z: NOT list_contains(shared, z[2])), lambda z: z[1]) AS kept FROM k, a)
SELECT doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - len(kept))::BIGINT AS n_dropped,
  sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM o
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("joined").alias("spans"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token_shards")
    binary_output.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return binary_output.read_index(spark, path)


def queries() -> dict[str, Query]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": oracles.OP2, "op3_url_filter": oracles.OP3, "op5_embedding_near_dedup": oracles.OP5, "op6_minhash_near_dedup": oracles.OP6, "op7_line_dedup": _OP7_SQL}
