"""The registered queries of the thirteen operators, with production parameters.

Each ``opN_<name>(spark, sf_dir)`` runs its operator over its whole table and
derives the contract's columns from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import chat_format, fill_middle, jaccard_join, knn_search, language_id, license_scan, mixing, packing, pii, quality, secret_scan, sharding, token_alignment


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_single(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(_table(spark, sf_dir, "documents")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no paths: a row stands at ``source/hundreds/doc_id``, and
    a text that grants a licence in any of its lines is that folder's licence file."""
    docs = _table(spark, sf_dir, "documents")
    name = F.when(license_scan.grants(F.col("text")), F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 100).cast("string"), name)
    return license_scan.scan(docs, path)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.join(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "class_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", *quality.COUNTS, "base_failed", "kept", "perplexity")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    sample = language_id.sample_texts(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return language_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), sample, ["doc_id", "held_out"])


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat_format.digest(chat_format.format_conversations(rows.unionByName(extra)))


def op9_knn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.drop("groups")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_license_scan": op4_license_scan,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality": op6_quality,
    "op7_language_id": op7_language_id,
    "op8_chat_format": op8_chat_format,
    "op9_knn_search": op9_knn_search,
    "op10_secret_scan": op10_secret_scan,
    "op11_fill_middle": op11_fill_middle,
    "op12_sharding": op12_sharding,
    "op13_token_alignment": op13_token_alignment,
}

_FILL_MIDDLE = """WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS varchar), '')) AS digest FROM documents),
  units AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
      [CAST('0x' || substr(digest, 8 * k + 1, 8) AS bigint) FOR k IN range(4)] AS h FROM texts),
  counted AS (SELECT *, CAST(len(units) AS bigint) AS n FROM units),
  cuts AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
        WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM counted),
  parts AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS bigint) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS bigint) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts"""

#: The other operators are beyond SQL; so is the checksum of op12 (see tests/llm for its other columns).
ORACLE_SQL: dict[str, str] = {"op11_fill_middle": _FILL_MIDDLE}
