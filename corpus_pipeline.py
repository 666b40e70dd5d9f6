"""A corpus pipeline: quality rules, near duplicates, PII, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; :func:`run` writes each stage's result as Parquet to the
shared folder and reads it again as the next one's input.

In all stages null texts are empty texts, a row counts as often as it is there,
texts of any length are taken whole, an empty table gives an empty one, and
further columns are passed on (but by the last stage), whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import jaccard_join, mixing, packing, pii, quality
from tidelog.llm.shared import kept, materialize, scratch


def _renamed(docs: DataFrame, *but: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names, ``but`` these, that no operator's own columns can clash with."""
    plain = {c: c if c in but else f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*plain.values()), plain


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.  Empty ones have too few words and go;
    equal texts of one language fare alike."""
    rows, plain = _renamed(docs)
    verdicts = quality.judge(rows, rows.columns, lang_col=plain["lang"], text_col=plain["text"])
    return verdicts.filter("kept").select(*plain.values()).toDF(*plain)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents: the one with the
    smallest id.  Rows that repeat an id that stays, or have none, go if their
    whole text is repeated too.  Texts without words link with nothing and stay."""
    rows, plain = _renamed(docs)
    key, text = plain["doc_id"], plain["text"]
    with scratch(spark):
        joined = kept(jaccard_join.join(rows, key, text), "components")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    by_id = joined.groupBy("doc_id").agg(F.count_if(stays).alias("n"))
    gone = materialize(by_id.filter("n = 0").select(F.col("doc_id").alias("gone")), "gone")
    left = rows.join(gone, F.col(key) == F.col("gone"), "left_anti")
    several = materialize(by_id.filter("n > 1").select(F.col("doc_id").alias("several")), "several")
    if not several.isEmpty():
        same = F.col(key).eqNullSafe(F.col("several"))
        left = left.join(several, same, "left_anti").unionByName(left.join(several, same, "left_semi").dropDuplicates([key, text]))
    return left.toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; a null
    text stays null."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it.  A null source is one
    of its own, the last; documents without words weigh nothing; of equal ids and
    texts each row is taken by itself."""
    rows, plain = _renamed(docs, "doc_id")
    return mixing.repeat_documents(rows, text_col=plain["text"], source_col=plain["source"]).select(*plain.values()).toDF(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 ids; an
    empty text still has its end id."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]

#: Perplexity, redaction and token ids are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
