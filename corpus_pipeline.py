"""From raw documents to token ids: the stages, each on what the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from refweave.llm import bpe, cotrain, mixing, pii, simhash
from refweave.llm.common import set_aside, table, text_of, unused, written
from refweave.operators.joins import join_unique


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    docs, back = set_aside(docs, cotrain.ADDED)
    found = cotrain.classify(docs, table(spark, sf_dir, "labels"))
    return found.where("kept").select(docs.columns).withColumnsRenamed(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, of several with that id any one.

    Documents without words are one group; a null id is the largest.
    """
    row = unused(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = simhash.near_copies(rows, row, "text")
    named = join_unique(groups, rows.select(row, "doc_id"), [row])
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("least"))
    return rows.join(first.select(F.col(f"least.{row}").alias(row)), row, "left_semi").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the text."""
    docs, back = set_aside(docs, pii.ADDED)
    found = written(pii.find(docs), "pii")
    found = pii.decide(found, pii.learn(found))
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return pii.redact(found).withColumn("n_chars", n_chars).select(docs.columns).withColumnsRenamed(back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    row, copy = unused(docs, "row"), unused(docs, "copy")
    name = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_of()).cast("binary"))
    rows = docs.withColumn(row, name)  # by content, so the same whenever it is computed
    taken = mixing.mix(rows, row, "source", "text").groupBy(row).agg(F.avg("copies").alias("copies"))
    # Equal rows are taken equally often, as many times in all as the mix says, rounded.
    copies = F.round(copy).cast("int")
    found = join_unique(rows, taken.withColumnRenamed("copies", copy), [row]).where(copies > 0)
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)``: token ids as little-endian unsigned 32-bit integers."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, "doc_id", "text", path, public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix),
    ("byte_bpe", encode),
]
#: Classifier, fingerprints and rounding are not for SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
