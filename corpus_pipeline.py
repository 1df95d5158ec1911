"""The corpus pipeline: stages that each keep, drop or encode documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's docs. All but the last return the columns they were given, whatever their names. Null texts
count as empty. Repeated rows share each other's fate, as do rows without doc_id. Tables without rows pass
through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwright.llm import bpe, decontam, exact, minhash, quality
from stackwright.llm.common import free_name, stage
from stackwright.llm.queries import tokenizer_path

#: Words of a shingle in the near-dedup stage.
NEAR_SIZE = 5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects; it learns from the labels of the table."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality.learn(docs, labels, F.lit(True))
    return quality.accepted(docs, rules)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest doc_id."""
    found = exact.dedup(docs).where("kept").select("doc_id", "digest")
    return keep(docs, found)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keep the smallest doc_id."""
    return keep(docs, minhash.near_components(docs, size=NEAR_SIZE).where("kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    found = decontam.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leak = free_name(docs.columns, "_leak")
    leaks = stage(found.select(F.col("doc_id").alias(leak)).distinct(), "leaks")
    small = F.broadcast(leaks) if leaks.count() <= minhash.BROADCAST_IDS else leaks
    return docs.join(small, docs["doc_id"] == small[leak], "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, with the proof that they decode to its text."""
    coded = bpe.round_trip(docs, tokenizer_path())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def keep(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents whose doc_id is among those found: an equi-join on ids alone, no text is grouped."""
    name = free_name(docs.columns, "_keep")
    ids = found.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids[name]), "left_semi")


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]
#: The quality classifier and near duplicates are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
