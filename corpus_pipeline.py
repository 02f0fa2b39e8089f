"""The corpus pipeline over ``documents``.

Each stage takes what its predecessor kept: bad texts go, of near copies
one stays, documents with benchmark items go, secrets are masked, and what
is left is packed into training sequences.  ``run`` writes every stage's
result into the shared checkpoint folder and reads it back.  Null and empty
texts pass like any text (the operators say how each is judged), repeated
rows are copies of each other, an empty table gives an empty result, and
columns beyond those of ``documents`` are carried to the last stage.
Workers of one stage serve the next, so each stage bounds the batches that
Python gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import small_batches, stored, table
from tessera.llm.decontam import drop_leaks
from tessera.llm.ngramjoin import keep_one
from tessera.llm.packing import pack
from tessera.llm.quality import fit_quality, keep_good
from tessera.llm.secrets import mask_secrets

#: The stages train a model, join by similarity and tokenize: SQL can't express them.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; all columns stay."""
    small_batches(spark)
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    small_batches(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    small_batches(spark)
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with their secrets masked."""
    small_batches(spark)
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    small_batches(spark)
    return pack(docs)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("secrets", secrets), ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences of all documents that the stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
