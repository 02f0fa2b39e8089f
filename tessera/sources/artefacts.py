"""Persisted artefacts: splits, run ledger, fitted fill tables, tokenizers.

Everything is parquet under one directory per artefact, written with
Spark (so it lands in the shared file system of the cluster), plus a
small JSON attribute file for scalar settings.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def split_reuse(spark: SparkSession, path: str, make_split) -> DataFrame:
    """First run writes ``make_split() -> (train, test)`` partitioned by ``split``;
    later runs read the stored split instead of recomputing it."""
    if not exists(spark, f"{path}/_SUCCESS"):
        train, test = make_split()
        both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
        both.write.mode("overwrite").partitionBy("split").parquet(path)
    return spark.read.parquet(path)


def append_run(spark: SparkSession, path: str, **settings) -> None:
    """Run ledger: append one row of settings per run."""
    spark.createDataFrame([Row(**settings)]).write.mode("append").parquet(path)


def _write_attrs(spark: SparkSession, path: str, attrs: dict) -> None:
    spark.createDataFrame([(json.dumps(attrs),)], "attrs string").coalesce(1).write.mode("overwrite").text(
        f"{path}/attrs")


def _read_attrs(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/attrs").first()[0])


def save_fill_model(spark: SparkSession, path: str, fitted, attrs: dict, overwrite: bool = False) -> None:
    """Save back-off context tables: one parquet table per context plus attributes."""
    if exists(spark, path) and not overwrite:
        raise FileExistsError(f"{path} exists; pass overwrite=True to replace it")
    _write_attrs(spark, path, {**attrs, "contexts": [list(c) for c, _ in fitted]})
    for i, (_, tbl) in enumerate(fitted):
        tbl.write.mode("overwrite").parquet(f"{path}/context_{i}")


def load_fill_model(spark: SparkSession, path: str):
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is not a saved model directory")
    attrs = _read_attrs(spark, path)
    fitted = [(ctx, spark.read.parquet(f"{path}/context_{i}")) for i, ctx in enumerate(attrs["contexts"])]
    return fitted, attrs


def save_fit_record(spark: SparkSession, path: str, record: dict) -> None:
    """Save what ``synth.fit_record`` gives: the counts as parquet, the rest as attributes."""
    if exists(spark, path):
        raise FileExistsError(f"{path} exists")
    record["counts"].write.parquet(f"{path}/counts")
    _write_attrs(spark, path, {k: v for k, v in record.items() if k != "counts"})


def load_fit_record(spark: SparkSession, path: str) -> dict:
    return {**_read_attrs(spark, path), "counts": spark.read.parquet(f"{path}/counts")}


def save_tokenizer(path: str, vocab: DataFrame, merges: DataFrame) -> None:
    vocab.write.mode("overwrite").parquet(os.path.join(path, "vocab"))
    merges.write.mode("overwrite").parquet(os.path.join(path, "merges"))


def load_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(os.path.join(path, "vocab")), spark.read.parquet(os.path.join(path, "merges"))
