"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage with a copy that all executors can reach, so a lost
    executor costs only its running tasks.
    """
    return _written(df, tag)[0]


def _written(df: DataFrame, tag: str):
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def passing(spark: SparkSession):
    """A ``stored`` whose copies are deleted at the end: for steps whose result is stored before that."""
    paths = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        out, path = _written(df, tag)
        paths.append(path)
        return out

    try:
        yield keep
    finally:
        for path in paths:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Let Spark hand Python at most ``size`` bytes at a time from now on (whole texts; never raises the setting)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    held = int(now[:-1]) * units[now[-1]] if now[-1] in units else int(now)
    if held < 0 or held > size:
        spark.conf.set(name, f"{size}b")


def release_memory() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def ascii_lower(text: str) -> str:
    """A-Z lower-cased, nothing else; never changes the length."""
    if text.isascii():
        return text.lower()
    low = text.lower()
    return low if len(low) == len(text) and not _CASED.search(text) else text.translate(ASCII_LOWER)


import regex as _regex  # noqa: E402

# upper-case characters beyond ASCII: str.lower would change them
_CASED = _regex.compile(r"[\p{Lu}\p{Lt}--[A-Z]]", _regex.V1)
