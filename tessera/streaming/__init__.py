"""Incremental scene ingest (Structured Streaming).

The source pipeline reads whole scenes in batch and has no streaming
operators, so nothing stateful lives here.  What a Spark user does when
new scene files keep arriving is the stateless half of the preparation on
a file stream: sentinel cleanup and NDVI per row, appended to the scene
store partitioned by date.  Pixel ids are a global rank and stay a batch
step (``operators.ids``) over the stored table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.operators.scene import sentinel_to_null, with_ndvi
from tessera.session import checkpoint_dir
from tessera.sources.scene import SCENE_FILE_SCHEMA


def scene_stream(spark: SparkSession, path: str, schema: T.StructType = SCENE_FILE_SCHEMA,
                 fmt: str = "csv", max_files: int | None = None) -> DataFrame:
    """Streaming scan of scene files with an explicit schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def prepare_stream(stream: DataFrame) -> DataFrame:
    """Per-row preparation that needs no global state."""
    return with_ndvi(sentinel_to_null(stream))


def ingest(stream: DataFrame, out_path: str, name: str = "scene-ingest", once: bool = True):
    """Append prepared rows to parquet partitioned by DOY; the checkpoint
    location sits in the shared checkpoint folder so a restarted query
    resumes exactly once."""
    own = hashlib.sha1(out_path.encode()).hexdigest()[:16]  # each output has a checkpoint of its own
    ckpt = f"{checkpoint_dir(stream.sparkSession).rstrip('/')}/{name}-{own}"
    writer = (prepare_stream(stream).writeStream.format("parquet").outputMode("append")
              .partitionBy("DOY").option("checkpointLocation", ckpt).option("path", out_path))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.start()
