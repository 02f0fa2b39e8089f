"""File-stream ingest gives the same rows as the batch preparation."""

import uuid

from conftest import SF_SMALL
from tessera.operators import scene as sc
from tessera.session import checkpoint_dir
from tessera.sources.scene import scene, write_csv
from tessera import streaming as st


def test_ingest_matches_batch(spark):
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-test-{uuid.uuid4().hex}"
    raw = scene(spark, SF_SMALL, 40, 25)
    write_csv(raw, f"{base}/in")
    q = st.ingest(st.scene_stream(spark, f"{base}/in", raw.schema), f"{base}/out", name=f"ck-{uuid.uuid4().hex}")
    q.awaitTermination()
    got = spark.read.parquet(f"{base}/out").select(*raw.columns, "NDVI")
    want = sc.with_ndvi(sc.sentinel_to_null(raw))
    assert got.count() == want.count() == 2485
    assert got.exceptAll(want.select(*got.columns)).count() == 0
