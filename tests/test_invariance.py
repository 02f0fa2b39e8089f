"""Rows-only keys give the same rows under different shuffle partition counts."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

KEYS = ["shuffle_rows", "impute_draw", "complete_prompts", "model_roundtrip"]


def _rows(spark, key):
    return sorted(map(repr, (tuple(r) for r in E.queries()[key](spark, SF_SMALL).collect())))


@pytest.mark.parametrize("key", KEYS)
def test_partition_invariance(spark, key):
    base = None
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "7", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = _rows(spark, key)
            base = got if base is None else base
            assert got == base, f"{key} differs with {parts} partitions"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
