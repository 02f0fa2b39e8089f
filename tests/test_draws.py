"""Draws from frequency tables: every temperature, many values, ordered merges against plain search."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.expr import uniform
from tessera.operators import synth

N = 12_000


@pytest.mark.parametrize("temperature", [1e-32, 0.1, 0.7, 1.0, 3.0, 10.0])
def test_shares_at_any_temperature(spark, temperature):
    have = {1.0: 100, 2.0: 90, 3.0: 20, 4.0: 1}
    train = spark.createDataFrame([(7, v) for v, n in have.items() for _ in range(n)], "DOY int, B02 double")
    rows = spark.range(N).select(F.col("id").alias("k"), F.lit(7).alias("DOY"), F.lit(None).cast("double").alias("B02"))
    got = Counter(r.B02 for r in synth.impute_draw(rows, train, "k", ["B02"], temperature=temperature).collect())
    weight = {v: (n / 100) ** (1 / temperature) for v, n in have.items()}
    total = sum(weight.values())
    want = {v: N * w / total for v, w in weight.items()}
    seen = [v for v in have if want[v] >= 5]
    assert sum(got.values()) == N and sum(got[v] for v in have if v not in seen) < 30
    chi2 = sum((got[v] - want[v]) ** 2 / want[v] for v in seen)
    assert chi2 < len(seen) + 5 * math.sqrt(2 * len(seen))
    if temperature == 1e-32:
        assert set(got) == {1.0}


def test_longest_context_with_data_wins(spark):
    train = spark.createDataFrame([(1, 10), (1, 10), (2, None), (3, 30)], "DOY int, B02 int")
    rows = spark.createDataFrame([(0, 1, None), (1, 2, None), (2, None, None), (3, 9, None), (4, 1, 5)],
                                 "k long, DOY long, B02 int")
    got = {r.k: r.B02 for r in synth.impute_draw(rows, train, "k", ["B02"]).collect()}
    assert got[0] == 10.0 and got[4] == 5.0 and {got[1], got[2], got[3]} <= {10.0, 30.0}
    none = synth.impute_draw(rows, train.limit(0), "k", ["B02"]).collect()
    assert {r.k: r.B02 for r in none} == {0: None, 1: None, 2: None, 3: None, 4: 5.0}
    with pytest.raises(ValueError):
        synth.impute_draw(rows, train, "k", ["B02"], temperature=0.0)


@pytest.mark.parametrize("parts", ["1", "3", "16"])
def test_lookup_of_many_values(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rng = np.random.default_rng(3)
        n = rng.integers(1, 50, 30_000)
        counts = spark.createDataFrame([(i, int(c)) for i, c in enumerate(n)], "value int, n long")
        rows = spark.range(5000).select(F.col("id").alias("k"), uniform(F.col("id"), 1).alias("u"))
        out = synth.draw(rows, counts, "u", "value", "value").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = np.lexsort((np.arange(len(n)), -n))
    ends = np.cumsum(n[order])
    want = {r.k: int(order[np.searchsorted(ends, math.floor(r.u * int(ends[-1])), "right")]) for r in rows.collect()}
    assert len(out) == 5000 and {r.k: r.value for r in out} == want


def test_many_draws_of_one_value(spark):
    counts = spark.createDataFrame([("only", 1)], "value string, n long")
    rows = spark.range(3000).select(F.col("id").alias("k"), uniform(F.col("id"), 2).alias("u"))
    out = synth.draw(rows, counts, "u", "value", "v")
    assert out.count() == 3000 and {r.v for r in out.collect()} == {"only"}
