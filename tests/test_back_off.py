"""Exact medians and modes, fit records and prompts of mixed types."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import fill, synth
from tessera.operators import prompts as pr
from tessera.sources import artefacts as art


def test_whole_medians_of_many_values(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=40_001).round(6), rng.integers(-50, 50, 40_001)
    df = spark.createDataFrame([(float(x), int(y), None) for x, y in zip(a, b)], "a double, b int, c int")
    got = fill.whole_medians(df, ["a", "b", "c"]).first()
    assert got["a"] == statistics.median(a.tolist()) and got["b"] == statistics.median(b.tolist())
    assert got["c"] is None
    even = spark.createDataFrame([(1.0,), (4.0,), (None,)], "a double")
    assert fill.whole_medians(even, ["a"]).first()["a"] == 2.5
    assert fill.whole_medians(even.limit(0), ["a"]).first()["a"] is None
    plan = fill.whole_medians(df, ["a"])._jdf.queryExecution().toString()
    assert "median" not in plan and "percentile" not in plan


def test_modes_of_unlike_types(spark):
    train = spark.createDataFrame(
        [(1, "b", 2**60 + 1, 0.5), (1, "a", 2**60 + 1, 0.5), (1, None, 7, 0.25), (2, None, None, None)],
        "k int, s string, n long, x double")
    todo = spark.createDataFrame([(1, None, None, None), (2, None, None, None)], train.schema)
    out = {r.k: tuple(r)[1:] for r in fill.impute(todo, train, ["s", "n", "x"], (("k",), ()), "mode").collect()}
    assert out == {1: ("a", 2**60 + 1, 0.5), 2: ("a", 2**60 + 1, 0.5)}


def test_fit_record_round_trip(spark, tmp_path):
    train = spark.createDataFrame([("f", 26.0), ("m", 30.5), ("f", None)], "sex string, age double")
    path = str(tmp_path / "r")
    art.save_fit_record(spark, path, synth.fit_record(train))
    record = art.load_fit_record(spark, path)
    assert (record["columns"], record["numeric"], record["conditional"], record["kind"]) == (
        ["sex", "age"], ["age"], "age", "continuous")
    with pytest.raises(FileExistsError):
        art.save_fit_record(spark, path, record)
    rows = spark.range(60).withColumnRenamed("id", "k")
    assert {r.start for r in synth.start_texts(rows, "k", record).collect()} == {"age is 26.00000,", "age is 30.50000,"}
    sex = synth.fit_record(train, "sex")
    assert synth.choose_sampler(record=sex) == "categorical" and synth.choose_sampler() == "random"
    assert {r.start for r in synth.start_texts(rows, "k", sex).collect()} == {"sex is f,", "sex is m,"}
    assert {r.start for r in synth.start_texts(rows, "k", cols=["sex"]).collect()} == {"sex is "}
    with pytest.raises(ValueError):
        synth.fit_record(train, "height")


def test_prompts_of_mixed_types(spark):
    train = spark.createDataFrame(
        [("female", 26, 1.5), ("female", 26, 2.5), ("male", 40, 9.0), ("male", 40, 9.0), ("male", None, None)],
        "Sex string, Age int, Pay double")
    prompts = spark.createDataFrame(
        [(0, "Sex is female, Age is 26"), (1, "Age is 40, Sex is"), (2, "Sex is male, Age is old"), (3, ""),
         (4, None), (5, "Pay is 3.25, Nothing is 1"), (6, "Sex is None, Age is 26")], "k long, prompt string")
    got = {r.k: (r.Sex, r.Age, r.Pay) for r in pr.complete_prompts(prompts, train, "k", [["Sex", "Age"], ["Age"], ["Sex"], []])
           .collect()}
    assert got == {0: ("female", 26, 2.0), 1: ("male", 40, 9.0), 2: ("male", 40, 9.0), 3: ("male", 33, 5.75),
                   4: ("male", 33, 5.75), 5: ("male", 33, 3.25), 6: ("female", 26, 2.0)}
    parsed = pr.parse_prompts(prompts, train, "k")
    assert parsed.filter(F.col("k") == 2).first()["Age"] is None and parsed.schema["Age"].dataType.typeName() == "integer"
    assert pr.complete_prompts(prompts.limit(0), train, "k").count() == 0
