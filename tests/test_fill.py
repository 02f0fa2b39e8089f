"""Fill, draws, synthesis and batch-model contracts on the small scene."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera.functions.expr import BANDS
from tessera.operators import fill, synth as sy, udf
from tessera.plans import recover as rc


@pytest.fixture(scope="module")
def t(spark):
    return rc.tables(spark, SF_SMALL)


def test_impute_keeps_present_cells(t):
    todo = rc.impute_table(t)
    out = fill.impute(todo, t.clear)
    j = todo.alias("a").join(out.alias("b"), ["PID", "DOY"])
    for b in BANDS:
        assert j.filter(F.col(f"a.{b}").isNotNull() & (F.col(f"a.{b}") != F.col(f"b.{b}"))).count() == 0
    assert out.filter(" OR ".join(f"{b} IS NULL" for b in BANDS)).count() == 0


def test_skipped_plus_filled_is_input(t):
    todo = rc.impute_table(t).select("PID", "DOY", *BANDS)
    out = fill.impute(todo, t.clear, contexts=(("PID",),))
    skipped = fill.rows_not_imputed(todo, out)
    assert out.count() + skipped.count() == todo.count()


def test_mode_ties_to_smallest(spark):
    train = spark.createDataFrame([(1, 5), (1, 3), (1, 5), (1, 3), (2, 9)], "DOY int, B02 int")
    rows = spark.createDataFrame([(1, None), (2, None)], "DOY int, B02 int")
    out = {r["DOY"]: r["B02"] for r in fill.impute(rows, train, ["B02"], (("DOY",), ()), "mode").collect()}
    assert out == {1: 3, 2: 9}


def test_draws_stay_in_support_and_follow_shares(spark):
    counts = spark.createDataFrame([("a", 700), ("b", 200), ("c", 100)], "value string, n long")
    rows = spark.range(20000).withColumnRenamed("id", "k")
    got = sy.start_categorical(rows, "k", "c", counts, seed=5)
    freq = {r["start"]: r["count"] for r in got.groupBy("start").count().collect()}
    assert set(freq) == {"c is a,", "c is b,", "c is c,"}
    assert sum(freq.values()) == 20000
    # chi-square with 2 degrees of freedom, 0.999 quantile is 13.8
    exp = {"c is a,": 14000, "c is b,": 4000, "c is c,": 2000}
    chi = sum((freq[k] - e) ** 2 / e for k, e in exp.items())
    assert chi < 13.8


def test_choose_sampler(spark):
    counts = spark.createDataFrame([("a", 1)], "value string, n long")
    assert sy.choose_sampler() == "random"
    assert sy.choose_sampler("c", counts) == "categorical"
    with pytest.raises(ValueError):
        sy.choose_sampler("c")


def test_impute_with_retry_contract(spark, t):
    rows = rc.impute_table(t).select((F.col("PID").cast("long") * 1000 + F.col("DOY")).alias("row_id"),
                                     "DOY", *BANDS)

    def flaky(pdf, seed):
        keep = (pdf["row_id"] + seed) % 2 == 0
        for b in BANDS:
            pdf.loc[keep & pdf[b].isna(), b] = 1.0
        return pdf

    out = udf.impute_with_retry(rows, flaky, ["row_id"], BANDS, max_retries=3)
    assert out.count() == rows.count()
    assert out.select("row_id").distinct().count() == rows.count()


def test_synthesize_returns_n_valid_rows(spark, t):
    keys = spark.range(300).withColumnRenamed("id", "k")
    out = sy.synthesize(keys, "k", t.clear, "DOY", BANDS, n=250, seed=3)
    assert out.count() == 250
    assert out.filter(" OR ".join(f"{b} IS NULL" for b in BANDS)).count() == 0


def test_exact_split_size_and_complement(t):
    import math
    from tessera.operators import sampling as sp
    clear = t.clear
    n = clear.count()
    train, test = sp.exact_split(clear, ["PID", "DOY"], 0.05, seed=42)
    assert test.count() == math.ceil(0.05 * n)
    assert train.count() + test.count() == n
    assert train.join(test, ["PID", "DOY"]).count() == 0
