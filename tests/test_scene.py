"""Scene view, splits and hold-out against the fixture table and properties."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera.operators import scene as sc
from tessera.operators.ids import dense_ids
from tessera.sources.scene import scene


@pytest.fixture(scope="module")
def small(spark):
    # the 40 x 25 grid of the fixture table
    raw = scene(spark, SF_SMALL, 40, 25)
    data = sc.prepare(raw).cache()
    return raw, data


def test_fixture_counts(small):
    raw, data = small
    assert raw.count() == 2485
    assert sc.rows_missing(data).count() == 167
    assert sc.rows_clear(data).count() == 1335
    assert sc.rows_cloudy(data).count() == 983
    assert data.filter("DOY = 211").count() == 354


def test_holdout_box_and_complement(small):
    _, data = small
    clear = sc.split(data).clear
    train, test = sc.aoi_holdout(clear, 211, 5, 2, 20, 8)
    assert test.count() == 58
    assert train.count() + test.count() == clear.count()
    assert train.join(test, ["PID", "DOY"]).count() == 0


def test_split_partition_of_scene(small):
    _, data = small
    n = data.count()
    parts = sc.rows_missing(data).count() + sc.rows_clear(data).count() + sc.rows_cloudy(data).count()
    assert parts == n


def test_pixel_ids_equal_dense_rank(small, spark):
    raw, _ = small
    from pyspark.sql import Window
    got = dense_ids(raw, ["X", "Y"], "PID").select("X", "Y", "PID").distinct()
    want = raw.select("X", "Y").distinct().withColumn(
        "PID", F.dense_rank().over(Window.orderBy("X", "Y")) - 1)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_pixel_ids_partition_invariant(small, parts):
    raw, _ = small
    a = dense_ids(raw, ["X", "Y"], "PID", n=parts).select("X", "Y", "PID")
    b = dense_ids(raw, ["X", "Y"], "PID", n=3).select("X", "Y", "PID")
    assert a.exceptAll(b).count() == 0


def test_ndvi_zero_denominator_and_flag_two(spark):
    rows = [(1, 1, 211, 10, 10, 10, -10, 0, 0, 0, 0, 0),   # B05 + B04 = 0 -> NDVI null -> missing
            (2, 1, 211, 10, 10, 10, 30, 2, 0, 0, 0, 0)]    # flag 2: neither clear nor cloudy
    cols = "X int, Y int, DOY int, B02 int, B03 int, B04 int, B05 int, cloud int, adj_cloud int, " \
           "cloud_shadow int, snow_ice int, water int"
    data = sc.prepare(spark.createDataFrame(rows, cols))
    assert sc.rows_missing(data).count() == 1
    assert sc.rows_clear(data).count() == 0 and sc.rows_cloudy(data).count() == 0


def test_sentinel_never_nan(spark):
    df = spark.createDataFrame([(1, -9999), (2, 5)], "a int, b int")
    out = sc.sentinel_to_null(df).collect()
    assert out[0]["b"] is None and out[1]["b"] == 5


def test_check_columns_and_table_from_rows(spark):
    with pytest.raises(ValueError):
        sc.table_from_rows(spark, [(1, 2)], ["a"])
    df = sc.table_from_rows(spark, [(1, 2)], ["a", "b"])
    sc.check_columns(df, ["b", "a"])
    with pytest.raises(ValueError):
        sc.check_columns(df, ["a"])
    assert sc.numeric_columns(df) == ["a", "b"]


def test_select_doys_repeats_rows(small):
    _, data = small
    n211 = data.filter("DOY = 211").count()
    assert sc.select_doys(data, [211, 211]).count() == 2 * n211
