"""Worked metric examples of the source pipeline (golden numbers)."""

import pytest
from tessera.operators import metrics as m


def _pairs(spark, preds, refs, weights=None):
    rows = [(i, float(p), float(r), float(weights[i]) if weights else 1.0) for i, (p, r) in enumerate(zip(preds, refs))]
    return spark.createDataFrame(rows, "i int, p double, r double, w double")


def test_accuracy_share(spark):
    df = _pairs(spark, [0, 1, 1, 2, 1, 0], [0, 1, 2, 0, 1, 2])
    assert m.accuracy(df, "p", "r").first()[0] == pytest.approx(0.5)


def test_accuracy_count(spark):
    df = _pairs(spark, [0, 1, 1, 2, 1, 0], [0, 1, 2, 0, 1, 2])
    assert m.accuracy(df, "p", "r", normalize=False).first()[0] == pytest.approx(3.0)


def test_accuracy_weighted(spark):
    df = _pairs(spark, [0, 1, 1, 2, 1, 0], [0, 1, 2, 0, 1, 2], [0.5, 2, 0.7, 0.5, 9, 0.4])
    assert m.accuracy(df, "p", "r", weight="w").first()[0] == pytest.approx(0.8778625954198473)


def test_accuracy_multilabel(spark):
    df = spark.createDataFrame([([0, 1], [0, 1]), ([1, 1], [1, 0])], "p array<int>, r array<int>")
    assert m.accuracy(df, "p", "r").first()[0] == pytest.approx(0.5)


def test_mae(spark):
    df = _pairs(spark, [2.5, 0.0, 2, 8], [3, -0.5, 2, 7])
    assert m.mae(df, "p", "r").first()[0] == pytest.approx(0.5)


def test_mae_multi_uniform_and_raw(spark):
    df = spark.createDataFrame([([0.5, 1.0], [0.0, 2.0]), ([-1.0, 1.0], [-1.0, 2.0]), ([7.0, -6.0], [8.0, -5.0])],
                               "p array<double>, r array<double>")
    out = {r["output"]: r["mae"] for r in m.mae_multi(df, "p", "r").collect()}
    assert out["uniform_average"] == pytest.approx(0.75)
    assert out["o0"] == pytest.approx(0.5) and out["o1"] == pytest.approx(1.0)


def test_mae_output_weights(spark):
    df = spark.createDataFrame([([0.5, 1.0], [0.0, 2.0]), ([-1.0, 1.0], [-1.0, 2.0]), ([7.0, -6.0], [8.0, -5.0])],
                               "p array<double>, r array<double>")
    out = {r["output"]: r["mae"] for r in m.mae_multi(df, "p", "r", output_weights=[0.3, 0.7]).collect()}
    assert out["weighted_average"] == pytest.approx(0.85)


def test_prf_weighted_matches_definition(spark):
    y_true = [0, 1, 2, 0, 1, 2, 2]
    y_pred = [0, 2, 1, 0, 0, 1, 2]
    df = spark.createDataFrame(list(zip(y_pred, y_true)), "p int, r int")
    got = m.prf_weighted(df, "p", "r").first()
    classes = sorted(set(y_true) | set(y_pred))
    tot = len(y_true)
    P = R = F1 = 0.0
    for c in classes:
        tp = sum(1 for a, b in zip(y_pred, y_true) if a == b == c)
        npred = sum(1 for a in y_pred if a == c)
        sup = sum(1 for b in y_true if b == c)
        p = tp / npred if npred else 0.0
        r = tp / sup if sup else 0.0
        f = 2 * p * r / (p + r) if p + r else 0.0
        P += sup * p / tot
        R += sup * r / tot
        F1 += sup * f / tot
    assert got["precision"] == pytest.approx(P) and got["recall"] == pytest.approx(R)
    assert got["f1"] == pytest.approx(F1)


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4]], "v double")
    h = {r["bin"]: r["n"] for r in m.band_histogram(df, "v", 4).collect()}
    assert h == {0: 1, 1: 1, 2: 1, 3: 2}


def test_l1_l2_by_key(spark):
    truth = spark.createDataFrame([(1, 1, 1, 2, 3), (2, 1, 0, 0, 0)], "PID int, DOY int, B02 int, B03 int, B04 int")
    imp = spark.createDataFrame([(1, 1, 2.0, 2.0, 5.0)], "PID int, DOY int, B02 double, B03 double, B04 double")
    r = m.l1_l2(truth, imp).first()
    assert r["L1"] == pytest.approx(3.0) and r["L2"] == pytest.approx(5 ** 0.5, abs=1e-6)
    assert r["n_matched"] == 1 and r["n_unmatched"] == 1


def test_value_dist_excludes_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    d = {r["value"]: r["p"] for r in m.value_dist(df, "c").collect()}
    assert d == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)}
