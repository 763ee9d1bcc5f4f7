import math

import pytest

from kredo.operators.scaling import apply_scaler, fit_scaler, scale_features


def _col(df, c):
    return [r[c] for r in df.orderBy("id").collect()]


def test_standard_population_std(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "id long, feat1 double")
    tr, _, params = scale_features(df, method="standard", cols=["feat1"])
    assert _col(tr, "feat1") == pytest.approx([-1.414214, -0.707107, 0.0, 0.707107, 1.414214], abs=1e-6)


def test_minmax_and_test_not_clipped(spark):
    train = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "id long, feat1 double")
    test = spark.createDataFrame([(1, 9.0), (2, 0.0)], "id long, feat1 double")
    tr, te, _ = scale_features(train, test, method="minmax", cols=["feat1"])
    assert _col(tr, "feat1") == pytest.approx([0, .25, .5, .75, 1])
    assert _col(te, "feat1") == pytest.approx([2.0, -0.25])


def test_constant_single_row_and_extremes(spark):
    df = spark.createDataFrame([(1, 5.0, 1e10, 1e-10), (2, 5.0, 2e10, 2e-10), (3, 5.0, 0.0, 0.0)],
                               "id long, c double, big double, small double")
    for m in ("standard", "minmax"):
        tr, _, _ = scale_features(df, method=m, cols=["c", "big", "small"])
        assert _col(tr, "c") == [0.0, 0.0, 0.0]
        assert all(math.isfinite(v) for v in _col(tr, "big") + _col(tr, "small"))
    one = spark.createDataFrame([(1, 3.0)], "id long, c double")
    assert _col(scale_features(one, cols=["c"])[0], "c") == [0.0]


def test_errors(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), 2.0)], "id long, feat1 double, feat2 double")
    with pytest.raises(ValueError):
        fit_scaler(df, ["feat1", "feat2"])
    ok = spark.createDataFrame([(1, 1.0)], "id long, feat1 double")
    with pytest.raises(ValueError):
        fit_scaler(ok, ["feat1"], method="robust")
    with pytest.raises(ValueError):
        apply_scaler(ok, {"feat1": {"mean": 0, "std": 1, "min": 0, "max": 1}}, method="robust")
