import random

import pytest

from kredo.operators import metrics as M


def frame(spark, y_true, y_pred=None, y_proba=None):
    n = len(y_true)
    y_pred = y_pred or [0] * n
    y_proba = y_proba or [None] * n
    return spark.createDataFrame(list(zip(range(n), y_true, y_pred, y_proba)),
                                 "id long, y_true int, y_pred int, y_proba double")


@pytest.mark.parametrize("y_true,y_pred,cost", [
    ([0, 0, 1, 1], [0, 0, 1, 1], 0), ([0, 0, 1, 1], [1, 1, 0, 0], 22), ([0, 1, 0, 1], [0, 0, 1, 1], 11),
    ([0, 0, 0, 0], [0, 1, 1, 0], 2), ([1, 1, 1, 1], [0, 1, 0, 1], 20)])
def test_business_cost(spark, y_true, y_pred, cost):
    assert M.business_cost(frame(spark, y_true, y_pred)).first()[0] == cost


def test_custom_costs(spark):
    df = frame(spark, [0, 1, 0], [1, 0, 1])
    assert M.business_cost(df, cost_fn=5, cost_fp=1).first()[0] == 7
    assert M.business_cost(df, cost_fn=1, cost_fp=5).first()[0] == 11


def test_worst_and_all_zero(spark):
    r = M.classification_metrics(frame(spark, [0, 0, 1, 1, 0, 1], [1, 1, 0, 0, 1, 0])).first()
    assert (r.accuracy, r.fn, r.fp, r.business_cost) == (0.0, 3, 3, 33)
    r = M.classification_metrics(frame(spark, [0, 0, 1, 1, 0], [0, 0, 0, 0, 0])).first()
    assert r.accuracy == pytest.approx(0.6) and r.recall == 0.0 and r.precision == 0.0 and r.f1 == 0.0


def test_threshold_grid_values():
    g = M.threshold_grid()
    assert len(g) == 80 and g[0] == 0.1 and g[41] == 0.5099999999999998


def test_separated(spark):
    df = frame(spark, [0, 0, 0, 1, 1, 1], y_proba=[.1, .2, .15, .8, .9, .85])
    r = M.find_optimal_threshold(df).first()
    assert r.optimal_threshold == 0.20999999999999996 and r.min_business_cost == 0
    assert M.average_precision(df).first()[0] == pytest.approx(1.0)


def test_shared_fixture(spark):
    df = frame(spark, [0, 1, 1, 0, 1, 0, 1, 1, 0, 0], [0, 1, 1, 0, 1, 1, 1, 1, 0, 0],
               [.1, .9, .8, .2, .7, .6, .75, .85, .1, .15])
    r = M.evaluate_model(df).first()
    assert r.business_cost == 1
    assert r.auc_pr == pytest.approx(1.0)
    assert r.optimal_threshold == 0.6099999999999998 and r.min_business_cost == 0
    assert r.business_score == 0


def test_overlap(spark):
    df = frame(spark, [0, 0, 1, 1], [0, 1, 1, 0], [.1, .6, .8, .4])
    r = M.evaluate_model(df).first()
    assert r.business_cost == 11
    assert r.auc_pr == pytest.approx(0.833333, abs=1e-6)
    assert r.optimal_threshold == 0.11 and r.min_business_cost == 1
    assert r.business_score == -r.min_business_cost


def test_no_positive_gives_zero_ap(spark):
    assert M.average_precision(frame(spark, [0, 0], y_proba=[.2, .3])).first()[0] == 0.0


def test_one_pass_sweep_equals_brute_force(spark):
    rnd = random.Random(7)
    n = 400
    yt = [rnd.randint(0, 1) for _ in range(n)]
    yp = [round(rnd.random(), 2) for _ in range(n)]  # many ties and exact grid hits
    df = frame(spark, yt, y_proba=yp)
    curve = {r.i: r.cost for r in M.cost_curve(df).collect()}
    grid = M.threshold_grid()
    for i, t in enumerate(grid):
        fn = sum(1 for a, p in zip(yt, yp) if a == 1 and not p >= t)
        fp = sum(1 for a, p in zip(yt, yp) if a == 0 and p >= t)
        assert curve[i] == fn * 10 + fp
    costs = [curve[i] for i in range(len(grid))]
    best = costs.index(min(costs))
    assert M.optimal_threshold(M.cost_curve(df)).first().optimal_threshold == grid[best]


def test_ap_brute_force(spark):
    rnd = random.Random(3)
    yt = [rnd.randint(0, 1) for _ in range(300)]
    yp = [round(rnd.random(), 2) for _ in range(300)]
    df = frame(spark, yt, y_proba=yp)
    scores = sorted(set(yp), reverse=True)
    npos = sum(yt)
    ap, ctp, cfp = 0.0, 0, 0
    for s in scores:
        tp = sum(1 for a, p in zip(yt, yp) if p == s and a == 1)
        fp = sum(1 for a, p in zip(yt, yp) if p == s and a == 0)
        ctp, cfp = ctp + tp, cfp + fp
        ap += tp / npos * ctp / (ctp + cfp)
    assert M.average_precision(df.repartition(5)).first()[0] == pytest.approx(ap, rel=1e-12)


def test_unscored_positives_count_against_average_precision(spark):
    from kredo.operators.metrics import average_precision
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, None), (0, None)], "y_true int, y_proba double")
    assert average_precision(df).first().auc_pr == 0.5
