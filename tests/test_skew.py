"""One key / value / group holding a third of all rows: results stay exact."""

import random

import numpy as np
import pytest

from kredo.operators import aggregates as A
from kredo.operators import metrics as M
from kredo.operators.ordered import exact_percentiles
from kredo.operators.profile import category_shares


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        hot = i % 3 == 0                       # a third of the rows
        key = 1 if hot else rnd.randint(2, 400)
        value = 0.5 if hot else round(rnd.random(), 3)
        rows.append((key, value, int(rnd.random() < 0.3), "hot" if hot else f"g{key % 5}"))
    df = spark.createDataFrame(rows, "SK_ID_CURR long, v double, y int, grp string").repartition(8)
    return rows, df


def test_hot_key_aggregate(spark, skewed):
    rows, df = skewed
    out = {r.SK_ID_CURR: r for r in A.agg_by_key(df, {"v": ["count", "sum", "nunique"]}, "x").collect()}
    hot = [v for k, v, _, _ in rows if k == 1]
    assert out[1].x_v_count == len(hot) == 1000
    assert out[1].x_v_sum == pytest.approx(sum(hot)) and out[1].x_v_nunique == 1


def test_hot_group_and_value_percentiles(spark, skewed):
    rows, df = skewed
    got = {r.grp: r for r in exact_percentiles(df, "v", {"p50": .5, "p95": .95}, ["grp"], buckets=8).collect()}
    for g in {r[3] for r in rows}:
        vals = [v for _, v, _, gg in rows if gg == g]
        assert got[g].p50 == pytest.approx(np.percentile(vals, 50))
        assert got[g].p95 == pytest.approx(np.percentile(vals, 95))


def test_hot_probability_sweep(spark, skewed):
    rows, df = skewed
    scored = df.selectExpr("SK_ID_CURR AS id", "y AS y_true", "v AS y_proba")
    curve = {r.i: r.cost for r in M.cost_curve(scored).collect()}
    for i, t in enumerate(M.threshold_grid()):
        fn = sum(1 for _, p, y, _ in rows if y == 1 and not p >= t)
        fp = sum(1 for _, p, y, _ in rows if y == 0 and p >= t)
        assert curve[i] == 10 * fn + fp


def test_hot_category(spark, skewed):
    rows, df = skewed
    top = [r for r in category_shares(df, ["grp"]).collect() if r["rank"] == 1][0]
    assert top.value == "hot" and top.n == 1000 and top.share == pytest.approx(1 / 3)
