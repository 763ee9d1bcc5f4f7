"""Property tests (hypothesis) against brute force on small random inputs."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kredo.operators import metrics as M
from kredo.operators.ordered import exact_percentiles

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.05, 0.1, 0.25, 0.5, 0.5, 0.73, 0.9, 1.0])),
                min_size=1, max_size=60),
       st.lists(st.sampled_from([0.1, 0.25, 0.5, 0.6, 0.73, 0.95]), min_size=1, max_size=8))
def test_sweep_matches_literal_loop(spark, rows, thresholds):
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(rows)], "id long, y_true int, y_proba double")
    costs = {}
    for t in thresholds:                       # the reference's loop, dict semantics
        fn = sum(1 for y, p in rows if y == 1 and not p >= t)
        fp = sum(1 for y, p in rows if y == 0 and p >= t)
        costs[t] = fn * 10 + fp
    best = min(costs, key=costs.get)
    r = M.find_optimal_threshold(df, thresholds=thresholds).first()
    assert r.optimal_threshold == best and r.min_business_cost == costs[best]


@SETTINGS
@given(st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=1, max_size=80),
       st.sampled_from([0.0, 0.25, 0.5, 0.9, 0.95, 1.0]), st.integers(1, 6))
def test_exact_percentile_matches_numpy(spark, values, p, buckets):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_percentiles(df, "v", {"q": p}, buckets=buckets).first().q
    assert got == pytest.approx(float(np.percentile(values, p * 100)), rel=1e-9, abs=1e-9)
