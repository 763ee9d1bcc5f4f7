import json

import pytest

from kredo.functions.payload import payload_frame
from kredo.operators import drift as D

# four payloads against five reference rows; the means and shares are worked out below
RECENT = [{"AMT_CREDIT": "30", "AMT_ANNUITY": "hh", "FLAG_OWN_CAR": "1", "NAME_FAMILY_STATUS": "x"},
          {"AMT_CREDIT": "50", "AMT_ANNUITY": 8.0, "FLAG_OWN_CAR": "Y", "NAME_FAMILY_STATUS": "x"},
          {"AMT_CREDIT": "10d", "AMT_ANNUITY": 12.0, "FLAG_OWN_CAR": 1, "NAME_FAMILY_STATUS": "y"},
          {"AMT_CREDIT": 40, "FLAG_OWN_CAR": "N", "NAME_FAMILY_STATUS": "y"}]
REFERENCE = [(20.0, 10.0, 1, "z"), (40.0, 10.0, 1, "z"), (30.0, 10.0, 1, "x"), (35.0, 10.0, 0, "z"), (25.0, 10.0, 1, "y")]


@pytest.fixture()
def sides(spark):
    # recent rows arrive as JSON payloads of a log; the reference is a table
    logs = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(RECENT)],
                                 "log_id long, input_data string")
    recent = payload_frame(logs, "input_data", fields=D.MONITORED_INPUT_FIELDS)
    ref = spark.createDataFrame(REFERENCE, "AMT_CREDIT double, AMT_ANNUITY double, FLAG_OWN_CAR int, NAME_FAMILY_STATUS string")
    return recent, ref


def test_mixed_drift_of_text_and_typed_sides(sides):
    recent, ref = sides
    det = {r.feature: r for r in D.compare_fields(recent, ref).collect()}
    assert set(det) == {"AMT_CREDIT", "AMT_ANNUITY", "FLAG_OWN_CAR", "NAME_FAMILY_STATUS"}
    # (30 + 50 + 40) / 3 = 40 against 30; '10d' and 'hh' are no numbers
    assert det["AMT_CREDIT"].change == pytest.approx(1 / 3)
    assert det["AMT_ANNUITY"].change == pytest.approx(0.0)
    # yes in 3 of 4 against 4 of 5, however it is written
    assert det["FLAG_OWN_CAR"].change == pytest.approx(0.05 / 0.8)
    # the most frequent value is another one (a tie goes to the smaller)
    assert det["NAME_FAMILY_STATUS"].change == 1.0
    assert det["AMT_CREDIT"].reference_display.startswith("mean = ")
    assert det["NAME_FAMILY_STATUS"].reference_display.startswith("dominant = ")
    summ = D.drift_summary(D.compare_fields(recent, ref), recent).first()
    assert summ.drift_score == pytest.approx((1 / 3 + 0 + 0.0625 + 1) / 4)
    assert summ.num_features_analyzed == 4 and summ.recent_sample_size == 4


def test_no_column_limit_by_default(spark):
    row = spark.createDataFrame([tuple(range(1, 26))], ", ".join(f"c{i} int" for i in range(25)))
    assert D.mean_shift(row, row).count() == 25


def test_mean_shift_rules(spark):
    cols = [f"c{i}" for i in range(8)]
    ref = spark.createDataFrame([tuple([1.0] * 8 + [5])], ", ".join(f"{c} double" for c in cols) + ", SK_ID_CURR long")
    cur = spark.createDataFrame([(1.6, 1.6, 1.35, 1.35, 1.35, 1.35, 1.35, 1.0, 9)],
                                ", ".join(f"{c} double" for c in cols) + ", SK_ID_CURR long")
    det = D.mean_shift(cur, ref)
    s = D.mean_shift_summary(det, 8).first()
    assert (s.drift_columns_50pct, s.drift_columns_30pct) == (2, 7)
    assert s.drift_detected and s.drift_severity == "severe"
    assert {r.feature for r in det.collect()} == set(cols)  # ID excluded
    signed = {r.feature: r.variation_pct for r in D.mean_shift(ref, cur, signed=True).collect()}
    assert signed["c0"] == pytest.approx((1.0 - 1.6) / 1.6 * 100)


def test_each_drift_alert_has_its_own_id(spark):
    from pyspark.sql import functions as F

    from kredo.operators import alerts as A
    s = spark.sql("SELECT true AS has_drift, 0.5D AS drift_score, array('a') AS affected_features")
    days = [A.drift_alert(s, F.lit(t).cast("timestamp_ntz")) for t in ("2024-01-01", "2024-01-02")]
    both = days[0].unionByName(days[1])
    first = days[0].select("alert_id")
    acked = A.ack_events(both, first, F.lit("2024-01-03").cast("timestamp_ntz"))
    state = A.alert_state(both.select(*A.EVENT_COLUMNS).unionByName(acked))
    assert sorted(r.acknowledged for r in state.collect()) == [False, True]
