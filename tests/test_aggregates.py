import pytest

from kredo.operators import aggregates as A
from kredo.operators.joins import merge_all, safe_merge
from tests.conftest import rows


def test_bureau_spec_on_fixture(spark):
    bureau = spark.createDataFrame(
        [(100001, 1, "Active", 100000), (100001, 2, "Closed", 50000),
         (100002, 3, "Active", 200000), (100003, 4, "Closed", 75000)],
        "SK_ID_CURR long, SK_ID_BUREAU long, CREDIT_ACTIVE string, AMT_CREDIT_SUM long")
    out = {r["SK_ID_CURR"]: r for r in rows(A.aggregate_bureau(bureau))}
    assert set(out[100001]) == {"SK_ID_CURR", "bureau_SK_ID_BUREAU_count", "bureau_AMT_CREDIT_SUM_sum",
                                "bureau_AMT_CREDIT_SUM_mean", "bureau_AMT_CREDIT_SUM_max"}
    assert out[100001]["bureau_SK_ID_BUREAU_count"] == 2
    assert out[100001]["bureau_AMT_CREDIT_SUM_sum"] == 150000
    assert out[100001]["bureau_AMT_CREDIT_SUM_mean"] == 75000
    assert out[100001]["bureau_AMT_CREDIT_SUM_max"] == 100000
    assert out[100002]["bureau_AMT_CREDIT_SUM_sum"] == 200000


def test_sum_of_all_missing_group_is_zero_and_null_keys_dropped(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, 5.0), (2, 3.0)],
                               "SK_ID_CURR long, AMT_ANNUITY double")
    out = {r["SK_ID_CURR"]: r for r in rows(A.agg_by_key(df, {"AMT_ANNUITY": ["sum", "mean", "count"]}, "x"))}
    assert set(out) == {1, 2}
    assert out[1]["x_AMT_ANNUITY_sum"] == 0
    assert out[1]["x_AMT_ANNUITY_mean"] is None
    assert out[1]["x_AMT_ANNUITY_count"] == 0


def test_no_numeric_column_gives_none(spark):
    df = spark.createDataFrame([(1, "a")], "SK_ID_CURR long, CREDIT_ACTIVE string")
    assert A.aggregate_bureau(df) is None


def test_installments_derivations_and_nunique(spark):
    df = spark.createDataFrame(
        [(1, 10, 1, 1, -30, -28, 100.0, 100.0), (1, 10, 2, 2, -10, -12, 50.0, 40.0),
         (1, 11, 1, 1, -5, -5, 0.0, 0.0)],
        "SK_ID_CURR long, SK_ID_PREV long, NUM_INSTALMENT_VERSION int, NUM_INSTALMENT_NUMBER int, "
        "DAYS_INSTALMENT int, DAYS_ENTRY_PAYMENT int, AMT_INSTALMENT double, AMT_PAYMENT double")
    r = rows(A.aggregate_installments(df))[0]
    assert r["inst_NUM_INSTALMENT_VERSION_nunique"] == 2
    assert r["inst_PAYMENT_PERC_min"] == 0.8          # 0/0 is NULL, skipped
    assert r["inst_PAYMENT_DIFF_sum"] == 10.0
    assert r["inst_DPD_max"] == 2
    with pytest.raises(KeyError):
        A.aggregate_installments(df.drop("AMT_PAYMENT"))


def test_safe_merge_left_join_keeps_rows_and_drops_duplicates(spark):
    train = spark.createDataFrame([(100001, 0, 202500), (100002, 1, 270000)],
                                  "SK_ID_CURR long, TARGET int, AMT_CREDIT long")
    agg = spark.createDataFrame([(100001, 150000, 1)], "SK_ID_CURR long, bureau_sum long, TARGET int")
    out = safe_merge(train, agg)
    assert out.count() == 2
    assert len(out.columns) == 4  # TARGET not duplicated
    got = {r["SK_ID_CURR"]: r["bureau_sum"] for r in out.collect()}
    assert got == {100001: 150000, 100002: None}


def test_merge_all_train_and_test(spark):
    train = spark.createDataFrame([(100001, 0, 202500), (100002, 1, 270000), (100003, 0, 135000)],
                                  "SK_ID_CURR long, TARGET int, AMT_CREDIT long")
    test = spark.createDataFrame([(100004, 100000), (100005, 200000)], "SK_ID_CURR long, AMT_CREDIT long")
    bureau = spark.createDataFrame([(100001, 1, 100000), (100001, 2, 50000), (100004, 3, 7)],
                                   "SK_ID_CURR long, SK_ID_BUREAU long, AMT_CREDIT_SUM long")
    tr, te = merge_all({"application_train": train, "application_test": test, "bureau": bureau})
    assert tr.count() == 3 and te.count() == 2
    t = {r["SK_ID_CURR"]: r["bureau_AMT_CREDIT_SUM_sum"] for r in tr.collect()}
    assert t == {100001: 150000, 100002: None, 100003: None}
    assert {r["SK_ID_CURR"]: r["bureau_SK_ID_BUREAU_count"] for r in te.collect()}[100004] == 1
    with pytest.raises(KeyError):
        merge_all({"application_train": train})


def test_approx_distinct_option(spark):
    df = spark.createDataFrame([(1, i % 7) for i in range(200)], "SK_ID_CURR long, v int")
    exact = A.agg_by_key(df, {"v": ["nunique"]}, "x").first()["x_v_nunique"]
    approx = A.agg_by_key(df, {"v": ["nunique"]}, "x", approx_distinct=0.01).first()["x_v_nunique"]
    assert exact == 7 and approx == 7


def test_all_five_specs_give_91_columns(spark):
    def table_for(spec, extra=()):
        cols = sorted(set(spec) | set(extra))
        ddl = ", ".join(["SK_ID_CURR long"] + [f"{c} double" for c in cols])
        rows = [tuple([k] + [float(k * 10 + j) for j in range(len(cols))]) for k in (1, 1, 2)]
        return spark.createDataFrame(rows, ddl)
    inst_source = [c for c in A.INSTALLMENTS_SPEC if c not in ("PAYMENT_PERC", "PAYMENT_DIFF", "DPD")]
    tables = {
        "application_train": spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "SK_ID_CURR long, TARGET int"),
        "application_test": spark.createDataFrame([(4,)], "SK_ID_CURR long"),
        "bureau": table_for(A.BUREAU_SPEC),
        "previous_application": table_for(A.PREVIOUS_SPEC),
        "POS_CASH_balance": table_for(A.POS_CASH_SPEC),
        "credit_card_balance": table_for(A.CREDIT_CARD_SPEC),
        "installments_payments": table_for(inst_source),
    }
    train, test = merge_all(tables)
    agg_cols = [c for c in train.columns if c not in ("SK_ID_CURR", "TARGET")]
    assert len(agg_cols) == 17 + 18 + 12 + 20 + 24 == 91
    assert train.count() == 3 and test.count() == 1
    r = {x.SK_ID_CURR: x for x in train.collect()}
    assert r[1]["bureau_SK_ID_BUREAU_count"] == 2 and r[3]["prev_SK_ID_PREV_count"] is None
