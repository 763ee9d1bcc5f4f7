import pytest

from kredo.functions.features import create_interaction_features, create_ratio_features
from tests.conftest import rows

FRAME = [(100000, 200000, 15000, 200000, -13297, -762), (150000, 300000, 20000, 300000, -10950, -1500),
         (200000, 400000, 25000, 400000, -15200, -2000), (80000, 150000, 12000, 150000, -12000, -800),
         (120000, 250000, 18000, 250000, -14500, -1200)]
SCHEMA = ("AMT_INCOME_TOTAL long, AMT_CREDIT long, AMT_ANNUITY long, AMT_GOODS_PRICE long, "
          "DAYS_BIRTH long, DAYS_EMPLOYED long")
EXPECTED = [  # CREDIT_INCOME, ANNUITY_CREDIT, ANNUITY_INCOME, AGE, EMPLOYED_YEARS
    (1.99998, 0.075, 0.149999, 36.405202, 2.086242), (1.999987, 0.066666, 0.133332, 29.979466, 4.106776),
    (1.99999, 0.0625, 0.124999, 41.615332, 5.475702), (1.874977, 0.079999, 0.149998, 32.854209, 2.190281),
    (2.083316, 0.072, 0.149999, 39.698836, 3.285421)]


def test_ratio_features_golden(spark):
    df = spark.createDataFrame(FRAME, SCHEMA)
    out = create_ratio_features(df).orderBy("AMT_INCOME_TOTAL").collect()
    exp = sorted(zip(FRAME, EXPECTED), key=lambda t: t[0][0])
    for r, (_, e) in zip(out, exp):
        got = (r.CREDIT_INCOME_PERC, r.ANNUITY_CREDIT_PERC, r.ANNUITY_INCOME_PERC, r.AGE_YEARS, r.EMPLOYED_YEARS)
        assert got == pytest.approx(e, abs=2e-6)


def test_edge_cases(spark):
    df = spark.createDataFrame(
        [(0, 200000, None, 365000), (100, 0, -10000, None), (-1, 5, -10000, -365)],
        "AMT_INCOME_TOTAL long, AMT_CREDIT long, DAYS_BIRTH long, DAYS_EMPLOYED long")
    out = rows(create_ratio_features(df), "AMT_INCOME_TOTAL")
    by = {r["AMT_INCOME_TOTAL"]: r for r in out}
    assert by[0]["CREDIT_INCOME_PERC"] == 200000.0
    assert by[100]["CREDIT_INCOME_PERC"] == 0.0
    assert by[-1]["CREDIT_INCOME_PERC"] is None          # zero denominator -> NULL
    assert by[0]["EMPLOYED_YEARS"] == 0.0                # pensioner code
    assert by[100]["EMPLOYED_YEARS"] is None              # NULL stays NULL
    assert by[-1]["EMPLOYED_YEARS"] == pytest.approx(365 / 365.25)
    assert by[0]["AGE_YEARS"] is None
    # only available ratios are created
    assert "ANNUITY_CREDIT_PERC" not in out[0]


def test_ext_sources_and_documents(spark):
    df = spark.createDataFrame(
        [(1, 0.2, None, None, None, None), (2, 0.2, 0.4, None, 1, None), (3, 0.2, 0.4, 0.9, 1, 1),
         (4, None, None, None, None, None)],
        "id long, EXT_SOURCE_1 double, EXT_SOURCE_2 double, EXT_SOURCE_3 double, "
        "FLAG_DOCUMENT_2 int, FLAG_DOCUMENT_3 int")
    out = {r["id"]: r for r in rows(create_ratio_features(df))}
    assert out[1]["EXT_SOURCES_MEAN"] == pytest.approx(0.2) and out[1]["EXT_SOURCES_STD"] is None
    assert out[2]["EXT_SOURCES_STD"] == pytest.approx(0.1414213562)
    assert out[3]["EXT_SOURCES_MEAN"] == pytest.approx(0.5)
    assert out[3]["EXT_SOURCES_STD"] == pytest.approx(0.3605551275)
    assert (out[3]["EXT_SOURCES_MAX"], out[3]["EXT_SOURCES_MIN"]) == (0.9, 0.2)
    assert out[4]["EXT_SOURCES_MEAN"] is None and out[4]["EXT_SOURCES_MAX"] is None
    assert out[4]["DOCUMENT_COUNT"] == 0 and out[3]["DOCUMENT_COUNT"] == 2


def test_interaction_features(spark):
    df = spark.createDataFrame([(100000.0, 200000.0, 1.0), (50.0, 10.0, -1.0)],
                               "AMT_INCOME_TOTAL double, AMT_CREDIT double, CNT_FAM_MEMBERS double")
    out = {r["AMT_INCOME_TOTAL"]: r for r in rows(create_interaction_features(df))}
    assert out[100000.0]["INCOME_PER_PERSON"] == 50000.0 and out[100000.0]["CREDIT_PER_PERSON"] == 100000.0
    assert out[50.0]["INCOME_PER_PERSON"] is None
