import duckdb
import pytest

import __spark_entry__ as E
from kredo.plans.registry import ORACLE, QUERIES
from kredo.sources.tables import TABLES
from tests.conftest import SF0001

ROWS_ONLY = {"batch_score", "feature_importance", "contributions"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "CREDIT_INCOME_PERC" in df.columns


def test_every_query_has_an_oracle_or_is_declared_rows_only():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", ["client_features", "hourly_performance", "stream_performance",
                                 "optimal_threshold", "drift_mixed", "latency_anomalies", "merge_all",
                                 "drift_record", "stream_drift", "stream_score", "fixed_contributions"])
def test_oracle_at_smoke_scale(spark, key):
    from tools.oracle_check import rows_of
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    df = E.queries()[key](spark, SF0001)
    cur = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, cur.fetchall())
