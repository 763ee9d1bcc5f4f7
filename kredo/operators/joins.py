"""Left joins of per-client aggregates onto the application tables.

All side tables are aggregated on the join key first (A1-A5), so each
aggregate comes out of its shuffle already hash-partitioned by the key and the
chain of left joins needs one exchange for the application side only; Spark
keeps that partitioning through the chain.  AQE decides broadcast vs.
sort-merge from the runtime size of each aggregate and splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kredo.operators.aggregates import AGGREGATORS, KEY

SIDE_TABLES = {
    "bureau": "bureau",
    "previous": "previous_application",
    "pos_cash": "POS_CASH_balance",
    "credit_card": "credit_card_balance",
    "installments": "installments_payments",
}


def safe_merge(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """Left join, dropping right columns that already exist on the left."""
    keep = [c for c in right.columns if c == key or c not in left.columns]
    return left.join(right.select(*keep), on=key, how="left")


def merge_tagged(tables: dict[str, DataFrame], key: str = KEY,
                 train: str = "application_train", test: str = "application_test") -> DataFrame:
    """J2 + U4: aggregate every side table present and join once onto the union
    of train and test, tagged by a ``split`` column (``train`` or ``test``).

    Both main tables are required; an absent side table is skipped.  Columns that
    one of them lacks are NULL there."""
    if train not in tables or test not in tables:
        raise KeyError(f"both {train!r} and {test!r} are required")
    base = (tables[train].withColumn("split", F.lit("train"))
            .unionByName(tables[test].withColumn("split", F.lit("test")),
                         allowMissingColumns=True))
    return join_aggregates(base, tables, key)


def merge_all(tables: dict[str, DataFrame], key: str = KEY,
              train: str = "application_train",
              test: str = "application_test") -> tuple[DataFrame, DataFrame]:
    """``merge_tagged`` as two frames (train, test).  Each is a plan of its own that
    runs all joins: to use both, write the tagged frame partitioned by ``split``."""
    base = merge_tagged(tables, key, train, test)
    return (base.where(F.col("split") == "train").drop("split"),
            base.where(F.col("split") == "test").drop("split"))


def join_aggregates(base: DataFrame, tables: dict[str, DataFrame],
                    key: str = KEY) -> DataFrame:
    """Left-join the per-client aggregate of every side table present in
    ``tables`` (keys of ``SIDE_TABLES`` or their file names) onto ``base``."""
    for kind, file_name in SIDE_TABLES.items():
        side = tables.get(kind, tables.get(file_name))
        if side is None:
            continue
        agg = AGGREGATORS[kind](side)
        if agg is not None:
            base = safe_merge(base, agg, key)
    return base
