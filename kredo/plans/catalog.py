"""Queries: the credit files as a folder that holds some bad lines, by declared schemas."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from kredo.plans import standins as S
from kredo.plans.common import register, rnd, rounded
from kredo.sources import catalog as C
from kredo.sources import sinks as SK
from kredo.sources.schemas import CATALOG
from kredo.streaming.monitor import work_dir

BAD_INCOME = -900        # clients below it have an income that is no number
ACCENT = "é"             # the training file is in latin-1


def credit_folder(spark, d) -> str:
    """The training table as a latin-1 CSV file, bureau credits as CSV with the columns in
    another order and some rows too long, previous applications as Parquet, the log as
    JSON lines with a broken one for each failure; the other tables have no file."""
    path = os.path.join(work_dir(spark, "credit"), "data")
    clients = S.clients(spark, d)
    income = F.when(F.col("AMT_INCOME_TOTAL") < BAD_INCOME, "hh").otherwise(F.col("AMT_INCOME_TOTAL").cast("string"))
    train = clients.select("SK_ID_CURR", F.concat("NAME_CONTRACT_TYPE", F.lit(ACCENT)).alias("NAME_CONTRACT_TYPE"),
                           income.alias("AMT_INCOME_TOTAL"), (F.col("AMT_INCOME_TOTAL") < 0).cast("int").alias("TARGET"))
    train.write.option("header", True).option("encoding", "ISO-8859-1").csv(os.path.join(path, "application_train.csv"))
    bureau = S.bureau(spark, d)
    more = F.when(F.col("CREDIT_DAY_OVERDUE") > 30, F.concat("CREDIT_ACTIVE", F.lit(",late"))).otherwise(F.col("CREDIT_ACTIVE"))
    (bureau.select("SK_ID_BUREAU", "SK_ID_CURR", "AMT_CREDIT_SUM", "DAYS_CREDIT", more.alias("CREDIT_ACTIVE"))
     .write.option("header", True).option("quote", "").csv(os.path.join(path, "bureau.csv")))
    S.previous_applications(spark, d).write.parquet(os.path.join(path, "previous_application.parquet"))
    logs = S.api_logs(spark, d)
    SK.write_ndjson(logs, os.path.join(path, "api.log"))
    broken = logs.where(F.col("error_message").isNotNull()).select(F.concat(F.lit('{"log_id": '), F.col("log_id").cast("string")).alias("value"))
    broken.write.mode("append").text(os.path.join(path, "api.log"))
    return path


_COUNTS = f"""WITH {S.SQL_CLIENTS}, {S.SQL_BUREAU}, {S.SQL_PREVIOUS}, {S.SQL_API_LOGS}, bad AS (
  SELECT 'application_train' AS "table", 'type: AMT_INCOME_TOTAL' AS reason FROM clients WHERE AMT_INCOME_TOTAL < {BAD_INCOME}
  UNION ALL SELECT 'bureau', 'columns' FROM bureau WHERE CREDIT_DAY_OVERDUE > 30
  UNION ALL SELECT 'api_logs', 'not JSON' FROM api_logs WHERE error_message IS NOT NULL)"""


@register("catalog_load", _COUNTS + f""", loaded AS (
  SELECT 'application_train' AS "table", count(*) AS n_rows, {rnd('sum(AMT_INCOME_TOTAL)', 2)} AS amount,
    count(DISTINCT NAME_CONTRACT_TYPE || '{ACCENT}') AS n_kinds FROM clients WHERE AMT_INCOME_TOTAL >= {BAD_INCOME}
  UNION ALL SELECT 'bureau', count(*), {rnd('sum(AMT_CREDIT_SUM)', 2)}, count(DISTINCT CREDIT_ACTIVE) FROM bureau WHERE CREDIT_DAY_OVERDUE <= 30
  UNION ALL SELECT 'previous_application', count(*), {rnd('sum(AMT_CREDIT)', 2)}, count(DISTINCT NAME_CONTRACT_STATUS) FROM previous
  UNION ALL SELECT 'api_logs', count(*), {rnd('sum(score)', 2)}, count(DISTINCT prediction_type) FROM api_logs)
SELECT t AS "table", CASE WHEN n_rows IS NULL THEN 'missing' ELSE 'loaded' END AS status, n_rows,
  CASE WHEN n_rows IS NOT NULL THEN (SELECT count(*) FROM bad WHERE bad."table" = t) END AS n_bad, amount, n_kinds
FROM (VALUES {', '.join(f"('{t}')" for t in CATALOG)}) x(t) LEFT JOIN loaded ON loaded."table" = t""")
def q_catalog_load(spark, d):
    """All declared tables, those without a file too, with what was
    read of each."""
    found = C.load_catalog(spark, credit_folder(spark, d))
    kinds = {"application_train": ("AMT_INCOME_TOTAL", "NAME_CONTRACT_TYPE"), "bureau": ("AMT_CREDIT_SUM", "CREDIT_ACTIVE"),
             "previous_application": ("AMT_CREDIT", "NAME_CONTRACT_STATUS"), "api_logs": ("score", "prediction_type")}
    sums = None
    for name, (amount, kind) in kinds.items():
        one = found.tables[name].agg(F.sum(amount).alias("amount"), F.countDistinct(kind).alias("n_kinds"))
        one = one.select(F.lit(name).alias("table"), "amount", "n_kinds")
        sums = one if sums is None else sums.unionByName(one)
    return rounded(found.counts(spark).join(sums, "table", "left"), 2)


@register("quarantine_counts", _COUNTS + """
SELECT "table", reason, count(*) AS n, count(*) AS n_lines FROM bad GROUP BY 1, 2""")
def q_quarantine_counts(spark, d):
    """The quarantine, written as a table and read back: bad lines by reason,
    each with a file and line of its own."""
    path = credit_folder(spark, d)
    kept = os.path.join(path, "quarantine")
    C.load_catalog(spark, path).quarantine.write.parquet(kept)
    bad = spark.read.parquet(kept)
    return bad.groupBy("table", "reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file", "line").alias("n_lines"))
