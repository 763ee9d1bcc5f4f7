"""Stand-ins: the driver's TPC-H-like tables mapped onto the credit data model.

Every stand-in is a projection (plus at most one key join) over a whole test
table, so its work grows with the table.  Each Spark builder has a SQL twin
(a DuckDB CTE body) used by the oracle queries; both must stay in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kredo.sources.tables import table

# Fixed parameters of the stand-ins.
AS_OF = "2024-01-31 00:00:00"          # "now" of the prediction log (events end 2024-01-30)
DAY_ZERO = "2001-08-02"                # "today" for relative day counts on orders/lineitem
DRIFT_SPLIT = "2024-01-20 00:00:00"    # events before = reference, after = recent


def _days(col: str) -> F.Column:
    return F.datediff(F.to_date(F.col(col)), F.lit(DAY_ZERO).cast("date"))


def _sql_days(col: str) -> str:
    return f"CAST(datediff('day', DATE '{DAY_ZERO}', CAST({col} AS DATE)) AS INTEGER)"


# ---------------------------------------------------------------- previous applications
def previous_applications(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.col("o_orderkey").alias("SK_ID_PREV"),
        F.col("o_totalprice").alias("AMT_CREDIT"),
        (F.col("o_totalprice") / 12).alias("AMT_ANNUITY"),
        (F.col("o_totalprice") * 1.25).alias("AMT_APPLICATION"),
        F.col("o_orderstatus").alias("NAME_CONTRACT_STATUS"),
        _days("o_orderdate").alias("DAYS_DECISION"),
        F.when(F.col("o_orderstatus") != "F", F.length("o_orderpriority") * 6).alias("CNT_PAYMENT"),
    )


SQL_PREVIOUS = f"""previous AS (
  SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_PREV, o_totalprice AS AMT_CREDIT,
         o_totalprice / 12 AS AMT_ANNUITY, o_totalprice * 1.25 AS AMT_APPLICATION,
         o_orderstatus AS NAME_CONTRACT_STATUS, {_sql_days('o_orderdate')} AS DAYS_DECISION,
         CASE WHEN o_orderstatus <> 'F' THEN CAST(length(o_orderpriority) * 6 AS INTEGER) END AS CNT_PAYMENT
  FROM orders)"""


# ---------------------------------------------------------------- instalments
def installments(spark: SparkSession, d: str, parts: int = 0) -> DataFrame:
    """``parts``: partitions that both tables are dealt over for the join, if that is
    more than the session's number."""
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        li, o = li.repartition(parts, "l_orderkey"), o.repartition(parts, "o_orderkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.col("l_orderkey").alias("SK_ID_PREV"),
        F.col("l_linenumber").alias("NUM_INSTALMENT_VERSION"),
        F.col("l_linenumber").alias("NUM_INSTALMENT_NUMBER"),
        _days("o_orderdate").alias("DAYS_INSTALMENT"),
        _days("l_shipdate").alias("DAYS_ENTRY_PAYMENT"),
        F.col("l_extendedprice").alias("AMT_INSTALMENT"),
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("AMT_PAYMENT"),
    )


SQL_INSTALLMENTS = f"""installments AS (
  SELECT o_custkey AS SK_ID_CURR, l_orderkey AS SK_ID_PREV,
         l_linenumber AS NUM_INSTALMENT_VERSION, l_linenumber AS NUM_INSTALMENT_NUMBER,
         {_sql_days('o_orderdate')} AS DAYS_INSTALMENT,
         {_sql_days('l_shipdate')} AS DAYS_ENTRY_PAYMENT,
         l_extendedprice AS AMT_INSTALMENT, l_extendedprice * (1 - l_discount) AS AMT_PAYMENT
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# ---------------------------------------------------------------- bureau / POS / card
def bureau(spark: SparkSession, d: str) -> DataFrame:
    """Credits held elsewhere: one row per lineitem, client = supplier."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("SK_ID_CURR"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("SK_ID_BUREAU"),
        F.col("l_returnflag").alias("CREDIT_ACTIVE"),
        _days("l_shipdate").alias("DAYS_CREDIT"),
        F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") * 5).otherwise(0).alias("CREDIT_DAY_OVERDUE"),
        F.col("l_tax").alias("AMT_CREDIT_MAX_OVERDUE"),
        F.col("l_extendedprice").alias("AMT_CREDIT_SUM"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("AMT_CREDIT_SUM_DEBT"),
        F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") * F.col("l_tax"))
        .alias("AMT_CREDIT_SUM_OVERDUE"),
        F.col("l_quantity").alias("AMT_ANNUITY"),
    )


SQL_BUREAU = f"""bureau AS (
  SELECT l_suppkey AS SK_ID_CURR, l_orderkey * 8 + l_linenumber AS SK_ID_BUREAU,
         l_returnflag AS CREDIT_ACTIVE, {_sql_days('l_shipdate')} AS DAYS_CREDIT,
         l_tax AS AMT_CREDIT_MAX_OVERDUE, l_extendedprice AS AMT_CREDIT_SUM,
         CASE WHEN l_returnflag = 'R' THEN l_linenumber * 5 ELSE 0 END AS CREDIT_DAY_OVERDUE,
         l_extendedprice * l_discount AS AMT_CREDIT_SUM_DEBT,
         CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_tax END AS AMT_CREDIT_SUM_OVERDUE,
         l_quantity AS AMT_ANNUITY
  FROM lineitem)"""


def pos_cash(spark: SparkSession, d: str) -> DataFrame:
    """Monthly POS balances: one row per lineitem, client = part."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_partkey").alias("SK_ID_CURR"),
        F.col("l_orderkey").alias("SK_ID_PREV"),
        (-F.col("l_linenumber")).alias("MONTHS_BALANCE"),
        F.col("l_quantity").alias("CNT_INSTALMENT"),
        (F.col("l_quantity") - F.col("l_linenumber")).alias("CNT_INSTALMENT_FUTURE"),
        F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).otherwise(0).alias("SK_DPD"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25), F.col("l_linenumber"))
        .alias("SK_DPD_DEF"),
    )


SQL_POS_CASH = """pos_cash AS (
  SELECT l_partkey AS SK_ID_CURR, l_orderkey AS SK_ID_PREV, -l_linenumber AS MONTHS_BALANCE,
         l_quantity AS CNT_INSTALMENT, l_quantity - l_linenumber AS CNT_INSTALMENT_FUTURE,
         CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END AS SK_DPD,
         CASE WHEN l_returnflag = 'R' AND l_quantity > 25 THEN l_linenumber END AS SK_DPD_DEF
  FROM lineitem)"""


def credit_card(spark: SparkSession, d: str) -> DataFrame:
    """Card balances: one row per order, client = customer."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.col("o_orderkey").alias("SK_ID_PREV"),
        (-F.month(F.col("o_orderdate"))).alias("MONTHS_BALANCE"),
        F.col("o_totalprice").alias("AMT_BALANCE"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("AMT_DRAWINGS_CURRENT"),
        (F.col("o_totalprice") * 1.5).alias("AMT_CREDIT_LIMIT_ACTUAL"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") * 0.25).alias("AMT_DRAWINGS_ATM_CURRENT"),
        (F.col("o_totalprice") * 0.5).alias("AMT_PAYMENT_CURRENT"),
        F.when(F.col("o_orderstatus") == "O", 2).otherwise(0).alias("CNT_DRAWINGS_ATM_CURRENT"),
        F.length("o_orderpriority").alias("CNT_DRAWINGS_CURRENT"),
    )


SQL_CREDIT_CARD = """credit_card AS (
  SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_PREV, -CAST(month(o_orderdate) AS INTEGER) AS MONTHS_BALANCE,
         o_totalprice AS AMT_BALANCE,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS AMT_DRAWINGS_CURRENT,
         o_totalprice * 1.5 AS AMT_CREDIT_LIMIT_ACTUAL,
         CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 0.25 END AS AMT_DRAWINGS_ATM_CURRENT,
         o_totalprice * 0.5 AS AMT_PAYMENT_CURRENT,
         CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END AS CNT_DRAWINGS_ATM_CURRENT,
         CAST(length(o_orderpriority) AS INTEGER) AS CNT_DRAWINGS_CURRENT
  FROM orders)"""


# ---------------------------------------------------------------- application rows
def clients(spark: SparkSession, d: str) -> DataFrame:
    """Main application table for the per-client build: one row per customer."""
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("SK_ID_CURR"),
        F.col("c_acctbal").alias("AMT_INCOME_TOTAL"),
        F.col("c_mktsegment").alias("NAME_CONTRACT_TYPE"),
    )


SQL_CLIENTS = """clients AS (
  SELECT c_custkey AS SK_ID_CURR, c_acctbal AS AMT_INCOME_TOTAL, c_mktsegment AS NAME_CONTRACT_TYPE
  FROM customer)"""


TRAIN_NATIONS = 15       # clients of the nations below train, the others test


def train_and_test(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The main application tables: every customer is in one of them, and only
    the training table has a TARGET."""
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("SK_ID_CURR"), F.col("c_acctbal").alias("AMT_INCOME_TOTAL"),
                    F.col("c_mktsegment").alias("NAME_CONTRACT_TYPE"), "c_nationkey")
    train = rows.where(F.col("c_nationkey") < TRAIN_NATIONS).drop("c_nationkey")
    test = rows.where(~(F.col("c_nationkey") < TRAIN_NATIONS)).drop("c_nationkey")
    return train.withColumn("TARGET", (F.col("AMT_INCOME_TOTAL") < 0).cast("int")), test


SQL_TRAIN_AND_TEST = f"""main AS (
  SELECT c_custkey AS SK_ID_CURR, c_acctbal AS AMT_INCOME_TOTAL, c_mktsegment AS NAME_CONTRACT_TYPE,
         CASE WHEN c_nationkey < {TRAIN_NATIONS} THEN CAST(c_acctbal < 0 AS INTEGER) END AS TARGET,
         CASE WHEN c_nationkey < {TRAIN_NATIONS} THEN 'train' ELSE 'test' END AS split
  FROM customer WHERE c_nationkey IS NOT NULL)"""


def applications(spark: SparkSession, d: str) -> DataFrame:
    """Credit applications: one row per order, joined with its customer."""
    return applications_from(table(spark, d, "orders"), table(spark, d, "customer"))


def applications_from(o: DataFrame, customer: DataFrame) -> DataFrame:
    """``applications`` of an orders frame (batch or stream)."""
    c = customer.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    days = _days("o_orderdate")
    status = F.col("o_orderstatus")
    prio = F.col("o_orderpriority")
    return j.select(
        F.col("o_orderkey").alias("SK_ID_CURR"),
        F.col("c_acctbal").alias("AMT_INCOME_TOTAL"),
        F.col("o_totalprice").alias("AMT_CREDIT"),
        (F.col("o_totalprice") / 12).alias("AMT_ANNUITY"),
        (F.col("o_totalprice") * 0.9).alias("AMT_GOODS_PRICE"),
        (days - 9000).alias("DAYS_BIRTH"),
        F.when(prio == "5-LOW", F.lit(365000)).otherwise(days).alias("DAYS_EMPLOYED"),
        (F.col("c_nationkey") % 5 + 1).alias("CNT_FAM_MEMBERS"),
        F.when(status != "F", F.col("c_acctbal") / 10000).alias("EXT_SOURCE_1"),
        (F.col("o_totalprice") / 600000).alias("EXT_SOURCE_2"),
        F.when(status != "O", 1 - F.col("o_totalprice") / 600000).alias("EXT_SOURCE_3"),
        F.when(prio == "1-URGENT", 1).otherwise(0).alias("FLAG_DOCUMENT_2"),
        F.when(status == "P", 1).when(status == "O", F.lit(None)).otherwise(0).alias("FLAG_DOCUMENT_3"),
        F.col("c_mktsegment").alias("OCCUPATION_TYPE"),
        status.alias("NAME_CONTRACT_STATUS"),
        prio.alias("NAME_EDUCATION_TYPE"),
        F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("CODE_GENDER"),
        F.when(F.col("o_totalprice") > 200000, "Y").otherwise("N").alias("FLAG_OWN_CAR"),
        F.when(F.col("c_acctbal") > 0, "Y").otherwise("N").alias("FLAG_OWN_REALTY"),
        status.alias("NAME_FAMILY_STATUS"),
        F.when(F.col("c_nationkey") < 10, "House / apartment")
         .when(F.col("c_nationkey") < 20, "With parents").otherwise("Rented apartment")
         .alias("NAME_HOUSING_TYPE"),
        F.to_date("o_orderdate").alias("APPLICATION_DATE"),
    )


SQL_APPLICATIONS = f"""applications AS (
  SELECT o_orderkey AS SK_ID_CURR, c_acctbal AS AMT_INCOME_TOTAL, o_totalprice AS AMT_CREDIT,
         o_totalprice / 12 AS AMT_ANNUITY, o_totalprice * 0.9 AS AMT_GOODS_PRICE,
         {_sql_days('o_orderdate')} - 9000 AS DAYS_BIRTH,
         CASE WHEN o_orderpriority = '5-LOW' THEN 365000 ELSE {_sql_days('o_orderdate')} END AS DAYS_EMPLOYED,
         c_nationkey % 5 + 1 AS CNT_FAM_MEMBERS,
         CASE WHEN o_orderstatus <> 'F' THEN c_acctbal / 10000 END AS EXT_SOURCE_1,
         o_totalprice / 600000 AS EXT_SOURCE_2,
         CASE WHEN o_orderstatus <> 'O' THEN 1 - o_totalprice / 600000 END AS EXT_SOURCE_3,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS FLAG_DOCUMENT_2,
         CASE WHEN o_orderstatus = 'P' THEN 1 WHEN o_orderstatus = 'O' THEN NULL ELSE 0 END AS FLAG_DOCUMENT_3,
         c_mktsegment AS OCCUPATION_TYPE, o_orderstatus AS NAME_CONTRACT_STATUS,
         o_orderpriority AS NAME_EDUCATION_TYPE,
         CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS CODE_GENDER,
         CASE WHEN o_totalprice > 200000 THEN 'Y' ELSE 'N' END AS FLAG_OWN_CAR,
         CASE WHEN c_acctbal > 0 THEN 'Y' ELSE 'N' END AS FLAG_OWN_REALTY,
         o_orderstatus AS NAME_FAMILY_STATUS,
         CASE WHEN c_nationkey < 10 THEN 'House / apartment' WHEN c_nationkey < 20 THEN 'With parents'
              ELSE 'Rented apartment' END AS NAME_HOUSING_TYPE,
         CAST(o_orderdate AS DATE) AS APPLICATION_DATE
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

APPLICATION_SPLIT = "1999-01-01"   # applications before = reference, from = recent

BAD_AMOUNTS = "1-URGENT"           # applications logged with an amount that is no number


def application_log(spark: SparkSession, d: str) -> DataFrame:
    """The prediction log of the applications: one row each, with a JSON payload as
    a web form sends it - all values as text, car flags as 1/0, some bad amounts."""
    return application_log_from(applications(spark, d))


def application_log_from(a: DataFrame) -> DataFrame:
    sent = {f.name: F.col(f.name).cast("string") for f in a.schema.fields if f.name != "APPLICATION_DATE"}
    sent["AMT_CREDIT"] = F.when(F.col("NAME_EDUCATION_TYPE") == BAD_AMOUNTS, "hh").otherwise(sent["AMT_CREDIT"])
    sent["FLAG_OWN_CAR"] = F.when(F.col("FLAG_OWN_CAR") == "Y", "1").otherwise("0")
    return a.select(F.col("SK_ID_CURR").alias("log_id"), F.col("SK_ID_CURR").alias("client_id"),
                    F.col("APPLICATION_DATE").cast("timestamp_ntz").alias("timestamp"),
                    F.to_json(F.struct(*[c.alias(n) for n, c in sent.items()])).alias("input_data"))


# ---------------------------------------------------------------- prediction log
GPU_TYPES = ("purchase", "signup")


def api_logs(spark: SparkSession, d: str) -> DataFrame:
    """The prediction log (api_logs schema) derived from ``events``."""
    return api_logs_from(table(spark, d, "events"))


def api_logs_from(e: DataFrame) -> DataFrame:
    """The api_logs projection of an events frame (batch or stream)."""
    et = F.col("event_type")
    gpu = et.isin(*GPU_TYPES)
    return e.select(
        F.col("event_id").alias("log_id"),
        F.col("ts").alias("timestamp"),
        F.col("user_id").alias("client_id"),
        F.when(et.isin("click", "view"), "single").otherwise("batch").alias("prediction_type"),
        F.col("props").alias("input_data"),
        F.when(et != "error", F.least(F.col("value") / 200, F.lit(1.0))).alias("score"),
        (F.col("value") / 1000).alias("latency_seconds"),
        F.least(F.col("value") / 4, F.lit(100.0)).alias("cpu_usage_pct"),
        F.when(gpu, F.least(F.col("value") / 5, F.lit(100.0))).alias("gpu_usage_pct"),
        F.when(gpu, F.col("value") * 8).alias("gpu_memory_mb"),
        F.when(gpu, "gpu").otherwise("cpu").alias("compute_device"),
        F.when(et == "error", "prediction failed").alias("error_message"),
        F.lit("1.0").alias("model_version"),
        F.col("ts").alias("created_at"),
    )


SQL_API_LOGS = """api_logs AS (
  SELECT event_id AS log_id, ts AS "timestamp", user_id AS client_id,
         CASE WHEN event_type IN ('click', 'view') THEN 'single' ELSE 'batch' END AS prediction_type,
         props AS input_data,
         CASE WHEN event_type <> 'error' THEN least(value / 200, 1.0) END AS score,
         value / 1000 AS latency_seconds,
         least(value / 4, 100.0) AS cpu_usage_pct,
         CASE WHEN event_type IN ('purchase', 'signup') THEN least(value / 5, 100.0) END AS gpu_usage_pct,
         CASE WHEN event_type IN ('purchase', 'signup') THEN value * 8 END AS gpu_memory_mb,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'gpu' ELSE 'cpu' END AS compute_device,
         CASE WHEN event_type = 'error' THEN 'prediction failed' END AS error_message,
         '1.0' AS model_version, ts AS created_at
  FROM events)"""


# ---------------------------------------------------------------- scored rows
def scored(spark: SparkSession, d: str, threshold: float = 0.5) -> DataFrame:
    """Labelled scores (id, y_true, y_pred, y_proba) from labels x documents."""
    lab = table(spark, d, "labels").select("doc_id", "toxic")
    doc = table(spark, d, "documents").select("doc_id", "n_chars")
    proba = F.least(F.col("n_chars") / 4000, F.lit(1.0))
    return lab.join(doc, "doc_id", "inner").select(
        F.col("doc_id").alias("id"),
        F.col("toxic").alias("y_true"),
        F.when(proba >= threshold, 1).otherwise(0).alias("y_pred"),
        proba.alias("y_proba"),
    )


SQL_SCORED = """scored AS (
  SELECT l.doc_id AS id, toxic AS y_true,
         CASE WHEN least(n_chars / 4000, 1.0) >= 0.5 THEN 1 ELSE 0 END AS y_pred,
         least(n_chars / 4000, 1.0) AS y_proba
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
