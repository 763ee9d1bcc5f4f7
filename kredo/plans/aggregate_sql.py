"""The aggregate outputs in SQL, written out: the oracle shares nothing with the
aggregate specs of the Spark side.  A line that starts with ``~`` is a double, compared
rounded."""

from __future__ import annotations

from kredo.plans.common import rnd

PREV = """
count(SK_ID_PREV) AS prev_SK_ID_PREV_count
~coalesce(sum(AMT_ANNUITY), 0) AS prev_AMT_ANNUITY_sum
~avg(AMT_ANNUITY) AS prev_AMT_ANNUITY_mean
~min(AMT_ANNUITY) AS prev_AMT_ANNUITY_min
~max(AMT_ANNUITY) AS prev_AMT_ANNUITY_max
~coalesce(sum(AMT_APPLICATION), 0) AS prev_AMT_APPLICATION_sum
~avg(AMT_APPLICATION) AS prev_AMT_APPLICATION_mean
~min(AMT_APPLICATION) AS prev_AMT_APPLICATION_min
~max(AMT_APPLICATION) AS prev_AMT_APPLICATION_max
~coalesce(sum(AMT_CREDIT), 0) AS prev_AMT_CREDIT_sum
~avg(AMT_CREDIT) AS prev_AMT_CREDIT_mean
~min(AMT_CREDIT) AS prev_AMT_CREDIT_min
~max(AMT_CREDIT) AS prev_AMT_CREDIT_max
min(DAYS_DECISION) AS prev_DAYS_DECISION_min
max(DAYS_DECISION) AS prev_DAYS_DECISION_max
~avg(DAYS_DECISION) AS prev_DAYS_DECISION_mean
~avg(CNT_PAYMENT) AS prev_CNT_PAYMENT_mean
CAST(coalesce(sum(CNT_PAYMENT), 0) AS BIGINT) AS prev_CNT_PAYMENT_sum
"""

INST = """
count(SK_ID_PREV) AS inst_SK_ID_PREV_count
count(DISTINCT NUM_INSTALMENT_VERSION) AS inst_NUM_INSTALMENT_VERSION_nunique
max(NUM_INSTALMENT_NUMBER) AS inst_NUM_INSTALMENT_NUMBER_max
~avg(NUM_INSTALMENT_NUMBER) AS inst_NUM_INSTALMENT_NUMBER_mean
min(DAYS_INSTALMENT) AS inst_DAYS_INSTALMENT_min
max(DAYS_INSTALMENT) AS inst_DAYS_INSTALMENT_max
~avg(DAYS_INSTALMENT) AS inst_DAYS_INSTALMENT_mean
min(DAYS_ENTRY_PAYMENT) AS inst_DAYS_ENTRY_PAYMENT_min
max(DAYS_ENTRY_PAYMENT) AS inst_DAYS_ENTRY_PAYMENT_max
~avg(DAYS_ENTRY_PAYMENT) AS inst_DAYS_ENTRY_PAYMENT_mean
~coalesce(sum(AMT_INSTALMENT), 0) AS inst_AMT_INSTALMENT_sum
~avg(AMT_INSTALMENT) AS inst_AMT_INSTALMENT_mean
~min(AMT_INSTALMENT) AS inst_AMT_INSTALMENT_min
~max(AMT_INSTALMENT) AS inst_AMT_INSTALMENT_max
~coalesce(sum(AMT_PAYMENT), 0) AS inst_AMT_PAYMENT_sum
~avg(AMT_PAYMENT) AS inst_AMT_PAYMENT_mean
~min(AMT_PAYMENT) AS inst_AMT_PAYMENT_min
~max(AMT_PAYMENT) AS inst_AMT_PAYMENT_max
~avg(PAYMENT_PERC) AS inst_PAYMENT_PERC_mean
~min(PAYMENT_PERC) AS inst_PAYMENT_PERC_min
~coalesce(sum(PAYMENT_DIFF), 0) AS inst_PAYMENT_DIFF_sum
~avg(PAYMENT_DIFF) AS inst_PAYMENT_DIFF_mean
max(DPD) AS inst_DPD_max
~avg(DPD) AS inst_DPD_mean
"""

BUREAU = """
count(SK_ID_BUREAU) AS bureau_SK_ID_BUREAU_count
min(DAYS_CREDIT) AS bureau_DAYS_CREDIT_min
max(DAYS_CREDIT) AS bureau_DAYS_CREDIT_max
~avg(DAYS_CREDIT) AS bureau_DAYS_CREDIT_mean
max(CREDIT_DAY_OVERDUE) AS bureau_CREDIT_DAY_OVERDUE_max
~avg(CREDIT_DAY_OVERDUE) AS bureau_CREDIT_DAY_OVERDUE_mean
~max(AMT_CREDIT_MAX_OVERDUE) AS bureau_AMT_CREDIT_MAX_OVERDUE_max
~avg(AMT_CREDIT_MAX_OVERDUE) AS bureau_AMT_CREDIT_MAX_OVERDUE_mean
~coalesce(sum(AMT_CREDIT_SUM), 0) AS bureau_AMT_CREDIT_SUM_sum
~avg(AMT_CREDIT_SUM) AS bureau_AMT_CREDIT_SUM_mean
~max(AMT_CREDIT_SUM) AS bureau_AMT_CREDIT_SUM_max
~coalesce(sum(AMT_CREDIT_SUM_DEBT), 0) AS bureau_AMT_CREDIT_SUM_DEBT_sum
~avg(AMT_CREDIT_SUM_DEBT) AS bureau_AMT_CREDIT_SUM_DEBT_mean
~coalesce(sum(AMT_CREDIT_SUM_OVERDUE), 0) AS bureau_AMT_CREDIT_SUM_OVERDUE_sum
~avg(AMT_CREDIT_SUM_OVERDUE) AS bureau_AMT_CREDIT_SUM_OVERDUE_mean
~coalesce(sum(AMT_ANNUITY), 0) AS bureau_AMT_ANNUITY_sum
~avg(AMT_ANNUITY) AS bureau_AMT_ANNUITY_mean
"""

POS = """
count(SK_ID_PREV) AS pos_SK_ID_PREV_count
min(MONTHS_BALANCE) AS pos_MONTHS_BALANCE_min
max(MONTHS_BALANCE) AS pos_MONTHS_BALANCE_max
~avg(MONTHS_BALANCE) AS pos_MONTHS_BALANCE_mean
~avg(CNT_INSTALMENT) AS pos_CNT_INSTALMENT_mean
~coalesce(sum(CNT_INSTALMENT), 0) AS pos_CNT_INSTALMENT_sum
~avg(CNT_INSTALMENT_FUTURE) AS pos_CNT_INSTALMENT_FUTURE_mean
~coalesce(sum(CNT_INSTALMENT_FUTURE), 0) AS pos_CNT_INSTALMENT_FUTURE_sum
max(SK_DPD) AS pos_SK_DPD_max
~avg(SK_DPD) AS pos_SK_DPD_mean
max(SK_DPD_DEF) AS pos_SK_DPD_DEF_max
~avg(SK_DPD_DEF) AS pos_SK_DPD_DEF_mean
"""

CARD = """
count(SK_ID_PREV) AS cc_SK_ID_PREV_count
min(MONTHS_BALANCE) AS cc_MONTHS_BALANCE_min
max(MONTHS_BALANCE) AS cc_MONTHS_BALANCE_max
~avg(MONTHS_BALANCE) AS cc_MONTHS_BALANCE_mean
~coalesce(sum(AMT_BALANCE), 0) AS cc_AMT_BALANCE_sum
~avg(AMT_BALANCE) AS cc_AMT_BALANCE_mean
~max(AMT_BALANCE) AS cc_AMT_BALANCE_max
~coalesce(sum(AMT_CREDIT_LIMIT_ACTUAL), 0) AS cc_AMT_CREDIT_LIMIT_ACTUAL_sum
~avg(AMT_CREDIT_LIMIT_ACTUAL) AS cc_AMT_CREDIT_LIMIT_ACTUAL_mean
~max(AMT_CREDIT_LIMIT_ACTUAL) AS cc_AMT_CREDIT_LIMIT_ACTUAL_max
~coalesce(sum(AMT_DRAWINGS_ATM_CURRENT), 0) AS cc_AMT_DRAWINGS_ATM_CURRENT_sum
~avg(AMT_DRAWINGS_ATM_CURRENT) AS cc_AMT_DRAWINGS_ATM_CURRENT_mean
~coalesce(sum(AMT_DRAWINGS_CURRENT), 0) AS cc_AMT_DRAWINGS_CURRENT_sum
~avg(AMT_DRAWINGS_CURRENT) AS cc_AMT_DRAWINGS_CURRENT_mean
~coalesce(sum(AMT_PAYMENT_CURRENT), 0) AS cc_AMT_PAYMENT_CURRENT_sum
~avg(AMT_PAYMENT_CURRENT) AS cc_AMT_PAYMENT_CURRENT_mean
CAST(coalesce(sum(CNT_DRAWINGS_ATM_CURRENT), 0) AS BIGINT) AS cc_CNT_DRAWINGS_ATM_CURRENT_sum
~avg(CNT_DRAWINGS_ATM_CURRENT) AS cc_CNT_DRAWINGS_ATM_CURRENT_mean
CAST(coalesce(sum(CNT_DRAWINGS_CURRENT), 0) AS BIGINT) AS cc_CNT_DRAWINGS_CURRENT_sum
~avg(CNT_DRAWINGS_CURRENT) AS cc_CNT_DRAWINGS_CURRENT_mean
"""


def items(lines: str) -> str:
    """The select list."""
    done = []
    for line in lines.strip().splitlines():
        expr, name = line.lstrip("~").rsplit(" AS ", 1)
        done.append(f"{rnd(expr) if line.startswith('~') else expr} AS {name}")
    return ",\n  ".join(done)


def by_client(lines: str, source: str) -> str:
    """The aggregate of ``source`` per client."""
    return f"SELECT SK_ID_CURR,\n  {items(lines)}\nFROM {source} WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR"
