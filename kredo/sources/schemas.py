"""Declared schemas of the tables that are read and written.

Fixed values: names and types of the prediction-log tables and of the public credit
files' columns that the operators use.  A file may hold further columns; they are read
as text."""

API_LOGS = """log_id BIGINT, timestamp TIMESTAMP_NTZ, client_id BIGINT, prediction_type STRING, input_data STRING,
    score DOUBLE, latency_seconds DOUBLE, cpu_usage_pct DOUBLE, gpu_usage_pct DOUBLE, gpu_memory_mb DOUBLE,
    compute_device STRING, error_message STRING, model_version STRING, created_at TIMESTAMP_NTZ"""
API_LOGS_ARCHIVE = API_LOGS + ", archive_id BIGINT, archived_at TIMESTAMP_NTZ, archive_reason STRING"
API_PERFORMANCE = """time_bucket TIMESTAMP_NTZ, total_requests BIGINT, avg_latency_seconds DOUBLE, min_latency_seconds DOUBLE,
    max_latency_seconds DOUBLE, p95_latency_seconds DOUBLE, p99_latency_seconds DOUBLE, error_count BIGINT,
    error_rate DOUBLE, avg_score DOUBLE, min_score DOUBLE, max_score DOUBLE"""
API_ALERTS = """alert_id BIGINT, alert_type STRING, severity STRING, message STRING, metadata STRING,
    acknowledged BOOLEAN, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"""
DRIFT_RESULTS = """detection_time TIMESTAMP_NTZ, is_drift_detected BOOLEAN, drift_score DOUBLE,
    affected_features ARRAY<STRING>, details STRING, model_version STRING"""

_APPLICATION = """SK_ID_CURR BIGINT, NAME_CONTRACT_TYPE STRING, CODE_GENDER STRING, FLAG_OWN_CAR STRING, FLAG_OWN_REALTY STRING,
    CNT_CHILDREN INT, AMT_INCOME_TOTAL DOUBLE, AMT_CREDIT DOUBLE, AMT_ANNUITY DOUBLE, AMT_GOODS_PRICE DOUBLE,
    NAME_EDUCATION_TYPE STRING, NAME_FAMILY_STATUS STRING, NAME_HOUSING_TYPE STRING, DAYS_BIRTH INT, DAYS_EMPLOYED INT,
    OCCUPATION_TYPE STRING, CNT_FAM_MEMBERS DOUBLE, EXT_SOURCE_1 DOUBLE, EXT_SOURCE_2 DOUBLE, EXT_SOURCE_3 DOUBLE"""
# table -> (file, declared schema)
CATALOG = {
    "application_train": ("application_train.csv", _APPLICATION + ", TARGET INT"),
    "application_test": ("application_test.csv", _APPLICATION),
    "bureau": ("bureau.csv", """SK_ID_CURR BIGINT, SK_ID_BUREAU BIGINT, CREDIT_ACTIVE STRING, DAYS_CREDIT INT, CREDIT_DAY_OVERDUE INT,
        AMT_CREDIT_MAX_OVERDUE DOUBLE, AMT_CREDIT_SUM DOUBLE, AMT_CREDIT_SUM_DEBT DOUBLE, AMT_CREDIT_SUM_OVERDUE DOUBLE,
        AMT_ANNUITY DOUBLE"""),
    "bureau_balance": ("bureau_balance.csv", "SK_ID_BUREAU BIGINT, MONTHS_BALANCE INT, STATUS STRING"),
    "previous_application": ("previous_application.csv", """SK_ID_CURR BIGINT, SK_ID_PREV BIGINT, AMT_ANNUITY DOUBLE,
        AMT_APPLICATION DOUBLE, AMT_CREDIT DOUBLE, NAME_CONTRACT_STATUS STRING, DAYS_DECISION INT, CNT_PAYMENT DOUBLE"""),
    "POS_CASH_balance": ("POS_CASH_balance.csv", """SK_ID_CURR BIGINT, SK_ID_PREV BIGINT, MONTHS_BALANCE INT, CNT_INSTALMENT DOUBLE,
        CNT_INSTALMENT_FUTURE DOUBLE, SK_DPD INT, SK_DPD_DEF INT"""),
    "credit_card_balance": ("credit_card_balance.csv", """SK_ID_CURR BIGINT, SK_ID_PREV BIGINT, MONTHS_BALANCE INT, AMT_BALANCE DOUBLE,
        AMT_CREDIT_LIMIT_ACTUAL DOUBLE, AMT_DRAWINGS_ATM_CURRENT DOUBLE, AMT_DRAWINGS_CURRENT DOUBLE, AMT_PAYMENT_CURRENT DOUBLE,
        CNT_DRAWINGS_ATM_CURRENT DOUBLE, CNT_DRAWINGS_CURRENT INT"""),
    "installments_payments": ("installments_payments.csv", """SK_ID_CURR BIGINT, SK_ID_PREV BIGINT, NUM_INSTALMENT_VERSION DOUBLE,
        NUM_INSTALMENT_NUMBER INT, DAYS_INSTALMENT DOUBLE, DAYS_ENTRY_PAYMENT DOUBLE, AMT_INSTALMENT DOUBLE, AMT_PAYMENT DOUBLE"""),
    "columns_description": ("HomeCredit_columns_description.csv", "Table STRING, Row STRING, Description STRING, Special STRING"),
    "api_logs": ("api.log", API_LOGS),
}
