"""Encoding, projection, alignment and validation.

Category vocabularies are learned as a code table (column, value, code) and joined
back; Spark chooses the join by the table's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kredo.functions.numeric import text_number

MISSING = "__MISSING__"


def fit_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """F17 fit: per column, sorted distinct values (missing as __MISSING__)
    numbered 0..k-1, over all tasks whatever the size of a vocabulary."""
    from kredo.operators.ordered import numbered
    values = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in cols]) \
        .unpivot([], cols, "column", "value").distinct()
    return numbered(values, "column", [F.col("value").asc()], "code") \
        .select("column", "value", F.col("code").cast("int").alias("code"))


def encode_labels(df: DataFrame, cols: list[str], codes: DataFrame,
                  unknown: int = -1) -> DataFrame:
    """F17 transform: each column replaced by ``<col>_enc``; unseen values
    get ``unknown``.  Spark broadcasts a column's codes where their size in bytes is
    below its threshold and shuffles otherwise."""
    out = df
    for c in cols:
        m = codes.where(F.col("column") == c).select(
            F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"{c}_enc"))
        key = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
        out = (out.join(m, key == F.col(f"_v_{c}"), "left")
               .withColumn(f"{c}_enc", F.coalesce(F.col(f"{c}_enc"), F.lit(unknown)))
               .drop(f"_v_{c}", c))
    return out


MAX_COLUMNS = 10_000


def vocabulary(codes: DataFrame, max_columns: int = MAX_COLUMNS) -> dict[str, list[str]]:
    """The fitted vocabulary, one name for each column that ``one_hot`` will add.

    A column with so many values that the result would pass ``max_columns`` is no
    category; that raises, and nothing is left out silently."""
    rows = codes.orderBy("column", "code").limit(max_columns + 1).collect()
    if len(rows) > max_columns:
        raise ValueError(f"more than {max_columns} categories: one-hot encoding would add a column for each")
    voc: dict[str, list[str]] = {}
    for r in rows:
        voc.setdefault(r["column"], []).append(r["value"])
    return voc


def one_hot(df: DataFrame, vocab: dict[str, list[str]], drop: bool = True) -> DataFrame:
    """``<col>_enc_<i>`` indicator columns from a fitted vocabulary
    (pure expressions, no join); originals dropped, other columns kept."""
    exprs = {}
    for c, values in vocab.items():
        key = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
        for i, v in enumerate(values):
            exprs[f"{c}_enc_{i}"] = (key == F.lit(v)).cast("int")
    out = df.withColumns(exprs)
    return out.drop(*vocab.keys()) if drop else out


def yes_no_to_int(c: Column | str) -> Column:
    """'Y' -> 1, anything else -> 0."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col == "Y", 1).otherwise(0)


def canonical_yes_no(c: Column | str) -> Column:
    """Y/N canonical text from 'Y'/'N' or 1/0 (both sides of a drift check)."""
    col = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(col.isin("Y", "1", "true"), "Y").when(col.isin("N", "0", "false"), "N")


def numeric_projection(df: DataFrame) -> DataFrame:
    """P1."""
    from kredo.operators.aggregates import numeric_columns
    return df.select(*numeric_columns(df))


def align_columns(df: DataFrame, expected: list[str], fill: float = 0.0) -> DataFrame:
    """Expected columns in order; absent ones filled with ``fill``;
    extras dropped."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in expected])


def invalid_numeric_fields(fields: list[str]) -> Column:
    """Names of fields whose non-NULL value does not convert to a number."""
    checks = [F.when(F.col(f).isNotNull() & text_number(F.col(f).cast("string")).isNull(),
                     F.lit(f)) for f in fields]
    return F.array_compact(F.array(*checks))


def split_valid(df: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with ``rejected_fields``)."""
    tagged = df.withColumn("rejected_fields", invalid_numeric_fields(fields))
    return (tagged.where(F.size("rejected_fields") == 0).drop("rejected_fields"),
            tagged.where(F.size("rejected_fields") > 0))


# Allowed categories and ranges of an application row.
GENDERS = ["M", "F"]
CONTRACT_TYPES = ["Cash loans", "Revolving loans"]
YES_NO = ["Y", "N"]
FAMILY_STATUSES = ["Married", "Single / not married", "Widow", "Widowed", "Separated",
                   "Divorced", "Civil marriage"]
HOUSING_TYPES = ["House / apartment", "With parents", "Municipal apartment",
                 "Rented apartment", "Office apartment", "Co-op apartment"]
EDUCATION_TYPES = ["Lower secondary", "Secondary / secondary special", "Incomplete higher",
                   "Higher education", "Academic degree"]
OCCUPATION_TYPES = ["Sales staff", "Managers", "Laborers", "Core staff", "Drivers",
                    "Accountants", "Medicine staff", "High skill tech staff",
                    "Low-skill Laborers", "IT staff", "Business owner", "Cleaning staff",
                    "Pensioner", "Technicians", "Unknown"]
PENSIONER_DAYS = 365000


def domain_rules() -> dict[str, tuple[str, Column]]:
    """Rule name -> (column, predicate that must hold when the value is
    present)."""
    c = F.col
    rules = {
        "gender_allowed": ("CODE_GENDER", c("CODE_GENDER").isin(*GENDERS)),
        "contract_allowed": ("NAME_CONTRACT_TYPE", c("NAME_CONTRACT_TYPE").isin(*CONTRACT_TYPES)),
        "own_car_yn": ("FLAG_OWN_CAR", c("FLAG_OWN_CAR").isin(*YES_NO)),
        "own_realty_yn": ("FLAG_OWN_REALTY", c("FLAG_OWN_REALTY").isin(*YES_NO)),
        "family_allowed": ("NAME_FAMILY_STATUS", c("NAME_FAMILY_STATUS").isin(*FAMILY_STATUSES)),
        "housing_allowed": ("NAME_HOUSING_TYPE", c("NAME_HOUSING_TYPE").isin(*HOUSING_TYPES)),
        "education_allowed": ("NAME_EDUCATION_TYPE", c("NAME_EDUCATION_TYPE").isin(*EDUCATION_TYPES)),
        "occupation_allowed": ("OCCUPATION_TYPE", c("OCCUPATION_TYPE").isin(*OCCUPATION_TYPES)),
        "children_0_10": ("CNT_CHILDREN", c("CNT_CHILDREN").between(0, 10)),
        "family_at_least_1": ("CNT_FAM_MEMBERS", c("CNT_FAM_MEMBERS") >= 1),
        "income_non_negative": ("AMT_INCOME_TOTAL", c("AMT_INCOME_TOTAL") >= 0),
        "credit_non_negative": ("AMT_CREDIT", c("AMT_CREDIT") >= 0),
        "annuity_non_negative": ("AMT_ANNUITY", c("AMT_ANNUITY") >= 0),
        "goods_non_negative": ("AMT_GOODS_PRICE", c("AMT_GOODS_PRICE") >= 0),
        "ext1_unit": ("EXT_SOURCE_1", c("EXT_SOURCE_1").between(0, 1)),
        "ext2_unit": ("EXT_SOURCE_2", c("EXT_SOURCE_2").between(0, 1)),
        "ext3_unit": ("EXT_SOURCE_3", c("EXT_SOURCE_3").between(0, 1)),
        "birth_in_past": ("DAYS_BIRTH", c("DAYS_BIRTH") < 0),
        "employed_in_past": ("DAYS_EMPLOYED", (c("DAYS_EMPLOYED") < 0)
                             | (c("DAYS_EMPLOYED") == PENSIONER_DAYS)),
    }
    return rules


def rule_violations(df: DataFrame) -> Column:
    """Array of the names of the rules a row breaks (rules whose
    column is absent are not applied)."""
    have = set(df.columns)
    checks = [F.when(F.col(col).isNotNull() & ~pred, F.lit(name))
              for name, (col, pred) in domain_rules().items() if col in have]
    return F.array_compact(F.array(*checks))


def violation_counts(df: DataFrame) -> DataFrame:
    """(rule, violations) for every applicable rule, one aggregate pass."""
    have = set(df.columns)
    rules = [(n, col, p) for n, (col, p) in domain_rules().items() if col in have]
    wide = df.agg(*[F.count_if(F.col(col).isNotNull() & ~p).alias(n) for n, col, p in rules])
    args = []
    for n, _, _ in rules:
        args += [F.lit(n), F.col(n)]
    return wide.select(F.stack(F.lit(len(rules)), *args).alias("rule", "violations"))
