"""History views of the log: recent rows, filters, pages, long forms
(O1, O6, P7, W5, N5, N6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kredo.operators.logstats import recent


def recent_logs(logs: DataFrame, as_of: str | None = None, last_n_hours: int = 24,
                limit: int | None = None) -> DataFrame:
    """Newest first, optional limit (a top-k: TakeOrderedAndProject,
    each task keeps only ``limit`` rows)."""
    r = recent(logs, as_of, last_n_hours).orderBy(F.col("timestamp").desc(), F.col("log_id").desc())
    return r.limit(limit) if limit else r


def filter_history(logs: DataFrame, min_score: float = 0.0, max_score: float = 1.0,
                   types: tuple[str, ...] = ("single", "batch"),
                   client_search: str | None = None, regex: bool = False) -> DataFrame:
    """Score range, type set and case-insensitive client-id search
    (literal substring, or a regex when ``regex=True``)."""
    cond = F.col("score").between(min_score, max_score) & F.col("prediction_type").isin(*types)
    if client_search:
        cid = F.lower(F.col("client_id").cast("string"))
        cond = cond & (cid.rlike("(?i)" + client_search) if regex
                       else cid.contains(client_search.lower()))
    return logs.where(cond)


def page(df: DataFrame, order: list[Column], page: int, size: int,
         clamp: bool = False) -> DataFrame:
    """1-based page of a sorted frame.  Sort + offset/limit is planned
    as a top-(page*size) per task; for deep pages use ``keyset_page``.  With
    ``clamp`` a page past the end becomes the last page (one count)."""
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    if clamp:
        page = min(page, page_count(df, size))
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


# The page sizes offered for the history table.
PAGE_SIZES = (10, 25, 50, 100)


def page_count(df: DataFrame, size: int) -> int:
    """Number of pages (at least 1) of ``size`` rows."""
    n = df.count()
    return max(1, -(-n // size))


def keyset_page(df: DataFrame, ts_col: str, id_col: str, after: tuple | None,
                size: int) -> DataFrame:
    """Deep paging, newest first: rows strictly after the last (ts, id) seen."""
    if after is not None:
        ts, i = after
        t = F.col(ts_col)
        ts = ts if isinstance(ts, Column) else F.lit(ts)
        df = df.where((t < ts) | ((t == ts) & (F.col(id_col) < F.lit(i))))
    return df.orderBy(F.col(ts_col).desc(), F.col(id_col).desc()).limit(size)


RESOURCE_LABELS = {"cpu_usage_pct": "CPU (%)", "gpu_usage_pct": "GPU (%)"}


def resource_long(logs: DataFrame) -> DataFrame:
    """CPU/GPU columns to (timestamp, resource_type, usage_pct), missing
    values dropped."""
    present = [c for c in RESOURCE_LABELS if c in logs.columns]
    long = logs.select("timestamp", *present).unpivot(
        "timestamp", present, "resource_type", "usage_pct")
    label = F.col("resource_type")
    for c, text in RESOURCE_LABELS.items():
        label = F.when(F.col("resource_type") == c, text).otherwise(label)
    return long.where(F.col("usage_pct").isNotNull()).withColumn("resource_type", label)


def payload_rows(logs: DataFrame, id_col: str = "log_id", payload: str = "input_data") -> DataFrame:
    """JSON object column -> (id, feature, value) rows."""
    m = F.from_json(F.col(payload), "map<string,string>")
    return logs.select(id_col, F.explode(m).alias("feature", "value"))
