"""Order-dependent statistics without a single-partition window.

``running_totals`` computes, for every distinct value of an ordering column,
the total of some measures over all rows ordered at or before it (ties
together, i.e. a RANGE frame), optionally per group.  A naive
``Window.orderBy(x)`` moves every row into one task; here:

1. rows are pre-aggregated per distinct (group, value) - map-side combine,
   so a hot value collapses to one row before the shuffle;
2. Spark's range partitioning deals the distinct (group, value) rows, in order,
   over as many tasks as the data asks for, and they are written once;
3. the totals of each group's stretch in each task (groups x tasks rows) give every
   stretch its offset through a small window;
4. the running sum is finished inside each stretch.

``exact_percentiles`` builds PERCENTILE_CONT on top of it: the totals tell which
stretch holds a target rank, and only those are summed up and searched.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

_S = "_stretch"


def _stretches(df: DataFrame, order_col: str, measures: dict[str, Column], g: list[str], descending: bool,
               buckets: int | None) -> tuple[DataFrame, DataFrame]:
    """(rows, runs): one row per distinct (group, value) with its stretch, and one row
    per (group, stretch) with ``_off_<m>``, the total before it, ``_run_<m>``, its own,
    and ``tot_<m>``, the group's."""
    from kredo.session import cut_lineage
    if not isinstance(df.schema[order_col].dataType, NumericType):
        raise TypeError(f"running_totals needs a numeric order column, {order_col!r} is none")
    distinct = (df.where(F.col(order_col).isNotNull()).groupBy(*g, order_col)
                .agg(*[F.sum(expr).alias(name) for name, expr in measures.items()]))
    order = [*[F.col(c) for c in g], F.col(order_col).desc() if descending else F.col(order_col).asc()]
    dealt = distinct.repartitionByRange(buckets, *order) if buckets else distinct.repartitionByRange(*order)
    # written, so that a row's task is the same for the totals and for the rows
    rows = cut_lineage(dealt.withColumn(_S, F.spark_partition_id()))
    runs = rows.groupBy(*g, _S).agg(*[F.sum(n).alias(f"_run_{n}") for n in measures])
    before = Window.partitionBy(*g).orderBy(_S).rowsBetween(Window.unboundedPreceding, -1)
    return rows, runs.select(*g, _S, *[f"_run_{n}" for n in measures], *[
        F.coalesce(F.sum(f"_run_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in measures], *[
        F.sum(f"_run_{n}").over(Window.partitionBy(*g)).alias(f"tot_{n}") for n in measures])


def _summed(rows: DataFrame, runs: DataFrame, order_col: str, measures: list[str], g: list[str], descending: bool) -> DataFrame:
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w = Window.partitionBy(*g, _S).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(runs, on=[*g, _S], how="inner").select(
        *g, order_col, *measures, *[(F.col(f"_off_{n}") + F.sum(n).over(w)).alias(f"cum_{n}") for n in measures],
        *[f"tot_{n}" for n in measures])


def running_totals(df: DataFrame, order_col: str, measures: dict[str, Column],
                   group_cols: list[str] | tuple = (), descending: bool = False,
                   buckets: int | None = None) -> DataFrame:
    """Return one row per distinct (group, order value) with each measure
    summed over its rows (``<m>``), its running total in order (``cum_<m>``)
    and the group total (``tot_<m>``, known from the stretches' totals at no
    extra pass).  The order column is numeric; ``numbered`` ranks other types.
    ``buckets`` fixes the number of stretches (Spark's own if None)."""
    g = list(group_cols)
    rows, runs = _stretches(df, order_col, measures, g, descending, buckets)
    return _summed(rows, runs, order_col, list(measures), g, descending)


def exact_percentiles(df: DataFrame, value_col: str, probs: dict[str, float],
                      group_cols: list[str] | tuple = (),
                      buckets: int | None = None) -> DataFrame:
    """PERCENTILE_CONT for each ``name -> p`` (linear interpolation between
    the values at ranks floor/ceil of p*(n-1)), per group.  NULLs ignored.
    Stretches that hold no such rank are passed over."""
    g = list(group_cols)
    rows, runs = _stretches(df, value_col, {"_n": F.lit(1)}, g, False, buckets)
    total = F.col("tot__n")
    place = {name: F.lit(float(p)) * (total - 1) for name, p in probs.items()}
    ranks = [f(pos) for pos in place.values() for f in (F.floor, F.ceil)]
    runs = runs.where(functools.reduce(Column.__or__, [
        (F.col("_off__n") <= r) & (r < F.col("_off__n") + F.col("_run__n")) for r in ranks]))
    rt = _summed(rows, runs, value_col, ["_n"], g, False)
    first = F.col("cum__n") - F.col("_n")          # 0-based rank of first copy
    last = F.col("cum__n") - 1                     # 0-based rank of last copy
    aggs = []
    for name, pos in place.items():
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs.append(F.max(F.when((first <= lo) & (lo <= last), F.col(value_col))).alias(f"_lo_{name}"))
        aggs.append(F.max(F.when((first <= hi) & (hi <= last), F.col(value_col))).alias(f"_hi_{name}"))
        aggs.append(F.max(pos - lo).alias(f"_fr_{name}"))
    res = rt.groupBy(*g).agg(*aggs)
    return res.select(*g, *[
        (F.col(f"_lo_{n}") + F.col(f"_fr_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n)
        for n in probs])


def percentile_columns(df: DataFrame, value_col: str, probs: dict[str, float],
                       group_cols: list[str] | tuple = (), exact: bool = True) -> DataFrame:
    """Exact (distributed, see above) or approximate (bounded sketch)
    percentiles per group."""
    if exact:
        return exact_percentiles(df, value_col, probs, group_cols)
    return df.groupBy(*group_cols).agg(*[
        F.percentile_approx(value_col, float(p), 10000).alias(n) for n, p in probs.items()])


def numbered(df: DataFrame, group_col: str, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the place (from 0) of each row in its group's ``order``, which is
    to have no ties.

    Spark's range partitioning sorts the rows over all tasks, groups one after the
    other, so neither a large group nor a large vocabulary meets in one task.  The
    sorted rows are written to the checkpoint folder; a row's place is its own
    position in its task, less that of its group's first row there, plus the group's
    rows in earlier tasks - a window over groups x tasks alone."""
    from kredo.session import cut_lineage
    sorted_rows = cut_lineage(
        df.repartitionByRange(F.col(group_col), *order).sortWithinPartitions(F.col(group_col), *order)
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    runs = sorted_rows.groupBy(group_col, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group_col).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (sorted_rows.join(runs, [group_col, "_part"])
            .withColumn(out, F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_part", "_at", "_first", "_before"))
