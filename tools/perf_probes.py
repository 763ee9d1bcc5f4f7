"""

1. threshold sweep: one-pass cost curve vs the literal 80-way cross join, on
   the scored rows of a scale factor replicated to >= 1 M rows;
2. streaming throughput of the hourly window job (file source, availableNow)
   over the events table replicated into many files.

Scratch data goes to a fresh folder under /tmp.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from kredo.operators import metrics as M  # noqa: E402
from kredo.plans import standins as S  # noqa: E402
from kredo.session import build_session  # noqa: E402
from kredo.streaming import monitor as MON  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
COPIES = int(os.environ.get("PROBE_COPIES", "300"))


def timed(df) -> float:
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    spark = build_session("local[8]", app_name="kredo-probes", shuffle_partitions=16)
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rep = F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("copy")
    scored = S.scored(spark, SF).select("*", rep)
    path = os.path.join(scratch, "scored")
    scored.write.parquet(path)
    big = spark.read.parquet(path)
    n = big.count()

    one_pass = M.cost_curve(big)
    grid = spark.createDataFrame([(i, t) for i, t in enumerate(M.threshold_grid())], "i long, threshold double")
    cross = (big.join(F.broadcast(grid), how="cross")
             .groupBy("i", "threshold")
             .agg(F.count_if((F.col("y_true") == 1) & ~(F.col("y_proba") >= F.col("threshold"))).alias("fn"),
                  F.count_if((F.col("y_true") == 0) & (F.col("y_proba") >= F.col("threshold"))).alias("fp"))
             .select("i", (F.col("fn") * 10 + F.col("fp")).alias("cost")))
    timed(one_pass), timed(cross)                      # warm-up
    t_one = min(timed(one_pass) for _ in range(3))
    t_cross = min(timed(cross) for _ in range(3))
    same = sorted((r.i, r.cost) for r in one_pass.select("i", "cost").collect()) == \
        sorted((r.i, r.cost) for r in cross.collect())

    events = spark.read.parquet(os.path.join(SF, "events.parquet"))
    src = os.path.join(scratch, "events_stream")
    k = max(1, COPIES // 30)
    (events.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("c"))
     .withColumn("event_id", F.col("event_id") * k + F.col("c")).drop("c")
     .repartition(16).write.parquet(src))
    stream = spark.readStream.schema(events.schema).parquet(src)
    rows = spark.read.parquet(src).count()
    t0 = time.perf_counter()
    MON.run_window_stream(S.api_logs_from(stream), os.path.join(scratch, "out"),
                          os.path.join(scratch, "ckpt"))
    t_stream = time.perf_counter() - t0
    print(json.dumps({
        "scored_rows": n, "sweep_one_pass_s": round(t_one, 3), "sweep_cross_join_s": round(t_cross, 3),
        "sweep_speedup": round(t_cross / t_one, 2), "sweep_same_result": same,
        "stream_rows": rows, "stream_seconds": round(t_stream, 3),
        "stream_rows_per_s": round(rows / t_stream), "scratch": scratch}))


if __name__ == "__main__":
    main()
