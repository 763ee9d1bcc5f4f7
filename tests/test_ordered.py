import random

import numpy as np
import pytest

from kredo.operators.ordered import exact_percentiles, running_totals
from pyspark.sql import functions as F


def test_exact_percentiles_match_numpy(spark):
    rnd = random.Random(11)
    data = [(g, float(rnd.choice([rnd.random(), 0.5, 0.25]))) for g in ("a", "b", "c") for _ in range(300)]
    data += [("d", 7.0)]  # single value group
    df = spark.createDataFrame(data, "g string, v double").repartition(7)
    out = {r.g: r for r in exact_percentiles(df, "v", {"p25": .25, "p95": .95, "p99": .99}, ["g"],
                                             buckets=5).collect()}
    for g in "abcd":
        vals = np.array([v for k, v in data if k == g])
        for name, p in (("p25", 25), ("p95", 95), ("p99", 99)):
            assert out[g][name] == pytest.approx(np.percentile(vals, p), abs=1e-12)


def test_global_percentile_and_running_totals(spark):
    vals = [float(i % 17) for i in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(4)
    r = exact_percentiles(df, "v", {"p95": .95}, buckets=3).first()
    assert r.p95 == pytest.approx(np.percentile(vals, 95))
    rt = running_totals(df, "v", {"n": F.lit(1)}, descending=True, buckets=4).orderBy(F.desc("v")).collect()
    cum = 0
    for row in rt:
        cum += sum(1 for x in vals if x == row.v)
        assert row.cum_n == cum


def test_string_codes_over_several_tasks(spark):
    from kredo.operators.encoding import fit_codes
    vals = [f"v{i:04d}" for i in range(0, 3000, 7)] + ["Zeta", "__MISSING__x", "é"]
    df = spark.createDataFrame([(v, v[::-1]) for v in vals] * 3, "a string, b string").repartition(5)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    for on in ("true", "false"):          # one task, then as many as shuffle partitions
        spark.conf.set(coalesce, on)
        try:
            codes = {(r.column, r.value): r.code for r in fit_codes(df, ["a", "b"]).collect()}
        finally:
            spark.conf.set(coalesce, before)
        for col, values in (("a", vals), ("b", [v[::-1] for v in vals])):
            expected = sorted(set(values), key=lambda s: s.encode("utf-8"))
            assert [codes[(col, v)] for v in expected] == list(range(len(expected)))


def test_too_many_categories_or_keys_raise(spark):
    from kredo.functions.payload import payload_keys
    from kredo.operators.encoding import fit_codes, vocabulary
    df = spark.createDataFrame([(f"v{i}", f'{{"k{i}": 1}}') for i in range(5)], "a string, j string")
    assert payload_keys(df, "j", max_keys=5) == [f"k{i}" for i in range(5)]
    assert vocabulary(fit_codes(df, ["a"]), max_columns=5) == {"a": [f"v{i}" for i in range(5)]}
    with pytest.raises(ValueError):
        payload_keys(df, "j", max_keys=4)
    with pytest.raises(ValueError):
        vocabulary(fit_codes(df, ["a"]), max_columns=4)


def test_category_share_ranks_break_ties_by_value(spark):
    from kredo.operators.profile import category_shares
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), ("a",), (None,)], "x string")
    got = {(r.value): (r.n, r.rank, r.share) for r in category_shares(df, ["x"]).collect()}
    assert got == {"a": (2, 1, 0.4), "c": (2, 2, 0.4), "b": (1, 3, 0.2)}


def test_stretches_grow_with_the_partitions(spark):
    """10**6 distinct values over 400 partitions: no task holds 2 % of them, and the
    percentile is the exact one."""
    from kredo.operators.ordered import _stretches
    n = 1_000_000
    df = spark.range(n).select((F.xxhash64("id") / 2.0).alias("v"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows, runs = _stretches(df, "v", {"n": F.lit(1)}, [], False, None)
        sizes = [r["_run_n"] for r in runs.collect()]
        assert len(sizes) > 300 and max(sizes) < 0.02 * n and sum(sizes) == n
        got = exact_percentiles(df, "v", {"p95": .95}).first().p95
        assert got == pytest.approx(df.agg(F.percentile("v", .95)).first()[0])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_percentiles_of_groups_of_all_sizes(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("g"), (F.col("id") % 1700).alias("v"))
    got = {r.g: r.p for r in exact_percentiles(df, "v", {"p": .9}, ["g"], buckets=6).collect()}
    want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", .9).alias("p")).collect()}
    assert got == pytest.approx(want)
    assert exact_percentiles(df.where("id < 0"), "v", {"p": .9}).first().p is None
