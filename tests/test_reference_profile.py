"""Reference profiles from states by file: new, changed and removed files."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from kredo.operators.profile import category_profile, numeric_profile
from kredo.operators.reference import ReferenceFrame, ReferenceProfile
from kredo.sources.versions import Store
from tests.conftest import rows


def frame(spark, low, high):
    return spark.range(low, high).select((F.col("id") * 1.5 + 1e6).alias("x"), F.when(F.col("id") % 7 == 0, None).otherwise(
        F.col("id")).cast("double").alias("y"), (F.col("id") % 3).cast("string").alias("c"), F.lit(None).cast("double").alias("z"))


def same(profile, df):
    got, want = rows(profile.numbers(), "feature"), rows(numeric_profile(df, ["x", "y"]), "feature")
    assert [r["feature"] for r in got] == [r["feature"] for r in want]
    for a, b in zip(got, want):
        assert all(a[k] == (pytest.approx(b[k], rel=1e-9) if isinstance(b[k], float) else b[k]) for k in b)
    assert rows(profile.categories(), "feature") == rows(category_profile(df, ["c"]), "feature")


def test_refreshes(spark, tmp_path):
    path = str(tmp_path / "reference")
    profile = ReferenceProfile(Store(spark, str(tmp_path / "store")), path, ["x", "y", "z"], ["c"])
    frame(spark, 0, 50).coalesce(2).write.mode("append").parquet(path)
    assert len(profile.refresh()) == 2
    same(profile, spark.read.parquet(path))
    assert profile.refresh() == []
    before = set(os.listdir(path))
    frame(spark, 50, 51).coalesce(1).write.mode("append").parquet(path)
    read = profile.refresh()
    assert [os.path.basename(f) for f in read] == [f for f in os.listdir(path) if f not in before and f.endswith(".parquet")]
    same(profile, spark.read.parquet(path))
    # one file goes, another takes new content under its old name
    names = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    os.remove(os.path.join(path, names[0]))
    frame(spark, 500, 590).coalesce(1).write.parquet(str(tmp_path / "other"))
    made = next(f for f in os.listdir(tmp_path / "other") if f.endswith(".parquet"))
    shutil.copy(tmp_path / "other" / made, os.path.join(path, names[1]))
    for crc in [f for f in os.listdir(path) if f.endswith(".crc")]:
        os.remove(os.path.join(path, crc))
    spark.catalog.refreshByPath(path)
    assert [os.path.basename(f) for f in profile.refresh()] == [names[1]]
    same(profile, spark.read.parquet(path))


def test_constant_and_single_values(spark, tmp_path):
    path = str(tmp_path / "one")
    profile = ReferenceProfile(Store(spark, str(tmp_path / "store")), path, ["x"], [])
    for _ in range(2):
        spark.range(1).select(F.lit(0.1).alias("x")).write.mode("append").parquet(path)
        profile.refresh()
    r = profile.numbers().first()
    assert r["count"] == 2 and r["std"] == pytest.approx(0, abs=1e-12) and r["mean"] == pytest.approx(0.1)


def test_reference_frame_is_renewed_and_released(spark, tmp_path):
    path = str(tmp_path / "frame")
    frame(spark, 0, 10).write.parquet(path)
    with ReferenceFrame(spark, path) as kept:
        first = kept.get()
        assert first.count() == 10 and kept.get() is first and first.is_cached
        frame(spark, 10, 15).write.mode("append").parquet(path)
        assert kept.get().count() == 15 and not first.is_cached
        last = kept.get()
    assert not last.is_cached
