"""Versioned tables: whole versions after a crash, conflicts, untouched days, clean-up."""

import pytest
from pyspark.sql import functions as F

from kredo.operators import alerts as AL
from kredo.operators import archive as AR
from kredo.sources.versions import Conflict, Store

LOG = "log_id long, timestamp timestamp_ntz, score double"


def log(spark, rows):
    return (spark.createDataFrame(rows, "log_id long, t string, score double")
            .select("log_id", F.col("t").cast("timestamp_ntz").alias("timestamp"), "score")
            .withColumn("log_date", F.to_date("timestamp")))


ROWS = [(1, "2024-01-01 10:00:00", .1), (2, "2024-01-05 08:00:00", .2), (3, "2024-01-05 16:00:00", .3),
        (4, "2024-01-20 00:00:00", .4), (5, None, .5)]


@pytest.fixture
def store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    change = store.change()
    assert change.append("api_logs", log(spark, ROWS), "log_date") == {
        "2024-01-01": 1, "2024-01-05": 2, "2024-01-20": 1, "__HIVE_DEFAULT_PARTITION__": 1}
    change.publish()
    return store


def ids(df):
    return sorted(r["log_id"] for r in df.collect())


def test_nothing_is_seen_before_it_is_published(spark, store):
    change = store.change()
    change.append("api_logs", log(spark, [(9, "2024-01-05 01:00:00", .9)]), "log_date")
    change.replace("api_logs", log(spark, [(10, "2024-01-20 01:00:00", 1.)]), "log_date", ["2024-01-20"])
    assert ids(store.read("api_logs")) == [1, 2, 3, 4, 5]      # as after a crash here
    assert change.publish() == 2
    assert ids(store.read("api_logs")) == [1, 2, 3, 5, 9, 10]
    assert ids(store.read("api_logs", version=1)) == [1, 2, 3, 4, 5]
    assert store.read("api_logs").schema["log_date"].dataType.simpleString() == "date"


def test_archive_stopped_between_the_writes(spark, store, monkeypatch):
    from kredo.sources import versions
    monkeypatch.setattr(versions.Change, "publish", lambda self: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError, match="stopped"):
        AR.apply_archive(store, "2024-01-31 12:00:00", days=26)
    assert ids(store.read("api_logs")) == [1, 2, 3, 4, 5] and store.versions() == [1]
    monkeypatch.undo()
    done = AR.apply_archive(store, "2024-01-31 12:00:00", days=26)
    assert done == {"archived": 2, "remaining": 3, "version": 2}
    assert ids(store.read("api_logs")) == [3, 4, 5] and ids(store.read("api_logs_archive")) == [1, 2]
    assert AR.apply_archive(store, "2024-01-31 12:00:00", days=26) == {"archived": 0, "remaining": 3, "version": 2}


def test_archive_touches_old_days_alone(spark, store):
    before = store.manifest()["tables"]["api_logs"]["parts"]
    AR.apply_archive(store, "2024-01-31 12:00:00", days=26)
    after = store.manifest()["tables"]["api_logs"]["parts"]
    assert after["2024-01-20"] == before["2024-01-20"] and after["2024-01-05"] != before["2024-01-05"]
    assert "2024-01-01" not in after


def test_rows_archived_before_are_not_added_again(spark, store):
    change = store.change()
    old = log(spark, ROWS[:1]).withColumn("archive_reason", F.lit("x")).withColumn("archived_at", F.col("timestamp"))
    change.append("api_logs_archive", old, "log_date")
    change.publish()
    assert AR.apply_archive(store, "2024-01-31 12:00:00", days=26)["archived"] == 1
    assert ids(store.read("api_logs_archive")) == [1, 2]


def test_the_second_of_two_writers_fails(spark, store):
    one, two = store.change(), store.change()
    one.drop("api_logs", ["2024-01-01"])
    two.drop("api_logs", ["2024-01-20"])
    one.publish()
    with pytest.raises(Conflict):
        two.publish()
    assert ids(store.read("api_logs")) == [2, 3, 4, 5]


def test_replace_checks_its_partitions(spark, store):
    with pytest.raises(ValueError, match="not replaced"):
        store.change().replace("api_logs", log(spark, ROWS[:2]), "log_date", ["2024-01-01"])
    with pytest.raises(ValueError, match="another schema"):
        store.change().append("api_logs", log(spark, ROWS[:2]).drop("score"), "log_date")


def test_cleanup(spark, store):
    events = log(spark, ROWS).select(
        F.col("log_id").alias("alert_id"), F.col("timestamp").alias("created_at"), F.col("log_date").alias("created_date"))
    change = store.change()
    change.append("alert_events", events, "created_date")
    change.publish()
    assert AL.apply_cleanup(store, "2024-01-31 12:00:00", days=26) == {"deleted": 2, "version": 3}
    assert sorted(r["alert_id"] for r in store.read("alert_events").collect()) == [3, 4, 5]
    assert AL.apply_cleanup(store, "2024-01-31 12:00:00", days=26) == {"deleted": 0, "version": 3}
    assert AL.apply_cleanup(store, "2024-01-31 00:00:00", days=11) == {"deleted": 1, "version": 4}


def test_vacuum_keeps_what_is_named(spark, store):
    AR.apply_archive(store, "2024-01-31 12:00:00", days=26)
    store.change().append("api_logs", log(spark, ROWS[:1]), "log_date")      # never published
    assert store.vacuum(keep=2) == 1
    assert ids(store.read("api_logs", version=1)) == [1, 2, 3, 4, 5]
    assert store.vacuum(keep=1) == 2 and store.versions() == [2]
    assert ids(store.read("api_logs")) == [3, 4, 5]


def test_partitions_read_alone(spark, store):
    assert ids(store.read("api_logs", ["2024-01-05", "2030-01-01"])) == [2, 3]
    assert len(store.read("api_logs", ["2024-01-05"]).inputFiles()) == 1
    assert store.read("api_logs", []).count() == 0
