"""Alert state as a snapshot and the events since, by hash bucket.

The state of an alert is its latest event.  Events are appended to the bucket of their
alert; from time to time the buckets that got some are merged into the snapshot, and the
others are not read or written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kredo.operators.alerts import EVENT_COLUMNS, alert_state
from kredo.sources.versions import Store

BUCKETS = 64


class AlertStore:
    def __init__(self, store: Store, buckets: int = BUCKETS):
        self.store, self.buckets = store, buckets

    def add(self, events: DataFrame) -> int:
        """Append events (raised or acknowledged); returns how many."""
        change = self.store.change()
        bucket = F.pmod(F.xxhash64("alert_id"), F.lit(self.buckets)).cast("int")
        n = sum(change.append("pending", events.select(*EVENT_COLUMNS, bucket.alias("bucket")), "bucket").values())
        if n:
            change.publish()
        return n

    def compact(self) -> list[str]:
        """Merge pending events into the snapshot; returns the buckets that were written."""
        change = self.store.change()
        buckets = sorted(change.base["tables"].get("pending", {"parts": {}})["parts"])
        if buckets:
            change.replace("snapshot", self._state(buckets), "bucket", buckets)
            change.drop("pending", buckets)
            change.publish()
        return buckets

    def _state(self, buckets: list[str] | None) -> DataFrame:
        """The state of the alerts of some buckets: an alert's bucket follows from its id."""
        tables = self.store.manifest()["tables"]
        parts = [self.store.read(t, buckets) for t in ("snapshot", "pending") if t in tables]
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        state = alert_state(both.drop("bucket"))
        return state.select(*EVENT_COLUMNS, F.pmod(F.xxhash64("alert_id"), F.lit(self.buckets)).cast("int").alias("bucket"))

    def current(self) -> DataFrame:
        """The state of all alerts: the snapshot with what came since."""
        tables = self.store.manifest()["tables"]
        if not tables:
            raise ValueError("no event was added yet")
        waiting = sorted(tables.get("pending", {"parts": {}})["parts"])
        rest = sorted(set(tables.get("snapshot", {"parts": {}})["parts"]) - set(waiting))
        parts = [self.store.read("snapshot", rest)] if rest else []
        if waiting or not parts:
            parts.append(self._state(waiting))
        return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).drop("bucket")
