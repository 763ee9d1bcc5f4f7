"""A request log in which each request is written once, however late it
comes again.

``dropDuplicatesWithinWatermark`` forgets keys as its watermark passes them.  Here the
keys of all requests are kept in a table by hash bucket, each bucket with a Bloom filter.
A batch is held against the filters; only requests that a filter may know are looked up
in the keys of their buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kredo.sources.versions import Store

BUCKETS = 64
BITS = 24                # bits of a bucket's filter, as a power of two
COMPACT_AFTER = 16       # pieces of a bucket's filter that are merged


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _places(key: Column) -> Column:
    """Three places of a key in its bucket's filter."""
    mask = F.lit((1 << BITS) - 1).cast("long")
    return F.array(*[F.xxhash64(F.lit(i), key).bitwiseAND(mask) for i in (1, 2, 3)])


def _filter_words(keys: DataFrame) -> DataFrame:
    """(bucket, word, bits) of the filters of some keys."""
    placed = keys.select("bucket", F.explode(_places(F.col("key"))).alias("place"))
    return placed.groupBy("bucket", F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(place & 63L AS INT))")).alias("bits"))


def _maybe_known(rows: DataFrame, words: DataFrame) -> DataFrame:
    """The keys of ``rows`` (bucket, key) whose three places are all set."""
    places = rows.select("bucket", "key", F.explode(_places(F.col("key"))).alias("place"))
    hit = places.join(words, (places["bucket"] == words["bucket"]) & (F.shiftright("place", 6) == words["word"]), "left")
    is_set = F.coalesce(F.expr("(shiftright(bits, CAST(place & 63L AS INT)) & 1L) = 1L"), F.lit(False))
    return hit.groupBy(places["bucket"], places["key"]).agg(F.bool_and(is_set).alias("m")).where("m").select("bucket", "key")


def log_once(store: Store, batch: DataFrame, batch_id: int, key: str = "request_id", order: str = "delivered_at",
             table: str = "requests") -> dict:
    """Publish the requests of a batch that were never logged before; returns how many
    came and how many are new.

    Of a request that comes several times in a batch the first by ``order`` is taken.
    Tables of the store: ``requests`` by ``log_date``, ``keys`` and ``filters`` by
    ``bucket``.  Requests without a key can't be told apart and are all logged.  A batch
    that was published before (its number is noted) is not taken in again.  A filter that
    fills up costs look-ups, never a request: the keys decide."""
    from pyspark import StorageLevel
    change = store.change()
    if change.base["notes"].get("batch", -1) >= batch_id:
        return {"received": 0, "new": 0}
    rows = batch.withColumn("_key", F.col(key).cast("string")).persist(StorageLevel.MEMORY_AND_DISK)
    kept = [rows]
    try:
        received = rows.count()
        first = rows.where("_key IS NOT NULL").groupBy("_key").agg(F.min_by(F.struct(*batch.columns), F.struct(order, *batch.columns)).alias("r"))
        first = first.select(_bucket(F.col("_key")).alias("bucket"), F.col("_key").alias("key"), "r")
        known_buckets = change.base["tables"].get("keys", {"parts": {}})["parts"]
        if known_buckets:
            words = store.read("filters", version=change.base["version"]).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
            maybe = _maybe_known(first.select("bucket", "key"), words).persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(maybe)
            buckets = sorted(str(r["bucket"]) for r in maybe.select("bucket").distinct().collect())   # at most BUCKETS
            known = store.read("keys", buckets, change.base["version"]).join(maybe, ["bucket", "key"], "left_semi")
            first = first.join(known, ["bucket", "key"], "left_anti")
        new = first.persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(new)
        taken = new.select("r.*").unionByName(rows.where("_key IS NULL").drop("_key"))
        written = sum(change.append(table, taken.withColumn("log_date", F.to_date(order)), "log_date").values())
        change.append("keys", new.select("key", "bucket"), "bucket")
        change.append("filters", _filter_words(new).select("word", "bits", "bucket"), "bucket")
        _compact(change)
        change.note("batch", batch_id)
        change.publish()
        return {"received": received, "new": written}
    finally:
        for df in kept:
            df.unpersist()


def _compact(change) -> None:
    """Merge the filters of buckets that are in many pieces; the others stay as they are."""
    parts = change.next["tables"].get("filters", {"parts": {}})["parts"]
    many = sorted(b for b, writes in parts.items() if len(writes) > COMPACT_AFTER)
    if many:
        merged = change.read("filters", many).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        change.replace("filters", merged.select("word", "bits", "bucket"), "bucket", many)


def run_log_once(stream: DataFrame, store: Store, ckpt: str, **options) -> None:
    """``log_once`` for each micro-batch to the end of the available input."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        log_once(store, batch, batch_id, **options)

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
