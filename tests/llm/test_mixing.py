"""The mix follows its schedule: discrepancy of every prefix, order of what is written,
and what is taken of each document."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from kredo.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 20, 90, 400])), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(600)]
    return spark.createDataFrame([(i, t, s, len(t)) for i, t, s in rows], SCHEMA).repartition(4).cache()


def shares(docs):
    sizes = docs.groupBy("source").agg(F.sum(F.size(F.array_remove(F.split("text", " "), ""))).alias("source_size"))
    return {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}


def worst_prefix(order, target):
    """The largest distance of a source's words from its share of the words so far."""
    total, seen, worst, whole = 0, collections.Counter(), 0.0, sum(target.values())
    for source, n in order:
        total += n
        seen[source] += n
        worst = max(worst, max(abs(seen[s] - t / whole * total) for s, t in target.items()))
    return worst


def test_every_prefix_is_near_the_targets(docs):
    block = 32
    rows, pieces = mixing.plan_mix(docs, block_words=block)
    by_slot = pieces.groupBy("slot").agg(F.first("source").alias("source"), F.sum(F.col("last") - F.col("first")).alias("n"))
    order = [(r["source"], r["n"]) for r in by_slot.orderBy("slot").collect()]
    target = shares(docs)
    assert worst_prefix(order, target) <= 2 * block * math.log2(len(order))
    one_after_another = sorted(order, key=lambda x: str(x[0]))
    assert worst_prefix(one_after_another, target) > 10 * block * math.log2(len(order))


def test_the_mix_comes_in_the_order_of_the_schedule(docs, monkeypatch):
    def written(df):
        return [(r["doc_id"], r["source"]) for r in df.collect()]

    mixed = mixing.mixed_documents(docs, block_words=32)
    order = written(mixed)
    assert order == written(mixing.mixed_documents(docs, block_words=32))
    target = shares(docs)
    size = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    largest = max(size.values())
    assert worst_prefix([(s, size[i]) for i, s in order], target) < worst_prefix(
        [(s, size[i]) for i, s in sorted(order, key=str)], target)
    assert worst_prefix([(s, size[i]) for i, s in order], target) <= 20 * largest

    # another schedule - one source after the other - gives the same rows in another order
    def in_turn(blocks, spark):
        slots = blocks.where("n_slots > 0").select("source", F.explode(F.expr("sequence(0L, CAST(n_slots - 1 AS BIGINT))")).alias("rank"))
        base = {"a": 0, "b": 10**6, "c": 2 * 10**6, None: 3 * 10**6}
        first = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(k)), v) for k, v in base.items()])
        return slots.select((first + F.col("rank")).cast("long").alias("slot"), "source", "rank")

    report = {r["doc_id"]: r for r in mixing.mix_report(docs, block_words=32).collect()}
    monkeypatch.setattr(mixing, "_schedule", in_turn)
    other = written(mixing.mixed_documents(docs, block_words=32))
    assert sorted(map(str, other)) == sorted(map(str, order)) and other != order
    changed = {r["doc_id"]: r for r in mixing.mix_report(docs, block_words=32).collect()}
    assert {i: r["taken"] for i, r in changed.items()} == {i: r["taken"] for i, r in report.items()}
    assert {i: r["first_slot"] for i, r in changed.items()} != {i: r["first_slot"] for i, r in report.items()}


def test_what_is_taken(docs):
    """Whole passes over a source, then a part of one more: per document its words so many
    times, and in all the target."""
    report = mixing.mix_report(docs, block_words=32).collect()
    of = collections.defaultdict(list)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in report:
        of[source[r["doc_id"]]].append(r)
    for rows in of.values():
        words, size = round(rows[0]["target"]), rows[0]["source_size"]
        passes, rest = divmod(words, size)
        assert sum(r["taken"] for r in rows) == words
        assert all(passes * r["size"] <= r["taken"] <= min(passes + 1, 2) * r["size"] for r in rows)
        partly = [r for r in rows if passes * r["size"] < r["taken"] < (passes + 1) * r["size"]]
        assert len(partly) <= 1 and sum(r["taken"] - passes * r["size"] for r in rows) == rest
        assert all((r["first_slot"] is None) == (r["taken"] == 0) for r in rows)
