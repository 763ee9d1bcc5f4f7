"""Mixing sources to target weights with a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kredo.llm.text import n_words, whole, words
from kredo.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)    # of the sources in order, repeating
SHARE = 1.5                  # words of the mix for each word of the corpus
REPEATS = 2                  # a source gives at most so many times its words
BLOCK_WORDS = 256
BUCKET_ROWS = 1024           # rows of a shuffle bucket, about
CHUNK_SLOTS = 2048           # slots that are ranked together
CELLS = 1024                 # cells of the unit interval in which sources are looked up


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Target words of each source from a table (source, source_size).

    Sources in code-point order, null last, take the weights in turn and share
    ``share`` times all words.  A target stops at ``repeats`` times its source's
    size and the excess goes to the others by weight until none is above: with
    sources in order of limit to weight, the first whose share at that point lies
    under its limit sets the level for all.  Windows here run over one row per
    source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("ratio", "rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = (sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", w)
         .withColumn("limit", F.col("source_size") * float(repeats))
         .withColumn("ratio", F.col("limit") / F.col("weight"))
         .withColumn("level", (share * F.sum("source_size").over(Window.partitionBy())
                               - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                     / (F.sum("weight").over(Window.partitionBy())
                        - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))))
    level = F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank"))).over(Window.partitionBy())
    return t.withColumn("level", level).select(
        "source", "source_size",
        F.least("limit", F.coalesce(F.col("weight") * F.col("level"), F.col("limit"))).alias("target"))


def _block_start(i: str) -> str:
    """SQL for the first word of block ``i``: blocks of a source differ by at most
    one word, the longer ones first."""
    return f"({i} * (source_size div n_blocks) + least({i}, source_size % n_blocks))"


def _block_of(p: str) -> str:
    long_part = "((source_size % n_blocks) * (source_size div n_blocks + 1))"
    return (f"CASE WHEN {p} < {long_part} THEN {p} div (source_size div n_blocks + 1) "
            f"ELSE source_size % n_blocks + ({p} - {long_part}) div (source_size div n_blocks) END")


def _keys(id_: Column, text: Column, source: Column) -> list[Column]:
    """Two hashes of id, text and source: 128 bits to tell rows apart."""
    text, source = F.xxhash64(whole(text)), source.cast("string")
    return [F.xxhash64(text, id_, source).alias("k1"), F.xxhash64(F.lit(1), source, id_, text).alias("k2")]


def _offsets(rows: DataFrame, n_rows: int) -> DataFrame:
    """Add ``start``: words before the row in its source's shuffled order.  Rows are
    dealt over buckets by the top bits of their random key; a bucket's rows are
    summed in one window and the buckets' totals in another."""
    bits = max(1, (n_rows // BUCKET_ROWS).bit_length())
    rows = rows.withColumn("bucket", F.shiftright("k1", 64 - bits))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    passed = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"),
                           F.coalesce(F.sum("words").over(passed), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(totals, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
            .withColumn("start", F.col("before") + F.col("inside"))
            .drop("_s", "_b", "before", "inside", "bucket"))


def _schedule(blocks: DataFrame, spark) -> DataFrame:
    """Slots of the mix: (slot, source, rank) for every block a source must give.

    Slot k has the van der Corput point of k (its bits mirrored); the sources'
    shares of all slots lie on the unit interval as neighbouring ranges, and the
    point's range names the slot's source.  Slots are then ranked per source, in
    chunks of consecutive slots with the chunks' counts added up.  What the points
    leave a source short of its blocks, a few slots, is appended at the end, and
    what it has too many is cut, so that each source gives exactly its blocks."""
    n = blocks.agg(F.sum("n_slots")).first()[0] or 0
    bits = max(1, int(n).bit_length())
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    ranges = (blocks.where("n_slots > 0")
              .withColumn("upto", F.sum("n_slots").over(in_order))
              .select("source", "n_slots", ((F.col("upto") - F.col("n_slots")) / F.lit(float(max(n, 1)))).alias("low"),
                      (F.col("upto") / F.lit(float(max(n, 1)))).alias("high"))
              .withColumn("cell", F.explode(F.expr(
                  f"sequence(CAST(floor(low * {CELLS}) AS INT), CAST(least(floor(high * {CELLS}), {CELLS - 1}) AS INT))"))))
    mirrored = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("double") / F.lit(float(1 << bits))
    slots = (spark.range(n).select(F.col("id").alias("slot"), mirrored.alias("point"))
             .withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
             .join(ranges, "cell").where("point >= low AND point < high")
             .select("slot", "source", "n_slots", F.expr(f"slot div {CHUNK_SLOTS}").alias("chunk")))
    counts = slots.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts_before = counts.select(F.col("source").alias("_s"), F.col("chunk").alias("_c"),
                                  F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = (slots.withColumn("inside", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
              .join(counts_before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("chunk") == F.col("_c")))
              .select("slot", "source", (F.col("before") + F.col("inside")).alias("rank"), "n_slots")
              .where("rank < n_slots").drop("n_slots"))
    have = counts.groupBy(F.col("source").alias("_s")).agg(F.sum("n").alias("have"))
    short = (blocks.where("n_slots > 0")
             .join(have, F.col("source").eqNullSafe(F.col("_s")), "left")
             .withColumn("have", F.coalesce("have", F.lit(0))).where("have < n_slots")
             .select(F.explode(F.expr("sequence(have, n_slots - 1)")).alias("rank"), "source")
             .select((F.lit(n) + F.col("rank")).alias("slot"), "source", "rank"))
    return ranked.unionByName(short)


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
             block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The mix as (rows, pieces).

    ``rows``: id, k1 and k2 (hashes of id, text and source), source, size, source_size, target, start of
    every document.  ``pieces``: what each slot of the schedule takes: slot, pass,
    id, k1, k2, source, start, first and last word (counted from 0 in the document, the
    last one excluded).

    Each source's documents are shuffled by a hash and cut into blocks of about
    ``block_words`` words, equal to one word; its slots take the blocks in turn,
    again from the first when all are used, and the last slot stops where the target
    is reached.  The same table gives the same mix.

    Null texts have no words; such documents and empty ones are rows without
    pieces.  Null sources form a source.  Equal rows count each for itself.  Other
    columns are not read.  An empty table gives empty tables."""
    spark = docs.sparkSession
    base = cut_lineage(docs.select(
        F.col(id_col).alias("id"), *_keys(F.col(id_col), F.col(text_col), F.col(source_col)),
        F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    blocks = cut_lineage(
        targets(sizes, weights, share, repeats)
        .withColumn("n_blocks", F.greatest(F.lit(1).cast("long"), F.expr(f"(source_size + {block_words - 1}) div {block_words}")))
        .withColumn("words", F.round("target").cast("long"))
        .withColumn("rest", F.when(F.col("source_size") > 0, F.expr("words % source_size")).otherwise(0))
        .withColumn("n_slots", F.when(F.col("source_size") > 0, F.expr(
            f"(words div source_size) * n_blocks + CASE WHEN rest = 0 THEN 0 ELSE {_block_of('(rest - 1)')} + 1 END")).otherwise(0)))
    n_rows = sizes.agg(F.sum("n")).first()[0] or 0
    spread = _offsets(base, n_rows)
    mine = blocks.select(F.col("source").alias("_s"), "source_size", "target", "n_blocks", "words")
    rows = spread.join(mine, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    parts = (rows.where("size > 0")
             .withColumn("block", F.explode(F.expr(f"sequence({_block_of('start')}, {_block_of('(start + size - 1)')})")))
             .select("id", "k1", "k2", "source", "start", "size", "block",
                     F.expr(f"greatest(start, {_block_start('block')})").alias("low"),
                     F.expr(f"least(start + size, {_block_start('(block + 1)')})").alias("high")))
    slots = (_schedule(blocks, spark)
             .join(blocks.select(F.col("source").alias("_s"), "source_size", "n_blocks", "words"),
                   F.col("source").eqNullSafe(F.col("_s")))
             .select("slot", F.col("source").alias("_s"), F.expr("rank div n_blocks").alias("pass"),
                     F.expr("rank % n_blocks").alias("_b"),
                     F.expr("words - (rank div n_blocks) * source_size").alias("stop")))
    pieces = (parts.join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
              .withColumn("high", F.least("high", "stop")).where("high > low")
              .select("slot", "pass", "id", "k1", "k2", "source", "start", "size",
                      (F.col("low") - F.col("start")).alias("first"), (F.col("high") - F.col("start")).alias("last")))
    return rows.drop("n_blocks", "words"), pieces


def mix_report(docs: DataFrame, id_col: str = "doc_id", **named) -> DataFrame:
    """One row per document: id, size, source_size, target, ``taken``, the words of it in
    the mix with repeats, and ``first_slot``, the slot of the schedule that first takes
    some of them (null if none does)."""
    rows, pieces = plan_mix(docs, id_col, **named)
    keys, none = ["id", "k1", "k2", "start"], F.lit(None).cast("long")
    given = rows.where("size > 0").select(*keys, "size", "source_size", "target", F.lit(0).cast("long").alias("taken"),
                                          none.alias("slot"))
    got = pieces.select(*keys, none.alias("size"), none.alias("source_size"),
                        F.lit(None).cast("double").alias("target"), (F.col("last") - F.col("first")).alias("taken"), "slot")
    summed = given.unionByName(got).groupBy(*keys).agg(
        F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"),
        F.sum("taken").alias("taken"), F.min("slot").alias("first_slot"))
    empty = rows.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"),
                                          none.alias("first_slot"))
    return (summed.select("id", "size", "source_size", "target", "taken", "first_slot").unionByName(empty)
            .withColumnRenamed("id", id_col))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    length_col: str | None = "n_chars", **named) -> DataFrame:
    """The mix itself, with the input's columns: a document once for each pass that
    takes words of it.  One that a pass takes whole keeps its text; one that the end
    of the target cuts has its taken words joined by one space.  ``length_col``, if
    the table has it, is set to the characters of the new text.  Documents without
    words are not in the mix.

    The rows come in the order of the schedule: tasks hold ranges of slots, and rows are
    sorted within a task by the first slot that takes them.  So every stretch of what is
    written, not just the whole, has the sources near their shares."""
    _, pieces = plan_mix(docs, id_col, text_col, source_col, **named)
    taken = (pieces.groupBy("k1", "k2", "start", "pass")
             .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("size").alias("size"),
                  F.min("slot").alias("slot"))
             # rows with the same id, text and source differ in their start alone
             .withColumn("nth", F.dense_rank().over(Window.partitionBy("k1", "k2").orderBy("start"))))
    rows = (docs.select(F.struct(*docs.columns).alias("row"),
                        *_keys(F.col(id_col), F.col(text_col), F.col(source_col)))
            .withColumn("mth", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0)))))
    cut = F.array_join(F.slice(words(F.col(f"row.{text_col}")), F.col("first").cast("int") + 1,
                               (F.col("last") - F.col("first")).cast("int")), " ")
    text = F.when(F.col("last") - F.col("first") == F.col("size"), F.col(f"row.{text_col}")).otherwise(cut)
    # numbers are compared as a difference so that they are no join key
    mixed = rows.join(taken, ["k1", "k2"]).where("mth - nth = 0").select("row", text.alias("text"), "slot")
    mixed = mixed.repartitionByRange("slot").sortWithinPartitions("slot")
    new = {text_col: F.col("text")}
    if length_col in docs.columns:
        new[length_col] = F.length("text").cast(docs.schema[length_col].dataType)
    return mixed.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
