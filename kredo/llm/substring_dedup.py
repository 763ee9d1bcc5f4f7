"""Repeated passages, found by word windows behind a count-min sketch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from kredo.llm import batches
from kredo.llm.text import row_keys, whole
from kredo.session import ship_package

WINDOW = 35
# The sketch: ROWS rows of 2**CELL_BITS counters that stop at 2.  A task's own copy
# takes 128 MB; merged, one bit a counter, it takes 16 MB whatever the corpus.
ROWS = 2
CELL_BITS = 26
BLOCK_BITS = 18          # counters of a block that is merged as one
GRAMS = 20               # word grams of a window of which the smallest stands for it

# Odd constants and a base for the polynomial of each of the two hashes.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BASE = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _mixed(h: np.ndarray, c: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(c)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _word_hashes(texts: batches.Texts, which: int) -> np.ndarray:
    """64-bit hash of each word's bytes: 8-byte lanes mixed in turn; words of over 32
    bytes by XXH64."""
    import xxhash

    lanes = np.ndarray(len(texts.data) - 7, "<u8", texts.data, strides=(1,))
    start, left = texts.start, texts.length.copy()
    h = _mixed(texts.length.astype(np.uint64) + np.uint64(MIX[1 - which]), MIX[which])
    at, go = start, np.arange(len(start))
    for lane in range(4):
        size = np.minimum(left, 8)
        shift = (8 * (8 - size)).astype(np.uint64)
        h[go] = _mixed(h[go] ^ ((lanes[at] << shift) >> shift), MIX[which])
        more = left > 8
        if not more.any():
            break
        go, at, left = go[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(texts.length > 32):
        a = int(start[i])
        h[i] = xxhash.xxh64_intdigest(texts.data[a:a + int(texts.length[i])].tobytes(), MIX[which])
    return h


class _Windows:
    """Rolling hashes of word windows: the sum of word hash times base to the word's
    place, less what comes before, over the base to the first place."""

    def __init__(self, hashes: np.ndarray, which: int):
        n = len(hashes)
        self.inverse = np.full(n, pow(BASE[which], -1, 1 << 64), np.uint64)
        power = np.full(n, BASE[which], np.uint64)
        if n:
            power[0] = self.inverse[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power, dtype=np.uint64)])
        self.which = which

    def at(self, places: np.ndarray | slice, width: int) -> np.ndarray:
        if isinstance(places, slice):
            n = max(len(self.sums) - width, 0)
            return _mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n], MIX[self.which])
        return _mixed((self.sums[places + width] - self.sums[places]) * self.inverse[places], MIX[self.which])


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` neighbours."""
    done, out = 1, values
    while done * 2 <= width:
        out = pick(out[:-done], out[done:]) if len(out) > done else out[:0]
        done *= 2
    rest = width - done
    return (pick(out[:-rest], out[rest:]) if len(out) > rest else out[:0]) if rest else out


def _standing(texts: batches.Texts, window: int):
    """The window starts, the gram hash that stands for each, and the hashes of all
    gram places that stand for some window.

    Equal windows have equal grams and so the same smallest one, at the same place
    within: counted by place, it occurs at least as often as the window starts."""
    span = min(GRAMS, window)
    first = _word_hashes(texts, 0)
    rolling = _Windows(first, 0)
    grams = rolling.at(slice(None), window - span + 1)
    starts = np.flatnonzero(np.arange(len(first)) + window <= texts.first[1:][texts.doc]) if len(first) else np.zeros(0, np.int64)
    least = _slide(grams, span, np.minimum)
    valid = np.zeros(len(least), bool)
    valid[starts] = True
    covering = np.concatenate([np.zeros(span - 1, np.uint64), np.where(valid, least, 0), np.zeros(span - 1, np.uint64)])
    stands = _slide(covering, span, np.maximum)[:len(grams)]
    chosen = grams[:len(stands)][(stands == grams[:len(stands)]) & (stands > 0)]
    return starts, least[starts], chosen, rolling


def _cells(hashes: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - CELL_BITS)
    return [(_mixed(hashes, MIX[r % 2] + 2 * r) >> shift).astype(np.int64) for r in range(ROWS)]


def sketch(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Merged count-min sketch of the windows of column ``text``: rows (row, block,
    bits), a bit set where two or more windows' standing grams fall on a counter.

    Each task counts its own partition and hands on the counters that are not 0;
    blocks are merged one by one as they arrive, in arrays of fixed size."""

    def count(found):
        table = np.zeros((ROWS, 1 << CELL_BITS), np.uint8)
        for batch in found:
            for _, _, part in batches.slices(batch):
                for row, cells in enumerate(_cells(_standing(part, window)[2])):
                    cell, n = np.unique(cells, return_counts=True)
                    table[row, cell] = np.minimum(table[row, cell] + np.minimum(n, 2), 2)
        for row in range(ROWS):
            places = np.flatnonzero(table[row])
            blocks, begin = np.unique(places >> BLOCK_BITS, return_index=True)
            for block, part in zip(blocks.tolist(), np.split(places, begin[1:])):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row], pa.int32()), pa.array([block], pa.int32()),
                     pa.array([(part & ((1 << BLOCK_BITS) - 1)).astype(np.uint32).tobytes()], pa.binary()),
                     pa.array([table[row, part].tobytes()], pa.binary())], names=["row", "block", "places", "counts"])

    def merge(found):
        tables: dict = {}
        for batch in found:
            for row, block, places, counts in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                table = tables.setdefault((row, block), np.zeros(1 << BLOCK_BITS, np.uint8))
                at = np.frombuffer(places, np.uint32)
                table[at] = np.minimum(table[at] + np.frombuffer(counts, np.uint8), 2)
        for (row, block), table in tables.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([row], pa.int32()), pa.array([block], pa.int32()),
                 pa.array([np.packbits(table >= 2).tobytes()], pa.binary())], names=["row", "block", "bits"])

    partial = texts.mapInArrow(count, "row int, block int, places binary, counts binary")
    return partial.repartition("row", "block").mapInArrow(merge, "row int, block int, bits binary")


def _sent(docs: DataFrame, seen, window: int) -> DataFrame:
    """What pass two sends, from documents (k1, k2, text): a row for each distinct
    window of a slice (h1, h2, whether it was found many times there, and the place
    of one), and a row for each document with the places that are settled (32-bit
    integers), whose h1 and h2 are its keys."""

    def probe(found):
        bits = seen.value
        for batch in found:
            keys = [np.asarray(batch.column(i)) for i in range(2)]
            for low, _, texts in batches.slices(batch):
                starts, standing, _, rolling = _standing(texts, window)
                may = np.ones(len(starts), bool)
                for row, cells in enumerate(_cells(standing)):
                    may &= (bits[row, cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
                starts = starts[may]
                if not len(starts):
                    continue
                h1, h2 = rolling.at(starts, window), _Windows(_word_hashes(texts, 1), 1).at(starts, window)
                order = np.lexsort((h2, h1))
                h1, h2, starts = h1[order], h2[order], starts[order]
                new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
                group = np.cumsum(new) - 1
                many = np.bincount(group)[group] > 1
                doc = texts.doc[starts]
                place = (starts - texts.first[doc]).astype(np.int32)
                # one row for each distinct window; windows found twice here are settled
                sent = np.flatnonzero(new)
                sent = sent[np.argsort(starts[sent])]    # by document: keys in a row compress well
                yield _rows(h1[sent], h2[sent], many[sent], keys[0][low + doc[sent]], keys[1][low + doc[sent]], place[sent])
                settled = np.flatnonzero(many)
                settled = settled[np.argsort(doc[settled], kind="stable")]
                owner, begin = np.unique(doc[settled], return_index=True)
                lists = [x.tobytes() for x in np.split(place[settled], begin[1:])] if len(owner) else []
                if lists:
                    yield _settled(keys[0][low + owner], keys[1][low + owner], lists)

    schema = StructType([StructField("h1", LongType()), StructField("h2", LongType()), StructField("many", IntegerType()),
                         StructField("k1", LongType()), StructField("k2", LongType()), StructField("place", IntegerType()),
                         StructField("settled", BinaryType())])
    names = schema.names

    def _rows(h1, h2, many, k1, k2, place):
        none = pa.nulls(len(h1), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(many.astype(np.int32)),
             pa.array(k1), pa.array(k2), pa.array(place), none], names=names)

    def _settled(k1, k2, lists):
        n = len(lists)
        return pa.RecordBatch.from_arrays(
            [pa.array(k1), pa.array(k2), pa.array(np.ones(n, np.int32)), pa.array(k1), pa.array(k2),
             pa.nulls(n, pa.int32()), pa.array(lists, pa.binary())], names=names)

    return docs.mapInArrow(probe, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_removed``, ``kept_text``.

    Words are runs of other characters than the six ASCII spaces, compared as they
    are.  Each word covered by a window of ``window`` consecutive words whose word
    sequence also starts anywhere else, in the same document too, is removed;
    windows are judged on the input.  What is left is joined by one space.

    Pass one sketches all windows; a task holds at most its own counters, and the
    merged sketch has a fixed size and is broadcast.  The sketch counts, instead of
    each window, the smallest of its word grams by place, which is never fewer than
    the window itself, so no repeated window is passed over.  Pass two sends the
    windows that the sketch takes for repeated, one row for each distinct window of
    a slice, and groups them exactly by 128-bit hashes; windows that repeat within a
    slice are settled there, so that a frequent one is sent once by each.  If a
    corpus fills the sketch, more windows are sent and the result is the same.

    Null texts have no words.  Rows with the same id and text are occurrences like
    others.  An empty table gives an empty one; other columns are not read."""
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    keyed = base.select("id", *row_keys(F.col("id"), F.col("text")), "text")
    table = np.zeros((ROWS, 1 << (CELL_BITS - 3)), np.uint8)
    size = 1 << (BLOCK_BITS - 3)
    for row in sketch(base.select("text"), window).toLocalIterator():
        table[row["row"], row["block"] * size:(row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    found = _sent(keyed.select("k1", "k2", "text"), spark.sparkContext.broadcast(table), window)

    # a window sent by m slices has at most m rows here; settled places pass by
    known = (found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h1", "h2")))
             .where("settled IS NOT NULL OR (many = 0 AND n > 1)")
             .groupBy("k1", "k2").agg(F.collect_list("place").alias("places"), F.collect_list("settled").alias("lists")))
    rows = keyed.join(known, ["k1", "k2"], "left")

    def rebuild(batch_iter):
        for batch in batch_iter:
            ids, texts, places, lists = (batch.column(i) for i in range(4))
            for low in range(0, len(ids), 512):
                out = [_rebuilt(*x, window) for x in zip(
                    *[c.slice(low, 512).to_pylist() for c in (texts, places, lists)])]
                n, removed, kept = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, 512), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    schema = StructType([base.schema["id"], StructField("n_words", LongType()), StructField("n_removed", LongType()),
                         StructField("kept_text", StringType())])
    return (rows.select("id", "text", "places", "lists").mapInArrow(rebuild, schema)
            .withColumnRenamed("id", id_col))


def _rebuilt(text: str, places, lists, window: int) -> tuple[int, int, str]:
    words = text.encode().split()
    if not places and not lists:
        return len(words), 0, b" ".join(words).decode()
    starts = np.concatenate([np.asarray(places or [], np.int64),
                             *[np.frombuffer(x, np.int32).astype(np.int64) for x in lists or []]])
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    gone = np.cumsum(steps[:-1]) > 0
    kept = [w for w, drop in zip(words, gone.tolist()) if not drop]
    return len(words), int(gone.sum()), b" ".join(kept).decode()
