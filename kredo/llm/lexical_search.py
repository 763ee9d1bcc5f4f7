"""Ranked lexical search over bit-sliced Bloom signatures."""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from kredo.llm.bloom import filter_of, maybe_in
from kredo.llm.substring_dedup import _mixed
from kredo.llm.terms import Terms, hash_of, slices, terms
from kredo.llm.text import row_keys, whole
from kredo.session import checkpoint_dir, ship_package

ENTRY_BITS = 12          # signature bits for each entry of the fullest document of a block
PROBES = 5               # slices an entry sets
BLOCK_DOCS = 1024        # documents of a block
BLOCK_ENTRIES = 1 << 20  # or fewer, if they hold so many entries
DICTIONARY = 1 << 22     # distinct terms that a task counts before it hands them on
BATCH_TERMS = 4096       # distinct terms of the items that are searched at once

# A document has an entry for each term and each of these counts that the term reaches
# in it, so that the signature bounds not just presence but frequency.
LEVELS = np.unique(np.concatenate([np.arange(1, 5), [3 << i for i in range(1, 28)], [4 << i for i in range(1, 28)]])).astype(np.int64)

INDEX = [StructField("keys", BinaryType()), StructField("lengths", BinaryType()), StructField("width", LongType()),
         StructField("slices", BinaryType()), StructField("n_docs", LongType()), StructField("n_terms", LongType()),
         StructField("hashes", BinaryType()), StructField("counts", BinaryType())]


def _entries(hashes: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    salt = (np.atleast_1d(level).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return _mixed(hashes ^ salt, 0xA0761D6478BD642F)


def _probes(entries: np.ndarray, width: int) -> list[np.ndarray]:
    """The slices, below ``width``, of each entry."""
    low, high, full = entries & np.uint64(0xFFFFFFFF), entries >> np.uint64(32) | np.uint64(1), np.uint64(0xFFFFFFFF)
    return [((((low + np.uint64(i) * high) & full) * np.uint64(width)) >> np.uint64(32)).astype(np.int64) for i in range(PROBES)]


# --- the index -------------------------------------------------------------------


class _Band:
    """Documents with about equally many entries, until they fill a block."""

    def __init__(self):
        self.ids, self.keys, self.lengths, self.entries, self.n = [], [], [], [], 0

    def add(self, ids, keys, lengths, entries, counts):
        self.ids.append(ids)
        self.keys.append(keys)
        self.lengths.append(lengths)
        self.entries.append((entries, counts))
        self.n += len(lengths)

    def block(self):
        entries = np.concatenate([e for e, _ in self.entries])
        counts = np.concatenate([c for _, c in self.entries])
        width = -(-ENTRY_BITS * int(counts.max()) // 8) * 8
        bits = np.zeros((width, self.n), bool)
        row = np.repeat(np.arange(self.n), counts)
        for probe in _probes(entries, width):
            bits[probe, row] = True
        keys = np.concatenate(self.keys)
        lengths = np.concatenate(self.lengths)
        return (pa.concat_arrays(self.ids), keys.tobytes(), lengths.tobytes(), width,
                np.packbits(bits, axis=1).tobytes(), self.n, int(lengths.sum()))


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the index of all documents as Parquet and return it.

    Rows of two kinds.  A block holds up to ``BLOCK_DOCS`` documents of one task with
    about equally many entries (``ids``, ``keys``, ``lengths`` in terms) and their
    signatures by bit: slice i is the bitmap of the documents that have bit i set.  A
    dictionary row holds 64-bit hashes of a task's distinct terms and in how many of
    its documents each occurs.  Nothing is shuffled.  Documents without terms, null
    texts among them, are in no block."""
    base = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    base = base.select("id", *row_keys(F.col("id"), F.col("text")), "text")
    schema = StructType([StructField("ids", ArrayType(base.schema["id"].dataType)), *INDEX])

    def row(kind, values, id_type):
        ids = pa.array([values[0]], pa.list_(id_type)) if kind == "terms" else pa.ListArray.from_arrays(
            pa.array([0, len(values[0])], pa.int32()), values[0])
        types = [pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([ids, *[pa.array([v], t) for v, t in zip(values[1:], types)]], names=schema.names)

    def dictionary(hashes, counts, id_type):
        return row("terms", [None, None, None, None, None, 0, 0, hashes.view(np.int64).tobytes(), counts.tobytes()], id_type)

    def build(found):
        bands: dict[int, _Band] = {}
        known, counted, id_type = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
        for batch in found:
            id_type = batch.column(0).type
            keys = np.stack([np.asarray(batch.column(i)) for i in (1, 2)], axis=1)
            for low, high, part in slices(batch):
                if not len(part.start):
                    continue
                doc, h, tf = _counted(part)
                # the dictionary
                merged, n = np.unique(h, return_counts=True)
                known, place = np.unique(np.concatenate([known, merged]), return_inverse=True)
                counted = np.bincount(place, np.concatenate([counted, n])).astype(np.int64)
                if len(known) > DICTIONARY:
                    yield dictionary(known, counted, id_type)
                    known, counted = known[:0], counted[:0]
                # the entries, by document
                levels = np.searchsorted(LEVELS, tf, "right")
                entries = _entries(np.repeat(h, levels), np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels))
                of_doc = np.bincount(doc, levels, part.n_docs).astype(np.int64)
                ends = np.cumsum(of_doc)
                lengths = np.diff(part.first)
                band_of = np.ceil(np.log2(np.maximum(of_doc, 1)) * 2).astype(np.int64)
                for band in np.unique(band_of[of_doc > 0]).tolist():
                    rows = np.flatnonzero((band_of == band) & (of_doc > 0))
                    limit = max(1, min(BLOCK_DOCS, BLOCK_ENTRIES // int(2 ** (band / 2) + 1)))
                    while len(rows):
                        kept = bands.setdefault(band, _Band())
                        now, rows = rows[:limit - kept.n], rows[limit - kept.n:]
                        taken = np.concatenate([np.arange(ends[d] - of_doc[d], ends[d]) for d in now])
                        kept.add(batch.column(0).take(pa.array(low + now)), keys[low + now], lengths[now].astype(np.int64),
                                 entries[taken], of_doc[now])
                        if kept.n >= limit:
                            yield row("block", [*bands.pop(band).block(), None, None], id_type)
        for band in bands.values():
            yield row("block", [*band.block(), None, None], id_type)
        if len(known):
            yield dictionary(known, counted, id_type)

    base.mapInArrow(build, schema).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _counted(part: Terms):
    """Distinct terms of each document, by document: documents, hashes, counts."""
    h = part.hashes()
    order = np.lexsort((h, part.doc))
    doc, h = part.doc[order], h[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]
    begin = np.flatnonzero(new)
    return doc[begin], h[begin], np.diff(np.append(begin, len(h)))


# --- the queries -----------------------------------------------------------------


class Query:
    """Some items: per item the places of its terms in ``hashes`` (sorted) and each
    one's weight times its repeats."""

    def __init__(self, hashes, items):
        self.hashes, self.items = hashes, items


def _batches(items: DataFrame, limit: int) -> DataFrame:
    """Items (number, words, part) in parts of at most ``limit`` words (or one item)."""
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-int(total) // limit) or 1
    while True:
        parts = items.withColumn("part", F.pmod(F.xxhash64("k1", "k2"), F.lit(n)).cast("int"))
        sizes = parts.groupBy("part").agg(F.sum(F.size("words")).alias("n"), F.count(F.lit(1)).alias("items"))
        if n == 1 or not sizes.where((F.col("n") > limit) & (F.col("items") > 1)).take(1):
            return parts
        n *= 2


def _document_counts(index: DataFrame, hashes: np.ndarray) -> dict[int, int]:
    """In how many documents each hash occurs."""
    given = index.sparkSession.sparkContext.broadcast(hashes)

    def look(found):
        asked = given.value
        total = np.zeros(len(asked), np.int64)
        for batch in found:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = np.frombuffer(a, np.int64).view(np.uint64), np.frombuffer(b, np.int64)
                at = np.minimum(np.searchsorted(a, asked), len(a) - 1)
                total += np.where(a[at] == asked, b[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["place", "n"])

    rows = index.where("hashes IS NOT NULL").select("hashes", "counts").mapInArrow(look, "place long, n long")
    return {r["place"]: r["n"] for r in rows.groupBy("place").agg(F.sum("n").alias("n")).collect()}


def _saturation(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return np.array([25 + (75 * int(x) * n_docs) // n_terms for x in n], np.int64)


def _upper(block, query: Query, n_docs: int, n_terms: int) -> np.ndarray:
    """Upper bounds of the scores, items by documents, of one block."""
    lengths = np.frombuffer(block["lengths"], np.int64)
    d, width = len(lengths), block["width"]
    bits = np.frombuffer(block["slices"], np.uint8).reshape(width, -1)
    m = _lengths(lengths, n_docs, n_terms)
    bound = np.zeros((len(query.hashes), d), np.int64)
    rows, present, before = np.arange(len(query.hashes)), None, np.zeros(d, np.int64)
    for level in range(len(LEVELS)):
        now = None
        for probe in _probes(_entries(query.hashes[rows], level), width):
            now = bits[probe] if now is None else now & bits[probe]
        present = now if present is None else now & present
        some = present.any(axis=1)
        rows, present = rows[some], present[some]
        if not len(rows):
            break
        most = LEVELS[level + 1] - 1 if level + 1 < len(LEVELS) else lengths
        share = _saturation(np.minimum(most, lengths), m)
        bound[rows] += np.unpackbits(present, axis=1, count=d) * (share - before)
        before = share
    return np.stack([weights @ bound[places] for places, weights in query.items]) if query.items else np.zeros((0, d), np.int64)


def _blocks(found, names):
    for batch in found:
        for i in range(len(batch)):
            yield {n: batch.column(c)[i].values if n == "ids" else batch.column(c)[i].as_py() for c, n in enumerate(names)}


def _order_key(value):
    return (value is None, value)


BLOCK = ["ids", "keys", "lengths", "width", "slices"]


def _seeds(blocks: DataFrame, query, n_docs: int, n_terms: int, k: int, id_type) -> DataFrame:
    """(item, id, k1, k2, bound): of each task the ``k`` documents of each item with the
    highest bounds, of equal ones those with the smallest ids."""

    def best(found):
        asked = query.value
        kept: list[list] = [[] for _ in asked.items]
        for block in _blocks(found, BLOCK):
            upper = _upper(block, asked, n_docs, n_terms)
            ids = block["ids"].to_pylist()
            keys = np.frombuffer(block["keys"], np.int64).reshape(-1, 2)
            place = np.argsort(pc.sort_indices(block["ids"], null_placement="at_end").to_numpy(), kind="stable")
            for item, bounds in enumerate(upper):
                worst = -kept[item][-1][0] if len(kept[item]) == k else 1
                some = np.flatnonzero(bounds >= worst)
                some = some[np.lexsort((place[some], -bounds[some]))[:k]]
                if len(some):
                    more = [(-int(bounds[i]), _order_key(ids[i]), int(keys[i, 0]), int(keys[i, 1])) for i in some]
                    kept[item] = sorted(kept[item] + more)[:k]
        flat = [(item, key[1], k1, k2, -b) for item, rows in enumerate(kept) for b, key, k1, k2 in rows]
        if flat:
            columns = list(zip(*flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa_type), *[pa.array(c, pa.int64()) for c in columns[2:]]],
                names=["item", "id", "k1", "k2", "bound"])

    from pyspark.sql.pandas.types import to_arrow_type

    pa_type = to_arrow_type(id_type)
    rows = blocks.mapInArrow(best, StructType([StructField("item", IntegerType()), StructField("id", id_type),
                                               *[StructField(c, LongType()) for c in ("k1", "k2", "bound")]]))
    return _first(rows, "bound", k)


def _first(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` rows of each item that are highest by a column, ties by id, ranked."""
    order = Window.partitionBy("item").orderBy(F.col(by).desc(), F.col("id").asc_nulls_last(), "k1", "k2")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _candidates(blocks: DataFrame, query, least: dict, n_docs: int, n_terms: int, id_type) -> DataFrame:
    """(id, k1, k2, items): documents with the items for which they are not excluded.
    A document is excluded if its bound is below the lowest of the best known scores,
    or equal to it with a larger id; ``least`` has that score and id by item."""
    given = blocks.sparkSession.sparkContext.broadcast(least)

    def open_(found):
        asked, limits = query.value, given.value
        score = np.array([limits[i][0] if i in limits else 1 for i in range(len(asked.items))], np.int64)
        for block in _blocks(found, BLOCK):
            upper = _upper(block, asked, n_docs, n_terms)
            may = upper > score[:, None]
            equal = (upper == score[:, None]) & (upper > 0)
            if equal.any():
                order = pc.sort_indices(block["ids"], null_placement="at_end").to_numpy()
                ranked = [_order_key(x) for x in block["ids"].take(pa.array(order)).to_pylist()]
                place = np.argsort(order, kind="stable")
                for item in np.flatnonzero(equal.any(axis=1)).tolist():
                    limit = bisect_right(ranked, _order_key(limits[item][1])) if item in limits else len(ranked)
                    may[item] |= equal[item] & (place < limit)
            docs = np.flatnonzero(may.any(axis=0))
            if len(docs):
                which, item = np.nonzero(may[:, docs].T)
                offsets = np.searchsorted(which, np.arange(len(docs) + 1)).astype(np.int32)
                keys = np.frombuffer(block["keys"], np.int64).reshape(-1, 2)[docs]
                yield pa.RecordBatch.from_arrays(
                    [block["ids"].take(pa.array(docs)), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(item, pa.int32()))], names=["id", "k1", "k2", "items"])

    return blocks.mapInArrow(open_, StructType([StructField("id", id_type), StructField("k1", LongType()), StructField("k2", LongType()),
                                                StructField("items", ArrayType(IntegerType()))]))


def _rescored(docs: DataFrame, wanted: DataFrame, query, n_docs: int, n_terms: int) -> DataFrame:
    """(item, id, k1, k2, score): exact scores of the documents that ``wanted`` (id, k1,
    k2, items) names.  Texts are read again where a Bloom filter of their keys says
    so; only counts of the items' terms are shuffled."""

    def count(found):
        asked = query.value.hashes
        for batch in found:
            keys = [np.asarray(batch.column(i)) for i in range(2)]
            for low, high, part in slices(batch):
                h = part.hashes()
                at = np.minimum(np.searchsorted(asked, h), len(asked) - 1)
                known = asked[at] == h
                pair, tf = np.unique(part.doc[known] * len(asked) + at[known], return_counts=True)
                ends = np.searchsorted(pair, np.arange(part.n_docs + 1) * len(asked)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[0][low:high]), pa.array(keys[1][low:high]), pa.array(np.diff(part.first), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(pair % len(asked), pa.int32())),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(tf, pa.int64()))],
                    names=["k1", "k2", "n", "places", "tfs"])

    def score(found):
        asked = query.value
        for batch in found:
            columns = [batch.column(i) for i in range(7)]
            m = _lengths(columns[4].to_numpy(), n_docs, n_terms)
            row, item_of, scores = [], [], []
            for i in range(len(batch)):
                tf = np.zeros(len(asked.hashes), np.int64)
                tf[columns[5][i].values.to_numpy()] = columns[6][i].values.to_numpy()
                for item in columns[3][i].as_py():
                    places, weights = asked.items[item]
                    row.append(i)
                    item_of.append(item)
                    scores.append(int((weights * _saturation(tf[places], int(m[i]))).sum()))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(item_of, pa.int32()), *[columns[c].take(at) for c in range(3)], pa.array(scores, pa.int64())],
                names=["item", "id", "k1", "k2", "score"])

    filter_words = filter_of(wanted.select("k1"), "k1")
    read = maybe_in(docs, "k1", filter_words).where("_maybe").select("k1", "k2", "text")
    counts = (read.mapInArrow(count, "k1 long, k2 long, n long, places array<int>, tfs array<bigint>")
              .dropDuplicates(["k1", "k2"]))
    both = wanted.join(counts, ["k1", "k2"]).select("id", "k1", "k2", "items", "n", "places", "tfs")
    schema = StructType([StructField("item", IntegerType()), wanted.schema["id"], StructField("k1", LongType()),
                         StructField("k2", LongType()), StructField("score", LongType())])
    return both.mapInArrow(score, schema).where("score > 0")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", k: int = 10, index: DataFrame | None = None, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """The ``k`` best documents of each item: item id, ``rank`` (from 1), document id,
    ``score`` (above 0; equal scores by ascending id, a null id last).

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z
    lower-cased; a term's weight w is floor(1000 * ln((2N + 2) / (2 df + 1))), and a
    document scores, for each term of the item, w * ((10**9 tf) div (1000 tf + 8 m))
    with m = 25 + (75 n N) div L, in whole numbers (N documents with terms, L terms in
    all, n terms of the document).

    Two passes over the index (``build_index``; built if none is given).  The slices
    of a term's bits, taken together, give every document that may hold it and how
    often at most; weighted sums of them bound all scores of a block from above.  Pass
    one takes the ``k`` documents of each item with the highest bounds and scores them
    exactly; the lowest of their scores is a floor under the result.  Pass two scores
    every document exactly whose bound reaches the floor.  The rest can't be among the
    first ``k``.  Items are searched in batches of at most ``batch_terms`` terms (or
    one item), each against all rows.

    Terms are told apart by 64-bit hashes, compared with a batch's terms only: with
    10**10 different terms a false match has odds of some 2 in a million.

    Null and empty texts match nothing; items with the same id and text count once;
    equal rows of documents are ranked each; very long texts are read whole, in memory
    some twenty times their size; an empty table gives no rows; other columns are not
    read."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = checkpoint_dir(spark).rstrip("/")
    if index is None:
        index = build_index(docs, f"{folder}/search-index-{uuid.uuid4().hex}", id_col, text_col)
    base = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    base = base.select("id", *row_keys(F.col("id"), F.col("text")), "text")
    id_type = base.schema["id"].dataType
    blocks = index.where("slices IS NOT NULL").select(*BLOCK)
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()

    asked = items.select(F.col(item_col).alias("item_id"), *row_keys(F.col(item_col), F.col(item_text_col)),
                         terms(F.col(item_text_col)).alias("words")).where(F.size("words") > 0).dropDuplicates(["k1", "k2"])
    asked = _batches(asked, batch_terms).checkpoint(eager=True)
    parts = sorted(r["part"] for r in asked.select("part").distinct().collect()) if n_docs else []
    out = None
    for part in parts:
        names, query = _query(asked.where(F.col("part") == part), index, n_docs)
        query = spark.sparkContext.broadcast(query)
        seeds = _seeds(blocks, query, n_docs, n_terms, k, id_type).groupBy("id", "k1", "k2", "rank").agg(
            F.collect_set("item").alias("items")).select("id", "k1", "k2", "items").checkpoint(eager=True)
        known = _first(_rescored(base, seeds, query, n_docs, n_terms), "score", k).where(F.col("rank") == k)
        least = {r["item"]: (r["score"], r["id"]) for r in known.collect()}
        wanted = _candidates(blocks, query, least, n_docs, n_terms, id_type).checkpoint(eager=True)
        done = _first(_rescored(base, wanted, query, n_docs, n_terms), "score", k)
        done = done.join(F.broadcast(names), "item").select(
            F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
        if len(parts) > 1:
            done = done.checkpoint(eager=True)
        out = done if out is None else out.unionByName(done)
    if out is None:
        out = spark.createDataFrame([], StructType([
            StructField(item_col, items.schema[item_col].dataType), StructField("rank", IntegerType()),
            StructField(id_col, id_type), StructField("score", LongType())]))
    return out


def _query(asked: DataFrame, index: DataFrame, n_docs: int):
    """One batch of items: a table of their numbers and ids, and a ``Query``."""
    spark = asked.sparkSession
    rows = asked.select("item_id", "words").collect()
    vocabulary = sorted({w for r in rows for w in r["words"]})
    hashes = np.array([hash_of(w.encode()) for w in vocabulary], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    place = {vocabulary[i]: p for p, i in enumerate(order.tolist())}
    hashes = hashes[order]
    counts = _document_counts(index, hashes)
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(p, 0) + 1))) for p in range(len(hashes))]
    made = []
    for r in rows:
        places, repeats = np.unique([place[w] for w in r["words"]], return_counts=True)
        made.append((places, repeats.astype(np.int64) * np.array([weight[p] for p in places], np.int64)))
    schema = StructType([StructField("item", IntegerType()), asked.schema["item_id"]])
    return spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], schema), Query(hashes, made)
