"""SimHash near-duplicates by a binary trie self-join of the fingerprints."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kredo.llm import batches
from kredo.llm.components import components
from kredo.llm.text import row_keys, whole
from kredo.session import cut_lineage, ship_package

SHINGLE = 4
MAX_BITS = 4
PER_KEY = 8             # fingerprints of a key at which more blocks are taken, if three do
CHUNK = 1024            # fingerprints of one side of a trie pair, about
LEAF = 16               # fingerprints of a trie node that is not split further
PAIRS_AT_ONCE = 1 << 18 # node pairs that are walked at once
LINKS_AT_ONCE = 1 << 22


def _fingerprints(texts: batches.Texts, shingle: int) -> np.ndarray:
    """One 64-bit fingerprint per document, as int64."""
    import xxhash

    data = texts.data
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data)
    # each word followed by one space, so that shingles are slices
    width = texts.length + 1
    at = np.concatenate([[0], np.cumsum(width)])
    joined = np.full(at[-1], 32, np.uint8)
    from_, to = np.repeat(texts.start, texts.length), np.repeat(at[:-1], texts.length)
    within = np.arange(len(from_)) - np.repeat(np.cumsum(texts.length) - texts.length, texts.length)
    joined[to + within] = data[from_ + within]
    joined = joined.tobytes()
    n_words = np.diff(texts.first)
    n_grams = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    out = np.zeros(texts.n_docs, np.int64)
    digest = xxhash.xxh64_intdigest
    for doc in np.flatnonzero(n_grams):
        first, n = int(texts.first[doc]), int(n_grams[doc])
        starts = at[first:first + n].tolist()
        last = first + min(shingle, int(n_words[doc]))
        ends = (at[last:last + n] - 1).tolist()
        ones = np.zeros(64, np.int64)
        for part in range(0, n, 100_000):
            hashes = np.fromiter((digest(joined[a:b], 42) for a, b in
                                  zip(starts[part:part + 100_000], ends[part:part + 100_000])), np.uint64)
            ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[doc] = np.packbits(2 * ones > n).view(">u8").astype(np.uint64).view(np.int64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the 64-bit SimHash over the document's lower-cased shingles of
    ``shingle`` words, repeats included, each hashed with XXH64 (seed 42).  A bit is
    set if more than half the hashes have it.  A shorter document is one shingle; one
    without words, a null text too, has fingerprint zero."""
    ship_package(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))

    def run(found):
        for batch in found:
            ids = batch.column(0)
            for low, high, texts in batches.slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), pa.array(_fingerprints(texts, shingle))], names=["id", "fp"])

    return base.mapInArrow(run, StructType([base.schema["id"], StructField("fp", LongType())]))


def trie_pairs(bits: np.ndarray, roots: np.ndarray, max_bits: int, emit) -> None:
    """Walk pairs of trie nodes together from the ``roots`` and call ``emit(i, j)``
    with the places of leaf pairs that differ in at most ``max_bits`` bits.

    ``bits`` are fingerprints (uint64), sorted within each root node.  A node is a
    range of places that share their leading bits; a root is (low, high) of one node
    and of the other, equal if a node is paired with itself.  Below each pair, four
    pairs of children (three for a node with itself) go on, those with unlike bits
    with one more difference, unless that exceeds the budget."""
    work = [(63, np.hstack([roots, np.zeros((len(roots), 1), roots.dtype)]).astype(np.int32))]
    ones: dict[int, np.ndarray] = {}
    while work:
        level, pairs = work.pop()
        if len(pairs) > PAIRS_AT_ONCE:
            work += [(level, pairs[i:i + PAIRS_AT_ONCE]) for i in range(0, len(pairs), PAIRS_AT_ONCE)]
            continue
        a0, a2, b0, b2, d = pairs.T
        own = (a0 == b0) & (a2 == b2)
        leaf = (a2 - a0 <= LEAF) & (b2 - b0 <= LEAF)
        if level < 0:
            leaf[:] = True
        if leaf.any():
            rows, cols = a2[leaf] - a0[leaf], b2[leaf] - b0[leaf]
            total = (rows * cols).astype(np.int64)
            of = np.repeat(np.arange(len(total)), total)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(total) - total, total)
            i, j = a0[leaf][of] + nth // cols[of], b0[leaf][of] + nth % cols[of]
            near = (np.bitwise_count(bits[i] ^ bits[j]) <= max_bits) & (~own[leaf][of] | (i < j))
            if near.any():
                emit(i[near], j[near])
        go = ~leaf
        if not go.any():
            continue
        a0, a2, b0, b2, d, own = a0[go], a2[go], b0[go], b2[go], d[go], own[go]
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((bits >> np.uint64(level)) & np.uint64(1))]).astype(np.int32)
        c = ones[level]
        a1, b1 = a2 - (c[a2] - c[a0]), b2 - (c[b2] - c[b0])
        sides = [(a0, a1, b0, b1, d, None), (a1, a2, b1, b2, d, None),
                 (a0, a1, b1, b2, d + 1, None), (a1, a2, b0, b1, d + 1, ~own)]
        for low_a, high_a, low_b, high_b, diff, also in sides:
            keep = (low_a < high_a) & (low_b < high_b) & (diff <= max_bits)
            if also is not None:
                keep &= also
            if keep.any():
                work.append((level - 1, np.stack([x[keep] for x in (low_a, high_a, low_b, high_b, diff)], axis=1)))


def _forest(n: int, links: list) -> np.ndarray:
    """The smallest connected place for each of ``n`` places."""
    label = np.arange(n)
    while links:
        changed = False
        for i, j in links:
            least = np.minimum(label[i], label[j])
            if (label[i] != least).any() or (label[j] != least).any():
                np.minimum.at(label, i, least)
                np.minimum.at(label, j, least)
                changed = True
        label = label[label]
        if not changed and (label[label] == label).all():
            break
    return label


def _linked(task: np.ndarray, side: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole tasks: pairs (fingerprint, smallest one it is connected to
    by what the tasks found), at most one for each fingerprint."""
    bits = fp.view(np.uint64)
    order = np.lexsort((bits, side, task))
    bits, task, side = bits[order], task[order], side[order]
    cut = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]) | (side[1:] != side[:-1]), True])
    low, high = cut[:-1], cut[1:]
    kind = side[low]          # 0: a chunk with itself; 1 and 2: the sides of a pair of chunks
    alone = kind == 0
    roots = [np.stack([low[alone], high[alone], low[alone], high[alone]], axis=1)]
    left = np.flatnonzero(kind == 1)
    left = left[(left + 1 < len(low))]
    left = left[(kind[left + 1] == 2) & (task[low[left]] == task[low[left + 1]])]
    roots.append(np.stack([low[left], high[left], low[left + 1], high[left + 1]], axis=1))
    distinct, place = np.unique(bits, return_inverse=True)
    label = np.arange(len(distinct))
    waiting: list = []

    def emit(i, j):
        nonlocal label
        waiting.append((place[i], place[j]))
        if sum(len(x) for x, _ in waiting) > LINKS_AT_ONCE:
            label = _forest(len(distinct), [*waiting, (np.arange(len(distinct)), label)])
            waiting.clear()

    trie_pairs(bits, np.concatenate(roots), max_bits, emit)
    label = _forest(len(distinct), [*waiting, (np.arange(len(distinct)), label)])
    moved = np.flatnonzero(label != np.arange(len(distinct)))
    return distinct[moved].view(np.int64), distinct[label[moved]].view(np.int64)


def _keys(n: int, max_bits: int) -> list[Column]:
    """Hash keys of which two fingerprints within ``max_bits`` share at least one.

    64 bits fall in ``max_bits + r`` blocks; ``max_bits`` differing bits leave r of
    them untouched, so each choice of r blocks is a key.  r grows with the number
    of fingerprints, so that evenly spread ones leave few to a key: comparisons
    then grow with the fingerprints, not with their square."""
    r = 1
    while r < 3 and n >> int(64 * r / (max_bits + r)) > PER_KEY:
        r += 1
    count = max_bits + r
    edges = [round(64 * i / count) for i in range(count + 1)]
    keys = []
    for chosen in combinations(range(count), r):
        mask = 0
        for i in chosen:
            mask |= ((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1)
        keys.append(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")))
    return keys


def links(fps: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """(u, v): links that connect all fingerprints of ``fps`` (fp, distinct) that
    chains of differences of at most ``max_bits`` bits connect.

    Candidates share one of the block keys.  A key's fingerprints are one trie, or
    are dealt over chunks of about ``chunk`` if there are more; every chunk meets
    itself and every other chunk of its key in a task of its own, where the pairs of
    nodes of both tries are walked together.  A task hands on a spanning forest of
    what it found instead of all its pairs."""
    ship_package(fps.sparkSession)
    n = fps.count()
    keyed = fps.select("fp", F.posexplode(F.array(*_keys(n, max_bits))).alias("part", "key"))
    sizes = (keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select("part", "key", F.expr(f"CAST(ceil(n / {int(chunk)}) AS INT)").alias("n_chunks")))
    tasks = (keyed.join(sizes, ["part", "key"])
             .withColumn("chunk", F.expr("CAST(pmod(xxhash64(fp), n_chunks) AS INT)"))
             .withColumn("other", F.explode(F.expr("sequence(0, n_chunks - 1)")))
             .select(F.xxhash64("part", "key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("task"),
                     F.expr("CASE WHEN chunk = other THEN 0 WHEN chunk < other THEN 1 ELSE 2 END").alias("side"), "fp")
             .repartition("task").sortWithinPartitions("task"))

    def run(found):
        rest = None
        for batch in found:
            now = [np.asarray(batch.column(i)) for i in range(3)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            whole_to = int(np.searchsorted(now[0], now[0][-1]))     # the last task may go on
            rest = [x[whole_to:] for x in now]
            if whole_to:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in _linked(*[x[:whole_to] for x in now], max_bits)], names=["u", "v"])
        if rest is not None and len(rest[0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in _linked(*rest, max_bits)], names=["u", "v"])

    return tasks.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id``,
    the smallest id that links of at most ``max_bits`` differing bits reach.

    Documents with equal fingerprints are linked; they are one node of the join,
    however many they are.  Null ids are passed over when the smallest is sought;
    a component of null ids alone has a null one.  An empty table gives an empty
    one; other columns are not read."""
    marked = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    nodes = marked.groupBy("fp").agg(F.min("id").alias("least"))
    reached = components(links(nodes.select("fp"), max_bits))
    members = reached.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(
        reached.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    roots = members.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    linked = members.join(roots, "root").select("fp", "component_id")
    classes = nodes.join(linked.withColumn("in_class", F.lit(True)), "fp", "left").select(
        "fp", F.when(F.col("in_class"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return marked.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """The documents that are the first of their component - by id, then by 128-bit keys
    of id and text - with their columns.  Rows without id stay; of rows that share an id
    each is judged by its own text; rows with the same id and text stay or go together."""
    keys = row_keys(F.col(id_col), F.col(text_col))
    marked = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *keys).alias("_row"),
                         F.col(text_col).alias("_text"))
    gone = (near_duplicates(marked, "_row", "_text", **named)
            .where((F.col("_row") != F.col("component_id")) & F.col("_row.id").isNotNull())
            .select(F.col("_row.k1").alias("_g1"), F.col("_row.k2").alias("_g2")).distinct())
    return docs.join(gone, (keys[0] == F.col("_g1")) & (keys[1] == F.col("_g2")), "left_anti")
