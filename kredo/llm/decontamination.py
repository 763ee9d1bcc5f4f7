"""Benchmark passages in training text, found by a suffix automaton of the items."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from kredo.llm.automaton import Automaton
from kredo.llm.terms import hash_of, slices, terms
from kredo.llm.text import row_keys, whole
from kredo.session import checkpoint_dir, ship_package

WINDOW = 10
PIECE = 4096             # words of a piece of a long item
PART_WORDS = 1 << 17     # words of the items of one automaton, which is broadcast (some 50 MB)


# --- the items -------------------------------------------------------------------


def _pieces(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Items as (item, words), long ones cut into pieces that share window - 1 words,
    so that each window lies in one piece."""
    cut = F.expr(f"""transform(sequence(0, greatest(0, (size(words) - {window}) div {PIECE})),
        i -> slice(words, i * {PIECE} + 1, {PIECE + window - 1}))""")
    return (items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                         terms(F.col(text_col)).alias("words"))
            .where(F.size("words") > 0).select("item", F.explode(cut).alias("words")).dropDuplicates())


def _parts(pieces: DataFrame, part_words: int) -> DataFrame:
    """Pieces dealt into parts of at most ``part_words`` words (or one piece)."""
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-int(total) // part_words) or 1
    while True:
        parts = pieces.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(n)).cast("int"))
        sizes = parts.groupBy("part").agg(F.sum(F.size("words")).alias("n"), F.count(F.lit(1)).alias("pieces"))
        if n == 1 or not sizes.where((F.col("n") > part_words) & (F.col("pieces") > 1)).take(1):
            return parts
        n *= 2


def _built(pieces, window: int) -> bytes:
    """The automaton of some pieces (item, words), with what it says of windows."""
    numbers: dict[str, int] = {}
    rows = [(item, [numbers.setdefault(w, len(numbers)) for w in words]) for item, words in pieces]
    made = Automaton()
    for _, words in rows:
        made.add(words)
    gram = [-1] * len(made.size)             # the state of the last ``window`` words
    for s in sorted(range(1, len(made.size)), key=made.size.__getitem__):
        if made.size[s] >= window:
            gram[s] = s if made.size[made.link[s]] < window else gram[made.link[s]]
    names = sorted({item for item, _ in rows})
    place = {item: i for i, item in enumerate(names)}
    found = set()                            # (state, item): a window that ends there is of the item
    short = set()
    for item, words in rows:
        for state, length in made.read(words):
            if length >= window:
                found.add((gram[state], place[item]))
        if len(words) < window:
            found.add((state, place[item]))
            short.add(state)
    # nearest suffix that is a whole short item
    nearest = [-1] * len(made.size)
    for s in sorted(range(1, len(made.size)), key=made.size.__getitem__):
        nearest[s] = s if s in short else nearest[made.link[s]]
    pairs = sorted({(a, b) for _, words in rows for a, b in zip(words, words[1:])})
    vocabulary = list(numbers)
    return pickle.dumps({
        "arrays": made.arrays(), "gram": np.array(gram, np.int32), "nearest": np.array(nearest, np.int32),
        "found": np.array(sorted(found), np.int32).reshape(-1, 2), "names": names, "words": vocabulary,
        "hashes": np.array([hash_of(w.encode()) for w in vocabulary], np.int64),
        "pairs": np.array([a << 32 | b for a, b in pairs], np.int64), "window": window,
        "least": min((min(len(words), window) for _, words in rows), default=window)})


class Passages:
    """An automaton with its windows, ready to read documents."""

    def __init__(self, data: bytes):
        spec = pickle.loads(data)
        self.window, self.least, self.names = spec["window"], spec["least"], spec["names"]
        self.automaton = Automaton.of(*spec["arrays"])
        self.gram, self.nearest = spec["gram"].tolist(), spec["nearest"].tolist()
        self.items: dict[int, list[int]] = {}
        for state, item in spec["found"].tolist():
            self.items.setdefault(state, []).append(item)
        self.numbers = {w.encode(): i for i, w in enumerate(spec["words"])}
        order = np.argsort(spec["hashes"], kind="stable")
        self.hashes, self.number = spec["hashes"][order], order.astype(np.int64)
        self.pairs = spec["pairs"]

    def runs(self, part) -> list[tuple[int, int]]:
        """Runs of terms, each with the next a pair that some item holds, long enough
        for a window.  Between two runs the automaton would fall back to matches of
        one word, so each run is read from the start state."""
        if not len(self.hashes) or not len(part.start):
            return []
        h = part.hashes().view(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        number = self.number[at]
        goes_on = np.zeros(len(h), bool)     # together with the term before
        both = np.flatnonzero(known[1:] & known[:-1] & (part.doc[1:] == part.doc[:-1])) + 1
        if len(self.pairs) and len(both):
            code = number[both - 1] << 32 | number[both]
            spot = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            goes_on[both] = self.pairs[spot] == code
        begins = np.flatnonzero(known & ~goes_on)
        ends = np.flatnonzero(known & ~np.append(goes_on[1:], False)) + 1
        long = ends - begins >= self.least
        return list(zip(begins[long].tolist(), ends[long].tolist()))

    def spans(self, part) -> dict[int, tuple[list[tuple[int, int]], set[str], int]]:
        """For documents with a hit: spans of hit terms (first, end; places in the
        slice), the items and the longest match."""
        out: dict = {}
        gram, nearest, link, size = self.gram, self.nearest, self.automaton.link, self.automaton.size
        for a, b in self.runs(part):
            words = [self.numbers.get(part.term(i), -1) for i in range(a, b)]
            if -1 in words:                  # a hash that is shared by another word
                words = [w if w >= 0 else (1 << 32) - 1 for w in words]
            spans, states, longest = [], set(), 0
            for i, (state, length) in enumerate(self.automaton.read(words), a + 1):
                reach = 0
                if length >= self.window:
                    reach = self.window
                    states.add(gram[state])
                short = nearest[state] if length >= size[state] else nearest[link[state]] if state else -1
                while short > 0:
                    reach = max(reach, size[short])
                    states.add(short)
                    short = nearest[link[short]]
                if reach:
                    longest = max(longest, length)
                    if spans and i - reach <= spans[-1][1]:
                        spans[-1] = (min(spans[-1][0], i - reach), i)
                        while len(spans) > 1 and spans[-1][0] <= spans[-2][1]:
                            last = spans.pop()
                            spans[-1] = (min(spans[-1][0], last[0]), last[1])
                    else:
                        spans.append((i - reach, i))
            if spans:
                got = out.setdefault(int(part.doc[a]), ([], set(), 0))
                got[0].extend(spans)
                got[1].update(self.names[i] for s in states for i in self.items[s])
                out[int(part.doc[a])] = (got[0], got[1], max(got[2], longest))
        return out


# --- the documents ---------------------------------------------------------------

SPAN = StructType([StructField("first", LongType()), StructField("end", LongType()),
                   StructField("begin_byte", LongType()), StructField("end_byte", LongType())])


def _read(docs: DataFrame, data: bytes, hits_only: bool) -> DataFrame:
    """Rows (id, k1, k2) with n_words, longest, items and spans, by one automaton."""
    broadcast = docs.sparkSession.sparkContext.broadcast(data)
    schema = StructType([*docs.select("id", "k1", "k2").schema.fields, StructField("n_words", LongType()),
                         StructField("longest", IntegerType()), StructField("items", ArrayType(StringType())),
                         StructField("spans", ArrayType(SPAN))])
    arrow_span = pa.list_(pa.struct([(f.name, pa.int64()) for f in SPAN.fields]))

    def match(found):
        passages = Passages(broadcast.value)
        for batch in found:
            for low, high, part in slices(batch):
                hits = passages.spans(part)
                rows = np.array(sorted(hits) if hits_only else range(part.n_docs), np.int64)
                if not len(rows):
                    continue
                longest, items, spans = [], [], []
                for d in rows.tolist():
                    got, names, most = hits.get(d, ((), (), 0))
                    longest.append(most)
                    items.append(sorted(names))
                    spans.append([dict(zip(SPAN.names, (
                        a - int(part.first[d]), b - int(part.first[d]), int(part.start[a] - part.bounds[d]),
                        int(part.start[b - 1] + part.length[b - 1] - part.bounds[d])))) for a, b in got])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(pa.array(low + rows)) for c in range(3)],
                     pa.array(np.diff(part.first)[rows], pa.int64()), pa.array(longest, pa.int32()),
                     pa.array(items, pa.list_(pa.string())), pa.array(spans, arrow_span)], names=schema.names)

    return docs.mapInArrow(match, schema)


# Spans in order, those that touch made one.
MERGED = """aggregate(array_sort(spans), slice(spans, 1, 0), (done, s) -> CASE
    WHEN size(done) > 0 AND s.first <= try_element_at(done, -1).end THEN concat(slice(done, 1, size(done) - 1), array(named_struct(
        'first', try_element_at(done, -1).first, 'end', greatest(s.end, try_element_at(done, -1).end),
        'begin_byte', try_element_at(done, -1).begin_byte, 'end_byte', greatest(s.end_byte, try_element_at(done, -1).end_byte))))
    ELSE concat(done, array(s)) END)"""


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
             part_words: int = PART_WORDS) -> DataFrame:
    """One row per document: id, ``n_words``, ``longest`` (words of the longest match),
    ``items`` (ids, as strings, of items with an occurring window, sorted) and
    ``spans`` of hit words in order (``first`` and ``end`` as word numbers,
    ``begin_byte`` and ``end_byte`` in the text's UTF-8).

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z
    lower-cased.  A window is ``window`` consecutive words of an item; an item of
    fewer words, but not none, is one window.  A document word inside any occurrence
    of a window is hit.

    A generalised suffix automaton of the items is built in a task and broadcast.
    Documents stream past it and nothing of them is shuffled; the longest match that
    ends at each word tells the windows that end there.  Words and pairs of
    neighbouring words that no item holds are passed over by lookup, as no match
    reaches across them.  Items of more than ``part_words`` words make several
    automata; each reads the documents in a scan of its own, and hits are merged by
    document.

    Null texts have no words; an item's null id is named by the empty string; items
    with the same id count as one; equal documents get a row each; very long texts
    and items are handled whole, a text's memory is some ten times its size; an
    empty table of either kind gives no rows or no hits; other columns are not read."""
    found = _overlaps(docs, items, id_col, text_col, item_col, item_text_col, window, part_words)
    return found.select(F.col("id").alias(id_col), "n_words", "longest", "items", "spans")


def _overlaps(docs, items, id_col, text_col, item_col, item_text_col, window, part_words) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    checkpoint_dir(spark)
    base = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    base = base.select("id", *row_keys(F.col("id"), F.col("text")), "text")
    parts = _parts(_pieces(items, item_col, item_text_col, window), part_words)
    parts = parts.checkpoint(eager=True)

    def build(group):
        import pandas as pd

        rows = sorted((item, list(words)) for item, words in zip(group["item"], group["words"]))
        return pd.DataFrame({"part": group["part"].iloc[:1], "data": [_built(rows, window)]})

    built = parts.groupBy("part").applyInPandas(build, "part int, data binary").checkpoint(eager=True)
    numbers = sorted(r["part"] for r in built.select("part").collect())
    automata = [lambda n=n: bytes(built.where(F.col("part") == n).first()["data"]) for n in numbers]
    if not automata:
        automata = [lambda: _built([], window)]
    found = _read(base, automata[0](), hits_only=False)
    if len(automata) > 1:
        more = None
        for data in automata[1:]:
            hits = _read(base, data(), hits_only=True).drop("id", "n_words").dropDuplicates(["k1", "k2"])
            more = hits if more is None else more.unionByName(hits)
        more = more.groupBy("k1", "k2").agg(F.max("longest").alias("l"), F.flatten(F.collect_list("items")).alias("i"),
                                            F.flatten(F.collect_list("spans")).alias("s"))
        found = found.join(more, ["k1", "k2"], "left").select(
            "id", "k1", "k2", "n_words", F.greatest("longest", F.coalesce("l", F.lit(0))).alias("longest"),
            F.array_sort(F.array_distinct(F.concat("items", F.coalesce("i", F.array().cast("array<string>"))))).alias("items"),
            F.concat("spans", F.coalesce("s", F.array().cast(ArrayType(SPAN)))).alias("spans"))
        found = found.withColumn("spans", F.expr(MERGED))
    return found


def n_hit(spans: Column) -> Column:
    """Hit words of a document."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def without_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                     max_words: int = WINDOW - 1, max_coverage: float = 0.5, part_words: int = PART_WORDS) -> DataFrame:
    """The documents, in their own columns, without benchmark passages: spans of hit
    words longer than ``max_words`` are cut out of the text, and a document of whose
    words more than ``max_coverage`` are hit goes whole.

    Only the rows with a hit are joined to the documents, by 128-bit keys of id and
    text, so that of documents that share an id each has its own spans.  Documents
    without a hit, null texts among them, stay as they are."""
    found = _overlaps(docs, items, id_col, text_col, item_col, item_text_col, window, part_words)
    hits = found.where(F.size("spans") > 0).select(
        F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), (n_hit(F.col("spans")) > max_coverage * F.col("n_words")).alias("_goes"),
        F.filter("spans", lambda s: s["end"] - s["first"] > max_words).alias("_cut")).dropDuplicates(["_k1", "_k2"])
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    rows = docs.withColumn("_j1", k1).withColumn("_j2", k2)
    rows = rows.join(hits, (F.col("_j1") == F.col("_k1")) & (F.col("_j2") == F.col("_k2")), "left")
    left = F.expr(f"""array_join(transform(sequence(0, size(_cut)), i -> decode(substring(CAST(`{text_col}` AS BINARY),
        CAST(CASE WHEN i = 0 THEN 0 ELSE _cut[i - 1].end_byte END + 1 AS INT),
        CAST(CASE WHEN i = size(_cut) THEN octet_length(`{text_col}`) ELSE _cut[i].begin_byte END
             - CASE WHEN i = 0 THEN 0 ELSE _cut[i - 1].end_byte END AS INT)), 'UTF-8')), '')""")
    text = F.when(F.size(F.coalesce("_cut", F.array().cast(ArrayType(SPAN)))) > 0, left).otherwise(F.col(text_col))
    return (rows.where(F.coalesce(~F.col("_goes"), F.lit(True))).withColumn(text_col, text)
            .select(*[f"`{c}`" for c in docs.columns]))
