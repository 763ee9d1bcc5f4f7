"""Document log-likelihood under a recurrent model and under word counts."""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from kredo.llm import gru
from kredo.llm.text import row_keys, whole
from kredo.session import cut_lineage, ship_package

LAYOUT = gru.Layout(classes=32, size=64, bins=32)
# Words whose counts are broadcast: at most so many, of at most WORD_BYTES bytes (17 MB).
KNOWN = 1 << 18
WORD_BYTES = 64
# Training: in each round every task trains a copy of the model on one training
# document of SHARE, dealt by hash, and the copies are averaged.  All rounds together
# take every training document once.
ROUNDS = 2
SHARE = ROUNDS
MEANS = 64               # groups of tasks whose parameters are averaged before those of all
TOKENS_AT_ONCE = 1 << 22 # about, that go forward together in scoring
# Each byte with A-Z in lower case and the six spaces as one.
PLAIN = bytes(range(256)).lower().translate(bytes.maketrans(b"\t\n\v\f\r", b"     "))
TEXT_AT_ONCE = 8 << 20    # bytes of texts whose words are told apart together


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 7; not for a null id."""
    return F.coalesce(F.crc32(id_.cast("string")) % 7 == 2, F.lit(False))


def _slices(texts: pa.Array):
    """(first text, texts), TEXT_AT_ONCE bytes or one text at a time."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    low = 0
    while low < len(texts):
        before = ends[low - 1] if low else 0
        n = max(1, int(np.searchsorted(ends, before + TEXT_AT_ONCE, "right")) - low)
        yield low, texts.slice(low, n)
        low += n


def _gathered(columns):
    """Texts of some columns, TEXT_AT_ONCE bytes or one longer text at a time."""
    held, size = [], 0
    for column in columns:
        for _, texts in _slices(column):
            n = pc.sum(pc.binary_length(texts)).as_py()
            if held and size + n > TEXT_AT_ONCE:
                yield pa.concat_arrays(held)
                held, size = [], 0
            held.append(texts)
            size += n
    if held:
        yield pa.concat_arrays(held)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of the lower-cased (A-Z) texts, the place among them of each
    word of the texts, and where each text's words begin, with their number as last."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]].tobytes().translate(PLAIN)
    plain = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(data)])
    found = pc.split_pattern(plain, " ")
    is_word = np.asarray(pc.greater(pc.binary_length(found.values), 0))       # not what is before or after the outer spaces
    first = np.concatenate([[0], np.cumsum(is_word)])[np.asarray(found.offsets)]
    of = found.values.filter(pa.array(is_word)).dictionary_encode()
    return of.dictionary.cast(pa.string()), np.asarray(of.indices), first


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over column ``text``: a task adds up the words of TEXT_AT_ONCE bytes of
    texts and hands them on."""
    def count(found):
        for texts in _gathered(batch.column(0) for batch in found):
            different, codes, _ = _words(texts)
            yield pa.RecordBatch.from_arrays(
                [different, pa.array(np.bincount(codes, minlength=len(different)), pa.int64())], names=["word", "c"])

    return texts.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Known words by rank (1 is the most frequent; 0 stands for all others), with
    what the scores need of each.  Rank r below the layout's head is a head word;
    head place 0 is the end."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n_docs: int, n_words: int, n_distinct: int,
                 bin_words: np.ndarray, bin_distinct: np.ndarray, layout: gru.Layout):
        self.layout = layout
        self.rank = {w: i + 1 for i, w in enumerate(words)}
        c = np.concatenate([[0], counts]).astype(float)
        self.log_c = np.log10(c + 1)
        bins = np.array([0, *[bin_of(w, layout.bins) for w in words]])
        place = np.arange(len(c))
        head = (place > 0) & (place < layout.head)
        self.token = np.where(head, place, layout.head + bins)
        self.head = head
        n_bin, v_bin = bin_words.astype(float), bin_distinct.astype(float)
        np.subtract.at(n_bin, bins[head], c[head])
        np.subtract.at(v_bin, bins[head], 1)
        # a rare word has its count plus one of its bin; what is left over is for new words
        self.log_bin = np.log10(n_bin + v_bin + 1)
        self.weight = np.zeros(layout.inputs)
        self.weight[0] = n_docs
        self.weight[place[head]] = c[head]
        self.weight[layout.head:] = n_bin
        self.train_tokens = n_words + n_docs
        self.distinct = n_distinct + (1 if n_docs else 0)
        self.end = np.log10(n_docs + 1)
        self.end_known = int(n_docs > 0)

    def read(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The different words of the texts, of all their words the places among them and
        the ranks, where each text's words begin, and the tokens of the model with an end
        after each text: those of text i begin i places later than its words."""
        different, codes, first = _words(texts)
        words = different.cast(pa.binary()).to_numpy(zero_copy_only=False)
        ranks = np.fromiter(map(self.rank.get, words, repeat(0)), np.int32, len(words))
        tokens = self.token[ranks]
        new = np.flatnonzero(ranks == 0)
        tokens[new] = [self.layout.head + bin_of(w, self.layout.bins) for w in words[new]]
        every = np.zeros(len(codes) + len(texts), np.int64)
        every[np.arange(len(codes)) + np.repeat(np.arange(len(texts)), np.diff(first))] = tokens[codes]
        return different, codes, ranks[codes], first, every


def _documents(first: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
    """The tokens of each text by itself."""
    ends = (first + np.arange(len(first))).tolist()
    return [tokens[a:b].copy() for a, b in zip(ends, ends[1:])]


def bin_of(word: bytes, bins: int) -> int:
    return zlib.crc32(word[-2:]) % bins


def _vocabulary(training: DataFrame, counts: DataFrame, layout: gru.Layout) -> Vocabulary:
    bin_ = (F.crc32(F.expr("substring(encode(word, 'UTF-8'), -2, 2)")) % layout.bins).cast("int")
    by_bin = counts.groupBy(bin_.alias("b")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    n_bin, v_bin = np.zeros(layout.bins), np.zeros(layout.bins)
    for row in by_bin:
        n_bin[row["b"]], v_bin[row["b"]] = row["n"], row["v"]
    top = (counts.where(F.octet_length("word") <= WORD_BYTES)
           .orderBy(F.desc("c"), "word").limit(KNOWN - 1).toArrow())
    words = [w.encode() for w in top.column("word").to_pylist()]
    return Vocabulary(words, np.asarray(top.column("c")), training.count(), int(n_bin.sum()), int(v_bin.sum()),
                      n_bin, v_bin, layout)


def train(training: DataFrame, vocabulary, layout: gru.Layout, rounds: int = ROUNDS, share: int = SHARE) -> dict:
    """Model parameters from ``training`` (id, text); ``vocabulary`` is broadcast.

    Rounds of local training: every task goes over its chosen documents, whole, with
    truncated backpropagation, and hands on its parameters in rows; these are
    averaged, weighted by tokens, on the executors.  The driver holds one model."""
    spark = training.sparkSession
    p = gru.initial(layout, vocabulary.value.weight)
    for step in range(rounds):
        start = spark.sparkContext.broadcast(p)

        def local(found):
            gru.one_thread()
            gru.keep_memory()
            voc, trainer = vocabulary.value, gru.Trainer(start.value, layout)
            texts = (x for batch in found for _, x in _slices(batch.column(0)))
            seen = trainer.train(doc for x in texts for doc in _documents(*voc.read(x)[3:]))
            if seen:
                for name, value in trainer.p.items():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([seen], pa.int64()), pa.array([value.tobytes()], pa.binary())],
                        names=["name", "tokens", "value"])

        def mean(found):
            sums: dict = {}
            for batch in found:
                for name, n, value in zip(*[batch.column(i).to_pylist() for i in range(3)]):     # of a group of tasks
                    old, weight = sums.get(name, (0.0, 0))
                    sums[name] = (old + n * np.frombuffer(value, np.float32).astype(float), weight + n)
            for name, (value, n) in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([n], pa.int64()), pa.array([(value / n).astype(np.float32).tobytes()], pa.binary())],
                    names=["name", "tokens", "value"])

        kind = "name string, tokens long, value binary"
        chosen = training.where(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(share)) == step).select("text")
        trained = chosen.mapInArrow(local, kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MEANS)))
        parts = trained.repartition("name", "part").mapInArrow(mean, kind)
        got = parts.repartition("name").mapInArrow(mean, kind).collect()
        for row in got:
            p[row["name"]] = np.frombuffer(row["value"], np.float32).reshape(p[row["name"]].shape).copy()
        start.unpersist()
    return p


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    layout: gru.Layout = LAYOUT) -> DataFrame:
    """One row per input row: id, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score``, ``score``.

    Tokens are the words of the lower-cased (A-Z) text and one end.  Words are
    counted over all training documents, those not held out.  ``base_score`` adds
    log10((c + 1) / (N + V + 1)) of each token.  ``score`` is the recurrent model's
    log10 probability of the whole text: class, then word in class for head words;
    bin, then share of the bin's counts for all others.

    The most frequent words are broadcast, a bounded table; every other word of a
    document goes to a join with all counts, once for each document, and both scores
    take its exact count.  Null and empty texts are an end alone.  Rows with equal id
    and text are scored each.  Without training documents all counts are 0.  An empty
    table gives an empty one; other columns are not read."""
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text")).withColumn("held", held_out(F.col("id")))
    training = base.where("NOT held").select("id", "text")
    counts = cut_lineage(word_counts(training.select("text")))
    voc = _vocabulary(training, counts, layout)
    vocabulary = spark.sparkContext.broadcast(voc)
    model = spark.sparkContext.broadcast(train(training, vocabulary, layout))

    names = ["word", "n", "k1", "k2", "id", "held", "n_tokens", "n_known", "base", "score"]
    schema = StructType([
        StructField("word", StringType()), StructField("n", LongType()), StructField("k1", LongType()),
        StructField("k2", LongType()), base.schema["id"], StructField("held", BooleanType()), StructField("n_tokens", LongType()),
        StructField("n_known", LongType()), StructField("base", DoubleType()), StructField("score", DoubleType())])

    def run(found):
        gru.one_thread()
        gru.keep_memory()
        voc, p = vocabulary.value, model.value
        docs_, known, base_, fixed = [], [], [], []
        keys: list = [[], [], [], []]

        def flush():
            n = len(docs_)
            done = gru.score(p, layout, docs_) / np.log(10) + np.array(fixed)
            k1 = pa.concat_arrays(keys[0])
            rows = pa.RecordBatch.from_arrays(
                [pa.array([f"\x00{k}" for k in k1.to_pylist()], pa.string()), pa.nulls(n, pa.int64()), k1,
                 *[pa.concat_arrays(k) for k in keys[1:]], pa.array([len(d) for d in docs_], pa.int64()),
                 pa.array(known, pa.int64()), pa.array(base_, pa.float64()), pa.array(done)], names=names)
            for x in (docs_, known, base_, fixed, *keys):
                x.clear()
            return rows

        waiting = 0
        for batch in found:
            for low, texts in _slices(batch.column(4)):
                different, codes, ranks, first, tokens = voc.read(texts)
                docs_ += _documents(first, tokens)
                waiting += len(tokens)
                known += (np.diff(np.concatenate([[0], np.cumsum(ranks > 0)])[first]) + voc.end_known).tolist()
                log_c, rest = voc.log_c[ranks], np.flatnonzero(~voc.head[ranks])
                of = np.repeat(np.arange(len(texts)), np.diff(first))
                log_rest, log_bin = log_c[rest], voc.log_bin[tokens[rest + of[rest]] - layout.head]
                cut = np.searchsorted(rest, first).tolist()
                base_ += [float(log_c[a:b].sum()) + voc.end for a, b in zip(first.tolist(), first[1:].tolist())]
                fixed += [float(log_rest[a:b].sum()) - float(log_bin[a:b].sum()) for a, b in zip(cut, cut[1:])]
                for x, c in zip(keys, range(4)):
                    x.append(batch.column(c).slice(low, len(texts)))
                new = np.flatnonzero(ranks == 0)
                if len(new):
                    pairs, n_of = np.unique(of[new] * len(different) + codes[new], return_counts=True)
                    n = len(pairs)
                    of = pa.array(low + pairs // len(different))
                    yield pa.RecordBatch.from_arrays(
                        [different.take(pa.array(pairs % len(different))), pa.array(n_of, pa.int64()), batch.column(0).take(of),
                         batch.column(1).take(of), pa.nulls(n, batch.column(2).type),
                         pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                         pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())], names=names)
                if waiting > TOKENS_AT_ONCE:
                    waiting = 0
                    yield flush()
        if docs_:
            yield flush()

    rows = base.select(*row_keys(F.col("id"), F.col("text")), "id", "held", "text").mapInArrow(run, schema)
    # a document's own row has a word that no count has, so that these rows are spread too
    joined = rows.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = F.col("n_tokens").isNull()
    summed = joined.groupBy("k1", "k2").agg(
        F.max("id").alias("id"), F.max("held").alias("held_out"), F.count("n_tokens").alias("copies"),
        F.max("n_tokens").alias("n_tokens"), F.max("n_known").alias("head_known"), F.max("base").alias("base"),
        F.max("score").alias("score"),
        F.sum(F.when(rare & (F.col("c") > 0), F.col("n"))).alias("rare_known"),
        F.sum(F.when(rare, F.col("n") * F.log10(F.col("c") + 1))).alias("rare_log"))
    copies = F.col("copies")
    rare_log = F.coalesce(F.col("rare_log") / copies, F.lit(0.0))
    every = float(np.log10(voc.train_tokens + voc.distinct + 1))
    return summed.select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce((F.col("rare_known") / copies).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(voc.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log - F.col("n_tokens") * F.lit(every)).alias("base_score"),
        (F.col("score") + rare_log).alias("score"),
        F.explode(F.expr("sequence(1, CAST(copies AS INT))")).alias("_copy")).drop("_copy")
