"""Tokens of two tokenizers aligned by byte offsets, long texts by composing fragments."""

from __future__ import annotations

import json
import math
import re
import uuid
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from kredo.llm.bpe import LONG_RUN, NOT_FAST, PRINTED, codec_of
from kredo.llm.text import row_keys, whole
from kredo.session import checkpoint_dir, ship_package

RANGE = 1 << 15          # bytes of a range of a long text
FAN = 64                 # fragments that are composed in one task
LONGEST = 1 << 31        # bytes of a text that Spark holds
SLICE = 256              # short texts that are aligned at once
PARTIAL = 1 << 21        # distinct pairs that a task counts before it hands them on
PART_PAIRS = 1 << 22     # pairs that are broadcast at once (17 bytes each)


# --- the tokenizers ----------------------------------------------------------------


class Tokenizers:
    """A byte-level BPE tokenizer file (A) and a sentencepiece model (B), with the bytes
    of each id.  A reads a space before the text; B adds it itself."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.codec = codec_of(path_a)
        self.plain = Tokenizer.from_file(path_a)
        self.plain.encode_special_tokens = True
        self.plain.no_truncation()
        self.plain.no_padding()
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = {chr(b): b for b in PRINTED}
        shown.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(PRINTED)))})
        self.bytes_a = [b""] * (max(self.plain.get_vocab_size(), max(vocabulary.values()) + 1))
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for i, p in enumerate(pieces) if not self.b.is_control(i)):
            raise ValueError(f"{path_b}: a piece goes on over the start of a word")
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        self.length_a, self.length_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # ids in decimal with what follows them, by 2 * id + (last of its group)
        digits = len(str(max(self.size_a, self.size_b))) + 1
        self.shown_a = np.array([f"{i}{end}" for i in range(self.size_a) for end in ",|"], f"S{digits}")
        self.shown_b = np.array([f"{i}{end}" for i in range(self.size_b) for end in ",;"], f"S{digits}")

        self.words = Words(self)

    def plainly(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """Of each text the ids of A (of a space and the text) and of B, and whether the
        bytes of both are those of the space and the text."""
        a: list = [None] * len(texts)
        other = []
        for i, text in enumerate(texts):
            if self.codec.fast is None or NOT_FAST.search(text) or LONG_RUN.search(text):
                other.append(i)
            else:
                a[i] = self.codec.fast.encode_ordinary(" " + text)
        for i, e in zip(other, self.plain.encode_batch([" " + texts[i] for i in other], add_special_tokens=False)):
            a[i] = e.ids
        out = []
        for text, x, y in zip(texts, a, self.b.encode(texts, num_threads=1)):
            data = b" " + text.encode()
            ok = b"".join(map(self.bytes_a.__getitem__, x)) == data and b"".join(map(self.bytes_b.__getitem__, y)) == data
            out.append((np.array(x, np.int32), np.array(y, np.int32), ok))
        return out

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """As ``plainly``, word by word where both tokenizers split before each space."""
        found = self.words.encode(texts)
        rest = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(rest, self.plainly([texts[i] for i in rest])):
            found[i] = x
        return found


class Words:
    """What a space and a word are encoded to, kept for the words of a task.

    Both tokenizers split a text before a space between two other characters, whatever
    stands around: B's pieces hold no space but at their start (which is checked when
    the model is loaded), and A's pattern begins anew there, unless white space stands
    on both sides of the space.  So a text in which each space stands alone is encoded
    as its words are."""

    KEPT, LONGEST, CHARACTERS, SIDE_BY_SIDE = 1 << 18, 1 << 12, 1 << 24, 64

    def __init__(self, t: Tokenizers):
        self.t = t
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = [array("i"), array("i")]
        self.first = [array("q", [0]), array("q", [0])]
        self.ok, self.begins, self.ends = bytearray(), bytearray(), bytearray()
        self.characters = 0

    def _add(self, words: list[str]) -> None:
        """Encode new words, as one text where they can stand side by side."""
        apart = [[w] for w in words if w[0].isspace()]
        words = [w for w in words if not w[0].isspace()]
        groups = [words[i:i + self.SIDE_BY_SIDE] for i in range(0, len(words), self.SIDE_BY_SIDE)] + apart
        for some, found in zip(groups, self.t.plainly([" ".join(g) for g in groups])):
            if found[2] or len(some) == 1:
                self._keep(some, *found)
            else:                            # some word's bytes differ: each for itself
                for w, x in zip(some, self.t.plainly(some)):
                    self._keep([w], *x)

    def _keep(self, words: list[str], a: np.ndarray, b: np.ndarray, ok: bool) -> None:
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        ends = np.cumsum([1 + len(w.encode()) for w in words])
        for ids, first, x, length in ((self.ids[0], self.first[0], a, self.t.length_a), (self.ids[1], self.first[1], b, self.t.length_b)):
            # the ids of a word whose bytes differ are of no use, wherever they are cut
            cut = np.searchsorted(np.cumsum(length[x]), ends, "right") if ok else np.full(1, len(x))
            first.frombytes((cut + len(ids)).astype(np.int64).tobytes())
            ids.frombytes(x.tobytes())
        self.ok.extend([ok] * len(words))
        self.begins.extend(w[0].isspace() for w in words)
        self.ends.extend(w[-1].isspace() for w in words)
        self.characters += int(ends[-1])

    def encode(self, texts: list[str]) -> list:
        """Ids of A and B and whether their bytes are the text's; None for a text that
        has to be encoded as a whole."""
        if len(self.place) > self.KEPT or self.characters > self.CHARACTERS:
            self.clear()
        split = [x.split(" ") for x in texts]
        split = [[] if not all(w) or max(map(len, w)) > self.LONGEST else w for w in split]
        counts = np.array([len(w) for w in split])
        self._add([w for w in dict.fromkeys(chain.from_iterable(split)) if w not in self.place])
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        text_of = np.repeat(np.arange(len(texts)), counts)
        ok, begins, ends = (np.frombuffer(bytes(x), bool) for x in (self.ok, self.begins, self.ends))
        good = np.bincount(text_of, ~ok[at], len(texts)) == 0
        both = ends[at[:-1]] & begins[at[1:]] & (text_of[:-1] == text_of[1:])
        whole_ = (counts > 0) & (np.bincount(text_of[1:], both, len(texts)) == 0)
        found = []
        for ids, first in zip(self.ids, self.first):
            ids, first = np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32), np.frombuffer(first, np.int64)
            n = first[at + 1] - first[at]
            begin = np.cumsum(n) - n
            flat = ids[np.repeat(first[at] - begin, n) + np.arange(int(n.sum()))]
            found.append(np.split(flat, np.cumsum(np.bincount(text_of, n, len(texts)).astype(np.int64))[:-1]))
            del ids, first                   # the arrays can't grow while they are looked at
        return [(a, b, bool(g)) if w else None for a, b, g, w in zip(*found, good, whole_)]


@lru_cache(maxsize=2)
def tokenizers_of(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


# --- groups and links --------------------------------------------------------------


class Aligned:
    """Texts of which both tokenizations cover the same bytes: ``a`` and ``b`` are their
    ids, text after text, ``ends`` the bytes where the texts end.

    A byte range between two neighbouring ends of tokens lies in one token of A and one
    of B, and two tokens that overlap share just one such range: the links are these
    ranges."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray, t: Tokenizers):
        end_a, end_b = np.cumsum(t.length_a[a]), np.cumsum(t.length_b[b])
        cuts = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        both = np.zeros(len(cuts), bool)
        both[1:] = cuts[1:] == cuts[:-1]
        common = cuts[both]
        cuts = cuts[~both]
        of_a, of_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        self.codes = a[of_a].astype(np.int64) * t.size_b + b[of_b]
        self.first_link = np.concatenate([[0], np.searchsorted(cuts, ends, "right")])
        self.n_groups = np.diff(np.concatenate([[0], np.searchsorted(common, ends, "right")]))
        # tokens in groups: A's, then B's
        last_a, last_b = (e == common[np.searchsorted(common, e)] for e in (end_a, end_b))
        group_a = np.cumsum(last_a) - last_a
        group_b = np.cumsum(last_b) - last_b
        n_a, n_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        self.shown = np.empty(len(a) + len(b), t.shown_a.dtype)
        self.shown[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]] = t.shown_a[2 * a + last_a]
        self.shown[np.arange(len(b)) + np.cumsum(n_a)[group_b]] = t.shown_b[2 * b + last_b]
        self.first_token = np.concatenate([[0], np.searchsorted(end_a, ends, "right") + np.searchsorted(end_b, ends, "right")])

    def groups(self, i: int) -> bytes:
        """The groups of a text, each with a semicolon behind it."""
        return self.shown[self.first_token[i]:self.first_token[i + 1]].tobytes().translate(None, b"\0")

    def links(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The linked pairs of a text (a * size of B + b), sorted, and their counts."""
        return np.unique(self.codes[self.first_link[i]:self.first_link[i + 1]], return_counts=True)


def _ids(data) -> np.ndarray:
    return np.frombuffer(data, np.int32)


def _summary(a: np.ndarray, b: np.ndarray, t: Tokenizers) -> tuple:
    """(groups, number of groups, pairs, counts) of tokens that begin and end together."""
    if not len(a):
        return b"", 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = Aligned(a, b, t.length_a[a].sum(keepdims=True), t)
    return found.groups(0), int(found.n_groups[0]), *found.links(0)


def _added(parts: list) -> tuple:
    """Summaries of neighbours as one."""
    codes = np.concatenate([np.zeros(0, np.int64), *[p[2] for p in parts]])
    counts = np.concatenate([np.zeros(0, np.int64), *[p[3] for p in parts]])
    codes, place = np.unique(codes, return_inverse=True)
    return (b"".join(p[0] for p in parts), sum(p[1] for p in parts), codes,
            np.bincount(place, counts, len(codes)).astype(np.int64))


class Fragment:
    """A byte range of a text: its tokens up to the first offset where tokens of both
    end (``prefix``, open to the left), the groups from there to the last such offset
    (``closed``, as a summary), and the tokens after it (``suffix``, open to the right).
    Without such an offset (``cut`` false) all tokens are in ``prefix``.  Tokens belong
    to the range in which they end.  Composing fragments is associative."""

    def __init__(self, prefix, cut, closed, suffix):
        self.prefix, self.cut, self.closed, self.suffix = prefix, cut, closed, suffix

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, start_a: int, start_b: int, t: Tokenizers) -> "Fragment":
        """From the tokens of a range, of which the first start at the given offsets."""
        end_a, end_b = start_a + np.cumsum(t.length_a[a]), start_b + np.cumsum(t.length_b[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        if not len(common):
            return cls((a, b), False, _summary(a[:0], b[:0], t), (a[:0], b[:0]))
        i, j = (np.searchsorted(end_a, common[[0, -1]]) + 1), (np.searchsorted(end_b, common[[0, -1]]) + 1)
        return cls((a[:i[0]], b[:j[0]]), True, _summary(a[i[0]:i[1]], b[j[0]:j[1]], t), (a[i[1]:], b[j[1]:]))

    @classmethod
    def composed(cls, fragments: list["Fragment"], t: Tokenizers) -> "Fragment":
        """Neighbours, in order, as one: a suffix and the next prefix make a group."""
        empty = np.zeros(0, np.int32)
        open_, prefix, closed = [(empty, empty)], None, []
        join = lambda tokens: tuple(np.concatenate(x) for x in zip(*tokens))
        for f in fragments:
            open_.append(f.prefix)
            if f.cut:
                if prefix is None:
                    prefix = join(open_)
                else:
                    closed.append(_summary(*join(open_), t))
                closed.append(f.closed)
                open_ = [f.suffix]
        if prefix is None:
            return cls(join(open_), False, _added([]), (empty, empty))
        return cls(prefix, True, _added(closed), join(open_))

    def finished(self, t: Tokenizers) -> tuple | None:
        """The summary of a whole text, whose start closes the prefix on the left; None
        if its end doesn't close the suffix."""
        if not self.cut or len(self.suffix[0]) or len(self.suffix[1]):
            return None
        return _added([_summary(*self.prefix, t), self.closed])


# --- ranges of long texts ------------------------------------------------------------

# Bytes after a space that surely begin no white space of the pattern: printable ASCII,
# and lead bytes of characters other than those of the blocks that hold white space.
AFTER = np.zeros(256, bool)
AFTER[33:127] = AFTER[0xC3:0xE1] = AFTER[0xE4:0xF5] = True


def ranges(data: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """(low, start, end, high): the byte ranges (start, end] of a text (with the space
    before it), and around each the bytes to the next places where both tokenizers
    split whatever stands around: before a single space that a character follows.

    A range has ``size`` bytes; where no such place is near its end, it goes on to the
    next one, so that unsplit text is not encoded again by every range it touches."""
    raw = np.frombuffer(data, np.uint8)
    safe = np.flatnonzero((raw[1:-1] == 32) & (raw[:-2] != 32) & AFTER[raw[2:]]) + 1
    out, start, n = [], 0, len(raw)
    while start < n:
        end = min(start + size, n)
        at = int(np.searchsorted(safe, end))
        high = int(safe[at]) if at < len(safe) else n
        if high - end > size:
            end = high
        before = int(np.searchsorted(safe, start, "right"))
        out.append((int(safe[before - 1]) if before else 0, start, end, high))
        start = end
    return out


COUNTED = [StructField("ok", BooleanType()), *[StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups")]]
PAIRS = [StructField("pairs", BinaryType()), StructField("counts", BinaryType())]
ROW = [*COUNTED, StructField("n_links", LongType()), StructField("groups", StringType()), *PAIRS]
NOTHING = (False, 0, 0, 0, 0, "", b"", b"")


def _values(n_a, n_b, summary) -> tuple:
    groups, n_groups, codes, counts = summary
    return (True, n_a, n_b, n_groups, int(counts.sum()), groups[:-1].decode(), codes.tobytes(),
            counts.astype(np.int32).tobytes())


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          size: int = RANGE, fan: int = FAN, longest: int = LONGEST) -> DataFrame:
    """One row per document: id, ``ok``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``groups``, and ``pairs`` and ``counts``.

    Each text is encoded without special tokens, a space and the text by tokenizer file
    A (byte-level BPE; strings of special tokens are plain text) and the text by
    sentencepiece model B, which adds the space.  Byte offsets where tokens of both end
    cut the tokens into groups: ``groups`` shows them as ``a1,a2|b1;a3|b2,b3``.  A token
    of A and one of B are linked if their bytes overlap; ``pairs`` holds the different
    linked pairs of ids (64-bit, a * size of B + b, ascending) and ``counts`` (32-bit)
    how many links of the document are of each.

    Texts of up to ``size`` bytes are aligned where they are read.  A longer one is cut
    into byte ranges that are dealt over the cluster.  Each range is encoded with what
    stands around it up to the next places where both tokenizers split in any case, and
    makes a fragment: open prefix, closed groups, open suffix.  Fragments are composed
    in a tree, ``fan`` at a time, in tasks of their own; the number of levels follows
    from ``longest``.  Equal long rows are aligned once and repeated.

    Null and empty texts, and texts whose tokens' bytes aren't those of the text (a
    U+2581 in it, say), have ``ok`` false, zeros and an empty ``groups``.  A run without
    spaces is encoded in one task, as B joins what it likes there; ``groups``, some three
    times the text, must fit into Spark's 2 GB of a string.  An empty table gives an
    empty one; other columns are not read."""
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    schema = StructType([base.schema["id"], *ROW])
    types = [pa.bool_(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]

    def rows(ids, values):
        return pa.RecordBatch.from_arrays([ids, *[pa.array(list(c), x) for c, x in zip(zip(*values), types)]], names=schema.names)

    def short(found):
        t = tokenizers_of(path_a, path_b)
        for batch in found:
            for low in range(0, len(batch), SLICE):
                part = batch.slice(low, SLICE)
                yield rows(part.column(0), _short(part.column(1).to_pylist(), t))

    def cut(found):
        for batch in found:
            for i in range(len(batch)):
                data = b" " + batch.column(3)[i].as_py().encode()
                places = ranges(data, size)
                for no in range(0, len(places), 1024):
                    some = places[no:no + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(c).take(pa.array([i] * len(some))) for c in range(3)]
                        + [pa.array(range(no, no + len(some)), pa.int32())]
                        + [pa.array(list(c), pa.int64()) for c in list(zip(*some))[:3]]
                        + [pa.array([data[low:high] for low, _, _, high in some], pa.binary())], names=cuts.names)

    done = base.where(F.octet_length("text") <= size).mapInArrow(short, schema)
    long = base.where(F.octet_length("text") > size).select("id", *row_keys(F.col("id"), F.col("text")), "text")
    cuts = StructType([*long.schema.fields[:3], StructField("no", IntegerType()),
                       *[StructField(c, LongType()) for c in ("low", "start", "end")], StructField("data", BinaryType())])
    dealt = (long.mapInArrow(cut, cuts).groupBy("k1", "k2", "no", "low", "start", "end", "data")
             .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))

    open_ = ["prefix_a", "prefix_b", "suffix_a", "suffix_b"]
    parts = StructType([*[dealt.schema[c] for c in ("k1", "k2", "id", "copies", "no")], StructField("cut", BooleanType()),
                        *[StructField(c, BinaryType()) for c in open_], *COUNTED, StructField("groups", BinaryType()), *PAIRS])

    def as_values(f: Fragment, ok, n_a, n_b):
        groups, n_groups, codes, counts = f.closed
        return (f.cut, *[x.astype(np.int32).tobytes() for x in (*f.prefix, *f.suffix)], ok, n_a, n_b, n_groups, groups,
                codes.tobytes(), counts.astype(np.int64).tobytes())

    def encode(found):
        t = tokenizers_of(path_a, path_b)
        kinds = [pa.bool_(), *[pa.binary()] * 4, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 3]
        for batch in found:
            for i in range(len(batch)):
                low, start, end, data = (batch.column(c)[i].as_py() for c in range(5, 9))
                a, b, ok = t.encode([data.decode()[1:]])[0]
                if not ok:                   # the whole text has no tokens then
                    a = b = np.zeros(0, np.int32)
                kept, starts = [], []
                for ids, length in ((a, t.length_a), (b, t.length_b)):
                    ends = low + np.cumsum(length[ids])
                    first, last = np.searchsorted(ends, [start, end], "right")
                    kept.append(ids[first:last])
                    starts.append(int(ends[first - 1]) if first else low)
                values = as_values(Fragment.of(*kept, *starts, t), ok, len(kept[0]), len(kept[1]))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(i, 1) for c in range(5)], *[pa.array([v], k) for v, k in zip(values, kinds)]],
                    names=parts.names)

    def fragments(group):
        return [Fragment((_ids(r.prefix_a), _ids(r.prefix_b)), r.cut,
                         (r.groups, r.n_groups, np.frombuffer(r.pairs, np.int64), np.frombuffer(r.counts, np.int64)),
                         (_ids(r.suffix_a), _ids(r.suffix_b))) for r in group.itertuples()]

    def compose(group):
        import pandas as pd

        group = group.sort_values("no")
        one = group.iloc[0]
        ok = bool(group["ok"].all())
        values = as_values(Fragment.composed(fragments(group) if ok else [], tokenizers_of(path_a, path_b)), ok,
                           int(group["n_a"].sum()), int(group["n_b"].sum()))
        return pd.DataFrame([[one["k1"], one["k2"], one["id"], one["copies"], one["no"] // fan, *values]], columns=parts.names)

    def finish(group):
        import pandas as pd

        t = tokenizers_of(path_a, path_b)
        one = group.iloc[0]
        summary = fragments(group)[0].finished(t) if one["ok"] else None
        values = NOTHING if summary is None else _values(one["n_a"], one["n_b"], summary)
        return pd.DataFrame([[one["id"], *values]] * int(one["copies"]), columns=schema.names)

    # deal the ranges first: grouping deals by document, too
    tree = dealt.select("k1", "k2", "id", "copies", "no", "low", "start", "end", "data").mapInArrow(encode, parts)
    for _ in range(max(1, math.ceil(math.log(max(longest / size, 2)) / math.log(fan)))):
        tree = tree.groupBy("k1", "k2", F.floor(F.col("no") / fan).alias("_at")).applyInPandas(compose, parts)
    tree = tree.groupBy("k1", "k2").applyInPandas(finish, schema)
    return done.unionByName(tree).withColumnRenamed("id", id_col)


def _short(texts: list[str], t: Tokenizers) -> list[tuple]:
    found = t.encode(texts)
    good = [i for i, x in enumerate(texts) if x and found[i][2]]
    out = [NOTHING] * len(texts)
    if good:
        a, b = (np.concatenate([found[i][k] for i in good]) for k in range(2))
        aligned = Aligned(a, b, np.cumsum([1 + len(texts[i].encode()) for i in good]), t)
        for place, i in enumerate(good):
            summary = aligned.groups(place), int(aligned.n_groups[place]), *aligned.links(place)
            out[i] = _values(len(found[i][0]), len(found[i][1]), summary)
    return out


# --- counts over the corpus ------------------------------------------------------------


def link_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(code, a, b, n, best): each linked pair of ids with its links in all documents,
    and whether no other pair of the same b has more.  Tasks count their own rows
    before anything is shuffled; a b has at most as many pairs as A has ids."""

    def count(found):
        known, counted = np.zeros(0, np.int64), np.zeros(0, np.int64)
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(known), pa.array(counted)], names=["code", "n"])
        for batch in found:
            codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)
            counts = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32)
            known, place = np.unique(np.concatenate([known, codes]), return_inverse=True)
            counted = np.bincount(place, np.concatenate([counted, counts]), len(known)).astype(np.int64)
            if len(known) > PARTIAL:
                yield batch_of()
                known, counted = known[:0], counted[:0]
        yield batch_of()

    found = (aligned.where("ok").select("pairs", "counts").mapInArrow(count, "code long, n long")
             .groupBy("code").agg(F.sum("n").alias("n")))
    found = found.withColumn("a", F.expr(f"code div {size_b}")).withColumn("b", F.expr(f"code % {size_b}"))
    return found.select("code", "a", "b", "n", (F.col("n") == F.max("n").over(Window.partitionBy("b"))).alias("best"))


def with_counts(aligned: DataFrame, links: DataFrame, part_pairs: int = PART_PAIRS) -> DataFrame:
    """Add ``n_best`` (links whose pair is a best one of its b) and ``count_sum`` (of the
    pairs' counts over the links) to aligned documents, which lose ``pairs``.

    The counted pairs are broadcast, at most ``part_pairs`` at once; if there are more,
    the documents pass by them part by part."""
    spark = aligned.sparkSession
    total = links.count()
    n = max(1, -(-total // part_pairs))
    dealt = links.withColumn("part", F.lit(0))
    while n > 1:
        dealt = links.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(n)).cast("int"))
        if dealt.groupBy("part").count().agg(F.max("count")).first()[0] <= part_pairs:
            break
        n *= 2

    def pack(found):
        for batch in found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.asarray(batch.column(0)).tobytes()], pa.binary()), pa.array([np.asarray(batch.column(1)).tobytes()], pa.binary()),
                 pa.array([batch.column(2).to_numpy(zero_copy_only=False).tobytes()], pa.binary())], names=["codes", "n", "best"])

    def adder(part):
        def add(found):
            codes, n, best = part.value
            for batch in found:
                sums = np.zeros((2, len(batch)), np.int64)
                for i, (pairs, counts) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                    pairs, counts = np.frombuffer(pairs, np.int64), np.frombuffer(counts, np.int32)
                    at = np.minimum(np.searchsorted(codes, pairs), len(codes) - 1)
                    here = codes[at] == pairs if len(codes) else np.zeros(0, bool)
                    at, counts = at[here], counts[here].astype(np.int64)
                    sums[:, i] = counts[best[at]].sum(), (counts * n[at]).sum()
                before = [np.asarray(c) for c in batch.columns[-2:]]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-2], *[pa.array(x + y) for x, y in zip(before, sums)]], names=batch.schema.names)
        return add

    others = [c for c in aligned.columns if c not in ("pairs", "counts")]
    rows = aligned.select("pairs", "counts", *others, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    for part in range(n):
        packed = dealt.where(F.col("part") == part).select("code", "n", "best").mapInArrow(pack, "codes binary, n binary, best binary")
        packed = packed.collect()
        codes, ns, best = (np.concatenate([np.zeros(0, d), *[np.frombuffer(r[c], d) for r in packed]])
                           for c, d in (("codes", np.int64), ("n", np.int64), ("best", bool)))
        order = np.argsort(codes)
        value = spark.sparkContext.broadcast((codes[order], ns[order], best[order]))
        rows = rows.mapInArrow(adder(value), rows.schema)
        if n > 1:
            rows = rows.checkpoint(eager=True)
    return rows.drop("pairs", "counts")


def aligned_corpus(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                   part_pairs: int = PART_PAIRS, **options) -> DataFrame:
    """One row per document: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum`` and ``groups_sha256`` (empty without tokens).  Alignments are written
    once to the shared folder, with the digest in place of the groups' text."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    found = align(docs, path_a, path_b, id_col, text_col, **options)
    digest = F.when(F.col("ok"), F.sha2("groups", 256)).otherwise("")
    found.withColumn("groups_sha256", digest).drop("groups").write.option("compression", "zstd").parquet(path)
    found = spark.read.parquet(path)
    links = link_counts(found, tokenizers_of(path_a, path_b).size_b).checkpoint(eager=True)
    return with_counts(found, links, part_pairs).select(
        id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
