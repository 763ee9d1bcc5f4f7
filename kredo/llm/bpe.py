"""Byte-level BPE encoding and decoding, long texts by tree concatenation."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from kredo.llm.text import row_keys, whole
from kredo.session import ship_package

PIECE = 1 << 15          # characters of a piece of a long text
LOOK_AHEAD = 8           # characters past a boundary that can move it; three are used by contractions
AGREE = 4                # tokens that must agree on each side of a window inside a word
LONG_WORD = 2048         # characters from which a joined word is spliced, not encoded anew

# The pattern splits before a single space between two other characters whatever
# comes before or after, so text falls there into chunks of their own.
CHUNK = re.compile(r"(?<=\S)(?= \S)")
# The pattern of byte-level BPE, and the bytes that stand for themselves.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
# What the fast encoder is not given: characters whose class may differ between
# versions of the character database, and runs that it would take long for.
NOT_FAST = re.compile(r"[^\x00-\u024f]")
LONG_RUN = re.compile(r"\S{2048}|\s{2048}")


class Codec:
    """A tokenizer file of the byte-level BPE kind, as its library reads it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" \
                or spec["pre_tokenizer"].get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path}: a byte-level BPE tokenizer without normalizer or prefix space is needed")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.raw = Tokenizer.from_file(path)
        self.raw.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.raw.encode_special_tokens = True
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.fast = self._fast(spec)

    @staticmethod
    def _fast(spec):
        """The same merges in an encoder that is several times as fast; none if ids
        don't follow the order of merges."""
        import tiktoken

        shown = {chr(b): b for b in PRINTED}
        shown.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(PRINTED)))})
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        made = [vocab.get(a + b) for a, b in pairs]
        if made != list(range(len(vocab) - len(pairs), len(vocab))) or spec["model"].get("ignore_merges"):
            return None
        ranks = {bytes(shown[c] for c in token): i for token, i in vocab.items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, as the library's; texts that the fast encoder may split
        otherwise, and those with special tokens, go to the library itself."""
        out: list = [None] * len(texts)
        other = []
        for i, text in enumerate(texts):
            if self.fast is None or NOT_FAST.search(text) or LONG_RUN.search(text) or any(s in text for s in self.special):
                other.append(i)
            else:
                out[i] = self.fast.encode_ordinary(text)
        for i, e in zip(other, self.tok.encode_batch([texts[i] for i in other], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)

    def words(self, text: str) -> list[int]:
        """Where the pattern's words start in the text."""
        return [a for _, (a, _) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def piece(self, text: str) -> "Encoded":
        """A text without special tokens, encoded as one."""
        starts = self.words(text)
        ends = [*starts[1:], len(text)]
        ids = [e.ids for e in self.raw.encode_batch([text[a:b] for a, b in zip(starts, ends)], add_special_tokens=False)]
        return Encoded(text, starts, ids)

    def text_of(self, ids: list[int]) -> str | None:
        """The text of some tokens of one text; None if a character is cut."""
        text = self.raw.decode(ids, skip_special_tokens=False)
        return None if "\ufffd" in text else text

    def spliced(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of one word from the ids of its two parts: a window around the join is
        encoded anew and grows until its outer tokens are those of both parts."""
        width = 2 * AGREE
        while True:
            a, b = max(len(left) - width, 0), min(width, len(right))
            text = self.text_of(left[a:] + right[:b])
            if text is not None:
                ids = self.raw.encode(text, add_special_tokens=False).ids
                if (a == 0 or ids[:AGREE] == left[a:a + AGREE]) and (b == len(right) or ids[-AGREE:] == right[b - AGREE:b]):
                    return left[:a] + ids + right[b:]
            elif a == 0 and b == len(right):
                return None
            width = width * 2 if text is not None else width + 1


class Encoded:
    """A text with the starts of its words and the ids of each."""

    def __init__(self, text: str, starts: list[int], ids: list[list[int]]):
        self.text, self.starts, self.ids = text, starts, ids

    def join(self, other: "Encoded", codec: Codec) -> "Encoded":
        """The encoding of both texts as one.

        The pattern reads from left to right and, from the start of a word, sees
        only what follows.  The last word start of the left text that lies
        LOOK_AHEAD or more before its end is one of the joined text too.  From there
        the text is split anew, over a window that grows into the right text until a
        word starts where one starts there: from that place on both agree."""
        if not self.text or not other.text:
            return other if not self.text else self
        n = len(self.text)
        keep = len(self.starts) - 1
        while keep > 0 and self.starts[keep] > n - LOOK_AHEAD:
            keep -= 1
        from_ = self.starts[keep]
        width = 2
        while True:
            end = other.starts[width] if width < len(other.starts) else len(other.text)
            window = self.text[from_:] + other.text[:end]
            last = len(window) - (LOOK_AHEAD if end < len(other.text) else 0)
            known = {s + n - from_: i for i, s in enumerate(other.starts[:width + 1])}
            known[len(other.text) + n - from_] = len(other.starts)
            places = [*codec.words(window), len(window)]
            meet = next((p for p in places if p >= n - from_ and p in known and p <= last), None)
            if meet is not None:
                break
            width *= 2
        starts = places[:places.index(meet)]
        ids = []
        for a, b in zip(starts, [*starts[1:], meet]):
            ids.append(self._word(other, window, a, b, n - from_, codec))
        later = known[meet]
        return Encoded(self.text + other.text,
                       self.starts[:keep] + [s + from_ for s in starts] + [s + n for s in other.starts[later:]],
                       self.ids[:keep] + ids + other.ids[later:])

    def _word(self, other, window, a, b, cut, codec):
        if a < cut < b and b - a > LONG_WORD:
            # a long word made of the left text's last word and the right one's first
            whole_left = self.starts[-1] == a + len(self.text) - cut
            first_end = other.starts[1] if len(other.starts) > 1 else len(other.text)
            if whole_left and first_end == b - cut:
                done = codec.spliced(self.ids[-1], other.ids[0])
                if done is not None:
                    return done
        return codec.raw.encode(window[a:b], add_special_tokens=False).ids


def concatenated(pieces: list[Encoded], codec: Codec) -> list[int]:
    """Join neighbours pairwise, level by level, to one list of ids."""
    while len(pieces) > 1:
        pieces = [pieces[i].join(pieces[i + 1], codec) if i + 1 < len(pieces) else pieces[i]
                  for i in range(0, len(pieces), 2)]
    return [t for ids in pieces[0].ids for t in ids] if pieces else []


def _open_ends(text: str, codec: Codec) -> dict:
    """A piece as its text up to the first place where the pattern splits whatever
    comes before, the ids from there to the last such place, and the text after it.
    Ends that are long are encoded word by word here, in the piece's own task."""
    places = [m.start() for m in CHUNK.finditer(text)]
    low, high = (places[0], places[-1]) if places else (len(text), len(text))
    ends = {"head": text[:low], "tail": text[high:] if places else ""}
    out = {"closed": bool(places), "ids": codec.encode([text[low:high]])[0], **ends}
    for end, part in ends.items():
        done = codec.piece(part) if len(part) > LONG_WORD else None
        out[end + "_starts"] = done and done.starts
        out[end + "_counts"] = done and [len(x) for x in done.ids]
        out[end + "_ids"] = done and [t for x in done.ids for t in x]
    return out


def _end_of(piece, end: str, codec: Codec) -> Encoded:
    starts, counts, ids = (getattr(piece, f"{end}_{c}") for c in ("starts", "counts", "ids"))
    if starts is None:
        return codec.piece(getattr(piece, end))
    at = [0, *np.cumsum(counts).tolist()]
    flat = [int(t) for t in ids]
    return Encoded(getattr(piece, end), [int(s) for s in starts], [flat[a:b] for a, b in zip(at[:-1], at[1:])])


def _run(ends: list, codec: Codec) -> list[int]:
    """Ids of the text between two places of splitting, which pieces share."""
    text = "".join(getattr(p, e) for p, e in ends)
    if len(text) <= LONG_WORD:
        return codec.encode([text])[0] if text else []
    return concatenated([_end_of(p, e, codec) for p, e in ends], codec)


def joined_pieces(pieces: list, codec: Codec) -> list[int]:
    """Ids of one text from its pieces in order (rows as of ``_open_ends``)."""
    ids: list[int] = []
    run: list = []
    for p in pieces:
        run.append((p, "head"))
        if p.closed:
            ids += _run(run, codec)
            ids += [int(t) for t in p.ids]
            run = [(p, "tail")]
    return ids + _run(run, codec)


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"    # a task has one core
    return Codec(path)


def _ids_array(ids: list[list[int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                  piece: int = PIECE) -> DataFrame:
    """One row per input row: id, ``ids`` (array of int) and ``decoded``, as the
    library's encode without added special tokens and its decode that skips none.

    ``tokenizer`` is the path of the file on every executor.  Texts of up to
    ``piece`` characters are encoded where they are read.  A longer one is cut into
    pieces that are dealt over the cluster and encoded in parallel.  Between two
    pieces, the text from the last place of the one to the first of the other where
    the pattern splits whatever comes before is encoded as one; where text goes on
    unsplit for long, over whole pieces too, its parts are concatenated as a tree,
    and around each join a growing window is encoded anew until it agrees with both
    sides.  Strings of special tokens in a text are
    such tokens, as in the library; pieces do not cross them.

    Null texts count as empty and have no ids; equal rows are encoded each; an empty
    table gives an empty one; other columns are not read."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer, encoding="utf-8") as f:
        special = [(t["content"], t["id"]) for t in json.load(f)["added_tokens"]]
    base = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    schema = StructType([base.schema["id"], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])

    def short(found):
        codec = codec_of(tokenizer)
        for batch in found:
            for low in range(0, len(batch), 256):
                ids = codec.encode(batch.column(1).slice(low, 256).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, 256), _ids_array(ids), pa.array(codec.decode(ids), pa.string())],
                    names=["id", "ids", "decoded"])

    done = base.where(F.length("text") <= piece).mapInArrow(short, schema)

    long = base.where(F.length("text") > piece).select("id", *row_keys(F.col("id"), F.col("text")), "text")
    if len(special) == 1:
        quoted = re.escape(special[0][0]).replace("'", "\\\\'")
        parts = F.split("text", quoted)
    elif not special:
        parts = F.array("text")
    else:
        raise ValueError("tokenizer files with more than one added token are not supported")
    cut = F.expr(f"""transform(sequence(0, greatest(0, (char_length(part) - 1) div {int(piece)})),
        i -> substring(part, i * {int(piece)} + 1, {int(piece)}))""")
    pieces = (long.select("id", "k1", "k2", F.posexplode(parts).alias("part_no", "part"))
              .select("id", "k1", "k2", "part_no", F.posexplode(cut).alias("no", "piece"))
              .groupBy("k1", "k2", "part_no", "no", "piece").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))

    lists = ["head_starts", "head_counts", "head_ids", "tail_starts", "tail_counts", "tail_ids"]

    def encoded(found):
        codec = codec_of(tokenizer)
        for batch in found:
            for i in range(len(batch)):
                done = _open_ends(batch.column(4)[i].as_py(), codec)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(i, 1) for c in (0, 1, 2, 3, 5, 6)], pa.array([done["closed"]]),
                     pa.array([done["head"]], pa.string()), pa.array([done["tail"]], pa.string()),
                     *[pa.array([done[c]], pa.list_(pa.int32())) for c in ("ids", *lists)]],
                    names=with_ids.names)

    with_ids = StructType(
        [f for f in pieces.schema.fields if f.name != "piece"]
        + [StructField("closed", BooleanType()), StructField("head", StringType()), StructField("tail", StringType())]
        + [StructField(c, ArrayType(IntegerType())) for c in ("ids", *lists)])

    def joined(group):
        import pandas as pd

        codec = codec_of(tokenizer)
        ids: list[int] = []
        for part_no, rows in group.sort_values(["part_no", "no"]).groupby("part_no", sort=True):
            if part_no:
                ids.append(special[0][1])
            ids += joined_pieces(list(rows.itertuples()), codec)
        n = int(group["copies"].max())
        return pd.DataFrame({"id": [group["id"].iloc[0]] * n, "ids": [ids] * n, "decoded": codec.decode([ids]) * n})

    tree = pieces.mapInArrow(encoded, with_ids).groupBy("k1", "k2").applyInPandas(joined, schema)
    return done.unionByName(tree).withColumnRenamed("id", id_col)
