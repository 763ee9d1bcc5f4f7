"""Terms of Arrow text columns: runs of digits, letters and characters beyond ASCII."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kredo.llm.batches import SLICE_BYTES
from kredo.llm.substring_dedup import _word_hashes
from kredo.llm.text import whole

# Bytes of terms, and each byte with A-Z lower-cased.  In UTF-8 every byte of a
# character beyond ASCII is 128 or more, so bytes decide as characters do.
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[65:91] = INSIDE[97:123] = INSIDE[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """The terms of a text as an array, in order; a null text has none."""
    lower = F.translate(whole(text), UPPER_LETTERS, LOWER_LETTERS)
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


class Terms:
    """Some documents' texts in lower case: ``data`` (8 zero bytes at the end), and of
    each term ``start``, ``length``, ``doc``; ``first`` is the first term of each
    document, with the number of terms at the end; ``bounds`` are the documents'."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.bounds, self.n_docs, n = bounds, len(bounds) - 1, len(data)
        self.data = np.concatenate([LOWER[data], np.zeros(8, np.uint8)])
        inside = INSIDE[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.length = np.flatnonzero(ends) + 1 - self.start
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return _word_hashes(self, 0)

    def term(self, i: int) -> bytes:
        a = int(self.start[i])
        return self.data[a:a + int(self.length[i])].tobytes()


def slices(batch: pa.RecordBatch, column: str = "text"):
    """Yield (first row, end row, Terms) for a batch, about SLICE_BYTES at a time; a
    longer document is a slice by itself."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, end, Terms(data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row])
        row = end


def hash_of(term: bytes) -> int:
    """The hash that ``Terms.hashes`` gives a term, as a signed 64-bit number."""
    data = np.frombuffer(term, np.uint8)
    return int(Terms(data, np.array([0, len(data)])).hashes().view(np.int64)[0])
