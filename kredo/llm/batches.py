"""Arrow text columns as byte arrays with the places of their words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Bytes of text that are worked on at once; a longer document is a slice by itself.
SLICE_BYTES = 8 << 20


class Texts:
    """Some documents' texts: ``data`` (bytes, 8 zero bytes at the end), ``bounds`` of
    the documents, and of each word ``start``, ``length`` and ``doc``; ``first`` is
    the first word of each document, with the number of words at the end."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.bounds, self.n_docs = bounds, len(bounds) - 1
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        n = len(data)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.length = np.flatnonzero(ends) + 1 - self.start
        self.first = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))


def slices(batch: pa.RecordBatch, column: str = "text"):
    """Yield (first row, end row, Texts) for a batch, about SLICE_BYTES at a time."""
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
        yield row, end, Texts(data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row])
        row = end
