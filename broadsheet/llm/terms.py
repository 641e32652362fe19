"""Terms of whole batches as Arrow arrays: the words themselves, exactly, not hashes of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from broadsheet.llm.tokens import text_bytes

_AZ = np.arange(256, dtype=np.uint8)
_AZ[65:91] += 32


@dataclass
class Spans:
    """Words of some texts end to end. ``data``: their bytes, nothing between them; ``at``: where each starts in
    ``data`` (one more at the end); ``doc``: index of the text of each; ``n``: words of each text."""

    data: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    n: np.ndarray

    def strings(self) -> pa.Array:
        """The words as a column."""
        return pa.LargeStringArray.from_buffers(len(self.doc), pa.py_buffer(self.at.astype(np.int64)), pa.py_buffer(self.data))


def spans(column: pa.Array, parting: np.ndarray) -> Spans:
    """Longest runs of bytes that ``parting`` (by byte) does not hold, in a text column without nulls; A-Z become a-z."""
    data, offsets = text_bytes(column)
    texts = len(offsets) - 1
    if not len(data):
        return Spans(data, np.zeros(1, np.int64), np.empty(0, np.int64), np.zeros(texts, np.int64))
    inside = ~parting[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    begins[edge] = inside[edge]  # a text's first byte never continues the text before
    start = np.flatnonzero(begins)
    before = np.cumsum(inside, dtype=np.int64)  # bytes of words up to and with each byte
    at = np.append(before[start] - 1, before[-1])
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Spans(_AZ[data[inside]], at, doc, np.bincount(doc, minlength=texts))


def runs(s: Spans, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of ``size`` consecutive words of one text, joined by one space: their words' (start, end) in a text of
    all words with a space after each, that text, and the text index of each run."""
    if size == 1:
        return s.at[:-1], s.at[1:], s.data, s.doc
    spaced = np.insert(s.data, s.at[1:], 32)
    first = s.at[:-1] + np.arange(len(s.doc))
    end = s.at[1:] + np.arange(len(s.doc))
    n = max(0, len(s.doc) - size + 1)
    whole = s.doc[:n] == s.doc[size - 1:size - 1 + n]
    return first[:n][whole], end[size - 1:size - 1 + n][whole], spaced, s.doc[:n][whole]
