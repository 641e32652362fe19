"""Words of whole batches as numpy arrays, straight from Arrow's UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from broadsheet.llm.common import SPACES, mix

_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
_SYMBOL = np.ones(256, bool)  # everything but digits, a-z (and, once lower-cased, A-Z) and bytes from 0x80
_SYMBOL[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: What parts words: white space, or everything in ASCII but letters and digits.
SPACE, SYMBOL = _SPACE, _SYMBOL

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _RANDOM.copy()
_FOLDED[65:91] = _RANDOM[97:123]  # A-Z hash as a-z
#: Bytes hashed at once; longer texts are gone through in pieces, so memory follows the batch and not the powers.
_PIECE = 1 << 20
_POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_PIECE, _BASE))])
_BACK = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_PIECE, _INVERSE))])


@dataclass
class Words:
    """Words of some texts in order. ``doc``: index of the text of each; ``start``, ``end``: its bytes in ``data``;
    ``first``: index of the first word of each text, and the number of all words at the end."""

    data: np.ndarray
    offsets: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column end to end, and where each text starts (one offset more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def words(column: pa.Array, parting: np.ndarray = SPACE, lower: bool = False) -> Words:
    """The words of a column without nulls: longest runs of bytes that ``parting`` does not hold. With ``lower``, A-Z
    count as a-z in the hashes (polynomial over random byte values, 64 bits, then mixed with the length)."""
    data, offsets = text_bytes(column)
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(data, offsets, np.empty(0, np.uint64), none, none, none, np.zeros(len(offsets), np.int64))
    inside = ~parting[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < n]
    begins[edge] = inside[edge]  # a text's first byte never continues the text before
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    before = edge[edge > 0] - 1
    ends[before] = inside[before]
    end = np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(offsets)))
    return Words(data, offsets, _hashes(data, start, end, _FOLDED if lower else _RANDOM), doc, start, end, first)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        low = start[i]
        j = int(np.searchsorted(end, low + _PIECE, side="right"))
        if j <= i:  # a word longer than a piece: piece by piece
            out[i] = _long(data[low:end[i]], values)
            i += 1
            continue
        high = end[j - 1]
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[data[low:high]] * _POWERS[:high - low], out=sums[1:])
        s, e = start[i:j] - low, end[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * _BACK[s], (e - s).astype(np.uint64))
        i = j
    return out


def _long(data: np.ndarray, values: np.ndarray) -> np.uint64:
    """A long word's hash: its pieces' sums, each with its own power, are the same polynomial."""
    total, power = np.uint64(0), 1
    for at in range(0, len(data), _PIECE):
        part = values[data[at:at + _PIECE]] * _POWERS[:min(_PIECE, len(data) - at)]
        total = np.uint64((int(total) + int(part.sum(dtype=np.uint64)) * power) & (2**64 - 1))
        power = power * int(_POWERS[_PIECE]) & (2**64 - 1)
    return mix(np.array([total]), np.array([len(data)], np.uint64))[0]


def within(w: Words, size: int, n: int) -> np.ndarray:
    """Which of the first ``n`` runs of ``size`` words lie in one text."""
    return w.doc[:n] == w.doc[size - 1:size - 1 + n]
