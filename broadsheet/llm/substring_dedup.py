"""Substring duplicates by recompression.

Words are named by their hashes. In each round every maximal run of one symbol is named by symbol and length, then every
pair of neighbours of which the first symbol is a left one and the second a right one (a bit of the symbol's name and
the round) becomes a symbol named by the two. Names are content hashes, so all tasks name alike without exchanging
tables, and equal substrings get equal symbols but near their ends: what a symbol is depends on its own words and a
bounded margin. Symbols of the last round reveal repeats: in every window the smallest of its inner symbols is its
anchor, and an anchor is keyed by the words from it on that every window that picks it has in common.

Spark then finds the keys that occur more than once in the corpus (first exchange), and for the windows of such anchors
only, which window hashes occur at an earlier place (second exchange). Removal is decided by the windows, which are
compared in full width: anchor key and window hash, 64 bits each, must both agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from broadsheet.llm import exchange as ex
from broadsheet.llm.common import mix, window_hashes
from broadsheet.llm.tokens import SPACE, Words, words

WINDOW = 20
ROUNDS = 2
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


class Symbols:
    """Symbols of some texts: ``name``, first word (``start``), the words that decide it (``low`` to ``high``), ``doc``."""

    def __init__(self, w: Words):
        n = len(w.hash)
        self.name, self.doc = w.hash, w.doc
        self.start = self.low = self.high = np.arange(n)
        self.words = n

    def pick(self, keep: np.ndarray, name, low, high) -> None:
        self.name, self.low, self.high = name[keep], low[keep], high[keep]
        self.start, self.doc = self.start[keep], self.doc[keep]

    def around(self) -> tuple[np.ndarray, np.ndarray]:
        """What the symbol before decides from on, and the symbol after up to; past a text's end, a word outside."""
        n, same = len(self.name), self.doc[1:] == self.doc[:-1]
        low, high = np.empty(n, np.int64), np.empty(n, np.int64)
        low[:1], high[-1:] = -1, self.words
        low[1:] = np.where(same, self.low[:-1], self.start[1:] - 1)
        high[:-1] = np.where(same, self.high[1:], self.start[1:])
        return low, high

    def round(self, turn: int) -> None:
        """Names maximal runs, then pairs of a left and a right symbol. A run is decided by its own words and its
        neighbours, a pair by its own, a left symbol without a partner also by the one after it, a right one by the one
        before it."""
        n = len(self.name)
        if not n:
            return
        first = np.ones(n, bool)
        first[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, n))
        before, after = self.around()
        low, high, name = self.low.copy(), self.high.copy(), self.name.copy()
        low[at] = np.minimum(low[at], before[at])
        high[at] = np.maximum(high[at + size - 1], after[at + size - 1])
        many = size > 1
        name[at[many]] = mix(name[at[many]], np.uint64(0xA5A5 + turn) * size[many].astype(np.uint64))
        self.pick(first, name, low, high)

        n = len(self.name)
        left = (mix(self.name, np.full(n, 77 + turn, np.uint64)) & np.uint64(1)).astype(bool)
        pair, second = np.zeros(n, bool), np.zeros(n, bool)
        pair[:-1] = left[:-1] & ~left[1:] & (self.doc[:-1] == self.doc[1:])
        second[1:] = pair[:-1]
        before, after = self.around()
        at = np.flatnonzero(pair)
        low, high, name = self.low.copy(), self.high.copy(), self.name.copy()
        alone = ~pair & ~second
        low[alone & ~left] = np.minimum(low, before)[alone & ~left]
        high[alone & left] = np.maximum(high, after)[alone & left]
        high[at] = np.maximum(high[at], high[at + 1])
        name[at] = mix(name[at], name[at + 1])
        self.pick(~second, name, low, high)


class Windows:
    """Windows of a block's texts: ``at`` (first word of each), ``hash``, ``anchor`` and ``key`` (its anchor's)."""

    def __init__(self, w: Words, size: int = WINDOW, rounds: int = ROUNDS):
        n = max(0, len(w.hash) - size + 1)
        self.at = np.flatnonzero(w.doc[:n] == w.doc[size - 1:size - 1 + n]) if n else np.empty(0, np.int64)
        self.hash = window_hashes(w.hash, size)[self.at]
        self.anchor, self.key = self.at, np.empty(0, np.uint64)
        if not len(self.at):
            return
        lead, room = plan(size)
        symbols = Symbols(w)
        for turn in range(rounds):
            symbols.round(turn)
        value = np.full(len(w.hash), NONE, np.uint64)
        value[symbols.start] = mix(symbols.name, np.full(len(symbols.name), 991, np.uint64)) >> np.uint64(1)
        low, high = np.zeros(len(w.hash), np.int64), np.zeros(len(w.hash), np.int64)
        low[symbols.start], high[symbols.start] = symbols.low, symbols.high
        best, anchor = np.full(len(self.at), NONE), self.at + lead
        for k in range(room):
            at = self.at + lead + k
            inner = value[at]
            less = (inner < best) & (low[at] >= self.at) & (high[at] < self.at + size)  # the leftmost of equals stays
            best[less], anchor[less] = inner[less], at[less]
        self.inner = best < NONE
        self.anchor = anchor
        self.key = mix(window_hashes(w.hash, size - room + 1)[anchor - lead], np.full(len(anchor), 4242, np.uint64))


NONE = np.uint64(np.iinfo(np.uint64).max)


def plan(size: int) -> tuple[int, int]:
    """(lead, room): anchors start at words ``lead`` to ``lead + room - 1`` of a window, so all windows of an anchor share
    the size - room + 1 words from ``lead`` words before it on. Those are its key."""
    return size // 5, max(1, size * 2 // 5)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    A word is removed when a window of ``size`` consecutive words over it has the word sequence of a window that starts
    earlier: in a row with a smaller id, or earlier in the same row. Windows are judged on the input. Null ids come
    after all others; rows that share an id are not earlier than one another but by their starts. Null and empty texts
    have no words and an empty ``kept``; an empty table gives none.
    """
    blocks, buckets = ex.blocks_of(docs, id_col, text_col)

    def ask_keys(block: ex.Block) -> list[tuple]:
        keys, counts = block_keys(Windows(words(block.text, SPACE), size))
        out = []
        for b, part in split(keys, buckets):
            out.append(ex.message(block.number, b, 0, keys[part].tobytes() + (counts[part] > 1).tobytes()))
        return out

    def find_shared(rows: list[tuple]) -> list[tuple]:
        keys = [np.frombuffer(body, np.uint64, len(body) // 9) for _, _, _, body in rows]
        many = [np.frombuffer(body, bool, len(body) // 9, len(body) // 9 * 8) for _, _, _, body in rows]
        shared = repeated(np.concatenate(keys), np.concatenate(many))
        return [ex.message(block, bucket, 0, np.packbits(s).tobytes())
                for (block, bucket, _, _), s in zip(rows, np.split(shared, np.cumsum([len(k) for k in keys])[:-1]), strict=True)]

    def ask_windows(block: ex.Block, replies: list[tuple]) -> list[tuple]:
        w = words(block.text, SPACE)
        v = Windows(w, size)
        asked, _ = candidates(v, replies, buckets)
        first, _ = block_firsts(block, w, v, asked)
        out = []
        for b, part in split(v.key[first], buckets):
            one = first[part]
            ids, starts = block.ids[w.doc[v.at[one]]], v.at[one] - w.first[w.doc[v.at[one]]]
            body = np.concatenate([v.key[one], v.hash[one], ids.view(np.uint64), starts.astype(np.uint64)])
            out.append(ex.message(block.number, b, 1, compact(body)))
        return out

    def find_earlier(rows: list[tuple]) -> list[tuple]:
        parts_ = [expand(body) for _, _, _, body in rows]
        key, hash_, ids, starts = (np.concatenate([p[i] for p in parts_]) for i in range(4))
        later = later_ones(key, hash_, ids.view(np.int64), starts.view(np.int64))
        return [ex.message(block, bucket, 1, np.packbits(s).tobytes())
                for (block, bucket, _, _), s in zip(rows, np.split(later, np.cumsum([len(p[0]) for p in parts_])[:-1]), strict=True)]

    def remove(block: ex.Block, replies: list[tuple]) -> pa.Table:
        w = words(block.text, SPACE)
        v = Windows(w, size)
        asked, _ = candidates(v, [r for r in replies if r[2] == 0], buckets)
        first, same = block_firsts(block, w, v, asked)
        elsewhere = np.zeros(len(first), bool)
        answers = {r[1]: r[3] for r in replies if r[2] == 1}
        for b, part in split(v.key[first], buckets):
            elsewhere[part] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=len(part)).astype(bool)
        group, later = same
        gone = asked[later | elsewhere[group]]
        cover = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(cover, v.at[gone], 1)
        np.add.at(cover, v.at[gone] + size, -1)
        removed = np.cumsum(cover[:-1]) > 0
        return kept_table(block, w, removed)

    shared = ex.answer(ex.ask(blocks, ask_keys), find_shared)
    earlier = ex.answer(ex.ask(blocks, ask_windows, shared), find_earlier)
    return ex.finish(blocks, shared.unionByName(earlier), remove, SCHEMA, lambda: kept_table(None, None, None))


def split(keys: np.ndarray, buckets: int):
    """(bucket, indices) for each bucket that has keys."""
    order, at = ex.deal(keys, buckets)
    for b in np.flatnonzero(np.diff(at)):
        yield int(b), order[at[b]:at[b + 1]]


def block_keys(v: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor keys of a block in order, and at how many anchors each occurs."""
    if not len(v.at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    new = np.ones(len(v.anchor), bool)
    new[1:] = v.anchor[1:] != v.anchor[:-1]  # windows that follow one another often share their anchor
    key = v.key[new]
    if np.any(np.diff(v.anchor) < 0):
        _, one = np.unique(v.anchor, return_index=True)
        key = v.key[one]
    return np.unique(key, return_counts=True)


def repeated(keys: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which keys occur again: in another place of the list, or already where they come from."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    again = many[order].copy()
    same = k[1:] == k[:-1]
    again[1:] |= same
    again[:-1] |= same
    out = np.empty(len(keys), bool)
    out[order] = again
    return out


def candidates(v: Windows, replies: list[tuple], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose anchor key occurs more than once, from the answers to the block's keys."""
    keys, _ = block_keys(v)
    shared = np.zeros(len(keys), bool)
    answers = {bucket: body for _, bucket, _, body in replies}
    for b, part in split(keys, buckets):
        shared[part] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=len(part)).astype(bool)
    if not len(keys):
        return np.empty(0, np.int64), keys
    return np.flatnonzero(shared[np.searchsorted(keys, v.key)]), keys


def block_firsts(block: ex.Block, w: Words, v: Windows, asked: np.ndarray):
    """Of the windows ``asked``: the first of each kind in the block, and for all of them (kind, later than the first)."""
    ids = block.ids[w.doc[v.at[asked]]]
    starts = v.at[asked] - w.first[w.doc[v.at[asked]]]
    order = np.lexsort((starts, ids, v.hash[asked], v.key[asked]))
    a = asked[order]
    new = np.ones(len(a), bool)
    new[1:] = (v.hash[a][1:] != v.hash[a][:-1]) | (v.key[a][1:] != v.key[a][:-1])
    kind = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    f = first[kind] if len(a) else first
    later_sorted = (ids[order] != ids[order][f]) | (starts[order] != starts[order][f]) if len(a) else np.empty(0, bool)
    group, later = np.empty(len(a), np.int64), np.empty(len(a), bool)
    group[order], later[order] = kind, later_sorted
    return a[first], (group, later)


def compact(body: np.ndarray) -> bytes:
    """Keys, hashes, ids and starts, as one array after another; ids and starts in the fewest bytes that hold them."""
    n = len(body) // 4
    key, hash_, ids, starts = (body[i * n:(i + 1) * n] for i in range(4))
    runs = np.ones(n, bool)
    runs[1:] = ids[1:] != ids[:-1]
    which = (np.cumsum(runs) - 1).astype(np.uint32)
    return b"".join([np.array([n, int(runs.sum())], np.uint32).tobytes(), key.tobytes(), hash_.tobytes(), ids[runs].tobytes(),
                     np.diff(which, prepend=np.uint32(0)).astype(np.uint8).tobytes(), starts.astype(np.uint32).tobytes()])


def expand(body: bytes):
    n, r = np.frombuffer(body, np.uint32, 2)
    n, r = int(n), int(r)
    key = np.frombuffer(body, np.uint64, n, 8)
    hash_ = np.frombuffer(body, np.uint64, n, 8 + 8 * n)
    ids = np.frombuffer(body, np.uint64, r, 8 + 16 * n)
    which = np.cumsum(np.frombuffer(body, np.uint8, n, 8 + 16 * n + 8 * r).astype(np.int64))
    starts = np.frombuffer(body, np.uint32, n, 8 + 17 * n + 8 * r).astype(np.uint64)
    return key, hash_, ids[which], starts


def later_ones(key: np.ndarray, hash_: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which windows have an equal one at a smaller (id, start)."""
    order = np.lexsort((starts, ids, hash_, key))
    k, h, i, s = key[order], hash_[order], ids[order], starts[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    f = np.flatnonzero(new)[np.cumsum(new) - 1] if len(k) else np.empty(0, np.int64)
    out = np.empty(len(k), bool)
    out[order] = (i != i[f]) | (s != s[f])
    return out


def kept_table(block: ex.Block | None, w: Words | None, removed: np.ndarray | None) -> pa.Table:
    """The result's rows: the bytes of the words left, each but a text's last with the byte behind it, as a space."""
    names = ["doc_id", "n_words", "n_removed", "kept"]
    if block is None:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names=names)
    n_words = w.counts()
    n_removed = np.bincount(w.doc[removed], minlength=len(n_words)).astype(np.int64)
    left = np.flatnonzero(~removed)
    last = np.ones(len(left), bool)
    last[:-1] = w.doc[left][1:] != w.doc[left][:-1]
    level = np.zeros(len(w.data) + 1, np.int8)
    end = w.end[left] + ~last  # with the space behind
    np.add.at(level, w.start[left], 1)
    np.add.at(level, end, -1)
    mask = np.cumsum(level[:-1], dtype=np.int8).astype(bool)
    data = w.data.copy()
    data[w.end[left[~last]]] = 32
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    offsets = total[w.offsets].astype(np.int32)
    kept = pa.StringArray.from_buffers(len(n_words), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[mask].tobytes()))
    return pa.table([block.doc_id, pa.array(n_words.astype(np.int64)), pa.array(n_removed), kept], names=names)
