"""Language-model scores from a log-frequency Bloom filter.

The filter holds, for each token and each pair of neighbours of the training texts, its count on a logarithmic scale:
an n-gram seen 2^q to 2^(q+1) - 1 times is entered with each of the levels 0 to q, so one seen once has a level of its
own. A count is read back by asking for level 0, 1, ... until one is missing, so errors can only raise it, and rarely by
more than one level. Probabilities are those of pairs, interpolated with smoothed ones of single tokens.

Counting is exact and covers all training texts: blocks of documents send their distinct n-grams and the counts of these
to buckets of keys. Each bucket makes its own segment of the filter, sized by the levels it enters, and answers the
blocks from it; so the filter grows with the n-grams, no process holds all of it and nothing is broadcast. The exact
counts of single tokens go back too, for the unigram score that is reported beside the model's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm import exchange as ex
from broadsheet.llm.common import mix
from broadsheet.llm.substring_dedup import split
from broadsheet.llm.tokens import SPACE, words

#: Bits of a segment for each level entered: with three probes, one in 200 keys that are not there is found.
BITS_PER_LEVEL = 16
PROBES = 3
SMOOTHING = 0.1
PAIR_SHARE = 0.6
END, START = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0x57A2757A2757A275)
SHORT = np.uint64((1 << 40) - 1)
SCHEMA = ("doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def pack(counts: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes that hold the largest; the first byte says how many."""
    kind = np.min_scalar_type(int(counts.max()) if len(counts) else 0)
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def unpack(body: bytes) -> np.ndarray:
    return np.frombuffer(body, f"<u{body[0]}", offset=1).astype(np.int64)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as the gaps between them, in the fewest bytes that hold the largest; the first byte says how many."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = (int(gaps.max()).bit_length() + 7) // 8 if len(gaps) else 0
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(body: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    """The ``n`` keys packed from byte ``at`` on, and where they end."""
    width = body[at]
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(body, np.uint8, n * width, at + 1).reshape(n, width)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64), at + 1 + n * width


class Tokens:
    """A block's tokens: the words of each text in order, then one end."""

    def __init__(self, block: ex.Block):
        w = words(block.text, SPACE, lower=True)
        n = len(w.first) - 1
        ends = w.first[1:] + np.arange(n)  # where the ends go
        self.n = w.counts() + 1
        self.hash = np.empty(len(w.hash) + n, np.uint64)
        is_end = np.zeros(len(self.hash), bool)
        is_end[ends] = True
        self.hash[is_end], self.hash[~is_end] = END, w.hash
        self.doc = np.repeat(np.arange(n), self.n)
        before = np.empty(len(self.hash), np.uint64)
        before[1:] = self.hash[:-1]
        first = np.concatenate([[0], ends[:-1] + 1]) if n else ends
        before[first] = START
        self.before = before
        self.pair = mix(before, self.hash)


def counted(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sum of their weights, and where each key is among them."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, weight, len(distinct)).astype(np.int64), inverse


def n_levels(counts: np.ndarray) -> np.ndarray:
    """How many levels a count is entered with."""
    return np.frexp(counts.astype(np.float64))[1]


class Filter:
    """Segments of equal size; a key's segment is that of its bucket. A bucket's own filter is one segment. Places depend
    on the key's lower 40 bits, which is what travels of a pair; the bucket, of which there are more in larger tables,
    tells apart the rest."""

    def __init__(self, bits: bytes | None, buckets: int, segment: int):
        self.buckets, self.size = buckets, segment
        self.bits = np.frombuffer(bits, np.uint8) if bits is not None else np.zeros(segment // 8, np.uint8)
        self.top = 62 if bits is not None else -1  # no level above it has been entered

    @classmethod
    def of(cls, counts: list[np.ndarray]) -> Filter:
        """An empty filter of one segment with room for n-grams that occur so often."""
        return cls(None, 1, 64 + 8 * (int(sum(n_levels(c).sum() for c in counts)) * BITS_PER_LEVEL // 8))

    def places(self, keys: np.ndarray, level: int) -> np.ndarray:
        a = mix(keys & SHORT, np.full(len(keys), 2 * level + 1, np.uint64))
        b = mix(a, np.full(len(keys), 0xB10C, np.uint64)) | np.uint64(1)
        at = (a + np.arange(PROBES, dtype=np.uint64)[:, None] * b) % np.uint64(self.size)
        return at + (keys >> np.uint64(40)) % np.uint64(self.buckets) * np.uint64(self.size)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Enters keys with their counts."""
        level, left = 0, counts >= 1
        while left.any():
            at = self.places(keys[left], level).ravel()
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
            self.top = max(self.top, level)
            level += 1
            left = counts >= 1 << level

    def read(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, -1 for one never seen, by asking for one level after the other up to the largest entered."""
        out = np.full(len(keys), -1)
        left, level = np.arange(len(keys)), 0
        while len(left) and level <= self.top:
            at = self.places(keys[left], level)
            found = ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
            left = left[found]
            out[left] = level
            level += 1
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, where never seen and seen once are alike."""
        return np.maximum(self.read(keys), 0)


def expected(levels: np.ndarray) -> np.ndarray:
    """The count that stands for a level: the middle of its range; 0 for one never seen."""
    return np.where(levels >= 0, 1.5 * np.exp2(levels) - 0.5, 0.0)


def both_split(tokens: np.ndarray, pairs: np.ndarray, buckets: int):
    """(bucket, indices of tokens, indices of pairs) for each bucket that has either, both in the order of the bits that
    travel; the keys themselves are in order."""
    one, two, none = dict(split(tokens, buckets)), dict(split(pairs, buckets)), np.empty(0, np.int64)
    for b in sorted({*one, *two}):
        other = two.get(b, none)
        yield b, one.get(b, none), other[np.argsort(pairs[other] & SHORT, kind="stable")]


def question(tokens: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray) -> bytes:
    """Distinct tokens and pairs of a block, in order, and how often its training texts hold each."""
    return (np.array([len(tokens), len(pairs)], np.uint64).tobytes() + pack_sorted(tokens) + pack_sorted(pairs & SHORT) + pack(counts) + pack(pair_counts))


def read_question(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m = (int(x) for x in np.frombuffer(body, np.uint64, 2))
    tokens, at = unpack_sorted(body, n, 16)
    pairs, at = unpack_sorted(body, m, at)
    end = at + 1 + body[at] * n
    return tokens, unpack(body[at:end]), pairs, unpack(body[end:])


def fit_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens (words and the end), n_known (tokens that training texts
    have), train_tokens (all training tokens), base_score (log10 of the smoothed unigram probability, from exact counts)
    and score (the filter model's log10 probability).

    Learns from the rows for which ``train``, a condition on the id column ``doc_id``, holds (null: no). Null and empty
    texts are an end only. Without training texts all counts are 0. Repeated rows count as often as they occur.
    """
    blocks, buckets = ex.blocks_of(docs, id_col, text_col, learn=F.coalesce(train, F.lit(False)))

    def ask(block: ex.Block) -> list[tuple]:
        t = Tokens(block)
        learn = np.repeat(block.extra("learn"), t.n)
        tokens, pairs = (counted(x, learn)[:2] for x in (t.hash, t.pair))
        return [ex.message(block.number, b, 0, question(*(x[part] for x in tokens), *(x[other] for x in pairs)))
                for b, part, other in both_split(tokens[0], pairs[0], buckets)]

    def answer(rows: list[tuple]) -> list[tuple]:
        bucket = rows[0][1]
        asked = [read_question(r[3]) for r in rows]
        (keys, counts, inverse), (pairs, pair_counts, pair_inverse) = (
            counted(np.concatenate([a[i] for a in asked]), np.concatenate([a[i + 1] for a in asked])) for i in (0, 2))
        made = Filter.of([counts, pair_counts])
        made.add(keys, counts)
        made.add(pairs, pair_counts)
        exact, single, both = counts[inverse], made.read(keys).astype(np.int8)[inverse], made.read(pairs).astype(np.int8)[pair_inverse]
        out, at, pair_at = [], 0, 0
        for r, a in zip(rows, asked, strict=True):
            k, m = len(a[0]), len(a[2])
            out.append(ex.message(r[0], bucket, 0, single[at:at + k].tobytes() + both[pair_at:pair_at + m].tobytes() + pack(exact[at:at + k])))
            at, pair_at = at + k, pair_at + m
        return out

    def add_up(table: pa.Table) -> pa.Table:
        """The tokens of a bucket and how many distinct ones training texts have."""
        asked = [read_question(body) for body in table.column("body").to_pylist()]
        counts = counted(*(np.concatenate([a[i] for a in asked]) for i in (0, 1)))[1]
        return pa.table([pa.array([int(counts.sum())]), pa.array([int((counts > 0).sum())])], names=["tokens", "distinct"])

    # Both read one exchange of the questions, and the totals reach the blocks as a subquery: nothing is stored or dealt twice.
    questions = ex.ask(blocks, ask)
    replies = ex.answer(questions, answer)
    totals = questions.groupBy("bucket").applyInArrow(add_up, "tokens bigint, distinct bigint").agg(F.array(F.sum("tokens"), F.sum("distinct")))
    blocks = blocks.withColumn("totals", totals.scalar())

    def score(block: ex.Block, answers: list[tuple]) -> pa.Table:
        t = Tokens(block)
        all_tokens, all_distinct = block.table.column("totals")[0].as_py()
        floor = all_tokens + SMOOTHING * (all_distinct + 1)
        n_docs = len(block.ids)
        keys, inverse = np.unique(t.hash, return_inverse=True)
        pairs, where = np.unique(t.pair, return_inverse=True)
        exact, levels, pair_levels = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(pairs), np.int64)
        found = {r[1]: r[3] for r in answers}
        for b, part, other in both_split(keys, pairs, buckets):
            k, m = len(part), len(other)
            levels[part], pair_levels[other] = np.frombuffer(found[b], np.int8, k), np.frombuffer(found[b], np.int8, m, k)
            exact[part] = unpack(found[b][k + m:])
        known = exact[inverse]
        base = np.bincount(t.doc, np.log10((exact + SMOOTHING) / floor)[inverse], n_docs)
        single = expected(levels)
        starts = single[np.searchsorted(keys, END)]  # as many texts begin as end
        both = expected(pair_levels)[where]
        context = np.empty(len(t.hash))
        context[1:] = single[inverse][:-1]
        context[t.before == START] = starts
        p = PAIR_SHARE * np.minimum(1.0, both / np.maximum(context, 1.0)) + (1 - PAIR_SHARE) * np.minimum(1.0, (single[inverse] + SMOOTHING) / floor)
        return pa.table([block.doc_id, pa.array(t.n.astype(np.int64)), pa.array(np.bincount(t.doc, known > 0, n_docs).astype(np.int64)),
                         pa.array(np.full(n_docs, all_tokens, np.int64)), pa.array(base), pa.array(np.bincount(t.doc, np.log10(p), n_docs))], names=names())

    return ex.finish(blocks, replies, score, SCHEMA, lambda: pa.table([pa.array([], f.type) for f in ARROW], names=names()))


ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                   ("base_score", pa.float64()), ("score", pa.float64())])


def names() -> list[str]:
    return ARROW.names
