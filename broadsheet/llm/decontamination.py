"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

A test item's n-grams are its seeds, however common. One pass over the corpus looks each text's n-grams up among them.
Where some are found, the item is a candidate; it is aligned with the words around them, so that edited and paraphrased
copies score by the words they kept. No alignment scores more than the item has words in common with what it is aligned
with, so an item that has too few in common with the text, or with the words around the seeds, is left without one:
that is what keeps common seeds cheap, and it drops no match. Items whose size is not known to be small are taken in
blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import filter_rows, map_batches, narrow, window_hashes
from broadsheet.llm.tokens import SYMBOL, Words, within, words

SEED = 4
#: Share of the greatest possible score from which on a text counts as holding an item.
THRESHOLD = 0.5
#: Shorter items hold too little to be told from chance and match nothing.
MIN_WORDS = 8
MATCH, MISMATCH, GAP = 1, -1, -1
#: Bytes of item text that one pass broadcasts.
BLOCK_BYTES = 8_000_000
SCHEMA = "doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint"


class Items:
    """Word hashes of the items of one block, and their seeds: ``seed`` (sorted), ``item`` and ``at`` of each.
    ``vocabulary`` holds the distinct words, ``word`` (from ``first``) the place in it of each item's."""

    def __init__(self, ids: list[int], texts: list[str]):
        w = words(pa.array(texts, pa.string()), SYMBOL, lower=True)
        self.ids = ids
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.first = w.first
        self.vocabulary, self.word = np.unique(w.hash, return_inverse=True)
        seeds, item, at = [], [], []
        for i, x in enumerate(self.words):
            if len(x) >= MIN_WORDS:
                g = window_hashes(x, SEED)
                seeds.append(g)
                item.append(np.full(len(g), i))
                at.append(np.arange(len(g)))
        self.seed, self.item, self.at = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((seeds, np.uint64), (item, int), (at, int)))
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item, self.at = self.seed[order], self.item[order], self.at[order]
        self.by_item = np.argsort(self.item, kind="stable")  # within an item by seed
        self.own = np.searchsorted(self.item[self.by_item], np.arange(len(ids) + 1))

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places in the texts whose n-gram is a seed, and the first such seed."""
        g = window_hashes(w.hash, SEED)
        if not len(g) or not len(self.seed):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        low = np.minimum(np.searchsorted(self.seed, g), len(self.seed) - 1)
        place = np.flatnonzero((self.seed[low] == g) & within(w, SEED, len(g)))
        return place, low[place]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, and the first and last word of the text it takes in."""
    n = len(text)
    above, begin_above = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, -1)
    slope = np.arange(n + 1) * -GAP
    for x in item:
        diagonal = above[:-1] + np.where(text == x, MATCH, MISMATCH)
        here, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
        here[1:] = np.maximum(diagonal, above[1:] + GAP)
        begin[1:] = np.where(diagonal >= above[1:] + GAP, begin_above[:-1], begin_above[1:])
        fresh = here <= 0
        here[fresh] = 0
        begin[fresh] = np.arange(n + 1)[fresh]
        # gaps in the item: the best of all cells to the left, less one for each step
        level = here + slope
        run = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == run, np.arange(n + 1), 0))
        here, begin = run - slope, begin[source]
        at = int(np.argmax(here))
        if here[at] > best[0]:
            best = (int(here[at]), int(begin[at]), at - 1)
        above, begin_above = here, begin
    return best


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers from each ``low`` to below its ``high``, end to end."""
    n = high - low
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def candidates(items: Items, seeds: np.ndarray, text: np.ndarray, threshold: float) -> np.ndarray:
    """Items with one of ``seeds`` of whose words enough occur in the text for a match."""
    seeds = np.unique(seeds)
    some = np.unique(items.item[ranges(np.searchsorted(items.seed, seeds), np.searchsorted(items.seed, seeds, side="right"))])
    there = np.zeros(len(items.vocabulary), bool)
    at = np.minimum(np.searchsorted(items.vocabulary, text), len(there) - 1)
    there[at[items.vocabulary[at] == text]] = True
    size = items.first[some + 1] - items.first[some]
    shared = np.add.reduceat(there[items.word[ranges(items.first[some], items.first[some + 1])]].astype(np.int64), np.cumsum(size) - size)
    return some[shared >= threshold * size]


def matches(items: Items, w: Words, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first and last word) of every text and item that align well; the best place of each."""
    place, low = items.hits(w)
    if not len(place):
        return []
    found = items.seed[low]
    docs, at = np.unique(w.doc[place], return_index=True)
    out = []
    for doc, a, b in zip(docs.tolist(), at.tolist(), [*at[1:].tolist(), len(place)], strict=True):
        for item in candidates(items, found[a:b], w.hash[w.first[doc]:w.first[doc + 1]], threshold).tolist():
            one, best = items.words[item], (0, 0, -1)
            own = items.by_item[items.own[item]:items.own[item + 1]]
            left, right = (np.searchsorted(items.seed[own], found[a:b], side=side) for side in ("left", "right"))
            begins = np.unique(np.repeat(place[a:b], right - left) - items.at[own[ranges(left, right)]])
            size = len(one)
            ends = np.flatnonzero(np.append(np.diff(begins) > size, True))
            for start, end in zip([0, *(ends[:-1] + 1)], ends, strict=True):
                low_, high = max(w.first[doc], begins[start] - size // 2), min(w.first[doc + 1], begins[end] + size + size // 2)
                near = w.hash[low_:high]
                if min(np.isin(one, near).sum(), np.isin(near, one).sum()) < threshold * size:
                    continue
                score, x, y = align(one, near)
                if score > best[0]:
                    best = (score, x + low_ - w.first[doc], y + low_ - w.first[doc])
            if best[0] and best[0] >= threshold * MATCH * size:
                out.append((doc, item, best[0] / (MATCH * size), int(best[1]), int(best[2])))
    return out


def item_blocks(benchmark: DataFrame, item_col: str, item_text: str):
    """The items in blocks of about BLOCK_BYTES."""
    items = benchmark.select(benchmark[item_col].cast("bigint").alias("item_id"), benchmark[item_text].cast("string").alias("item_text")).where("item_text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("item_text").cast("bigint")), F.lit(0))).first()[0]
    n = size // BLOCK_BYTES + 1
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "item_text"), F.lit(n)))
    for part in range(n):
        rows = items.where(F.col("part") == part).select("item_id", "item_text").collect()
        block = Items([r[0] for r in rows], [r[1] for r in rows])
        if len(block.seed):
            yield block


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs`` and test item that it holds a copy of: doc_id, item_id, score (alignment score over
    the item's greatest possible one), first_word and last_word (the copy's, as word numbers of the text).

    Null and empty texts and items, and items with fewer than MIN_WORDS words, match nothing. Repeated rows of ``docs`` or
    of the items give repeated rows.
    """
    spark, rows = docs.sparkSession, narrow(docs, id_col, text_col)
    out = None
    for block in item_blocks(benchmark, item_col, item_text):
        sent = spark.sparkContext.broadcast(block)

        def build(sent=sent):
            def work(batch):
                found = matches(sent.value, words(batch.column(1), SYMBOL, lower=True), threshold)
                if not found:
                    return None
                doc, item, score, first, last = zip(*found, strict=True)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array([sent.value.ids[i] for i in item], pa.int64()), pa.array(score, pa.float64()),
                                                   pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["doc_id", "item_id", "score", "first_word", "last_word"])

            return work

        one = map_batches(rows, build, SCHEMA)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, without the rows that hold a copy of a test item: a narrow pass for each block of items."""
    out = docs
    for block in item_blocks(benchmark, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def build(sent=sent):
            def keep(text):
                good = np.ones(len(text), bool)
                good[[m[0] for m in matches(sent.value, words(text, SYMBOL, lower=True), threshold)]] = False
                return good

            return keep

        out = filter_rows(out, text_col, build)
    return out
