"""Importance resampling towards a target distribution of hashed word n-grams.

Features are hashed with crc32, computed for whole batches: the CRC of a span is the exclusive or of what each of its bytes
contributes at its distance from the end, and of a constant for its length. Contributions stand in a table by distance
and byte; ``np.bitwise_xor.reduceat`` folds them over all spans of a batch at once. Spans longer than the table are folded in
blocks of its height, moved on by the same table.

A document's weight is the sum of its features' log ratios between target and corpus; with Gumbel noise fixed by its id, the
highest scores are a sample without replacement in proportion to the importance weights.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import map_batches, narrow, stage
from broadsheet.llm.terms import Spans, runs, spans
from broadsheet.llm.tokens import SYMBOL
from broadsheet.operators.ranges import number_rows

#: Distances from the end that the table holds: the length of a block.
BLOCK = 64


def _table(height: int) -> np.ndarray:
    """What a byte contributes to the CRC at each distance from the end, beyond what a zero byte does."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    rows = [byte]
    for _ in range(height - 1):
        rows.append((rows[-1] >> np.uint32(8)) ^ byte[rows[-1] & np.uint32(255)])
    return np.stack(rows)


TABLE = _table(BLOCK)
#: CRC of so many zero bytes: the constant of a length.
LENGTHS = np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], np.uint32)


def _onward(distance: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``x``, moved on by as many zero bytes as a table of four rows of 256 says."""
    x = x.astype(np.uint32)
    return distance[0, x & 255] ^ distance[1, x >> 8 & 255] ^ distance[2, x >> 16 & 255] ^ distance[3, x >> 24]


def _long(data: np.ndarray) -> int:
    """CRC of a span longer than a block: blocks from its end, neighbours joined until one is left."""
    n = len(data)
    blocks = -(-n // BLOCK)
    padded = np.concatenate([np.zeros(blocks * BLOCK - n, np.uint8), data])  # a zero byte contributes nothing
    parts = np.empty(blocks, np.uint32)
    for at in range(0, blocks, 1 << 14):  # bounded memory however long the span
        piece = padded[at * BLOCK:(at + (1 << 14)) * BLOCK].reshape(-1, BLOCK)
        parts[at:at + len(piece)] = np.bitwise_xor.reduce(TABLE[np.arange(BLOCK - 1, -1, -1), piece], axis=1)
    shift = TABLE[[BLOCK - 1, BLOCK - 2, BLOCK - 3, BLOCK - 4]]
    while len(parts) > 1:
        if len(parts) % 2:
            parts = np.concatenate([np.zeros(1, np.uint32), parts])
        parts = _onward(shift, parts[0::2]) ^ parts[1::2]
        shift = _onward(shift, shift.ravel()).reshape(4, 256)
    return int(parts[0]) ^ zlib.crc32(bytes(n))


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """crc32 of each span of bytes (they may overlap), as unsigned 32-bit integers."""
    length = end - start
    out = np.zeros(len(start), np.uint32)
    short = np.flatnonzero((length > 0) & (length <= BLOCK))
    upto = np.cumsum(length[short])
    i = 0
    while i < len(short):  # about ``piece`` bytes at a time
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + piece, side="right")))
        chosen = short[i:j]
        n = length[chosen]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        bytes_ = data[np.repeat(start[chosen], n) + within]
        out[chosen] = np.bitwise_xor.reduceat(TABLE[np.repeat(n, n) - 1 - within, bytes_], first) ^ LENGTHS[n]
        i = j
    for k in np.flatnonzero(length > BLOCK):
        out[k] = _long(data[start[k]:end[k]])
    return out


def _features(s: Spans, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text index of every feature of a batch."""
    found, docs = [], []
    for size in range(1, longest + 1):
        start, end, data, doc = runs(s, size)
        found.append((crc32_spans(data, start, end) % np.uint32(buckets)).astype(np.int64))
        docs.append(doc)
    return np.concatenate(found), np.concatenate(docs)


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how often the features of all texts fall into each bucket. Only buckets that occur; a task gives one
    row a bucket, so no more than tasks × ``buckets`` rows are shuffled, whatever the texts. Null texts have no feature."""
    def build():
        total = np.zeros(buckets, np.int64)

        def work(batch: pa.RecordBatch) -> None:
            np.add(total, np.bincount(_features(spans(batch.column(0), SYMBOL), longest, buckets)[0], minlength=buckets), out=total)

        def finish():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

        work.finish = finish
        return work

    rows = texts.select(F.coalesce(texts[text_col].cast("string"), F.lit("")).alias("text"))
    return map_batches(rows, build, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Log ratio of each bucket in thousandths, floors going down: floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))).
    At most ``buckets`` numbers of either side reach the driver."""
    def counts(rows: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for r in rows.collect():  # at most one row a bucket
            out[r["bucket"]] = r["n"]
        return out

    s, t = counts(corpus), counts(target)
    whole_s, whole_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * whole_s / ((float(a) + 1) * whole_t))) for a, b in zip(s, t, strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row of ``docs``: the sum of its features' gains (none: 0). Narrow;
    ``gain`` (8 bytes a bucket) travels with the task."""
    def build():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = spans(batch.column(1), SYMBOL)
            found, doc = _features(s, longest, len(gain))
            weight = np.zeros(batch.num_rows, np.int64)
            np.add.at(weight, doc, gain[found])
            n = np.bincount(doc, minlength=batch.num_rows)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.n), pa.array(n.astype(np.int64)), pa.array(weight)],
                                              names=["doc_id", "n_words", "n_features", "weight"])

        return work

    return map_batches(narrow(docs, id_col, text_col), build, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024,
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_features, weight, score, rank (from 1 among the drawn, else null).

    Of the N documents with at least ``least_words`` words, floor(``percent`` N / 100) with the highest scores are drawn; ties
    go to the smaller id (null last). Ranks come from ranges of the scores and offsets, never from one sorted partition.
    Null and empty texts have weight 0 and are never drawn (with ``least_words`` over 0); a null id draws the noise of the
    empty id. Repeated rows are ranked one after the other. An empty target counts as one without features; an empty table
    gives no rows; other columns are not looked at.
    """
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    # stored: the texts are gone through once for the weights, and ranges are cut and read over the same rows
    scored = stage(weigh(docs, gain, longest, id_col, text_col).withColumn("score", F.col("weight") + noise), "scores")
    columns = ["doc_id", "n_features", "weight", "score"]
    long_enough = F.col("n_words") >= least_words
    drawn = percent * scored.where(long_enough).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")]
    ranked = number_rows(scored.where(long_enough).select(*columns), order, "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    short = scored.where(~long_enough).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked.unionByName(short)
