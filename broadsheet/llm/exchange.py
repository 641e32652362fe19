"""Questions from blocks of documents to buckets of keys, and answers back.

Several operators ask of every word, anchor or window of a text what the whole corpus knows of it. Here documents are
dealt into blocks once; each block asks about each of its keys once, however many of its texts hold it (so a key that a
third of all texts hold makes one question per block); a question goes to the bucket that the key hashes to. A bucket
sees all questions about its keys, and answers each block in the order in which it asked, so that an answer can be as
short as a bit. Rows are (block, bucket, body) with packed arrays as bodies: Spark partitions, shuffles and spills
them, numpy works inside a block or bucket. How many blocks and buckets there are follows from the bytes of the texts
alone, not from the shuffle partitions, so that a block's or bucket's size stays the same as tables grow, and a table's
messages stay the same however many partitions it is dealt over. A block sends no more messages than it has keys.

A block goes through its rows in an order of content (id, hash of id and text), so all passes over it agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import narrow, parts

#: Bytes of text that a block holds on average (more where one text is longer), and the blocks for each bucket.
BLOCK_BYTES = 5_000_000
BLOCKS_PER_BUCKET = 2
MESSAGE = "block int, bucket int, kind int, body binary"
LAST = np.iinfo(np.int64).max


def blocks_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> tuple[DataFrame, int]:
    """(block, doc_id, text, row_hash, ``more``): documents dealt into blocks by a hash of id and length; and the number
    of buckets for their keys. ``more`` may refer to the id as ``doc_id``. One pass over the texts adds up their bytes."""
    rows = narrow(docs, id_col, text_col).select("*", *[c.alias(name) for name, c in more.items()])
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    n = size // BLOCK_BYTES + 1
    block = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n)).cast("int")
    dealt = rows.select(block.alias("block"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("row_hash"), *more)
    return dealt.repartition(parts(docs.sparkSession), "block"), -(-n // BLOCKS_PER_BUCKET)


class Block:
    """One block's rows, in their order. ``ids``: LAST stands for null."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id")
        filled = np.asarray(ids.fill_null(LAST).combine_chunks())
        order = np.lexsort((np.asarray(table.column("row_hash").combine_chunks()), filled))
        table = table.take(pa.array(order))
        self.doc_id, self.text, self.ids = table.column("doc_id").combine_chunks(), table.column("text"), filled[order]
        self.number = table.column("block")[0].as_py()
        self.table = table

    def extra(self, name: str) -> np.ndarray:
        return self.table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def message(block: int, bucket: int, kind: int, body: bytes) -> tuple:
    return block, bucket, kind, body


def messages(rows: list[tuple]) -> pa.Table:
    block, bucket, kind, body = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table([pa.array(block, pa.int32()), pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())],
                    names=["block", "bucket", "kind", "body"])


def rows_of(table: pa.Table) -> list[tuple]:
    """Messages by block, bucket and kind, as (block, bucket, kind, body)."""
    return sorted(zip(*(table.column(c).to_pylist() for c in ("block", "bucket", "kind", "body")), strict=True), key=lambda r: r[:3])


def deal(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys by bucket (else unchanged), and where each bucket starts in it (one more at the end)."""
    bucket = (keys >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def ask(blocks: DataFrame, work: Callable[[Block], list[tuple]], replies: DataFrame | None = None) -> DataFrame:
    """Messages that ``work`` makes of each block (and, with ``replies``, of the answers the block has had)."""
    if replies is None:
        return blocks.groupBy("block").applyInArrow(lambda t: messages(work(Block(t))), MESSAGE)
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        lambda left, right: messages(work(Block(left), rows_of(right)) if left.num_rows else []), MESSAGE)


def answer(questions: DataFrame, work: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """What ``work`` answers to all the questions that one bucket has got."""
    return questions.groupBy("bucket").applyInArrow(lambda t: messages(work(rows_of(t))), MESSAGE)


def finish(blocks: DataFrame, replies: DataFrame, work: Callable[[Block, list[tuple]], pa.Table], schema: str, empty: Callable[[], pa.Table]) -> DataFrame:
    """Rows that ``work`` makes of each block and its answers."""
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        lambda left, right: work(Block(left), rows_of(right)) if left.num_rows else empty(), schema)
