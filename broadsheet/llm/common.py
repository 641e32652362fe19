"""Helpers that the operators of this subpackage share: input columns, batches, word hashes, stored stages."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.session import materialize

#: Characters that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
_TO_SPACE = str.maketrans({c: " " for c in SPACES})
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Texts are handled in chunks of about so many characters, however long or many the rows of a batch are.
CHUNK_CHARS = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """Only the id, the text (null: empty) and ``more``; whatever else the table holds cannot clash."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
                       *[c.alias(n) for n, c in more.items()])


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does that where every character is a single byte; elsewhere each
    character is looked up."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def lower_az(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def words_of(text: str) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` (``str.split()`` would also part words at other Unicode spaces)."""
    return text.split() if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else [
        w for w in text.translate(_TO_SPACE).split(" ") if w]


def remainder(value, modulus: int) -> int:
    """crc32 of an id as text, as ``crc32(cast(id as string)) % modulus`` has it."""
    return zlib.crc32(str(value).encode()) % modulus


class WordHashes(dict):
    """word -> 64-bit hash, remembered for at most ``limit`` words (a memo: forgetting costs only time)."""

    def __init__(self, limit: int = 300_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), self.seed)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, order-sensitive; wraps around."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes, by doubling; empty if there are fewer."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    power, h = {1: words}, 1
    while h * 2 <= size:
        power[h * 2] = mix(power[h][:-h], power[h][h:])
        h *= 2
    out, width = power[h], h
    while width < size:
        step = 1 << ((size - width).bit_length() - 1)
        n = len(words) - width - step + 1
        out = mix(out[:n], power[step][width:width + n])
        width += step
    return out


def map_batches(df: DataFrame, build: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None]],
                schema: str) -> DataFrame:
    """``mapInArrow`` whose function is built once per task and sees chunks of about CHUNK_CHARS characters."""
    def run(batches):
        work = build()
        for batch in batches:
            for part in chunks(batch):
                out = work(part)
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        finish = getattr(work, "finish", None)
        if finish:
            yield from finish()

    return df.mapInArrow(run, schema)


def filter_rows(docs: DataFrame, text_col: str, build: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows of ``docs``, all columns, whose text (null: empty) a function made once per task says to keep.

    Only texts go to Python and only booleans come back; the rows stay in the JVM."""
    def keep(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = build()
        for text in texts:
            done = [pa.array(work(part.column(0)), pa.bool_()) for part in chunks(pa.RecordBatch.from_arrays([text.cast(pa.string())], names=["text"]))]
            yield pa.concat_arrays(done)

    return docs.where(F.arrow_udf(keep, "boolean")(F.coalesce(docs[text_col].cast("string"), F.lit(""))))


def chunks(batch: pa.RecordBatch, text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about CHUNK_CHARS bytes of text each, at least one row."""
    at = batch.schema.get_field_index(text_col)
    if at < 0 or batch.num_rows < 2:
        yield batch
        return
    total = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(at)).fill_null(0)), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + CHUNK_CHARS, side="right")))
        yield batch.slice(start, end - start)
        start = end


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back; the shuffle files behind it can go."""
    out = materialize(df, name)
    release(df.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
