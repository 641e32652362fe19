"""Counting words inside documents.

Text is cleaned and lower-cased in the JVM. Counting runs on pieces of Arrow batches: the words of a whole piece are
dictionary-encoded once and counted per document with array arithmetic, so there is no shuffle (a
document's words never leave its row) and no per-row Python. A piece holds a bounded size of text, however many rows a
batch has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.batches import by_pieces, pieces
from broadsheet.functions.text import WS_CHARS, col


def word_text(text) -> Column:
    """Lower-case words of cleaned text (no URLs, e-mail addresses, symbols), separated by single spaces."""
    c = F.translate(col(text), WS_CHARS, " " * len(WS_CHARS))
    c = F.regexp_replace(c, "http[^ ]+|www[^ ]+", "")
    c = F.regexp_replace(c, "(?<![^ ])[^ ]+@[^ ]+", "")
    return F.lower(F.regexp_replace(c, r"[^a-zA-Z0-9_\p{L}\p{N}]+", " "))


def spaced_text(text) -> Column:
    """Lower-case text with plain spaces."""
    return F.lower(F.translate(col(text), WS_CHARS, " " * len(WS_CHARS)))


def split_words(texts: pa.Array, min_len: int, stop: list[str]) -> tuple[np.ndarray, pa.Array]:
    """(row, word) of a batch of space-separated texts, in reading order."""
    lists = pc.split_pattern(texts, " ")
    rows, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    keep = pc.and_(
        pc.greater_equal(pc.utf8_length(words), min_len),
        pc.invert(pc.is_in(words, value_set=pa.array(stop, words.type))),
    )
    return rows.filter(keep).to_numpy(), words.filter(keep)


def with_ngrams(rows: np.ndarray, words: pa.Array, ngrams: tuple[int, int]) -> tuple[np.ndarray, pa.Array]:
    """The n-grams of neighbouring words of one row, for every size of the range."""
    all_rows, all_terms = [], []
    for size in range(ngrams[0], ngrams[1] + 1):
        n = len(words) - size + 1
        if n <= 0:
            continue
        parts = [words.slice(k, n) for k in range(size)]
        inside = rows[:n] == rows[size - 1:]
        terms = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", words.type))
        all_rows.append(rows[:n][inside])
        all_terms.append(terms.filter(pa.array(inside)))
    if not all_terms:
        return rows[:0], words.slice(0, 0)
    return np.concatenate(all_rows), pa.concat_arrays(all_terms)


def counted(rows: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, place of the term in the sorted vocabulary, count), by row and term, and that vocabulary."""
    coded = terms.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    width = max(1, len(order))
    keys, counts = np.unique(rows.astype(np.int64) * width + place[coded.indices.to_numpy()], return_counts=True)
    return keys // width, keys % width, counts, coded.dictionary.take(pa.array(order))


def best_lists(n_rows: int, rows, places, weight, n: int):
    """Offsets and positions of the ``n`` heaviest terms of each row, equal weights in term order."""
    order = np.lexsort((places, -weight, rows))
    sorted_rows = rows[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows, side="left")
    kept = order[rank < n]
    offsets = np.searchsorted(rows[kept], np.arange(n_rows + 1), side="left").astype(np.int32)
    return pa.array(offsets), kept


def top_words(text: Column, n: int, min_len: int = 1, stop=(), ngrams: tuple[int, int] = (1, 1)) -> Column:
    """The ``n`` most frequent words (or n-grams) of space-separated text, ties in word order."""
    stop = list(stop)

    def best(texts: pa.Array) -> pa.Array:
        rows, terms = with_ngrams(*split_words(texts, min_len, stop), ngrams)
        rows, places, counts, vocabulary = counted(rows, terms)
        offsets, kept = best_lists(len(texts), rows, places, counts, n)
        return pa.ListArray.from_arrays(offsets, vocabulary.take(pa.array(places[kept])).cast(pa.string()))

    @F.arrow_udf("array<string>")
    def top(texts: pa.Array) -> pa.Array:
        return by_pieces(best, texts)

    return top(text)


def word_count(text: Column, min_len: int = 1, stop=()) -> Column:
    """Number of words of space-separated text that are long enough and no stopwords."""
    stop = list(stop)

    def words(texts: pa.Array) -> pa.Array:
        rows, _ = split_words(texts, min_len, stop)
        return pa.array(np.bincount(rows, minlength=len(texts)).astype(np.int32))

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        return by_pieces(words, texts)

    return count(text)


def term_statistics(df: DataFrame, text: str, min_len: int, stop, ngrams: tuple[int, int]) -> DataFrame:
    """(term, tf, df) over a corpus. Each piece of a batch is summed before it leaves Python, each task's pieces before
    anything is shuffled."""
    stop = list(stop)

    def run(batches):
        for part in (p for batch in batches for p in pieces(batch)):
            rows, terms = with_ngrams(*split_words(part.column(0), min_len, stop), ngrams)
            rows, places, counts, vocabulary = counted(rows, terms)
            size = len(vocabulary)
            yield pa.record_batch(
                [vocabulary.cast(pa.string()), pa.array(np.bincount(places, counts, size).astype(np.int64)),
                 pa.array(np.bincount(places, minlength=size).astype(np.int64))],
                names=["term", "tf", "df"])

    partial = df.select(text).mapInArrow(run, "term string, tf bigint, df bigint")
    return partial.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def top_counts(text: Column, n: int, min_len: int = 1, stop=(), ngrams: tuple[int, int] = (1, 1)) -> Column:
    """struct(terms, counts): the ``n`` most frequent words (or n-grams) of space-separated text, ties in order."""
    stop = list(stop)

    def best(texts: pa.Array) -> pa.Array:
        rows, terms = with_ngrams(*split_words(texts, min_len, stop), ngrams)
        rows, places, counts, vocabulary = counted(rows, terms)
        offsets, kept = best_lists(len(texts), rows, places, counts, n)
        words = vocabulary.take(pa.array(places[kept])).cast(pa.string())
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, words), pa.ListArray.from_arrays(offsets, pa.array(counts[kept].astype(np.int64)))],
            ["terms", "counts"])

    @F.arrow_udf("terms array<string>, counts array<bigint>")
    def top(texts: pa.Array) -> pa.Array:
        return by_pieces(best, texts)

    return top(text)
