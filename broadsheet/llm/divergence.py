"""How the sources of a language differ in their words: exact divergences between term distributions.

The count vectoriser of each language is a table: terms in at least ``min_df`` of the language's documents, up to the largest
integer in number, with exact sparse counts. Vectors are summed as they are made: a task turns its documents into sparse
vectors of terms and adds them up by (language, source), Spark adds up the tasks'. Pairs of sources are evaluated sparsely:
terms that neither has all contribute alike, terms that one has contribute by its histogram of counts, and only terms that
both have are met one by one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from broadsheet.llm.common import chunks, parts, stage
from broadsheet.llm.terms import spans
from broadsheet.session import broadcast_if_small

#: The largest vocabulary of a language: its terms are numbered by integers.
VOCABULARY = 2**31 - 1
#: Probabilities are counted in units of 1 / UNIT.
UNIT = 1_000_000_000
_LETTERS = np.ones(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Texts that a task counts together before it hands their sums on.
GROUP_BYTES = 8_000_000
#: Rows (source and term) of a bucket, about, and pairs evaluated at once.
BUCKET_ROWS = 200_000
PAIRS_AT_ONCE = 1_000_000


def _vectors(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Sparse vectors of some documents: terms, groups (lang, source), and sorted (document, term) keys with counts."""
    s = spans(batch.column("text"), _LETTERS)
    coded = s.strings().dictionary_encode()
    terms, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    keys, counts = np.unique(s.doc * max(1, len(terms)) + codes, return_counts=True)
    return terms, keys, counts


def _summed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, df) of some documents, and a row without a term for each group."""
    terms, keys, counts = _vectors(batch)
    pairs = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], names=["lang", "source"])
    names, group = np.unique(np.array([f"{len(p['lang'])}:{p['lang']}{p['source']}" for p in pairs.to_pylist()], object), return_inverse=True)
    first = np.zeros(len(names), np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]
    size = max(1, len(terms))
    doc, code = keys // size, keys % size
    cell, at, df = np.unique(group[doc] * size + code, return_inverse=True, return_counts=True)
    n = np.zeros(len(cell), np.int64)
    np.add.at(n, at, counts)
    rows = pa.array(np.concatenate([first[cell // size], first]))
    none = pa.nulls(len(names), pa.string())
    return pa.RecordBatch.from_arrays(
        [batch.column("lang").take(rows), batch.column("source").take(rows),
         pa.concat_arrays([terms.take(pa.array(cell % size)).cast(pa.string()), none]),
         pa.array(np.concatenate([n, np.zeros(len(names), np.int64)])), pa.array(np.concatenate([df, np.zeros(len(names), np.int64)]))],
        names=["lang", "source", "term", "n", "df"])


def _text(docs: DataFrame, name: str) -> Column:
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def group_vectors(docs: DataFrame, min_df: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, first, lang_n): each group's count of each kept term that it has, whether the row is
    its term's first in the language, and the language's count of the term. A row with a null term stands for each
    group, whether it has terms or not."""
    rows = docs.select(_text(docs, lang_col).alias("lang"), _text(docs, source_col).alias("source"), _text(docs, text_col).alias("text"))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in chunks(batch):
                held.append(part)
                size += part.nbytes
                if size >= GROUP_BYTES:
                    yield _summed(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size = [], 0
        if sum(b.num_rows for b in held):
            yield _summed(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    sums = rows.mapInArrow(run, "lang string, source string, term string, n bigint, df bigint").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("df").alias("df"))
    of_term = W.partitionBy("lang", "term")
    kept = sums.select("lang", "source", "term", "n", F.sum("df").over(of_term).alias("lang_df"), F.sum("n").over(of_term).alias("lang_n"),
                       (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"))
    return kept.where((F.col("lang_df") >= min_df) | F.col("term").isNull()).select("lang", "source", "term", "n", "first", "lang_n")


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (count + 1) / (total + terms)), exactly."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", whole(F.lit(UNIT)) * whole(count + 1), whole(F.greatest(total + terms, F.lit(1))))


def _meet(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``small`` (one row a key): broadcast if few, else joined over 32 copies of each key,
    so that no key's rows meet in one task."""
    held = broadcast_if_small(small)
    if held is not small:
        return rows.join(held, keys)
    return rows.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(32))).join(
        small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(31).cast("bigint")))), [*keys, "_salt"]).drop("_salt")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _pair_rows(lang: str, group: list, item: list, value: list) -> pa.Table:
    g, i, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (group, item, value))
    return pa.table([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(i, pa.int64()), pa.array(v, pa.int64())], names=["lang", "g", "i", "value"])


_PAIRS = "lang string, g bigint, i bigint, value bigint"


def _one_sided(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over the terms that one of two sources has, and over those that neither has. ``left``: histograms (g, p,
    terms) of some sources; ``right``: all sources (g, p0) of their language and its number of terms."""
    lang = key[0].as_py()
    order = np.argsort(right.column("g").to_numpy())
    all_g, all_p0 = right.column("g").to_numpy()[order], right.column("p0").to_numpy()[order]
    terms = right.column("terms").to_numpy()[0] if len(all_g) else 0
    g, p, m = (left.column(c).to_numpy() for c in ("g", "p", "m"))
    out: tuple[list, list, list] = ([], [], [])
    for x in np.unique(g):
        x0 = all_p0[np.searchsorted(all_g, x)]
        has = (g == x) & (m > 0)
        px, mx = p[has], m[has]
        ahead, behind = terms * _f(x0, all_p0), np.zeros(len(all_g), np.int64)
        step = max(1, PAIRS_AT_ONCE // max(1, len(all_g)))
        for at in range(0, len(px), step):
            some, times = px[at:at + step, None], mx[at:at + step, None]
            ahead += (times * (_f(some, all_p0) - _f(x0, all_p0))).sum(0)
            behind += (times * (_f(all_p0[None, :], some) - _f(all_p0, x0))).sum(0)
        other = all_g != x
        out[0].extend([np.full(other.sum(), x), all_g[other]])
        out[1].extend([all_g[other], np.full(other.sum(), x)])
        out[2].extend([ahead[other], behind[other]])
    return _pair_rows(lang, *out)


def _shared(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """What terms that both of two sources have add to the one-sided sums, for the terms of one bucket."""
    lang = key[0].as_py()
    code = rows.column("term").combine_chunks().dictionary_encode()
    code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code = code[order]
    g, p, p0 = (rows.column(c).to_numpy()[order] for c in ("g", "p", "p0"))
    start = np.searchsorted(code, code, side="left")
    width = np.searchsorted(code, code, side="right") - start  # sources that have the row's term
    upto = np.cumsum(width)
    out: tuple[list, list, list] = ([], [], [])
    i = 0
    while i < len(code):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS_AT_ONCE, side="right")))
        n = width[i:j]
        a = np.repeat(np.arange(i, j), n)
        b = np.repeat(start[i:j], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        other = a != b
        a, b = a[other], b[other]
        value = _f(p[a], p[b]) - _f(p[a], p0[b]) - _f(p0[a], p[b]) + _f(p0[a], p0[b])
        by = np.lexsort((g[b], g[a]))
        ga, gb, value = g[a][by], g[b][by], value[by]
        new = np.flatnonzero(np.concatenate([[True], (ga[1:] != ga[:-1]) | (gb[1:] != gb[:-1])])) if len(ga) else np.empty(0, np.int64)
        if len(new):
            out[0].append(ga[new])
            out[1].append(gb[new])
            out[2].append(np.add.reduceat(value, new))
        i = j
    return _pair_rows(lang, *out)


def audit(docs: DataFrame, min_df: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``, how far each source of a language is from each other one, and
    part ``term``, the ``top`` terms by which a source differs from its language.

    With p and q as counts of 1 / UNIT, smoothed by one, f = floor((p - q)² / q), in whole numbers. Pairs: the sum of f over
    all kept terms, all ranks. Terms: f of each kept term that the source has and that is likelier there than in the
    language. Ranks go by value, largest first, then by the item's bytes. Null text, lang and source are ''; groups without
    terms take part; a language without kept terms has value 0 for its pairs; repeated rows count as often as they occur;
    an empty table gives no rows; other columns are not looked at. Vocabularies beyond VOCABULARY terms raise.
    """
    spark = docs.sparkSession
    rows = stage(group_vectors(docs, min_df, text_col, lang_col, source_col), "vectors")
    real = F.col("term").isNotNull()
    sources = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = rows.groupBy("lang").agg(F.count_if(real & F.col("first")).alias("terms"), F.sum("n").alias("lang_total"))
    of_lang = W.partitionBy("lang").orderBy("source")
    large = F.raise_error(F.concat(F.lit("the vocabulary of a language exceeds 2^31 - 1 terms: "), F.col("lang")))
    groups = stage(sources.join(langs, "lang").select(
        "lang", "source", "total", F.when(F.col("terms") <= VOCABULARY, F.col("terms")).otherwise(large.cast("bigint")).alias("terms"), "lang_total",
        F.row_number().over(of_lang).cast("bigint").alias("g"), probability(F.lit(0), F.col("total"), F.col("terms")).alias("p0")), "groups")
    scored = _meet(rows.where(real), groups, ["lang", "source"]).select(
        "lang", "source", "term", "g", "p0", probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        probability(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))

    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = scored.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    # as many as the rows need, however many partitions there are: each bucket gives a row for each pair of sources
    buckets = max(1, math.ceil(rows.count() / BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    shared = scored.select("lang", bucket.alias("bucket"), "term", "g", "p", "p0").groupBy("lang", "bucket").applyInArrow(_shared, _PAIRS)
    block = F.pmod(F.col("g"), F.lit(parts(spark))).cast("int")
    # one row of no terms for each group: its pairs exist even if it has none
    none = groups.select("lang", "g", F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("m"))
    histogram = scored.groupBy("lang", "g", "p").agg(F.count("*").alias("m")).unionByName(none).withColumn("block", block)
    blocks = histogram.select("lang", "block").distinct()
    sides = groups.join(blocks, "lang").select(*[F.col(c).alias(c) for c in ("lang", "block", "g", "p0", "terms")])
    single = histogram.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block")).applyInArrow(_one_sided, _PAIRS)
    sums = single.unionByName(shared).groupBy("lang", "g", "i").agg(F.sum("value").alias("value"))
    names = groups.select("lang", F.col("g"), "source")
    pairs = sums.join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("i"), F.col("source").alias("item")), ["lang", "i"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms)
