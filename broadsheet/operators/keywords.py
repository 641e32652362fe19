"""Keyword extraction. Counting is narrow (see :mod:`broadsheet.functions.tokens`); only the corpus-wide
term statistics of the tf-idf ranking shuffle, summed per batch first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.functions.text import strip
from broadsheet.functions.tokens import (
    spaced_text, term_statistics, top_counts, top_words, word_count, word_text,
)
from broadsheet.operators.entities import combined_text
from broadsheet.operators.matching import any_of

LONG_WORD = 4


def keywords_by_frequency(
    articles: DataFrame, n: int = 15, min_len: int = LONG_WORD, stopwords=None, text: Column | None = None,
    out: str = "keywords",
) -> DataFrame:
    """T04. Most frequent words of each article; equal counts in word order."""
    text = combined_text() if text is None else text
    stop = fixed.STOPWORDS if stopwords is None else stopwords
    return articles.withColumn(out, top_words(word_text(text), n, min_len, stop))


def keywords_simple(
    articles: DataFrame, n: int = 10, stopwords=None, text: Column | None = None, out: str = "keywords_simple"
) -> DataFrame:
    """T07. Most frequent space-separated words longer than three characters."""
    text = F.col("content") if text is None else text
    stop = fixed.SIMPLE_STOPWORDS if stopwords is None else stopwords
    return articles.withColumn(out, top_words(spaced_text(text), n, LONG_WORD, stop))


def keywords_tfidf(
    articles: DataFrame, n: int = 15, ngrams: tuple[int, int] = (1, 2), max_features: int = 100,
    corpus: DataFrame | str = "all", stopwords=None, text: Column | None = None, out: str = "keywords_tfidf", id: str = "id",
) -> DataFrame:
    """T05. Terms of each article by tf·idf, rows L2-normalised; adds the terms as ``out`` and their scores
    as ``out``_scores. Terms are words of two or more characters without stopwords, and their n-grams; the
    ``max_features`` most frequent terms of an article (ties in term order) are weighed by ln((1+N)/(1+df))+1.

    Document frequencies stay a table over all terms of the corpus: each article's terms, counted in its own
    task, meet them in a join, so the vocabulary has no bound. ``corpus`` names another table to count on;
    ``'self'`` ranks each article by its own counts alone.
    """
    if max_features < 1:
        raise ValueError("max_features starts at 1")
    text = combined_text() if text is None else text
    stop = fixed.STOPWORDS if stopwords is None else stopwords
    if isinstance(corpus, str) and corpus == "self":
        return articles.withColumn(out, top_words(word_text(text), n, 2, stop, ngrams))
    base = articles if isinstance(corpus, str) else corpus
    known = term_statistics(base.select(word_text(text).alias("_t")), "_t", 2, stop, ngrams).select("term", "df")
    total = base.agg(F.count("*").alias("n")).scalar()
    own = articles.select(id, top_counts(word_text(text), max_features, 2, stop, ngrams).alias("_c"))
    terms = own.select(id, F.explode(F.arrays_zip("_c.terms", "_c.counts")).alias("_e")).select(
        id, F.col("_e.terms").alias("term"), F.col("_e.counts").alias("tf"))
    idf = F.log((1 + F.col("_total")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    weighed = terms.join(known, "term", "left").withColumn("_total", total).select(
        id, "term", F.round(F.col("tf") * idf, 9).alias("w"))
    best = weighed.groupBy(id).agg(  # at most max_features terms an article
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("o"), "term", "w"))), 1, n).alias("_b"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    lists = best.select(id, F.transform("_b", lambda b: b["term"]).alias(out),
                        F.transform("_b", lambda b: F.round(b["w"] / F.col("_norm"), 9)).alias(f"{out}_scores"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return articles.join(lists, id, "left").withColumn(out, F.coalesce(out, none("string"))).withColumn(
        f"{out}_scores", F.coalesce(f"{out}_scores", none("double")))


def keywords_combined(
    articles: DataFrame, n: int = 15, corpus: DataFrame | str = "all", stopwords=None, text: Column | None = None,
    out: str = "keywords_combined", **tfidf,
) -> DataFrame:
    """T06. T04 and T05 merged: each word by its better rank, then by word. Articles with ten or fewer
    long words keep the frequency list."""
    text = combined_text() if text is None else text
    freq = keywords_by_frequency(articles, n, stopwords=stopwords, text=text, out="_freq")
    both = keywords_tfidf(freq, n, corpus=corpus, stopwords=stopwords, text=text, out="_tfidf", **tfidf)
    stop = fixed.STOPWORDS if stopwords is None else stopwords
    counted = both.withColumn("_long", word_count(word_text(text), LONG_WORD, stop))
    far = F.lit(1_000_000).cast("bigint")
    rank = lambda arr, w: F.coalesce(F.nullif(F.array_position(arr, w), F.lit(0)), far)
    merged = F.transform(
        F.array_distinct(F.concat("_freq", "_tfidf")),
        lambda w: F.struct(F.least(rank(F.col("_freq"), w), rank(F.col("_tfidf"), w)).alias("rank"), w.alias("word")),
    )
    union = F.transform(F.slice(F.sort_array(merged), 1, n), lambda x: x["word"])
    return counted.withColumn(out, F.when(F.col("_long") > 10, union).otherwise(F.col("_freq"))).drop(
        "_freq", "_tfidf", "_tfidf_scores", "_long")


def key_points(
    articles: DataFrame, n: int = 5, verbs=None, sentences: int | None = None, min_len: int = 30,
    text: Column | None = None, out: str = "key_points",
) -> DataFrame:
    """T09. Of all (or the first ``sentences``) sentences, those longer than ``min_len`` with a reporting verb."""
    text = F.col("content") if text is None else text
    verbs = verbs or fixed.REPORTING_VERBS
    pieces = F.split(text, r"\.") if sentences is None else F.slice(F.split(text, r"\.", sentences + 1), 1, sentences)
    parts = F.transform(pieces, lambda s: strip(s))
    kept = F.filter(parts, lambda s: (F.length(s) > min_len) & any_of(F.lower(s), verbs))
    return articles.withColumn(out, F.transform(F.slice(kept, 1, n), lambda s: F.concat(s, F.lit("."))))

