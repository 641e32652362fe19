"""Lexicon operators: theme scores, keyword flags, topics and stance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.dims import UNROLL_LIMIT, dim_frame, dim_rows, grouped
from broadsheet.functions.arrays import literal_array
from broadsheet.operators.entities import combined_text
from broadsheet.operators.matching import any_of, distinct_hits, match_by_join, match_counts, occurrences


def theme_scores(articles: DataFrame, lexicon, text: Column | None = None, out: str = "theme_scores", key: str = "id",
                 unroll_limit: int = UNROLL_LIMIT) -> DataFrame:
    """T01. map theme → occurrences of its keywords; nested keywords each count, zero themes are left out. A lexicon of
    more than ``unroll_limit`` keywords is joined, by the articles' unique ``key``."""
    text = combined_text() if text is None else text
    rows = dim_rows(lexicon, unroll_limit)
    if rows is None:
        return _themes_by_join(articles, lexicon, text, out, key)
    work = articles.withColumn("_lower", F.lower(text))
    low = F.col("_lower")
    entries = []
    for theme, members in grouped(rows, "theme", "theme_ordinal"):
        score = F.lit(0)
        for row in members:
            score = score + occurrences(low, row["keyword"])
        entries.append(F.struct(F.lit(theme).alias("key"), score.alias("value")))
    scored = F.filter(F.array(*entries), lambda e: e["value"] > 0)
    return work.withColumn(out, F.map_from_entries(scored)).drop("_lower")


def _keywords(articles: DataFrame, lexicon) -> DataFrame:
    """The lexicon with its keywords in lower case as _t."""
    return dim_frame(articles.sparkSession, lexicon).withColumn("_t", F.lower("keyword"))


def _themes_by_join(articles: DataFrame, lexicon, text: Column, out: str, key: str) -> DataFrame:
    """Only keywords that occur in a text are counted there; their counts alone travel where an automaton holds them."""
    words = _keywords(articles, lexicon)
    counted = match_counts(articles.select(key, text.alias("_text")), key, "_text", words, "_t")
    per = counted.join(words, "_t").groupBy(key, "theme").agg(F.min("theme_ordinal").alias("place"), F.sum("n").cast("int").alias("n"))
    scores = per.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "theme", "n"))).alias("_s"))
    scores = scores.select(key, F.map_from_entries(F.transform("_s", lambda s: F.struct(s["theme"], s["n"]))).alias(out))
    none = F.create_map().cast("map<string,int>")
    return articles.drop(out).join(scores, key, "left").withColumn(out, F.coalesce(out, none))


def _topics_by_join(articles: DataFrame, lexicon, n: int, text: Column, out: str, key: str) -> DataFrame:
    words = _keywords(articles, lexicon)
    hits = match_by_join(articles.select(key, text.alias("_text")), key, "_text", words, "_t", "substring")
    per = hits.join(words, "_t").groupBy(key, "theme").agg(F.min("theme_ordinal").alias("place"))
    found = per.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "theme"))).alias("_s"))
    found = found.select(key, F.slice(F.transform("_s", lambda s: s["theme"]), 1, n).alias(out))
    return articles.drop(out).join(found, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def is_keyword_article(
    articles: DataFrame, keywords: list[str], out: str, min_hits: int = 2, text: Column | None = None
) -> DataFrame:
    """T02/T03. At least ``min_hits`` different keywords of the list occur."""
    text = combined_text() if text is None else text
    work = articles.withColumn("_lower", F.lower(text))
    return work.withColumn(out, distinct_hits(F.col("_lower"), keywords) >= min_hits).drop("_lower")


def topics(articles: DataFrame, lexicon, n: int = 5, text: Column | None = None, out: str = "topics", key: str = "id",
           unroll_limit: int = UNROLL_LIMIT) -> DataFrame:
    """T10. Topics with a keyword in the text, in lexicon order, the first ``n``. A lexicon of more than
    ``unroll_limit`` keywords is joined, by the articles' unique ``key``."""
    text = F.col("content") if text is None else text
    listed = dim_rows(lexicon, unroll_limit)
    if listed is None:
        return _topics_by_join(articles, lexicon, n, text, out, key)
    work = articles.withColumn("_lower", F.lower(text))
    low = F.col("_lower")
    found = [
        F.when(any_of(low, [r["keyword"] for r in rows]), F.lit(topic))
        for topic, rows in grouped(listed, "theme", "theme_ordinal")
    ]
    return work.withColumn(out, F.slice(F.array_compact(F.array(*found)), 1, n)).drop("_lower")


def infer_stance(
    articles: DataFrame, positive=None, negative=None, neutral=None, labels=fixed.STANCE_LABELS,
    text: Column | None = None, out: str = "stance",
) -> DataFrame:
    """T11. Which of three word lists has strictly more different words in the text than both others."""
    text = F.col("content") if text is None else text
    work = articles.withColumn("_lower", F.lower(text))
    low = F.col("_lower")
    counted = (
        work.withColumn("_p", distinct_hits(low, positive or fixed.POSITIVE_WORDS))
        .withColumn("_n", distinct_hits(low, negative or fixed.NEGATIVE_WORDS))
        .withColumn("_z", distinct_hits(low, neutral or fixed.NEUTRAL_WORDS))
    )
    p, n, z = F.col("_p"), F.col("_n"), F.col("_z")
    stance = F.when((p > n) & (p > z), labels[0]).when((n > p) & (n > z), labels[1]).otherwise(labels[2])
    return counted.withColumn(out, stance).drop("_p", "_n", "_z", "_lower")


def stance_from_keywords(keywords: Column, support=None, oppose=None) -> Column:
    """T12. Stance read off a keyword list; support wins over opposition."""
    s, o = support or fixed.KEYWORD_SUPPORT, oppose or fixed.KEYWORD_OPPOSE
    return (
        F.when(F.arrays_overlap(keywords, literal_array(s)), "Supportive")
        .when(F.arrays_overlap(keywords, literal_array(o)), "Critical")
        .otherwise("Neutral")
    )
