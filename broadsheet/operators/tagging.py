"""Composite taggers: categorisation of articles (T14) and the rule-based analysis (T17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet import fixed_values as fixed
from broadsheet.dims import Dim, dim_frame
from broadsheet.functions.dates import extract_dates
from broadsheet.functions.text import summary_lead
from broadsheet.operators.entities import (
    affiliations_of, combined_text, entity_map, figure_list, party_list, tag_entities, tag_people_partial,
)
from broadsheet.operators.keywords import key_points, keywords_by_frequency, keywords_combined, keywords_simple
from broadsheet.operators.names import distinct_known_names, figure_aliases
from broadsheet.operators.themes import infer_stance, is_keyword_article, theme_scores, topics

SPEECH_CATEGORY, STANCE_CATEGORY = "Speech Analysis", "Political Stance"


def categorize(
    articles: DataFrame, gaz, lexicon, speech=None, stance=None, mode: str = "word", keywords: str = "frequency",
    text: Column | None = None, n_keywords: int = 15, people: str = "figures", aliases=None, key: str = "id", **keyword_options,
) -> DataFrame:
    """T14. Adds entities, parties, people, people_affiliations, theme_scores, themes, keywords, dates,
    is_speech, is_stance, categories and the five sizes. Narrow throughout: each article is read once and
    never shuffled (unless ``keywords='combined'`` asks for corpus statistics, or a dimension is so large that it is
    joined by the unique ``key``).

    ``people='figures'`` lists the figures of the entities found; ``people='partial'`` looks for names whole or in part
    (J03), brings them to their canonical form by ``aliases`` (J07; the gazetteer's own if not given) and keeps each once (R10)."""
    if people not in ("figures", "partial"):
        raise ValueError(f"unknown kind of people {people!r}")
    text = combined_text() if text is None else text
    base = articles.drop("parties", "people", "people_affiliations", "themes", "keywords", "is_speech", "is_stance")
    work = tag_entities(base.withColumn("_all", text), gaz, mode, key, text=F.col("_all"))
    work = work.withColumn("political_entities", entity_map()).withColumn("parties", party_list()).withColumn("people", figure_list())
    work = work.drop("entities")
    if people == "partial":
        known = dim_frame(articles.sparkSession, gaz).where("kind = 'figure'").select("variant")
        work = tag_people_partial(work, gaz, F.col("_all"), "people", key)
        work = distinct_known_names(work, key, "people", known, figure_aliases(gaz) if aliases is None else aliases)
    work = work.withColumn("people_affiliations", affiliations_of(F.col("people"), gaz))
    work = theme_scores(work, lexicon, F.col("_all"), key=key).withColumn("themes", F.array_sort(F.map_keys("theme_scores")))
    if keywords == "combined":
        work = keywords_combined(work, n_keywords, text=F.col("_all"), out="keywords", **keyword_options)
    else:
        work = keywords_by_frequency(work, n_keywords, text=F.col("_all"), out="keywords", **keyword_options)
    work = is_keyword_article(work, speech or fixed.SPEECH_KEYWORDS, "is_speech", text=F.col("_all"))
    work = is_keyword_article(work, stance or fixed.STANCE_KEYWORDS, "is_stance", text=F.col("_all"))
    flags = F.array_compact(F.array(
        F.when(F.col("is_speech"), SPEECH_CATEGORY), F.when(F.col("is_stance"), STANCE_CATEGORY)))
    return (
        work.withColumn("dates", extract_dates("_all"))
        .withColumn("categories", F.array_sort(F.array_union(F.array_union("parties", "themes"), flags)))
        .withColumns({f"total_{c}": F.size(c) for c in ("categories", "people", "parties", "keywords", "dates")})
        .drop("_all")
    )


def analyze_rule_based(
    articles: DataFrame, topic_lexicon: Dim, verbs=None, positive=None, negative=None, neutral=None,
    stopwords=None,
) -> DataFrame:
    """T17. Adds summary, key_points, topics, keywords and stance. Narrow."""
    work = articles.withColumn("summary", summary_lead("content"))
    work = key_points(work, verbs=verbs)
    work = topics(work, topic_lexicon)
    work = keywords_simple(work.drop("keywords"), stopwords=stopwords, out="keywords")
    return infer_stance(work, positive, negative, neutral)


def analyze_entity(assigned: DataFrame, topic_lexicon: Dim, party: str | None = None, figure: str | None = None,
                   date=None, limit: int | None = None, **lists) -> DataFrame:
    """T17 over the articles of a party or a figure; ``limit`` takes the first by id."""
    rows = assigned if party is None else assigned.where(F.col("party_id") == party)
    if figure is not None:
        rows = rows.where(F.array_contains("mentioned_figures", figure))
    if date is not None:
        rows = rows.where(F.col("date") == F.lit(date))
    if limit:
        rows = rows.orderBy("id").limit(limit)
    return analyze_rule_based(rows, topic_lexicon, **lists)
