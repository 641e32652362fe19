"""Composite pages: party and figure profiles, category listings, the categorisation audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.dims import config_rows
from broadsheet.functions.arrays import first_non_empty
from broadsheet.functions.text import preview
from broadsheet.operators.entities import attach_summary, check_category, missing_associations
from broadsheet.operators.filters import filter_affiliated, filter_any, filter_date_lexical, filter_date_strict, filter_source_ci
from broadsheet.operators.identity import dedup_by_url
from broadsheet.operators.paging import group_by_date, latest_n, paginate
from broadsheet.operators.stats import party_figure_breakdown


def _summaries(df: DataFrame) -> DataFrame:
    """Columns of a profile's article list. The preview is cut before anything is sorted."""
    extra = [c if c in df.columns else F.array().cast("array<string>").alias(c) for c in ("llm_topics", "llm_extra_keywords")]
    return df.select("id", "title", "date", "source", "url", "parties", "people", "keywords", *extra,
                     preview("content", 300).alias("preview")).withColumn(
        "best_keywords", first_non_empty("llm_topics", "llm_extra_keywords", "keywords")).drop(
        "llm_topics", "llm_extra_keywords")


def _check(gaz, party: str, figure: str | None = None) -> None:
    rows = config_rows(gaz)
    if party not in {r["party"] for r in rows}:
        raise ValueError(f"unknown party {party!r}")
    if figure is not None and figure not in {r["canonical"] for r in rows if r["party"] == party and r["kind"] == "figure"}:
        raise ValueError(f"{figure!r} is not listed under {party!r}")


def party_articles(articles: DataFrame, gaz, party: str, date_from=None, date_to=None, dedup: bool = True) -> DataFrame:
    _check(gaz, party)
    rows = filter_any(articles, parties=[party])
    if dedup:
        rows = dedup_by_url(rows)
    return filter_date_strict(rows, date_from, date_to)


def _kept(rows: DataFrame, dedup: bool, date_from, date_to) -> DataFrame:
    """First row of each URL, then the date range. Listed rows come in, so no text is shuffled to find duplicates."""
    return filter_date_strict(dedup_by_url(rows) if dedup else rows, date_from, date_to)


def party_profile(articles: DataFrame, gaz, party: str, date_from=None, date_to=None, page: int = 1, size: int = 20,
                  dedup: bool = True) -> DataFrame:
    """O07. One page of a party's articles, newest first, with totals. Every party of the gazetteer has a
    profile, also without articles."""
    _check(gaz, party)
    rows = _kept(_summaries(filter_any(articles, parties=[party])), dedup, date_from, date_to)
    return paginate(rows, page, size).withColumn("party", F.lit(party))


def figure_articles(articles: DataFrame, gaz, party: str, figure: str, date_from=None, date_to=None,
                    dedup: bool = True) -> DataFrame:
    _check(gaz, party, figure)
    rows = filter_affiliated(articles, figure, party)
    if dedup:
        rows = dedup_by_url(rows)
    return filter_date_strict(rows, date_from, date_to)


def figure_profile(articles: DataFrame, gaz, party: str, figure: str, date_from=None, date_to=None,
                   top_k: int | None = None, page: int | None = None, size: int = 20, dedup: bool = True) -> DataFrame:
    """O08. A figure's articles under a party: the newest ``top_k``, or one page, or all."""
    _check(gaz, party, figure)
    rows = _kept(_summaries(filter_affiliated(articles, figure, party)), dedup, date_from, date_to)
    if page is not None:
        rows = paginate(rows, page, size)
    elif top_k:
        rows = latest_n(rows, top_k)
    return rows.withColumn("party", F.lit(party)).withColumn("figure", F.lit(figure))


def profile_timeline(profile: DataFrame) -> DataFrame:
    """O05 over a profile's page."""
    return group_by_date(profile)


def profile_summary(profile: DataFrame, summaries: DataFrame, name: str) -> DataFrame:
    """J13 beside a profile page."""
    return attach_summary(profile, summaries, name)


def category_articles(articles: DataFrame, taxonomy, category: str, party: str | None = None, start=None, end=None,
                      source: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """O09. One page of a category's articles with the excerpt and whether it is the primary category."""
    check_category(taxonomy, category)
    rows = articles.where(F.array_contains("ai_categories", category))
    rows = filter_any(rows, parties=[party] if party else None)
    rows = filter_date_lexical(rows, start, end)
    if source:
        rows = filter_source_ci(rows, source)
    excerpt = (
        F.coalesce(F.try_element_at("category_excerpts", F.lit(category)), F.lit(""))
        if "category_excerpts" in rows.columns else F.lit("")
    )
    listed = rows.select(
        "id", "title", "content", "date", "source", "url", "parties", "people", "primary_category", "ai_categories",
        (F.col("primary_category") == category).alias("is_primary"), excerpt.alias("relevant_excerpt"),
    )
    return paginate(listed, page, size)


def categorization_audit(articles: DataFrame, limit: int = 50) -> DataFrame:
    """O10. The newest articles with their tags, as shown to an auditor."""
    from broadsheet.functions.arrays import join_list

    return latest_sample(articles, limit).select(
        "id", F.coalesce("title", F.lit("No title")).alias("title"), "date", "source", join_list("parties").alias("parties"),
        join_list("people").alias("people"), F.to_json("people_affiliations").alias("people_affiliations"),
        F.substring(join_list("keywords"), 1, 100).alias("keywords"), F.substring("content", 1, 200).alias("content_preview"),
    )


def latest_sample(articles: DataFrame, limit: int) -> DataFrame:
    return articles.orderBy(F.desc_nulls_last("date"), F.desc("id")).limit(limit)


def audit_breakdown(articles: DataFrame, limit: int = 50) -> DataFrame:
    """O10's party → figures of the sample."""
    return party_figure_breakdown(latest_sample(articles, limit))


def audit_issues(articles: DataFrame, gaz) -> DataFrame:
    """O10 with J12: figures found under a party whose gazetteer entry does not list them."""
    pairs = party_figure_breakdown(articles).select("party", F.explode("figures").alias("figure"))
    return missing_associations(pairs, gaz)


def browse_partition(store: DataFrame, party: str | None = None, figure: str | None = None, where: dict | None = None,
                     limit: int = 10) -> DataFrame:
    """O11. Articles of a party partition or that mention a figure (loose, on the joined list), with
    further equality conditions; the first ``limit`` by id."""
    from broadsheet.operators.filters import filter_contains, filter_generic

    rows = store if party is None else store.where(F.col("party_id") == party)
    if figure is not None:
        rows = filter_contains(rows, "mentioned_figures", figure)
    return filter_generic(rows, where or {}).orderBy("id").limit(limit)
