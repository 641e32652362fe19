"""API stories: JSON text → article rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.dates import check_bound, date_from_millis
from broadsheet.functions.text import prefer_full_content

STORY_SCHEMA = (
    "`headline` string, `slug` string, `sections` array<struct<name:string,slug:string>>, "
    "`published-at` bigint, `first-published-at` bigint, `summary` string, `subheadline` string, "
    "`author-name` string"
)


def parse_story_json(
    raw: DataFrame, column: str = "raw", base_url: str = "https://news.example", full_content: str | None = None,
    source: str = "api", language: str = "Bangla", section: str | None = "politics", section_names=(),
    start=None, end=None, min_len: int = 100,
) -> DataFrame:
    """S07 (with S08, S09). Stories need a headline, a slug and a publication time; those of another
    section, outside the dates or with too little text are dropped. ``full_content`` names the column
    with the fetched page text when there is one."""
    keep = [c for c in raw.columns if c != column]
    s = raw.withColumn("_s", F.from_json(column, STORY_SCHEMA))
    s = s.select(*keep, "_s.*")
    ok = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    s = s.where(ok("headline") & ok("slug"))
    tokens = tuple(t for t in (section, *section_names) if t)
    if tokens:
        from broadsheet.operators.filters import filter_section

        s = filter_section(s, tokens, f"/{section}/")
    published = F.coalesce(F.nullif(F.col("published-at"), F.lit(0)), F.nullif(F.col("first-published-at"), F.lit(0)))
    s = s.withColumn("date", date_from_millis(published)).where(F.col("date").isNotNull())
    lo, hi = check_bound(start), check_bound(end)
    if lo is not None:
        s = s.where(F.col("date") >= F.lit(lo))
    if hi is not None:
        s = s.where(F.col("date") <= F.lit(hi))
    short = F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("subheadline"), F.lit(""))
    full = F.col(full_content) if full_content else F.lit("")
    hits = F.filter("sections", lambda x: _names_section(x["name"], tokens))
    s = s.withColumn("content", prefer_full_content(full, short, min_len)).where(F.col("content").isNotNull())
    keep = [k for k in keep if k != full_content]
    return s.select(
        *keep, F.col("headline").alias("title"), "content", "date",
        F.concat(F.lit(base_url.rstrip("/") + "/"), F.col("slug")).alias("url"),
        F.lit(source).alias("source"), F.lit(language).alias("language"),
        F.coalesce(F.get(hits, F.lit(0))["name"], F.lit(section or "general")).alias("category"),
        F.nullif(F.col("author-name"), F.lit("")).alias("author"),
    )


def _names_section(name, tokens):
    hit = F.lit(False)
    for token in tokens:
        hit = hit | F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(token.lower()))
    return hit
