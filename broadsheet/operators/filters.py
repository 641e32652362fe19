"""Filters on articles. Each is a conjunction of column predicates, so Catalyst pushes what it can to the
scan and nothing is ranked or counted before it is filtered."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions.arrays import literal_array
from broadsheet.functions.dates import as_date, check_bound

log = logging.getLogger(__name__)


def _is_date(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.DateType)


def date_between(df: DataFrame, date: str, start, end) -> DataFrame:
    """Inclusive date range; rows without a readable date fail as soon as one bound is given."""
    lo, hi = check_bound(start), check_bound(end)
    c = F.col(date) if _is_date(df, date) else as_date(date)
    if lo is not None:
        df = df.where(c >= F.lit(lo))
    if hi is not None:
        df = df.where(c <= F.lit(hi))
    return df


def filter_articles(
    df: DataFrame, category=None, is_speech=None, is_stance=None, source=None, language=None,
    date_from=None, date_to=None, date: str = "date",
) -> DataFrame:
    """F01. Every given condition must hold."""
    equal = {"category": category, "is_speech": is_speech, "is_stance": is_stance, "source": source,
             "language": language}
    for name, value in equal.items():
        if value is not None and value != "":
            df = df.where(F.col(name) == F.lit(value))
    return date_between(df, date, date_from, date_to)


def any_element(column: str, values) -> Column:
    return F.arrays_overlap(F.col(column), literal_array(values))


def filter_any(df: DataFrame, parties=None, people=None, themes=None) -> DataFrame:
    """F02. Any value of a list, all lists; exact elements."""
    for name, values in {"parties": parties, "people": people, "themes": themes}.items():
        if values:
            df = df.where(any_element(name, values))
    return df


def filter_date_lexical(df: DataFrame, start=None, end=None, date: str = "date") -> DataFrame:
    """F03. ISO text comparison: a missing date sorts below every bound, so it fails a start bound only."""
    c = F.coalesce(F.col(date).cast("string"), F.lit(""))
    is_date = _is_date(df, date)  # bounds on a date column reach the scan
    if start:
        bound = check_bound(start)
        df = df.where(F.col(date) >= F.lit(bound) if is_date else c >= str(bound))
    if end:
        bound = check_bound(end)
        df = df.where((F.col(date) <= F.lit(bound)) | F.col(date).isNull() if is_date else c <= str(bound))
    return df


def filter_date_strict(df: DataFrame, start=None, end=None, date: str = "date") -> DataFrame:
    """F04. Bounds must be real dates; rows whose date is not one are dropped when a bound is given."""
    return date_between(df, date, start, end)


def filter_affiliated(df: DataFrame, figure: str, party: str | None = None,
                      affiliations: str = "people_affiliations") -> DataFrame:
    """F05. The figure is affiliated with the party, or with any party when none is given."""
    m = F.col(affiliations)
    if party is None:
        return df.where(F.map_contains_key(m, figure))
    return df.where(F.try_element_at(m, F.lit(figure)) == party)


def filter_source_ci(df: DataFrame, source: str) -> DataFrame:
    """F06."""
    return df.where(F.lower("source") == source.lower())


def filter_presence(df: DataFrame, has_people: bool | None = None, has_parties: bool | None = None) -> DataFrame:
    """F07. Unset conditions do not filter."""
    for name, wanted in {"people": has_people, "parties": has_parties}.items():
        if wanted is not None:
            present = F.size(F.coalesce(F.col(name), F.array().cast("array<string>"))) > 0
            df = df.where(present if wanted else ~present)
    return df


def filter_contains(df: DataFrame, field: str, value: str, date_from=None, date_to=None) -> DataFrame:
    """F08. Substring of the joined list, so a short name also finds longer ones; date range on top."""
    joined = F.array_join(F.col(field), ", ")
    return date_between(df.where(F.contains(joined, F.lit(value))), "date", date_from, date_to)


def filter_generic(df: DataFrame, conditions: dict) -> DataFrame:
    """F09. Scalar → equality; list → any element (array columns) or membership; None → no condition."""
    for name, value in conditions.items():
        if value is None:
            continue
        if isinstance(value, (list, tuple, set)):
            array = isinstance(df.schema[name].dataType, T.ArrayType)
            df = df.where(any_element(name, list(value)) if array else F.col(name).isin(list(value)))
        else:
            df = df.where(F.col(name) == F.lit(value))
    return df


def text_search(df: DataFrame, query: str, columns=("title", "content")) -> DataFrame:
    """F10. Case-insensitive substring in any of the columns."""
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), F.lit(query.lower()))
    return df.where(hit)


def session_search(messages: DataFrame, titles: DataFrame, query: str) -> DataFrame:
    """F10 for chat sessions: the title or any message contains the text. One row per session."""
    q = F.lit(query.lower())
    per = messages.groupBy("conv_id").agg(F.bool_or(F.contains(F.lower("text"), q)).alias("_any"))
    return (
        titles.join(per, "conv_id", "left")
        .where(F.coalesce("_any", F.lit(False)) | F.contains(F.lower("title"), q))
        .drop("_any")
    )


def filter_uncategorized(df: DataFrame, start, end, force: bool = False, limit: int | None = None) -> DataFrame:
    """F11. Work list of the classifier: in range, not yet categorised unless ``force``; oldest ids first."""
    done = (F.size(F.coalesce(F.col("ai_categories"), F.array().cast("array<string>"))) > 0) | (
        F.coalesce(F.col("primary_category"), F.lit("")) != "")
    out = date_between(df, "date", start, end)
    if not force:
        out = out.where(~done)
    return out.orderBy("id").limit(limit) if limit else out


def filter_people_fuzzy(df: DataFrame, name: str) -> DataFrame:
    """F12. Either name contains the other, without case."""
    n = name.lower()
    return df.where(F.exists("people", lambda p: F.contains(F.lower(p), F.lit(n)) | F.contains(F.lit(n), F.lower(p))))


def filter_by_source_name(df: DataFrame, names, known=None) -> DataFrame:
    """F14. Keep the listed sources; names that are not known are reported and skipped."""
    wanted = list(names)
    if known is not None:
        for name in wanted:
            if name not in known:
                log.warning("unknown source %r skipped", name)
        wanted = [n for n in wanted if n in known]
    return df.where(F.col("source").isin(wanted)) if wanted else df.where(F.lit(False))


def filter_section(stories: DataFrame, tokens=("politics",), url_part: str = "/politics/", sections: str = "sections",
                   slug: str = "slug") -> DataFrame:
    """S08. A section name or slug holds one of the tokens, or the story's URL lies in the section."""
    def named(s: Column) -> Column:
        hit = F.lit(False)
        for token in tokens:
            for field in ("name", "slug"):
                hit = hit | F.contains(F.lower(F.coalesce(s[field], F.lit(""))), F.lit(token.lower()))
        return hit

    listed = F.coalesce(F.exists(F.col(sections), named), F.lit(False))
    return stories.where(listed | F.contains(F.col(slug), F.lit(url_part)))
