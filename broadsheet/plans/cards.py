"""Article projections: store schema, its inverse, and the card shown in search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.arrays import join_list, split_list
from broadsheet.functions.dates import as_date


def _has(df: DataFrame, path: str) -> bool:
    head, _, field = path.partition(".")
    if head not in df.columns:
        return False
    return not field or field in df.schema[head].dataType.fieldNames()


def _field(df: DataFrame, path: str, kind: str) -> Column:
    return F.col(path) if _has(df, path) else F.lit(None).cast(kind)


def flatten_article(df: DataFrame, chars: int | None = None, n_keywords: int | None = None,
                    n_model_keywords: int | None = None) -> DataFrame:
    """P08. Nested article → flat store row of scalars. Top-level fields beat ``categorization``; keywords
    of a model fill an empty list or go to ``llm_extra_keywords``. ``chars`` cuts summary and stance, the
    others the keyword lists, where they are given."""
    arr = "array<string>"
    f = lambda p, k="string": _field(df, p, k)

    def pick(top: str, nested: str) -> Column:
        return F.coalesce(f(top, arr), f(nested, arr))

    keywords = pick("keywords", "categorization.keywords")
    model_keywords = f("llm_keywords.keywords", arr)
    has_model = F.coalesce(F.size(model_keywords) > 0, F.lit(False))
    model_text = F.when(has_model, join_list(model_keywords, n_model_keywords))
    text_or_null = lambda c: F.nullif(c, F.lit(""))
    cut = lambda c: c if chars is None else F.substring(c, 1, chars)
    joined_or_null = lambda c: F.when(F.size(c) > 0, join_list(c))
    out = {
        "title": f("title"), "date": f("date").cast("string"),
        "date_ts": F.unix_date(as_date(f("date"))).cast("bigint") * 86_400,
        "source": f("source"), "category": f("category"), "url": f("url"), "language": f("language"),
        "author": f("author"),
        "parties": join_list(pick("parties", "categorization.parties")),
        "people": join_list(pick("people", "categorization.people")),
        "people_affiliations": F.to_json(f("people_affiliations", "map<string,string>")),
        "keywords": F.when(keywords.isNull(), model_text).otherwise(join_list(keywords, n_keywords)),
        "themes": join_list(pick("themes", "categorization.categories")),
        "is_speech": F.initcap(F.coalesce(f("is_speech", "boolean"), f("categorization.is_speech", "boolean")).cast("string")),
        "is_stance": F.initcap(F.coalesce(f("is_stance", "boolean"), f("categorization.is_stance", "boolean")).cast("string")),
        "mentioned_figures": join_list(f("mentioned_figures", arr)),
        "primary_parties": join_list(f("primary_parties", arr)),
        "llm_summary": cut(text_or_null(f("llm_summary.summary"))),
        "llm_key_points": joined_or_null(f("llm_summary.key_points", arr)),
        "llm_stance": cut(text_or_null(f("llm_summary.stance_analysis"))),
        "llm_figure": text_or_null(f("llm_summary.political_figure")),
        "llm_party": text_or_null(f("llm_summary.political_party")),
        "llm_extra_keywords": F.when(keywords.isNotNull(), model_text),
        "llm_phrases": joined_or_null(f("llm_keywords.phrases", arr)),
        "llm_topics": joined_or_null(f("llm_keywords.topics", arr)),
    }
    kept = [c for c in ("id", "content") if c in df.columns]
    return df.select(*kept, *[c.alias(name) for name, c in out.items()])


def unflatten_article(df: DataFrame) -> DataFrame:
    """P09. Store row → nested article; reads both generations of column names."""
    f = lambda name: _field(df, name, "string")
    lists = lambda c: F.when(c.isNotNull(), split_list(c))
    boolean = lambda c: F.lower(c) == "true"
    summary = F.struct(
        f("llm_summary").alias("summary"), lists(f("llm_key_points")).alias("key_points"),
        F.coalesce(f("llm_stance_analysis"), f("llm_stance")).alias("stance_analysis"),
        f("llm_figure").alias("political_figure"), f("llm_party").alias("political_party"),
    )
    keywords = F.struct(
        lists(F.coalesce(f("llm_keywords"), f("llm_extra_keywords"))).alias("keywords"),
        lists(f("llm_phrases")).alias("phrases"), lists(f("llm_topics")).alias("topics"),
    )
    any_set = lambda *cols: F.coalesce(*cols).isNotNull()
    kept = [c for c in ("id", "content") if c in df.columns]
    return df.select(
        *kept, f("title").alias("title"), f("date").alias("date"), f("source").alias("source"),
        f("category").alias("category"), f("url").alias("url"), f("language").alias("language"),
        f("author").alias("author"),
        lists(f("parties")).alias("parties"), lists(f("people")).alias("people"),
        F.from_json(f("people_affiliations"), "map<string,string>").alias("people_affiliations"),
        lists(f("keywords")).alias("keywords"), lists(f("themes")).alias("themes"),
        boolean(f("is_speech")).alias("is_speech"), boolean(f("is_stance")).alias("is_stance"),
        F.when(any_set(
            f("llm_summary"), f("llm_key_points"), f("llm_stance_analysis"), f("llm_stance"), f("llm_figure"),
            f("llm_party")), summary).alias("llm_summary"),
        F.when(any_set(f("llm_keywords"), f("llm_extra_keywords"), f("llm_phrases"), f("llm_topics")), keywords)
        .alias("llm_keywords"),
    )


def article_card(df: DataFrame) -> DataFrame:
    """P11. Card with summary, key points, stance, keywords, phrases and topics. A summarised article's
    document is its summary; else the nested model summary; else nothing."""
    arr = "array<string>"
    empty = F.array().cast(arr)
    f = lambda p, k="string": _field(df, p, k)
    done = F.coalesce(f("is_summarized", "boolean"), F.lit(False))
    nested = _has(df, "llm_summary.summary")
    nested_kw = _has(df, "llm_keywords.keywords")
    has_summary = F.col("llm_summary").isNotNull() if nested else F.lit(False)
    has_keywords = F.col("llm_keywords").isNotNull() if nested_kw else F.lit(False)
    n = lambda p, k="string": f(p, k)

    def branch(summarized: Column, old: Column, default: Column, has: Column) -> Column:
        return F.when(done, summarized).when(has, F.coalesce(old, default)).otherwise(default)

    flat_keywords = f("llm_keyword_list", arr)
    return df.select(
        "id", "title", "date", "source", "url", "similarity", "parties", "people",
        F.coalesce(f("is_speech", "boolean"), F.lit(False)).alias("is_speech"), done.alias("is_summarized"),
        branch(F.col("content"), n("llm_summary.summary") if nested else F.lit(None).cast("string"), F.lit(""),
               has_summary).alias("summary"),
        branch(F.coalesce(f("llm_key_points", arr), empty),
               n("llm_summary.key_points", arr) if nested else F.lit(None).cast(arr), empty, has_summary)
        .alias("key_points"),
        branch(f("llm_stance_analysis"), n("llm_summary.stance_analysis") if nested else F.lit(None).cast("string"),
               F.lit(""), has_summary).alias("stance_analysis"),
        F.when(done, F.coalesce(flat_keywords, empty))
        .when(has_keywords, n("llm_keywords.keywords", arr) if nested_kw else empty)
        .otherwise(F.coalesce(f("keywords", arr), empty)).alias("keywords"),
        branch(empty, n("llm_keywords.phrases", arr) if nested_kw else F.lit(None).cast(arr), empty, has_keywords)
        .alias("key_phrases"),
        branch(F.coalesce(f("llm_topics", arr), empty), n("llm_keywords.topics", arr) if nested_kw else
               F.lit(None).cast(arr), empty, has_keywords).alias("topics"),
    )
