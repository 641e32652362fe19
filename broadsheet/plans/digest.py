"""Composite jobs around the model: retrieval for questions, answers, entity digests, period summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.dates import check_bound, parse_multi_format_date
from broadsheet.operators.enrich import (
    NO_HITS_CONTEXT, Completer, answer_prompt, build_summary_prompts, classify_queries, complete,
    parse_marked_sections, parse_period_sections, parse_sectioned_summary,
)
from broadsheet.operators.filters import filter_any, filter_date_strict
from broadsheet.operators.index import VectorIndex
from broadsheet.operators.identity import dedup_by_url, replace_document
from broadsheet.operators.ranking import (
    intent_filters, pack_context, relax_if_empty, rerank, select_strategy, top_ranked, top_sources,
)
from broadsheet.operators.ranges import running
from broadsheet.operators.search import embed, filter_index, filtered_knn_join
from broadsheet.operators.stats import coverage_window
from broadsheet.operators.summaries import lookup_summary
from broadsheet.session import bounded_rows, broadcast_if_small, materialize


def retrieve(questions: DataFrame, corpus: DataFrame, k: int = 20, now=None, metric: str = "cosine",
             known_parties=("Interim Government",), index: VectorIndex | None = None) -> DataFrame:
    """V13. Per question the k best articles: filters from its intent, twice k candidates, without list
    filters when those leave nothing, re-ranked. ``questions``: query_id, embedding and the intent columns.

    Only ids and scores leave the index (``index``, or one made of the corpus: see
    :func:`broadsheet.operators.search.filter_index`); the few chosen articles are joined back to their texts.
    """
    filters = intent_filters(questions, known_parties)
    index = filter_index(corpus, metric) if index is None else index
    # staged, so that the corpus is scored once although the next steps read the hits several times; only questions
    # that their filters leave without a hit are asked again without list filters
    strict = materialize(filtered_knn_join(filters, index, 2 * k, metric, forms=(True,)), "hits")
    missed = filters.join(strict.select("query_id").distinct(), "query_id", "left_anti")
    loose = materialize(filtered_knn_join(missed, index, 2 * k, metric, forms=(False,)), "hits")
    hits = relax_if_empty(strict, loose).select("query_id", "id", "similarity")
    window = questions.select("query_id", F.col("time_constraint.days").alias("_days"))
    articles = broadcast_if_small(hits).join(corpus.drop("embedding"), "id").join(window, "query_id", "left")
    today = F.current_date() if now is None else (now if isinstance(now, Column) else F.lit(now))
    return top_ranked(rerank(articles, today, F.col("_days")), k).drop("_days")


def answer_batch(
    questions: DataFrame, corpus: DataFrame, intent_completer: Completer, answer_completer: Completer, known: list[str],
    topics: list[str], now, k: int = 20, max_chars: int = 24_000, encoder=None, dim: int = 384,
) -> tuple[DataFrame, DataFrame]:
    """E19. (answers, sources) of many questions: intent, retrieval, packed context, completion. A question
    without hits is asked with a fixed context. ``questions``: query_id, query, language."""
    intents = classify_queries(questions, intent_completer, known, topics, now)
    embedded = materialize(embed(intents, encoder, dim, text=F.col("query")), "intents")
    ranked = materialize(retrieve(embedded, corpus, k, now), "ranked")
    context = pack_context(ranked, max_chars)
    asked = (
        embedded.drop("embedding", "embedding_dimension", "error").join(context, "query_id", "left")
        .withColumn("context", F.coalesce("context", F.lit(NO_HITS_CONTEXT)))
        .withColumn("strategy", select_strategy())
        .withColumn("prompt", answer_prompt())
    )
    counts = ranked.groupBy("query_id").agg(F.count("*").alias("total_articles_retrieved"))
    answers = (
        complete(asked, answer_completer, out="answer").withColumn("answer", F.btrim("answer"))
        .join(counts, "query_id", "left").fillna(0, ["total_articles_retrieved"])
        .select("query_id", "query", "answer", "error", "type", "strategy", "total_articles_retrieved")
    )
    return answers, top_sources(ranked)


def entity_articles(articles: DataFrame, entity_type: str, name: str, start=None, end=None) -> DataFrame:
    """Articles of a party or figure, one per URL, in a strict date range."""
    if entity_type not in ("party", "figure"):
        raise ValueError("entity_type is party or figure")
    rows = filter_any(articles, parties=[name] if entity_type == "party" else None,
                      people=[name] if entity_type == "figure" else None)
    return filter_date_strict(dedup_by_url(rows), start, end)


def newest_articles(articles: DataFrame, n: int) -> DataFrame:
    """The n newest articles, by a date in any of four formats; undated ones last."""
    d = F.col("date") if articles.schema["date"].dataType.typeName() == "date" else parse_multi_format_date("date")
    return articles.orderBy(F.desc_nulls_last(d), F.desc("id")).limit(n)


def build_digest_input(articles: DataFrame, entity_type: str, name: str, n: int, start=None, end=None) -> DataFrame:
    """E12. One row: the n newest articles of an entity as numbered blocks, with A18's window. Articles are chosen without their
    texts; the texts of the n chosen ones (ids are distinct) are read then and stored for the steps that follow."""
    ids = newest_articles(entity_articles(articles.drop("content"), entity_type, name, start, end), n).select("id")
    chosen = materialize(articles.join(F.broadcast(ids), "id", "left_semi"), "chosen")
    order = F.struct(
        (-F.unix_date(F.coalesce(F.col("date"), F.to_date(F.lit("0001-01-01"))))).alias("d"), (-F.col("id")).alias("i"),
        F.coalesce("title", F.lit("No title")).alias("title"), F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce(F.col("date").cast("string"), F.lit("No date")).alias("date"),
        F.coalesce("source", F.lit("Unknown")).alias("source"),
    )
    # at most n rows meet here, n being the size of one prompt
    packed = chosen.agg(F.sort_array(F.collect_list(order)).alias("a"))
    text = F.array_join(F.transform("a", lambda x, i: F.concat(
        F.lit("\nArticle #"), (i + 1).cast("string"), F.lit("\nDate: "), x["date"], F.lit("\nSource: "), x["source"],
        F.lit("\nTitle: "), x["title"], F.lit("\nContent: "), x["content"], F.lit("\n---\n"))), "\n")
    window = coverage_window(chosen)
    row = packed.select(F.lit(entity_type).alias("entity_type"), F.lit(name).alias("entity_name"),
                        F.size("a").cast("bigint").alias("articles_analyzed"), text.alias("digest_text"))
    for c in ("earliest", "latest", "sources", "sample_titles"):
        row = row.withColumn(c, window.select(c).scalar())
    return row


def digest_prompt() -> Column:
    return F.concat(
        F.lit("The articles below are the "), F.col("articles_analyzed").cast("string"),
        F.lit(" most recent ones about "), F.col("entity_name"),
        F.lit(".\nAnswer under these headings, starting with the first: **TOP_KEYWORDS** (10, comma-separated), "
              "**TOPICS_COVERED** (5-7, comma-separated), **SUMMARY** (2-3 paragraphs), then an analysis of stance, "
              "themes, developments, people, sentiment and quotes.\n"), F.col("digest_text"))


def fallback_digest() -> Column:
    """Statistics text that stands in for a failed completion."""
    sources = F.array_join("sources", ", ")
    na = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    n = F.col("articles_analyzed").cast("string")
    return F.concat(
        F.lit("**Overall Positioning & Stance**\n"), F.col("entity_name"), F.lit(" is covered in "), n,
        F.lit(" articles from "), sources, F.lit(".\n\n**Article Summary**\n- Total articles: "), n,
        F.lit("\n- Date range: "), na("earliest"), F.lit(" to "), na("latest"), F.lit("\n- Sources: "), sources,
        F.lit("\n\n**Recent Headlines**\n"),
        F.array_join(F.transform("sample_titles", lambda t: F.concat(F.lit("- "), t)), "\n"), F.lit("\n"))


def entity_digest(articles: DataFrame, entity_type: str, name: str, completer: Completer, n: int = 50, start=None,
                  end=None, now=None, associated_party: str | None = None) -> DataFrame:
    """E13. One row: the digest of an entity's newest articles, ready for E15. No articles, no row. A failed
    completion leaves the statistics text as analysis."""
    row = build_digest_input(articles, entity_type, name, n, start, end).where("articles_analyzed > 0")
    asked = complete(row.withColumn("prompt", digest_prompt()), completer)
    done = asked.withColumn("raw_analysis", F.coalesce("response", fallback_digest())).withColumn(
        "_p", parse_marked_sections("raw_analysis"))
    return done.select(
        "entity_type", "entity_name", "_p.keywords", "_p.topics", "_p.summary", "articles_analyzed",
        F.lit(associated_party).cast("string").alias("associated_party"),
        (F.current_timestamp() if now is None else F.lit(now)).cast("timestamp").alias("last_updated"),
        "raw_analysis", "earliest", "latest", "sources", "sample_titles",
    )


def period_articles(articles: DataFrame, entity_type: str, name: str, start, end) -> DataFrame:
    rows = filter_any(articles, parties=[name] if entity_type == "party" else None,
                      people=[name] if entity_type == "figure" else None)
    return filter_date_strict(rows, start, end)


def summarize_missing(rows: DataFrame, completer: Completer) -> DataFrame:
    """E14's per-article step: (id, title, date, summary, already_summarized, error) and what the response says beside the
    summary (``SUMMARY_FIELDS``). An article whose summary fails stays, with a NULL summary and the reason."""
    done = F.coalesce("is_summarized", F.lit(False)) if "is_summarized" in rows.columns else F.lit(False)
    flagged = rows.withColumn("_done", done)
    asked = build_summary_prompts(flagged.withColumn("language", F.lit("Bangla")), "_all")
    asked = complete(asked.withColumn("_p", F.when(~F.col("_done"), F.col("_all"))), completer, "_p", "_r", "_e")
    asked = asked.withColumn("_read", parse_sectioned_summary("_r"))
    answered = F.col("_r").isNotNull()
    summary = F.when(F.col("_done"), F.col("content")).otherwise(F.when(answered, F.col("_read.summary")))
    return asked.select(
        "id", "title", "date", summary.alias("summary"), F.col("_done").alias("already_summarized"),
        F.when(summary.isNull(), F.coalesce("_e", F.lit("no summary in the response"))).alias("error"),
        *[F.when(answered, F.col(f"_read.{field}")).alias(name) for name, field in SUMMARY_FIELDS.items()])


#: Columns of an article that a summary's response fills, and its sections.
SUMMARY_FIELDS = {"llm_key_points": "key_points", "llm_keyword_list": "keywords", "llm_topics": "topics", "llm_stance_analysis": "stance_analysis"}
#: Texts of a range when running lengths are summed: each is up to half a prompt long.
TEXTS_IN_RANGE = 2_000


def combine_texts(rows: DataFrame, completer: Completer, instruction: str, max_chars: int) -> tuple[str | None, str | None]:
    """(response, error): one response over the texts of all rows (order_key, text), in key order.

    While everything fits one prompt it is one call. Otherwise the rows are cut into groups that each fit a
    prompt (a text beyond half a prompt in pieces first), each group is summarised in its task, and the
    summaries are combined the same way, for as many levels as it takes. The texts of a group whose call fails
    go on as they are, so none is lost; if they then do not get shorter, the failure is the error and there is
    no response. No task or driver ever holds more than one prompt.
    """
    half, before, failure, levels = max(1, max_chars // 2), None, None, iter(("month", "year"))
    while True:
        total = rows.agg(F.sum(F.length("text") + 2).alias("chars"), F.count("*").alias("n")).first()
        if not total["n"]:
            return None, None
        if total["chars"] <= max_chars or total["n"] == 1 and total["chars"] <= max_chars + 2:
            packed = rows.agg(F.sort_array(F.collect_list(F.struct("order_key", "text"))).alias("a"))
            prompt = F.concat(F.lit(instruction), F.array_join(F.transform("a", lambda x: x["text"]), "\n\n"))
            last = complete(packed.select(prompt.alias("prompt")), completer).first()
            return last["response"], last["error"]
        if before is not None and total["chars"] >= before:
            if failure:
                return None, failure
            raise ValueError("responses are not shorter than their prompts, so the texts cannot be combined")
        before = total["chars"]
        level = next(levels, None)
        cuts = F.sequence(F.lit(0), F.ceil(F.greatest(F.length("text"), F.lit(1)) / half).cast("int") - 1)
        pieces = rows.select("order_key", F.posexplode(F.transform(cuts, lambda i: F.substring("text", i * half + 1, F.lit(half)))).alias("_at", "text"))
        # running lengths: a group begins below half a prompt and takes in at most half a prompt more
        pieces = running(pieces, [F.xxhash64("text"), F.col("_at")], {"_upto": F.length("text") + 2}, by=["order_key"], range_rows=TEXTS_IN_RANGE)
        part = F.floor((F.col("_upto") - F.length("text") - 2) / half)
        packed = pieces.withColumn("_part", part).groupBy("order_key", "_part").agg(
            F.array_join(F.sort_array(F.collect_list("text")), "\n\n").alias("_texts"))
        prompts = packed.select("order_key", "_texts", F.concat(F.lit(instruction), F.col("_texts")).alias("prompt"))
        coarser = F.lit("") if level is None else F.coalesce(F.trunc(F.try_to_date("order_key"), level).cast("string"), F.lit(""))
        partial = complete(prompts, completer).select(
            coarser.alias("order_key"), F.coalesce("response", "_texts").alias("text"),
            F.when(F.col("response").isNull(), F.coalesce("error", F.lit("no response"))).alias("error"))
        rows = materialize(partial, "combined")
        failure = rows.agg(F.max("error")).first()[0]


PERIOD_INSTRUCTION = (
    "নিচের সারাংশগুলো বিশ্লেষণ করে বাংলায় উত্তর দিন। শিরোনাম: সারসংক্ষেপ: (২০০-৩০০ শব্দ), মূল পয়েন্ট: (- দিয়ে ৫-৮টি), "
    "মূল শব্দ: (কমা দিয়ে ৮-১২টি), আলোচিত বিষয়: (কমা দিয়ে ৫-৮টি)।\n\n"
)


def period_summary(
    articles: DataFrame, cache: DataFrame, entity_type: str, name: str, start, end, article_completer: Completer,
    period_completer: Completer, max_chars: int = 200_000, now=None,
) -> tuple[DataFrame, DataFrame | None]:
    """E14. (summary row, articles with the new summaries merged by R08: document, key points, keywords, topics, stance). ``failed_articles`` counts articles without a summary and
    ``error`` says why the answer is not complete (NULL: it is). A cached key is returned as it is, with no model call
    and no articles to merge; an entity without articles gives no row."""
    hit = lookup_summary(cache, entity_type, name, start, end)
    if bounded_rows(hit.select("entity_name").limit(1), 1):
        return hit.withColumn("from_cache", F.lit(True)), None
    rows = materialize(summarize_missing(period_articles(articles, entity_type, name, start, end), article_completer), "period")
    texts = rows.where("summary is not null").select(
        F.col("date").cast("string").alias("order_key"),
        F.concat(F.lit("Date: "), F.col("date").cast("string"), F.lit("\nTitle: "), F.coalesce("title", F.lit("")),
                 F.lit("\nSummary: "), F.col("summary")).alias("text"))
    response, error = combine_texts(texts, period_completer, PERIOD_INSTRUCTION, max_chars)
    stats = rows.agg(
        F.count("*").alias("total_articles"),
        F.count_if(~F.col("already_summarized") & F.col("summary").isNotNull()).alias("newly_summarized"),
        F.count_if("already_summarized").alias("already_summarized"), F.count_if(F.col("summary").isNull()).alias("failed"),
        F.max("error").alias("_error"))
    out = (
        stats.where("total_articles > 0")
        .withColumn("_p", parse_period_sections(F.lit(response if response is not None else "")))
        .select(
            F.lit(entity_type).alias("entity_type"), F.lit(name).alias("entity_name"),
            F.lit(check_bound(start)).alias("start_date"), F.lit(check_bound(end)).alias("end_date"), "_p.summary",
            "_p.key_points", "_p.keywords", "_p.topics",
            F.struct("total_articles", "newly_summarized", "already_summarized").alias("statistics"),
            (F.current_timestamp() if now is None else F.lit(now)).cast("timestamp").alias("last_updated"),
            F.lit(False).alias("from_cache"), F.col("failed").alias("failed_articles"),
            F.coalesce(F.lit(error).cast("string"), F.col("_error")).alias("error"))
    )
    fresh = rows.where("not already_summarized and summary is not null").select("id", "summary", *SUMMARY_FIELDS)
    return out, replace_document(articles, fresh, also=tuple(SUMMARY_FIELDS))
