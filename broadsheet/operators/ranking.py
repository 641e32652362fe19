"""Re-ranking, intents and context packing for batches of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from broadsheet.functions.arrays import literal_array
from broadsheet.functions.dates import recency_score

# Weights of the four ranking signals and of their levels.
WEIGHTS = {"similarity": 0.4, "importance": 0.3, "recency": 0.2, "completeness": 0.1}
IMPORTANCE = {"speech": 1.0, "stance": 0.8, "summarised": 0.6, "other": 0.4}
COMPLETENESS = {"llm_summary": 0.4, "llm_keywords": 0.3, "llm_topics": 0.3}


def present(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(False)
    if df.schema[name].dataType.typeName() in ("array", "map"):
        return F.coalesce(F.size(name) > 0, F.lit(False))
    return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""


def rerank(candidates: DataFrame, now, window_days=None, weights: dict = WEIGHTS) -> DataFrame:
    """V11. Adds ``rerank_score``: similarity, importance, recency and completeness, weighted. ``now`` is a
    date column or value; ``window_days`` the asked time window, if any."""
    now = now if isinstance(now, Column) else F.lit(now)
    importance = (
        F.when(F.coalesce("is_speech", F.lit(False)), IMPORTANCE["speech"])
        .when(F.coalesce("is_stance", F.lit(False)), IMPORTANCE["stance"])
        .when(present(candidates, "llm_summary"), IMPORTANCE["summarised"])
        .otherwise(IMPORTANCE["other"])
    )
    completeness = F.lit(0.0)
    for name, share in COMPLETENESS.items():
        completeness = completeness + F.when(present(candidates, name), share).otherwise(0.0)
    score = (
        F.coalesce("similarity", F.lit(0.5)) * weights["similarity"] + importance * weights["importance"]
        + recency_score("date", now, window_days) * weights["recency"] + completeness * weights["completeness"]
    )
    return candidates.withColumn("rerank_score", score)


def top_ranked(scored: DataFrame, k: int, query_id: str = "query_id", id: str = "id",
               score: str = "rerank_score") -> DataFrame:
    """Best k per query with their ``position``; each task keeps at most k rows of a query."""
    w = W.partitionBy(query_id).orderBy(F.desc(score), id)
    return scored.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def intent_filters(intents: DataFrame, known_parties=("Interim Government",)) -> DataFrame:
    """V14. Entities in capitals, or known as parties, become party filters, the others people filters;
    topics become themes; the time constraint becomes a date range. Empty lists filter nothing."""
    e = F.col("entities")
    known = literal_array(known_parties) if known_parties else F.array().cast("array<string>")
    is_party = lambda x: ((F.upper(x) == x) & (F.lower(x) != x)) | F.array_contains(known, x)
    return (
        intents.withColumn("filter_parties", F.filter(e, is_party))
        .withColumn("filter_people", F.filter(e, lambda x: ~is_party(x)))
        .withColumn("filter_themes", F.col("topics"))
        .withColumn("filter_from", F.col("time_constraint.start"))
        .withColumn("filter_to", F.col("time_constraint.end"))
    )


def select_strategy() -> Column:
    """V15. Label of the dominant trait of an intent."""
    return (
        F.when(F.col("comparison"), "comparison").when(F.col("type") == "entity_focus", "entity_focused")
        .when(F.col("type") == "topic_focus", "topic_focused")
        .when(F.col("time_constraint").isNotNull(), "time_range").otherwise("general_search")
    )


def relax_if_empty(strict: DataFrame, loose: DataFrame, query_id: str = "query_id") -> DataFrame:
    """V16. Queries without strict hits get their loose ones. Decided per query inside the plan."""
    answered = strict.select(query_id).distinct()
    return strict.unionByName(loose.join(answered, query_id, "left_anti"))


def _or_na(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("N/A"))


def context_block(per_doc: int = 1000) -> Column:
    """Text block of one ranked article for a prompt; ``position`` is its number."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("N/A")
    return F.concat(
        F.lit("\nArticle "), F.col("position").cast("string"), F.lit(":\nTitle: "), _or_na(F.col("title")),
        F.lit("\nDate: "), _or_na(F.col("date")), F.lit("\nSource: "), _or_na(F.col("source")),
        F.lit("\nParties: "), listed("parties"), F.lit("\nPeople: "), listed("people"),
        F.lit("\n\nContent: "), F.substring("content", 1, per_doc), F.lit("...\n\n---\n"),
    )


def packed_blocks(ranked: DataFrame, max_chars: int = 24_000, per_doc: int = 1000,
                  query_id: str = "query_id") -> DataFrame:
    """V18, row form: the leading blocks of each query whose total length fits the budget. Sums only grow,
    so the kept rows are a prefix that ends at the first overflow. A query has at most k ranked rows."""
    blocks = ranked.withColumn("block", context_block(per_doc))
    w = W.partitionBy(query_id).orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    return blocks.withColumn("used_chars", F.sum(F.length("block")).over(w)).where(F.col("used_chars") <= max_chars)


def pack_context(ranked: DataFrame, max_chars: int = 24_000, per_doc: int = 1000,
                 query_id: str = "query_id") -> DataFrame:
    """V18. One context text per query, blocks joined by a newline."""
    packed = packed_blocks(ranked, max_chars, per_doc, query_id)
    ordered = F.sort_array(F.collect_list(F.struct("position", "block")))
    return packed.groupBy(query_id).agg(
        F.array_join(F.transform(ordered, lambda x: x["block"]), "\n").alias("context"),
        F.count("*").alias("blocks"),
    )


def top_sources(ranked: DataFrame, n: int = 20, query_id: str = "query_id") -> DataFrame:
    """V19. Title, date, source, URL and score of the first n ranked articles of each query."""
    return ranked.where(F.col("position") <= n).select(
        query_id, "position", _or_na(F.col("title")).alias("title"), _or_na(F.col("date")).alias("date"),
        _or_na(F.col("source")).alias("source"), "url", F.col("rerank_score").alias("relevance_score"),
    )
