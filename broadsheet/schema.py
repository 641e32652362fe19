"""The article schema and adapters that give the driver tables its shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

ARTICLE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("date", T.DateType()), T.StructField("source", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("category", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("parties", STRINGS), T.StructField("people", STRINGS),
    T.StructField("people_affiliations", T.MapType(T.StringType(), T.StringType())),
    T.StructField("political_entities", T.MapType(T.StringType(), T.StructType([
        T.StructField("party_mentioned", T.BooleanType()), T.StructField("figures", STRINGS)]))),
    T.StructField("themes", STRINGS), T.StructField("keywords", STRINGS),
    T.StructField("is_speech", T.BooleanType()), T.StructField("is_stance", T.BooleanType()),
    T.StructField("ai_categories", STRINGS), T.StructField("primary_category", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])


def articles_from_documents(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Article rows from (doc_id, text, lang, source): narrow, except for the join that adds the label flags."""
    title = F.substring(F.get(F.split("text", "\n", 2), F.lit(0)), 1, 80)
    url = F.when(F.col("doc_id") % 50 == 0, "").otherwise(
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), F.md5(F.col("text").cast("binary"))))
    rows = documents.select(
        F.col("doc_id").alias("id"), title.alias("title"), F.col("text").alias("content"),
        F.date_add(F.lit("2024-08-05").cast("date"), (F.col("doc_id") % 421).cast("int")).alias("date"),
        "source", F.col("lang").alias("language"), url.alias("url"), F.col("lang").alias("category"),
    )
    if labels is None:
        return rows
    flags = labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("is_speech"),
                          (F.col("toxic") == 1).alias("is_stance"))
    return rows.join(flags, "id", "left")


def primary_theme(scores: Column) -> Column:
    """Highest-scoring theme, ties by name; ``Others`` when there is none."""
    ranked = F.array_min(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    return F.coalesce(ranked["k"], F.lit("Others"))


def tagged_articles(articles: DataFrame, gaz, lexicon) -> DataFrame:
    """Articles with parties, people, affiliations, themes and the theme-based categories."""
    from broadsheet.operators.entities import affiliations_of, figure_list, party_list, tag_entities_word
    from broadsheet.operators.themes import theme_scores

    work = tag_entities_word(articles, gaz)
    work = work.withColumn("parties", party_list()).withColumn("people", figure_list()).drop("entities")
    work = work.withColumn("people_affiliations", affiliations_of(F.col("people"), gaz))
    work = theme_scores(work, lexicon).withColumn("themes", F.array_sort(F.map_keys("theme_scores")))
    return (
        work.withColumn("ai_categories", F.when(F.size("themes") > 0, F.col("themes")).otherwise(F.array(F.lit("Others"))))
        .withColumn("primary_category", primary_theme(F.col("theme_scores")))
    )
