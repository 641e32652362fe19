"""Embedding and similarity search.

Ranking always follows filtering. A single query keeps the best k rows of every task and merges them
(Catalyst's TakeOrderedAndProject). A batch of queries meets the corpus in the cells of a stored index, where one
matrix product scores a cell's rows against the queries that visit it and only each query's best k leave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions.text import document_text
from broadsheet.functions.vectors import similarity_to
from broadsheet.operators.filters import filter_any, filter_articles
from broadsheet.operators.index import QUESTION_ROWS, VectorIndex, build_index, index_join, probes_for

Encoder = Callable[[pd.Series], np.ndarray]


def hashing_embed(df: DataFrame, text: Column, dim: int = 384, out: str = "embedding") -> DataFrame:
    """The bundled encoder: hashed word counts, L2-normalised, all in the JVM."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)
    counted = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim).transform(df.withColumn("_tok", tokens))
    normed = Normalizer(inputCol="_tf", outputCol="_vec").transform(counted)
    return normed.withColumn(out, vector_to_array("_vec", "float32")).drop("_tok", "_tf", "_vec")


def embed(
    articles: DataFrame, encoder: Encoder | None = None, dim: int = 384, batch_size: int = 32,
    text: Column | None = None, out: str = "embedding",
) -> DataFrame:
    """V01. Adds a unit-norm vector and its dimension. ``encoder`` maps a batch of texts to a matrix; it
    is shipped to the tasks and called ``batch_size`` texts at a time. Without one, words are hashed."""
    text = document_text("title", "content", " ") if text is None else text
    if encoder is None:
        return hashing_embed(articles, text, dim, out).withColumn("embedding_dimension", F.lit(dim))

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out_ = []
            for at in range(0, len(texts), batch_size):
                part = texts.iloc[at:at + batch_size]
                m = np.asarray(encoder(part), dtype=np.float64)
                if len(m) != len(part):
                    raise ValueError(f"the encoder returned {len(m)} vectors for {len(part)} texts")
                norm = np.sqrt((m * m).sum(1, keepdims=True))
                out_.extend((m / np.where(norm == 0, 1.0, norm)).astype(np.float32))
            yield pd.Series(out_, index=texts.index, dtype=object)

    # only the text goes to Python: every other column stays as it is in the JVM
    return articles.withColumn(out, vectors(text)).withColumn("embedding_dimension", F.size(out))


def embed_text(spark: SparkSession, query: str, encoder: Encoder | None = None, dim: int = 384) -> list[float]:
    """The vector of one query text."""
    row = spark.createDataFrame([(query,)], "content string")
    return list(embed(row, encoder, dim, text=F.col("content")).select("embedding").first()[0])


def knn(query: list[float], corpus: DataFrame, k: int, metric: str = "cosine", id: str = "id",
        embedding: str = "embedding") -> DataFrame:
    """V03. The k most similar rows, best first, ties by id. Adds ``similarity``."""
    scored = corpus.where(F.col(embedding).isNotNull()).withColumn(
        "similarity", similarity_to(embedding, query, metric))
    # rows without a similarity sort last and go after the cut: a test before it would score every row twice
    return scored.orderBy(F.desc_nulls_last("similarity"), id).limit(k).where(F.col("similarity").isNotNull())


def search(query_text: str, corpus: DataFrame, k: int, encoder: Encoder | None = None, dim: int = 384,
           metric: str = "cosine", id: str = "id") -> DataFrame:
    """V04. Text query, k ≥ 1."""
    if k < 1:
        raise ValueError("k starts at 1")
    return knn(embed_text(corpus.sparkSession, query_text, encoder, dim), corpus, k, metric, id)


def _questions(queries: DataFrame, query_id: str, embedding: str, *more: str) -> DataFrame:
    return queries.select(F.col(query_id).cast("bigint").alias("qid"), F.col(embedding).alias("qv"), *more)


def knn_join(
    queries: DataFrame, corpus: DataFrame | VectorIndex, k: int, metric: str = "cosine", query_id: str = "query_id", id: str = "id",
    embedding: str = "embedding", question_rows: int = QUESTION_ROWS,
) -> DataFrame:
    """V05. k nearest corpus rows of every query, exactly: (query_id, id, similarity, rank).

    Query ids and corpus ids are integers. Questions meet the corpus in the cells of its index (see
    :mod:`broadsheet.operators.index`), in those that can hold one of their k best; an index made before can be
    given instead of the corpus.
    """
    index = corpus if isinstance(corpus, VectorIndex) else build_index(corpus, metric, id, embedding)
    found = index_join(_questions(queries, query_id, embedding), index, k, question_rows=question_rows)
    return found.select(F.col("qid").alias(query_id), F.col("cid").alias(id), "similarity", "rank")


def approx_knn_join(queries: DataFrame, corpus: DataFrame | VectorIndex, k: int, recall: float = 0.95, metric: str = "cosine", query_id: str = "query_id",
                    id: str = "id", embedding: str = "embedding") -> DataFrame:
    """V06 for many queries: as :func:`knn_join`, but each query visits only its nearest cells, as many as reach
    ``recall`` for rows of the index's sample."""
    index = corpus if isinstance(corpus, VectorIndex) else build_index(corpus, metric, id, embedding)
    found = index_join(_questions(queries, query_id, embedding), index, k, probes=probes_for(index, k, recall))
    return found.select(F.col("qid").alias(query_id), F.col("cid").alias(id), "similarity", "rank")


def approx_knn(query: list[float], corpus: DataFrame, k: int, id: str = "id", embedding: str = "embedding", recall: float = 0.95,
               index: VectorIndex | None = None) -> DataFrame:
    """V06. Approximate nearest rows of one vector, best first; ``similarity`` is the cosine."""
    one = corpus.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id bigint, embedding array<double>")
    hits = approx_knn_join(one, index or build_index(corpus, "cosine", id, embedding), k, recall)
    return corpus.join(F.broadcast(hits.select(F.col("id").alias(id), "similarity")), id).orderBy(F.desc("similarity"), id)


def filtered_knn_join(queries: DataFrame, corpus: DataFrame | VectorIndex, k: int, metric: str = "cosine", question_rows: int = QUESTION_ROWS,
                      forms: tuple[bool, ...] = (True, False)) -> DataFrame:
    """V07 for many questions in one pass over the corpus: each question's own filters, then its k best.

    ``queries``: query_id, embedding, filter_parties, filter_people, filter_themes, filter_from, filter_to.
    Returns (query_id, id, similarity, rank, strict): the strict answer of each question and, beside it,
    the answer without list filters, for :func:`broadsheet.operators.ranking.relax_if_empty`; ``forms`` takes one of the
    two (``(True,)``: strict). An index made by :func:`filter_index` can be given instead of the corpus.
    """
    index = corpus if isinstance(corpus, VectorIndex) else filter_index(corpus, metric)
    none = F.lit(None).cast("array<string>")
    q = queries.where("embedding is not null").withColumn("_strict", F.explode(F.array(*map(F.lit, forms)))).select(
        (F.col("query_id").cast("bigint") * 2 + F.when(F.col("_strict"), 0).otherwise(1)).alias("qid"), F.col("embedding").alias("qv"),
        *[F.when(F.col("_strict"), F.col(c)).otherwise(none).alias(c) for c in ("filter_parties", "filter_people", "filter_themes")],
        F.col("filter_from").cast("date").alias("filter_from"), F.col("filter_to").cast("date").alias("filter_to"))
    found = index_join(q, index, k, question_rows=question_rows)
    return found.select(F.shiftright("qid", 1).alias("query_id"), F.col("cid").alias("id"), "similarity", "rank",
                        (F.pmod("qid", F.lit(2)) == 0).alias("strict"))


def filter_index(corpus: DataFrame, metric: str = "cosine") -> VectorIndex:
    """An index of articles that holds what filters test."""
    return build_index(corpus, metric, keep=("parties", "people", "themes", "date"))


def filtered_search(query: list[float], corpus: DataFrame, k: int, metric: str = "cosine", parties=None, people=None,
                    themes=None, **filters) -> DataFrame:
    """V07. All filters first, then the ranking: k rows whenever k rows qualify."""
    rows = filter_any(filter_articles(corpus, **filters), parties, people, themes)
    return knn(query, rows, k, metric)


def entity_search(query: list[float], corpus: DataFrame, figure: str | None = None, party: str | None = None,
                  date_from=None, date_to=None, speeches_only: bool = False, k: int = 10,
                  metric: str = "cosine") -> DataFrame:
    """V09. Search within a figure's and a party's articles, as article cards (P11)."""
    from broadsheet.plans.cards import article_card

    hits = filtered_search(
        query, corpus, k, metric, parties=[party] if party else None, people=[figure] if figure else None,
        is_speech=True if speeches_only else None, date_from=date_from, date_to=date_to)
    return article_card(hits)


def cards_by_date(cards: DataFrame) -> DataFrame:
    """V09's second part: date → list of cards in id order."""
    entry = F.struct("id", "title", "summary", "key_points", "stance_analysis")
    return cards.where(F.col("date").isNotNull()).groupBy("date").agg(
        F.sort_array(F.collect_list(entry)).alias("summaries"))


def search_all_partitions(query: list[float], store: DataFrame, k: int, party: str | None = None,
                          metric: str = "cosine", id: str = "id") -> DataFrame:
    """V10. Search a party-partitioned store: one party prunes to its directory, none searches all. Each
    task's best k merge into the best k overall, which is the same rows as k per party merged."""
    rows = store if party is None else store.where(F.col("party_id") == party)
    return knn(query, rows, k, metric, id)


def embedding_cache(store: DataFrame, batch: DataFrame, encoder: Encoder | None = None, dim: int = 384,
                    text: Column | None = None) -> DataFrame:
    """V20. Vectors of a batch, reusing stored ones with the same text hash; only misses are encoded, once
    per distinct text. Adds ``embedding`` and ``cached``."""
    text = document_text("title", "content", " ") if text is None else text
    keyed = batch.withColumn("_h", F.sha2(text, 256)).withColumn("_text", text)
    known = store.select(F.col("text_hash").alias("_h"), F.col("embedding").alias("_old")).dropDuplicates(["_h"])
    probe = keyed.join(known, "_h", "left")
    missing = keyed.join(known, "_h", "left_anti").groupBy("_h").agg(F.first("_text").alias("content"))
    fresh = embed(missing, encoder, dim, text=F.col("content")).select("_h", F.col("embedding").alias("_new"))
    return (
        probe.join(fresh, "_h", "left")
        .withColumn("embedding", F.coalesce("_old", "_new"))
        .withColumn("cached", F.col("_old").isNotNull())
        .withColumnRenamed("_h", "text_hash").drop("_old", "_new", "_text")
    )
