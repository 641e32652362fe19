"""Similarity search and ranking over the driver's vectors."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from broadsheet.catalog.base import ARTICLES, BASE, FLAGS, NOW, query, text_of, with_
from broadsheet.functions.arrays import literal_array
from broadsheet.functions.dates import recency_score, time_window
from broadsheet.functions.vectors import distance_to_similarity, similarity
from broadsheet.operators import ranking, search
from broadsheet.plans.digest import retrieve
from broadsheet.session import scratch_path
from broadsheet.sources.store import write_party_partitioned

TODAY = dt.date.fromisoformat(NOW)
QID = 7


def probe(t):
    """The vector of one stored row, as a query."""
    return t.embeddings.where(F.col("vec_id") == QID).select("embedding").first()[0]


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")


def cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


Q = ("q", f"SELECT embedding AS qv FROM embeddings WHERE vec_id = {QID}")


@query("v01_embed", with_(BASE) + r"""
SELECT id, 64 AS dim, CASE WHEN regexp_matches(both_text, '[\p{L}\p{N}_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM base""")
def _(t):
    e = search.embed(t.articles, dim=64)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return e.select("id", F.col("embedding_dimension").alias("dim"), F.round(norm, 3).alias("norm"))


@query("v02_similarity", f"""
SELECT a.vec_id, round({cos('a.embedding', 'b.embedding')}, 6) AS cosine,
 round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot,
 round(1 / (1 + list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS euclidean
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(t):
    a, b = t.embeddings, t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    j = a.join(b, "vec_id")
    return j.select("vec_id", *[F.round(similarity("embedding", "other", m), 6).alias(m) for m in ("cosine", "dot", "euclidean")])


@query("v03_knn", with_(Q) + f"""
SELECT vec_id AS id, round({cos('embedding', 'qv')}, 6) AS similarity FROM embeddings, q ORDER BY {cos('embedding', 'qv')} DESC, vec_id LIMIT 10""")
def _(t):
    return search.knn(probe(t), vectors(t), 10).select("id", F.round("similarity", 6).alias("similarity"))


@query("v03_knn_euclidean", with_(Q) + """
SELECT vec_id AS id, round(1 / (1 + list_distance(embedding::DOUBLE[], qv::DOUBLE[])), 5) AS similarity FROM embeddings, q ORDER BY list_distance(embedding::DOUBLE[], qv::DOUBLE[]), vec_id LIMIT 10""")
def _(t):
    return search.knn(probe(t), vectors(t), 10, "euclidean").select("id", F.round("similarity", 5).alias("similarity"))


LETTERS = "etaonihsrdlu"


def letter_counts(texts):
    """An encoder that SQL can repeat: how often each of some letters occurs."""
    return np.array([[x.count(c) for c in LETTERS] for x in texts], dtype=float)


def letters_sql(expr: str) -> str:
    return "[" + ", ".join(f"length({expr}) - length(replace({expr}, '{c}', ''))" for c in LETTERS) + "]"


QUESTION_TEXT = "thing of the erin onan"


@query("v04_search", with_(BASE) + f"""
SELECT id, round({cos(letters_sql('both_text'), letters_sql("'" + QUESTION_TEXT + "'"))}, 5) AS similarity FROM base
WHERE NOT isnan({cos(letters_sql('both_text'), letters_sql("'" + QUESTION_TEXT + "'"))})
ORDER BY round({cos(letters_sql('both_text'), letters_sql("'" + QUESTION_TEXT + "'"))}, 9) DESC, id LIMIT 60""")
def _(t):
    corpus = search.embed(t.articles, letter_counts, batch_size=1000)
    return search.search(QUESTION_TEXT, corpus, 60, letter_counts).select("id", F.round("similarity", 5).alias("similarity"))


@query("v05_knn_join", f"""
SELECT query_id, id, similarity, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({cos('a.embedding', 'b.embedding')}, 6) AS similarity,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY {cos('a.embedding', 'b.embedding')} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b) WHERE rank <= 5""")
def _(t):
    q = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    out = search.knn_join(q, vectors(t), 5)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query("v06_approx_knn")
def _(t):
    """Ten neighbours of every row whose id is divisible by 50, among all rows; recall is tested against the exact join."""
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    out = search.approx_knn_join(q, vectors(t), 10)
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


CORPUS = ("corpus", "SELECT t.*, e.embedding, e.label, f.is_speech, f.is_stance FROM tagged t JOIN embeddings e ON e.vec_id = t.id LEFT JOIN flags f ON f.id = t.id")
FULL = (*ARTICLES, FLAGS, CORPUS, Q)


@query("v07_filtered_search", with_(*FULL) + f"""
SELECT id, round({cos('embedding', 'qv')}, 6) AS similarity FROM corpus, q WHERE language = 'en' AND date >= DATE '2024-09-01'
 AND (list_contains(parties, 'P1') OR list_contains(parties, 'P2')) AND list_contains(themes, 'T1') ORDER BY {cos('embedding', 'qv')} DESC, id LIMIT 10""")
def _(t):
    hits = search.filtered_search(probe(t), t.with_vectors, 10, parties=["P1", "P2"], themes=["T1"], language="en", date_from="2024-09-01")
    return hits.select("id", F.round("similarity", 6).alias("similarity"))


@query("v08_distance_to_similarity", f"""
SELECT vec_id, round(1 - list_cosine_distance(embedding::DOUBLE[], qv::DOUBLE[]), 6) AS similarity FROM embeddings, ({Q[1]})""")
def _(t):
    from broadsheet.functions.vectors import similarity_to

    distance = F.lit(1.0) - similarity_to("embedding", probe(t))
    return t.embeddings.select("vec_id", F.round(distance_to_similarity(distance), 6).alias("similarity"))


ENTITY = with_(*FULL)


@query("v09_entity_search", ENTITY + f"""
SELECT id, title, round({cos('embedding', 'qv')}, 6) AS similarity, array_to_string(parties, '|') AS parties, coalesce(is_speech, false) AS is_speech, '' AS summary
FROM corpus, q WHERE list_contains(parties, 'P1') AND list_contains(people, 'F1') ORDER BY {cos('embedding', 'qv')} DESC, id LIMIT 10""")
def _(t):
    cards = search.entity_search(probe(t), t.with_vectors, "F1", "P1")
    return cards.select("id", "title", F.round("similarity", 6).alias("similarity"), text_of("parties").alias("parties"), "is_speech", "summary")


@query("v09_cards_by_date", ENTITY + f"""
, h AS (SELECT id, title, date FROM corpus, q WHERE list_contains(parties, 'P1') ORDER BY {cos('embedding', 'qv')} DESC, id LIMIT 20)
SELECT CAST(date AS VARCHAR) AS date, count(*) AS n, string_agg(title, '|' ORDER BY id) AS titles FROM h GROUP BY date""")
def _(t):
    by_date = search.cards_by_date(search.entity_search(probe(t), t.with_vectors, party="P1", k=20))
    return by_date.select(F.col("date").cast("string").alias("date"), F.size("summaries").cast("bigint").alias("n"),
                          text_of(F.transform("summaries", lambda s: s["title"])).alias("titles"))


@query("v10_search_all_partitions", with_(Q) + f"""
SELECT vec_id AS id, label AS party_id, round({cos('embedding', 'qv')}, 6) AS similarity FROM embeddings, q ORDER BY {cos('embedding', 'qv')} DESC, vec_id LIMIT 10""")
def _(t):
    path = write_party_partitioned(vectors(t).withColumn("party_id", F.col("label")), scratch_path(t.spark, "parties"))
    return search.search_all_partitions(probe(t), t.spark.read.parquet(path), 10).select("id", "party_id", F.round("similarity", 6).alias("similarity"))


def recency(date: str, window: str = "NULL") -> str:
    age = f"date_diff('day', {date}, DATE '{NOW}')"
    return f"""CASE WHEN {date} IS NULL THEN 0.5 WHEN {window} IS NOT NULL AND {age} <= {window} THEN 1.0 WHEN {window} IS NOT NULL AND {age} <= 2 * {window} THEN 0.7
 WHEN {age} <= 7 THEN 1.0 WHEN {age} <= 30 THEN 0.8 WHEN {age} <= 90 THEN 0.6 WHEN {age} <= 180 THEN 0.4 ELSE 0.2 END"""


def score(sim: str, window: str = "NULL", summary: str = "false") -> str:
    return f"""({sim} * 0.4::DOUBLE + CASE WHEN coalesce(is_speech, false) THEN 1.0 WHEN coalesce(is_stance, false) THEN 0.8 WHEN {summary} THEN 0.6 ELSE 0.4 END::DOUBLE * 0.3::DOUBLE
 + ({recency('date', window)})::DOUBLE * 0.2::DOUBLE + CASE WHEN {summary} THEN 0.4 ELSE 0 END::DOUBLE * 0.1::DOUBLE)"""


@query("v11_rerank", ENTITY + f"""
SELECT id, round({score(cos('embedding', 'qv'), '90', 'id % 2 = 0')}, 6) AS rerank_score FROM corpus, q""")
def _(t):
    from broadsheet.functions.vectors import similarity_to

    c = t.with_vectors.withColumn("similarity", similarity_to("embedding", probe(t))).withColumn(
        "llm_summary", F.when(F.col("id") % 2 == 0, "short"))
    return ranking.rerank(c, TODAY, 90).select("id", F.round("rerank_score", 6).alias("rerank_score"))


@query("v12_recency_score", with_(BASE) + f"""
SELECT id, CAST({recency("d")} AS DOUBLE) AS plain, CAST({recency("d", "20")} AS DOUBLE) AS windowed FROM (SELECT id, CASE WHEN id % 10 <> 0 THEN date END AS d FROM base)""")
def _(t):
    a = t.articles.withColumn("d", F.when(F.col("id") % 10 != 0, F.col("date")))
    return a.select("id", recency_score("d", F.lit(TODAY)).alias("plain"), recency_score("d", F.lit(TODAY), 20).alias("windowed"))


def intents(t):
    """One intent per vector: entities from its label, topics and a time window by turns."""
    k = F.col("vec_id")
    period = F.when(k % 4 == 0, "month").when(k % 4 == 1, "quarter").otherwise("recent")
    window = time_window(period, F.lit(400), F.lit(TODAY))
    days = F.when(k % 4 == 0, 30).when(k % 4 == 1, 90).otherwise(400)
    return t.embeddings.select(
        k.alias("query_id"), "embedding",
        F.when(k % 3 == 0, "comparison").when(k % 3 == 1, "entity_focus").otherwise("topic_focus").alias("type"),
        F.when(k % 30 == 3, literal_array(["P4"])).when(k % 30 == 13, literal_array(["P1", "f1x"])).otherwise(literal_array(["P2"])).alias("entities"),
        F.when(k % 20 == 3, literal_array(["T1"])).otherwise(literal_array([])).alias("topics"),
        F.when(k % 20 == 13, F.struct(period.alias("period"), days.alias("days"), window["start"].alias("start"), window["end"].alias("end"))).alias("time_constraint"),
        (k % 3 == 0).alias("comparison"),
    )


INTENTS = ("intents", f"""
SELECT vec_id AS query_id, embedding AS qv, CASE vec_id % 3 WHEN 0 THEN 'comparison' WHEN 1 THEN 'entity_focus' ELSE 'topic_focus' END AS type,
 CASE WHEN vec_id % 30 = 3 THEN ['P4'] WHEN vec_id % 30 = 13 THEN ['P1'] ELSE ['P2'] END AS fp, CASE WHEN vec_id % 30 = 13 THEN ['f1x'] ELSE [] END AS fpe,
 CASE WHEN vec_id % 20 = 3 THEN ['T1'] ELSE [] END AS ft,
 CASE WHEN vec_id % 20 = 13 THEN CAST(DATE '{NOW}' - CASE vec_id % 4 WHEN 0 THEN 30 WHEN 1 THEN 90 ELSE 400 END AS DATE) END AS ff,
 CASE WHEN vec_id % 20 = 13 THEN DATE '{NOW}' END AS fto, CASE WHEN vec_id % 20 = 13 THEN CASE vec_id % 4 WHEN 0 THEN 30 WHEN 1 THEN 90 ELSE 400 END END AS days
FROM embeddings""")
MATCH = """(ff IS NULL OR c.date >= ff) AND (fto IS NULL OR c.date <= fto)"""
STRICT = MATCH + """ AND list_has_any(c.parties, fp) AND (len(fpe) = 0 OR list_has_any(c.people, fpe)) AND (len(ft) = 0 OR list_has_any(c.themes, ft))"""
RETRIEVED = ("retrieved", f"""
SELECT query_id, id, sim, days, is_speech, is_stance, date, title, source, url, parties, people, content FROM (SELECT i.query_id, c.*, i.days, strict, {cos('c.embedding', 'i.qv')} AS sim,
  row_number() OVER (PARTITION BY i.query_id, strict ORDER BY {cos('c.embedding', 'i.qv')} DESC, c.id) AS rn, bool_or(ok) OVER (PARTITION BY i.query_id) AS any_strict
  FROM (SELECT *, true AS strict FROM intents UNION ALL SELECT *, false FROM intents) i
  JOIN (SELECT * FROM corpus) c ON CASE WHEN i.strict THEN {STRICT} ELSE {MATCH} END
  CROSS JOIN LATERAL (SELECT i.strict AS ok))
WHERE rn <= 10 AND strict = any_strict""")
RANKED = ("ranked", f"""
SELECT * FROM (SELECT *, {score('sim', 'days')} AS s, row_number() OVER (PARTITION BY query_id ORDER BY round({score('sim', 'days')}, 9) DESC, id) AS pos FROM retrieved) WHERE pos <= 5""")
QUESTION = (*ARTICLES, FLAGS, CORPUS, INTENTS, RETRIEVED, RANKED)


def ranked(t):
    out = retrieve(intents(t), t.with_vectors, 5, TODAY)
    return out


@query("v13_retrieve", with_(*QUESTION) + "SELECT query_id, id, CAST(pos AS BIGINT) AS position, round(s, 6) AS rerank_score FROM ranked")
def _(t):
    return ranked(t).select("query_id", "id", F.col("position").cast("bigint").alias("position"), F.round("rerank_score", 6).alias("rerank_score"))


@query("v14_intent_filters", with_(INTENTS) + """
SELECT query_id, array_to_string(fp, '|') AS parties, array_to_string(fpe, '|') AS people, array_to_string(ft, '|') AS themes, CAST(ff AS VARCHAR) AS "from", CAST(fto AS VARCHAR) AS "to" FROM intents""")
def _(t):
    f = ranking.intent_filters(intents(t))
    return f.select("query_id", text_of("filter_parties").alias("parties"), text_of("filter_people").alias("people"),
                    text_of("filter_themes").alias("themes"), F.col("filter_from").cast("string").alias("from"), F.col("filter_to").cast("string").alias("to"))


@query("v15_select_strategy", with_(INTENTS) + """
SELECT query_id, CASE type WHEN 'comparison' THEN 'comparison' WHEN 'entity_focus' THEN 'entity_focused' ELSE 'topic_focused' END AS strategy FROM intents""")
def _(t):
    return intents(t).select("query_id", ranking.select_strategy().alias("strategy"))


@query("v16_relax_if_empty", with_(*ARTICLES) + """
SELECT s.query_id, t.id FROM (SELECT DISTINCT source AS query_id FROM tagged) s JOIN tagged t ON t.source = s.query_id
WHERE list_contains(t.people, 'F3') OR NOT EXISTS (SELECT 1 FROM tagged x WHERE x.source = s.query_id AND list_contains(x.people, 'F3'))""")
def _(t):
    loose = t.tagged.select(F.col("source").alias("query_id"), "id", "people")
    strict = loose.where(F.array_contains("people", "F3"))
    return ranking.relax_if_empty(strict, loose).select("query_id", "id")


@query("v17_resolve_time_window", """
SELECT event_id, CAST(CASE WHEN event_id % 6 = 5 THEN DATE '2024-02-01' ELSE CAST(CAST(ts AS DATE) - CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 7 WHEN 2 THEN 30 WHEN 3 THEN 90 ELSE 12 END AS DATE) END AS VARCHAR) AS "start",
 CAST(CASE WHEN event_id % 6 = 5 THEN DATE '2024-02-29' ELSE CAST(ts AS DATE) END AS VARCHAR) AS "end" FROM events""")
def _(t):
    k = F.col("event_id") % 6
    period = F.when(k == 0, "today").when(k == 1, "week").when(k == 2, "month").when(k == 3, "quarter").otherwise("recent")
    given = lambda d: F.when(k == 5, F.lit(d).cast("date"))
    w = time_window(period, F.lit(12), F.to_date("ts"), given("2024-02-01"), given("2024-02-29"))
    return t.events.select("event_id", w["start"].cast("string").alias("start"), w["end"].cast("string").alias("end"))


BLOCK = """chr(10) || 'Article ' || pos || ':' || chr(10) || 'Title: ' || coalesce(nullif(title, ''), 'N/A') || chr(10) || 'Date: ' || coalesce(CAST(date AS VARCHAR), 'N/A') || chr(10) || 'Source: ' || source || chr(10)
 || 'Parties: ' || CASE WHEN len(parties) > 0 THEN array_to_string(parties, ', ') ELSE 'N/A' END || chr(10) || 'People: ' || CASE WHEN len(people) > 0 THEN array_to_string(people, ', ') ELSE 'N/A' END
 || chr(10) || chr(10) || 'Content: ' || left(content, 1000) || '...' || chr(10) || chr(10) || '---' || chr(10)"""


@query("v18_pack_context", with_(*QUESTION) + f"""
, b AS (SELECT query_id, pos, {BLOCK} AS block FROM ranked), c AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY pos) AS used FROM b)
SELECT query_id, string_agg(block, chr(10) ORDER BY pos) AS context, count(*) AS blocks FROM c WHERE used <= 2500 GROUP BY query_id""")
def _(t):
    return ranking.pack_context(ranked(t), 2500)


@query("v19_top_sources", with_(*QUESTION) + """
SELECT query_id, CAST(pos AS BIGINT) AS position, coalesce(nullif(title, ''), 'N/A') AS title, CAST(date AS VARCHAR) AS date, source, url, round(s, 6) AS relevance_score FROM ranked WHERE pos <= 3""")
def _(t):
    s = ranking.top_sources(ranked(t), 3)
    return s.withColumn("relevance_score", F.round("relevance_score", 6)).withColumn("position", F.col("position").cast("bigint"))


@query("v20_embedding_cache", """
WITH stored AS (SELECT DISTINCT text FROM documents WHERE lang = 'fr')
SELECT doc_id AS id, sha256(text) AS text_hash, text IN (SELECT text FROM stored) AS cached FROM documents""")
def _(t):
    fr = t.articles.where("language = 'fr'").dropDuplicates(["content"])
    store = search.embed(fr, dim=64, text=F.col("content")).select(F.sha2("content", 256).alias("text_hash"), "embedding")
    return search.embedding_cache(store, t.articles, dim=64, text=F.col("content")).select("id", "text_hash", "cached")


@query("v10_search_one_partition", with_(Q) + f"""
SELECT vec_id AS id, round({cos('embedding', 'qv')}, 6) AS similarity FROM embeddings, q WHERE label = 2 ORDER BY {cos('embedding', 'qv')} DESC, vec_id LIMIT 5""")
def _(t):
    store = vectors(t).withColumn("party_id", F.col("label"))
    return search.search_all_partitions(probe(t), store, 5, party=2).select("id", F.round("similarity", 6).alias("similarity"))
