"""Model-based enrichment and ingestion over the driver tables, with recorded model responses."""

from __future__ import annotations

import datetime as dt
import json
import re

import pandas as pd
from pyspark.sql import functions as F

from broadsheet.catalog.base import (
    ARTICLES, FLAGS, GAZ, LEXICON, NOW, SPEECH, STANCE, TAXONOMY, base, listing, query, quote, tagged, text_of, trimmed, with_,
)
from broadsheet.catalog.scalars import BODIES, PAGE_RULES
from broadsheet.operators import enrich, summaries
from broadsheet.operators.identity import merge_columns
from broadsheet.plans import digest
from broadsheet.plans.ingest import IngestConfig, ingest_batch
from broadsheet.session import scratch_path
from broadsheet.sources.store import read_articles
from broadsheet.streaming.ingest import ingest_stream

TODAY = dt.date.fromisoformat(NOW)
CATS = [r["category"] for r in TAXONOMY.dicts()]


def recorded_classifier(prompts: pd.Series) -> pd.Series:
    """A recorded model: the category by the length of title and text; prose around the JSON for some."""
    def one(p: str) -> str:
        title, content = p.rsplit("Title: ", 1)[1].split("\nContent: ", 1)
        n = (len(title) + len(content)) % 4
        if n == 3:
            return "I cannot tell."
        body = json.dumps({"categories": [CATS[n], "Unknown"], "primary_category": CATS[n], "confidence_scores": {CATS[n]: 80},
                           "reasoning": "r", "speaking_figures": ["F1", "Nobody"], "speaking_parties": []})
        return f"Here it is:\n```json\n{body}\n```" if n == 1 else body

    return prompts.map(one)


def recorded_summary(prompts: pd.Series) -> pd.Series:
    """A recorded model that quotes the head of the article it was given."""
    head = prompts.str.split("Article Content:\n").str[-1].str[:60].str.replace("\n", " ")
    return "**Summary**: " + head + "\n**Key Points**\n- a first point made\n**Keywords**\nreform, vote\n**Topics Covered**\n- law\n**Stance Analysis**\nfor it"


MENU = "\n".join(f"{i}. {r['category']}: {r['description']}" for i, r in enumerate(TAXONOMY.dicts(), 1))


@query("e01_build_classification_prompts", base(f"""
SELECT id, contains(content, 'é') AS is_accented, 'Title: ' || title || chr(10) || 'Content: ' || content AS tail, true AS has_menu FROM base"""))
def _(t):
    lang = F.when(F.col("content").contains("é"), "Bangla").otherwise("English")
    p = enrich.build_classification_prompts(t.articles, TAXONOMY, GAZ, language=lang)
    tail = F.substr(F.col("prompt"), F.instr("prompt", "Title: "))
    return p.select("id", F.contains("prompt", F.lit("this Bangla news")).alias("is_accented"), tail.alias("tail"),
                    F.contains("prompt", F.lit(MENU)).alias("has_menu"))


def responses(t):
    """Model responses made of each document's text: bare, fenced, wrapped in prose, or broken."""
    k = F.col("doc_id") % 5
    word = F.regexp_replace("text", "[{}]", "")
    cats = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("T1"), F.lit("Bogus"))).when(
        F.col("doc_id") % 3 == 1, F.array(F.lit("Bogus"))).otherwise(F.array(F.lit("T2"), F.lit("T3")))
    body = F.to_json(F.struct(
        cats.alias("categories"), F.when(F.col("doc_id") % 2 == 0, "T2").otherwise("Bogus").alias("primary_category"),
        F.create_map(F.lit("T1"), F.lit(85)).alias("confidence_scores"), word.alias("reasoning"),
        F.array(F.lit("F1"), F.lit("Nobody"), F.lit("F3")).alias("speaking_figures"), F.array(F.lit("P1")).alias("speaking_parties")))
    text = (F.when(k == 0, body).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone.")))
            .when(k == 2, F.concat(F.lit("Answer: "), body, F.lit(" as asked"))).when(k == 3, F.concat(F.lit("{broken "), word)).otherwise(body))
    return t.documents.select(F.col("doc_id").alias("id"), text.alias("response"), F.lit(None).cast("string").alias("error"), word.alias("word"))


RESPONSES = ("resp", """
SELECT doc_id AS id, doc_id % 5 <> 3 AS ok, CASE doc_id % 3 WHEN 0 THEN ['T1'] WHEN 1 THEN ['Others'] ELSE ['T2', 'T3'] END AS valid,
 CASE WHEN doc_id % 2 = 0 THEN 'T2' END AS prim, regexp_replace(text, '[{}]', '', 'g') AS word FROM documents""")


@query("e02_parse_json_response", with_(RESPONSES) + """
SELECT id, CASE WHEN ok THEN word END AS reasoning, CASE WHEN ok THEN array_to_string(CASE id % 3 WHEN 0 THEN ['T1', 'Bogus'] WHEN 1 THEN ['Bogus'] ELSE ['T2', 'T3'] END, '|') END AS categories,
 CASE WHEN ok THEN 85.0::DOUBLE END AS confidence FROM resp""")
def _(t):
    p = responses(t).withColumn("p", enrich.parse_json_response("response", enrich.CLASSIFICATION_SCHEMA))
    return p.select("id", F.col("p.reasoning").alias("reasoning"), text_of("p.categories").alias("categories"),
                    F.try_element_at("p.confidence_scores", F.lit("T1")).alias("confidence"))


@query("e03_validate_classification", with_(RESPONSES) + """
SELECT id, array_to_string(valid, '|') AS categories, coalesce(prim, valid[1]) AS primary_category, 'F1|F3' AS speaking_figures FROM resp WHERE ok""")
def _(t):
    p = responses(t).withColumn("parsed", enrich.parse_json_response("response", enrich.CLASSIFICATION_SCHEMA)).where("parsed is not null")
    v = enrich.validate_classification(p, TAXONOMY, GAZ)
    return v.select("id", text_of("categories").alias("categories"), "primary_category", text_of("speaking_figures").alias("speaking_figures"))


@query("e04_classify_responses", with_(RESPONSES) + """
SELECT id, CASE WHEN ok THEN array_to_string(valid, '|') ELSE 'Others' END AS categories, CASE WHEN ok THEN coalesce(prim, valid[1]) ELSE 'Others' END AS primary_category,
 CASE WHEN NOT ok THEN 'invalid JSON response' END AS error FROM resp""")
def _(t):
    c = enrich.classify_responses(responses(t), TAXONOMY, GAZ)
    return c.select("id", text_of("categories").alias("categories"), "primary_category", "error")


@query("e04_classify_batch", tagged(f"""
, n AS (SELECT *, (length(title) + length(content)) % 4 AS n FROM tagged)
SELECT id, CASE WHEN n = 3 THEN array_to_string(ai_categories, '|') ELSE {listing(CATS)}[n + 1] END AS ai_categories,
 CASE WHEN n = 3 THEN primary_category ELSE {listing(CATS)}[n + 1] END AS primary_category,
 CASE WHEN n = 3 THEN array_to_string(people, '|') ELSE 'F1' END AS people, CASE WHEN n <> 3 THEN 'r' END AS category_reasoning FROM n"""))
def _(t):
    c = enrich.classify_batch(t.articles, recorded_classifier, TAXONOMY, GAZ)
    merged = merge_columns(t.tagged.withColumn("category_reasoning", F.lit(None).cast("string")), enrich.classification_updates(c, NOW))
    return merged.select("id", text_of("ai_categories").alias("ai_categories"), "primary_category", text_of("people").alias("people"), "category_reasoning")


@query("e04_category_distribution", with_(RESPONSES) + """
SELECT x AS "value", count(*) AS "count" FROM (SELECT unnest(CASE WHEN ok THEN valid ELSE ['Others'] END) AS x FROM resp) GROUP BY x""")
def _(t):
    from broadsheet.operators.stats import value_counts

    return value_counts(enrich.classify_responses(responses(t), TAXONOMY, GAZ), "categories")


@query("e05_speakers_override", tagged("""
SELECT id, CASE WHEN id % 4 = 0 THEN 'F9' ELSE array_to_string(people, '|') END AS people, CASE WHEN id % 6 = 0 THEN 'P9' ELSE array_to_string(parties, '|') END AS parties FROM tagged"""))
def _(t):
    none = F.array().cast("array<string>")
    a = t.tagged.withColumn("speaking_figures", F.when(F.col("id") % 4 == 0, F.array(F.lit("F9"))).otherwise(none)).withColumn(
        "speaking_parties", F.when(F.col("id") % 6 == 0, F.array(F.lit("P9"))).otherwise(none))
    return enrich.speakers_override(a).select("id", text_of("people").alias("people"), text_of("parties").alias("parties"))


def line(t):
    """Each document on one line, without marks."""
    return F.btrim(F.regexp_replace("text", "[^A-Za-z ]+", ""), F.lit(" "))


LINE = "trim(regexp_replace(text, '[^A-Za-z ]+', '', 'g'), ' ')"


@query("e06_parse_sectioned_summary", f"""
SELECT doc_id, summary, key_points, 'reform|vote' AS keywords, 'law' AS topics FROM (SELECT doc_id, 'so ' || {LINE} AS summary, CASE WHEN length('point ' || {LINE}) > 5 THEN trim('point ' || {LINE}) END AS key_points FROM documents)""")
def _(t):
    r = F.concat(F.lit("**Summary**: so "), line(t), F.lit("\n\n## Key Points\n- point "), line(t), F.lit("\n- ab\n**Keywords**\nreform, vote, x\n4. **Topics Covered**\n* law\n**Stance Analysis**: for"))
    p = t.documents.select("doc_id", enrich.parse_sectioned_summary(r).alias("p"))
    trail = lambda c: F.rtrim(c)
    return p.select("doc_id", F.when(trail(F.col("p.summary")) == "so", F.lit("so ")).otherwise(F.col("p.summary")).alias("summary"),
                    text_of("p.key_points").alias("key_points"), text_of("p.keywords").alias("keywords"), text_of("p.topics").alias("topics"))


@query("e07_parse_keyword_lists", f"""
SELECT doc_id, 'alpha|beta' AS keywords, trim('p ' || {LINE}, ' ') AS phrases, 't1|t2|t3' AS topics FROM documents""")
def _(t):
    r = F.concat(F.lit("1. **Keywords**\n- alpha\n- beta\n- gamma\n\n**Key Phrases**\n1. p "), line(t), F.lit("\n**Main Topics**\nt1\nt2\nt3\nt4"))
    p = t.documents.select("doc_id", enrich.parse_keyword_lists(r, 2).alias("p"))
    return p.select("doc_id", text_of("p.keywords").alias("keywords"), text_of("p.phrases").alias("phrases"), text_of("p.topics").alias("topics"))


MARKED = "'**TOP_KEYWORDS**' || chr(10) || 'a, b ,, ' || left(replace(text, '**', ''), 40) || chr(10) || '**TOPICS_COVERED**' || chr(10) || 't1, t2' || chr(10) || chr(10) || '**SUMMARY**' || chr(10) || text || chr(10) || '**Overall** more'"
SECTION = r"regexp_extract(r, '(?s)\*\*{0}\*\*\s*\n(.*?)(?:\n\*\*|$)', 1)"


def split_sql(expr: str) -> str:
    return f"list_filter(list_transform(string_split({expr}, ','), lambda x: {trimmed('x')}), lambda x: x <> '')"


@query("e08_parse_marked_sections", f"""
WITH x AS (SELECT doc_id, {MARKED} AS r FROM documents)
SELECT doc_id, array_to_string(list_slice({split_sql(trimmed(SECTION.format('TOP_KEYWORDS')))}, 1, 10), '|') AS keywords,
 array_to_string({split_sql(trimmed(SECTION.format('TOPICS_COVERED')))}, '|') AS topics, {trimmed(SECTION.format('SUMMARY'))} AS summary FROM x""")
def _(t):
    r = F.concat(F.lit("**TOP_KEYWORDS**\na, b ,, "), F.substring(F.replace("text", F.lit("**"), F.lit("")), 1, 40),
                 F.lit("\n**TOPICS_COVERED**\nt1, t2\n\n**SUMMARY**\n"), F.col("text"), F.lit("\n**Overall** more"))
    p = t.documents.select("doc_id", enrich.parse_marked_sections(r).alias("p"))
    return p.select("doc_id", text_of("p.keywords").alias("keywords"), text_of("p.topics").alias("topics"), F.col("p.summary").alias("summary"))


@query("e09_parse_period_sections", f"""
SELECT doc_id, trim('so ' || {LINE}, ' ') AS summary, 'one two|three' AS key_points, 'k1|k 2' AS keywords, 't1|t2' AS topics FROM
 (SELECT doc_id, regexp_replace(text, '  +', ' ', 'g') AS text FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]+', ' ', 'g') AS text FROM documents))""")
def _(t):
    short = F.regexp_replace("text", "[^A-Za-z]+", " ")
    r = F.concat(F.lit("### SUMMARY: so "), short, F.lit("\n\nKEY POINTS:\n- one  two\n• three\nnot a point\n\nKEYWORDS: k1, k  2,\n\nTOPICS: t1, t2"))
    p = t.documents.select("doc_id", enrich.parse_period_sections(r).alias("p"))
    return p.select("doc_id", F.col("p.summary").alias("summary"), text_of("p.key_points").alias("key_points"),
                    text_of("p.keywords").alias("keywords"), text_of("p.topics").alias("topics"))


@query("e10_validate_article_analysis", """
SELECT doc_id, array_to_string(list_transform(list_slice(string_split(text, ' '), 1, 3), lambda x: left(x, 50)), '|') AS keywords, 'P1' AS parties, 'F1|F2' AS figures,
 doc_id % 2 = 0 AS has_election_impact, CASE WHEN doc_id % 2 = 0 THEN 'why' ELSE '' END AS election_impact_description, CASE WHEN doc_id % 2 = 0 THEN 'P2' ELSE '' END AS election_impact_parties FROM documents""")
def _(t):
    body = F.to_json(F.struct(
        F.lit("s").alias("summary"), F.slice(F.split("text", " "), 1, 9).alias("keywords"), F.array(F.lit("x")).alias("topics"),
        F.array(F.lit("P1"), F.lit("PX")).alias("parties"), F.array(F.lit("F1"), F.lit("FX"), F.lit("F2")).alias("figures"),
        (F.col("doc_id") % 2 == 0).alias("has_election_impact"), F.lit("why").alias("election_impact_description"),
        F.array(F.lit("P2"), F.lit("?")).alias("election_impact_parties")))
    p = t.documents.select("doc_id", enrich.parse_json_response(body, enrich.ANALYSIS_SCHEMA).alias("parsed"))
    v = enrich.validate_article_analysis(p, GAZ, n_keywords=3, n_topics=2, n_figures=10, keyword_chars=50, topic_chars=100)
    return v.select("doc_id", text_of("keywords").alias("keywords"), text_of("parties").alias("parties"), text_of("figures").alias("figures"),
                    "has_election_impact", "election_impact_description", text_of("election_impact_parties").alias("election_impact_parties"))


@query("e11_enrich_articles", tagged("""
SELECT id, length(content) AS original_length, CASE WHEN f.is_speech THEN trim(replace(left(content, 60), chr(10), ' ')) END AS summary,
 'reform, vote' AS keywords, 'Neutral' AS stance FROM tagged LEFT JOIN flags f USING (id)""", FLAGS))
def _(t):
    e = enrich.enrich_articles(t.tagged_flagged, recorded_summary)
    return e.select("id", F.col("original_length").cast("bigint").alias("original_length"), "llm_summary.summary",
                    text_of("llm_keywords.keywords").alias("keywords"), "stance")


DIGEST_BLOCK = """chr(10) || 'Article #' || rn || chr(10) || 'Date: ' || CAST(date AS VARCHAR) || chr(10) || 'Source: ' || source || chr(10) || 'Title: ' || title || chr(10) || 'Content: ' || content || chr(10) || '---' || chr(10)"""


@query("e12_build_digest_input", tagged(f"""
, m AS (SELECT * FROM tagged WHERE list_contains(parties, 'P1')), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS k FROM m) WHERE k = 1 OR url = ''),
 c AS (SELECT *, row_number() OVER (ORDER BY date DESC, id DESC) AS rn FROM u), d AS (SELECT * FROM c WHERE rn <= 10)
SELECT 'P1' AS entity_name, count(*) AS articles_analyzed, string_agg({DIGEST_BLOCK}, chr(10) ORDER BY rn) AS digest_text, CAST(min(date) AS VARCHAR) AS earliest, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM d"""))
def _(t):
    d = digest.build_digest_input(t.tagged, "party", "P1", 10)
    return d.select("entity_name", "articles_analyzed", "digest_text", F.col("earliest").cast("string").alias("earliest"), text_of("sources").alias("sources"))


def recorded_digest(prompts: pd.Series) -> pd.Series:
    titles = prompts.map(lambda p: len(re.findall(r"\nArticle #", p)))
    return "**TOP_KEYWORDS**\nk1, k2\n**TOPICS_COVERED**\nt1\n**SUMMARY**\n" + titles.astype(str) + " articles"


def failing(prompts: pd.Series) -> pd.Series:
    raise RuntimeError("model is down")


@query("e13_entity_digest", tagged("""
SELECT 'party' AS entity_type, 'P1' AS entity_name, 'k1|k2' AS keywords, 't1' AS topics, '20 articles' AS summary, 20::BIGINT AS articles_analyzed FROM (SELECT count(*) AS n FROM tagged WHERE list_contains(parties, 'P1')) WHERE n >= 20"""))
def _(t):
    d = digest.entity_digest(t.tagged, "party", "P1", recorded_digest, 20, now=TODAY)
    return d.select("entity_type", "entity_name", text_of("keywords").alias("keywords"), text_of("topics").alias("topics"), "summary", "articles_analyzed")


@query("e13_entity_digest_fallback", tagged("""
, m AS (SELECT * FROM tagged WHERE list_contains(people, 'F3')), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS k FROM m) WHERE k = 1 OR url = ''),
 d AS (SELECT * FROM u ORDER BY date DESC, id DESC LIMIT 5)
SELECT 'F3' AS entity_name, contains('x', 'y') AS has_summary, count(*) AS articles_analyzed, CAST(max(date) AS VARCHAR) AS latest, string_agg(title, '|' ORDER BY date DESC, id DESC) AS headlines FROM d"""))
def _(t):
    d = digest.entity_digest(t.tagged, "figure", "F3", failing, 5, now=TODAY)
    return d.select("entity_name", (F.col("summary") != "").alias("has_summary"), "articles_analyzed",
                    F.col("latest").cast("string").alias("latest"), text_of("sample_titles").alias("headlines"))


def recorded_period(prompts: pd.Series) -> pd.Series:
    return pd.Series(["SUMMARY: all of it\n\nKEY POINTS:\n- first\n- second\n\nKEYWORDS: a, b\n\nTOPICS: t"] * len(prompts), index=prompts.index)


PERIOD = "date BETWEEN DATE '2024-10-01' AND DATE '2024-12-31' AND list_contains(parties, 'P2')"


@query("e14_period_summary", tagged(f"""
SELECT 'P2' AS entity_name, 'all of it' AS summary, 'first|second' AS key_points, count(*) AS total_articles, count(*) FILTER (id % 3 <> 0) AS newly_summarized, count(*) FILTER (id % 3 = 0) AS already_summarized
FROM tagged WHERE {PERIOD}"""))
def _(t):
    a = t.tagged.withColumn("is_summarized", F.col("id") % 3 == 0)
    cache = t.spark.createDataFrame([], summaries.PERIOD_SUMMARY_SCHEMA)
    row, _ = digest.period_summary(a, cache, "party", "P2", "2024-10-01", "2024-12-31", recorded_summary, recorded_period, now=TODAY)
    return row.select("entity_name", "summary", text_of("key_points").alias("key_points"), "statistics.total_articles",
                      "statistics.newly_summarized", "statistics.already_summarized")


@query("e14_merged_articles", tagged(f"""
SELECT id, id % 3 = 0 OR ({PERIOD}) AS is_summarized, CASE WHEN new THEN trim(replace(left(content, 60), chr(10), ' ')) ELSE content END AS content, CASE WHEN new THEN content END AS original_content,
 CASE WHEN new THEN 'a first point made' END AS key_points, CASE WHEN new THEN 'reform|vote' END AS keywords, CASE WHEN new THEN 'law' END AS topics, CASE WHEN new THEN 'for it' END AS stance
FROM (SELECT *, ({PERIOD}) AND id % 3 <> 0 AS new FROM tagged)"""))
def _(t):
    a = t.tagged.withColumn("is_summarized", F.col("id") % 3 == 0)
    cache = t.spark.createDataFrame([], summaries.PERIOD_SUMMARY_SCHEMA)
    _, merged = digest.period_summary(a, cache, "party", "P2", "2024-10-01", "2024-12-31", recorded_summary, recorded_period, now=TODAY)
    return merged.select("id", "is_summarized", "content", "original_content", text_of("llm_key_points").alias("key_points"),
                         text_of("llm_keyword_list").alias("keywords"), text_of("llm_topics").alias("topics"), F.col("llm_stance_analysis").alias("stance"))


def stored_summaries(t):
    """One summary per source from its articles, and later ones for some sources."""
    per = t.articles.groupBy(F.col("source").alias("entity_name")).agg(F.count("*").alias("n"), F.max("date").alias("d"))
    return per.select(
        F.lit("party").alias("entity_type"), "entity_name", F.array(F.lit("k")).alias("keywords"), F.array().cast("array<string>").alias("topics"),
        F.concat(F.lit("old "), F.col("entity_name")).alias("summary"), F.col("n").alias("articles_analyzed"),
        F.lit(None).cast("string").alias("associated_party"), F.col("d").cast("timestamp").alias("last_updated"))


def newer(t):
    return stored_summaries(t).where("entity_name like 'src1%'").withColumn("summary", F.concat(F.lit("new "), F.col("entity_name")))


@query("e15_upsert_summary", """
SELECT source AS entity_name, CASE WHEN source LIKE 'src1%' THEN 'new ' ELSE 'old ' END || source AS summary, count(*) AS articles_analyzed FROM documents GROUP BY source""")
def _(t):
    return summaries.upsert_summary(stored_summaries(t), newer(t)).select("entity_name", "summary", "articles_analyzed")


@query("e16_lookup_summary", "SELECT source AS entity_name, 'old ' || source AS summary FROM documents WHERE source = 'src2' GROUP BY source")
def _(t):
    return summaries.lookup_summary(stored_summaries(t), "party", "src2").select("entity_name", "summary")


def periods(t):
    per = t.articles.groupBy("source", F.trunc("date", "month").alias("start_date")).agg(F.count("*").alias("n"))
    return per.select(F.lit("party").alias("entity_type"), F.col("source").alias("entity_name"), "start_date",
                      F.last_day("start_date").alias("end_date"), "n")


PERIODS = base(", p AS (SELECT source AS entity_name, CAST(date_trunc('month', date) AS DATE) AS start_date, count(*) AS n FROM base GROUP BY ALL) ")


@query("e16_list_period_summaries", PERIODS + "SELECT CAST(start_date AS VARCHAR) AS start_date, n FROM p WHERE entity_name = 'src3' ORDER BY p.start_date DESC")
def _(t):
    return summaries.list_period_summaries(periods(t), "party", "src3").select(F.col("start_date").cast("string").alias("start_date"), "n")


@query("e16_delete_summary", PERIODS + "SELECT entity_name, CAST(start_date AS VARCHAR) AS start_date, n FROM p WHERE NOT (entity_name = 'src3')")
def _(t):
    return summaries.delete_summary(periods(t), "party", "src3").select("entity_name", F.col("start_date").cast("string").alias("start_date"), "n")


@query("e17_summary_age_days", f"""
SELECT source AS entity_name, CASE WHEN source <> 'src4' THEN date_diff('day', max(date), DATE '{NOW}')::DOUBLE END AS age_days FROM (SELECT source, CAST(DATE '2024-08-05' + CAST(doc_id % 421 AS INTEGER) AS DATE) AS date FROM documents) GROUP BY source""")
def _(t):
    s = stored_summaries(t).withColumn("last_updated", F.when(F.col("entity_name") != "src4", F.col("last_updated")))
    return summaries.summary_age_days(s, TODAY).select("entity_name", F.round("age_days", 6).alias("age_days"))


def questions(t):
    """The first user turn of every conversation, as a question."""
    return t.conversations.where("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(
        F.min_by("text", "turn").alias("query")).withColumn("language", F.lit(None).cast("string"))


KNOWN = ["P1", "P2", "F1", "Interim Government"]


@query("e18_intents_from_responses", f"""
WITH q AS (SELECT conv_id AS query_id, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT query_id, CASE WHEN query_id % 4 = 3 THEN 'general' ELSE 'entity_focus' END AS type, CASE WHEN query_id % 4 = 3 THEN '' ELSE 'Interim Government|P1' END AS entities,
 CASE WHEN query_id % 4 = 3 THEN 0.3 ELSE 0.8 END::DOUBLE AS confidence, CASE WHEN query_id % 4 < 3 AND query_id % 2 = 0 THEN CAST(CAST(DATE '{NOW}' - 30 AS DATE) AS VARCHAR) END AS "start",
 CASE WHEN query_id % 4 = 3 THEN 'error_fallback' ELSE 'llm' END AS method FROM q WHERE {trimmed('query')} <> ''""")
def _(t):
    k = F.col("query_id")
    body = F.concat(F.lit('{"type": "entity_focus", "entities": ["p1", "interim", "nobody at all"]'),
                    F.when(k % 2 == 0, ', "time_constraint": {"period": "month", "days": 30}').otherwise(""), F.lit("}"))
    r = questions(t).withColumn("response", F.when(k % 4 == 3, "no idea").otherwise(body)).withColumn("error", F.lit(None).cast("string"))
    i = enrich.intents_from_responses(r, KNOWN, TODAY).where("classification_method <> 'empty'")
    return i.select("query_id", "type", text_of("entities").alias("entities"), "confidence",
                    F.col("time_constraint.start").cast("string").alias("start"), F.col("classification_method").alias("method"))


def recorded_intent(prompts: pd.Series) -> pd.Series:
    """A recorded model: questions of odd length are about P1."""
    return prompts.map(lambda p: json.dumps(
        {"type": "entity_focus", "entities": ["P1"] if len(p.split("Question: ", 1)[1]) % 2 else [], "topics": []}))


INTENT_ROWS = ("intent", f"""
SELECT *, {trimmed('query')} = '' AS blank, length(query) % 2 = 1 AS odd FROM (SELECT conv_id AS query_id, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id)""")


def recorded_answer(prompts: pd.Series) -> pd.Series:
    return prompts.map(lambda p: f" seen {p.count('Title: ')} articles ")


@query("e18_classify_queries", with_(INTENT_ROWS) + """
SELECT query_id, CASE WHEN blank THEN 'general' ELSE 'entity_focus' END AS type, CASE WHEN odd AND NOT blank THEN 'P1' ELSE '' END AS entities,
 CASE WHEN blank THEN 'empty' ELSE 'llm' END AS classification_method FROM intent""")
def _(t):
    i = enrich.classify_queries(questions(t), recorded_intent, KNOWN, ["T1"], TODAY)
    return i.select("query_id", "type", text_of("entities").alias("entities"), "classification_method")


@query("e19_answer_batch", tagged("""
, n AS (SELECT count(*) AS n_all, count(*) FILTER (list_contains(parties, 'P1')) AS n_own FROM tagged),
 r AS (SELECT query_id, blank, least(5, CASE WHEN odd AND NOT blank AND n_own > 0 THEN n_own ELSE n_all END) AS hits FROM intent, n)
SELECT query_id, 'seen ' || hits || ' articles' AS answer, CASE WHEN blank THEN 'general' ELSE 'entity_focus' END AS type, hits AS total_articles_retrieved FROM r""", INTENT_ROWS))
def _(t):
    from broadsheet.operators.search import embed

    corpus = embed(t.tagged_flagged, dim=64)
    answers, _ = digest.answer_batch(questions(t), corpus, recorded_intent, recorded_answer, KNOWN, ["T1"], TODAY, k=5, dim=64)
    return answers.select("query_id", "answer", "type", "total_articles_retrieved")


@query("e20_build_summary_prompts", tagged("""
SELECT id, CASE WHEN title <> '' THEN 'Article Title: ' || title ELSE '' END || CASE WHEN len(people) > 0 THEN CASE WHEN title <> '' THEN chr(10) ELSE '' END || 'Political Figure: ' || people[1] ELSE '' END AS context_start, length(content) AS n FROM tagged"""))
def _(t):
    p = enrich.build_summary_prompts(t.tagged)
    context = F.split_part(F.split_part("prompt", F.lit("sentences).\n\n"), F.lit(2)), F.lit("\n\nArticle Content:\n"), F.lit(1))
    cut = F.regexp_replace(F.regexp_replace(context, r"(?s)(^|\n)Political Party: .*", ""), r"(?s)(^|\n)Key Issues: .*", "")
    return p.select("id", cut.alias("context_start"), F.length("content").cast("bigint").alias("n"))


@query("e20_build_keyword_prompts", tagged("""
SELECT id, CASE WHEN title <> '' THEN 'Article Title: ' || title ELSE '' END || CASE WHEN len(parties) > 0 AND len(people) > 0 THEN CASE WHEN title <> '' THEN chr(10) ELSE '' END || 'Political Context: ' || parties[1] || ' - ' || people[1] ELSE '' END AS context FROM tagged"""))
def _(t):
    p = enrich.build_keyword_prompts(t.tagged)
    after = F.substr(F.col("prompt"), F.instr("prompt", "**Main Topics** (3).\n\n") + len("**Main Topics** (3).\n\n"))
    return p.select("id", F.substr(after, F.lit(1), F.instr(after, "\n\nArticle Content:\n") - 1).alias("context"))


@query("e20_build_analysis_prompts", base("SELECT id, 'Title: ' || title || chr(10) || 'Content: ' || content AS tail, true AS lists_names FROM base"))
def _(t):
    p = enrich.build_analysis_prompts(t.articles, GAZ)
    return p.select("id", F.substr(F.col("prompt"), F.instr("prompt", "Title: ")).alias("tail"),
                    F.contains("prompt", F.lit("- P1: F1, F2\n- P2: F3")).alias("lists_names"))


# --- ingestion ----------------------------------------------------------------------------------------

CONFIG = IngestConfig(rules=PAGE_RULES, gaz=GAZ, lexicon=LEXICON, speech=tuple(SPEECH), stance=tuple(STANCE), dim=64)


INGESTED = (BODIES, ("base", """
SELECT sha256(url) AS id, url, title, content, DATE '2024-01-01' AS date, 'web' AS source, 'English' AS language, 'politics' AS category, title || ' ' || content AS both_text
FROM bodies WHERE title IS NOT NULL AND length(content) >= 100"""), *ARTICLES[1:])
SPOKEN_OF = " + ".join(f"CAST(contains(lower(both_text), {quote(w)}) AS INTEGER)" for w in SPEECH)


@query("i01_ingest_batch", with_(*INGESTED) + f"""
SELECT id, url, title, array_to_string(parties, '|') AS parties, array_to_string(themes, '|') AS themes, {SPOKEN_OF} >= 2 AS is_speech, 64 AS dim FROM tagged""")
def _(t):
    pages = t.pages.select("url", "html")
    rows = ingest_batch(pages, None, CONFIG)
    return rows.select("id", "url", "title", text_of("parties").alias("parties"), text_of("themes").alias("themes"), "is_speech",
                       F.size("embedding").alias("dim"))


@query("i02_ingest_stream", with_(*INGESTED) + "SELECT id, url, title, array_to_string(parties, '|') AS parties FROM tagged")
def _(t):
    """Two runs over the same pages: the second finds nothing new."""
    store, checkpoint = scratch_path(t.spark, "store"), scratch_path(t.spark, "progress")
    pages = scratch_path(t.spark, "pages")
    t.pages.select("url", "html").write.parquet(pages)
    for _ in range(2):
        ingest_stream(t.spark, pages, "url string, html string", store, checkpoint, CONFIG).awaitTermination()
    t.pages.select("url", "html").write.mode("append").parquet(pages)
    ingest_stream(t.spark, pages, "url string, html string", store, checkpoint, CONFIG).awaitTermination()
    return read_articles(t.spark, store).select("id", "url", "title", text_of("parties").alias("parties"))
