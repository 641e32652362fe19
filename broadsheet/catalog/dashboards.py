"""Statistics, profiles and category pages over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet import dims
from broadsheet.catalog.base import (
    ALIASES, ARTICLES, BASE, FLAGS, GAZ, NEUTRAL, PARTIES, SPEECH, STANCE, TAXONOMY, base, query, quote, tagged, text_of, with_,
)
from broadsheet.catalog.rows import score_sql
from broadsheet.catalog.tags import FREQ, STANCE_SQL, TOPIC_LEXICON, VERBS, simple_cte, topics_sql
from broadsheet.functions.dates import month_key
from broadsheet.operators import stats
from broadsheet.operators.entities import assign_party
from broadsheet.operators.keywords import keywords_by_frequency
from broadsheet.operators.tagging import analyze_entity
from broadsheet.plans import profiles

WITH_FLAGS = with_(*ARTICLES, FLAGS)
#: Keywords of every article: the most frequent words of its text.
KEYWORDS = ("kw", "SELECT t.*, coalesce(k.keywords, []) AS keywords FROM tagged t LEFT JOIN (SELECT id, list(w ORDER BY rn) AS keywords FROM freq WHERE rn <= 15 GROUP BY id) k ON k.id = t.id")


def with_keywords(df):
    return keywords_by_frequency(df)


@query("a01_corpus_stats", base("""
SELECT count(*) AS total_articles, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, string_agg(DISTINCT language, '|' ORDER BY language) AS languages FROM base"""))
def _(t):
    s = stats.corpus_stats(t.articles)
    return s.select("total_articles", text_of("sources").alias("sources"), text_of("languages").alias("languages"))


@query("a02_coverage_stats", tagged("""
, p AS (SELECT DISTINCT unnest(parties) AS x FROM tagged), q AS (SELECT DISTINCT unnest(people) AS x FROM tagged)
SELECT count(*) AS total_articles, count(*) FILTER (len(parties) > 0) AS articles_with_parties, count(*) FILTER (len(people) > 0) AS articles_with_people,
 round(count(*) FILTER (len(parties) > 0) / count(*)::DOUBLE * 100, 1) AS pct_with_parties, round(count(*) FILTER (len(people) > 0) / count(*)::DOUBLE * 100, 1) AS pct_with_affiliations,
 (SELECT string_agg(x, '|' ORDER BY x) FROM p) AS unique_parties, (SELECT string_agg(x, '|' ORDER BY x) FROM q) AS unique_people, (SELECT count(*) FROM q) AS n_unique_people FROM tagged"""))
def _(t):
    c = stats.coverage_stats(t.tagged)
    return c.select("total_articles", "articles_with_parties", "articles_with_people", "pct_with_parties", "pct_with_affiliations",
                    text_of("unique_parties").alias("unique_parties"), text_of("unique_people").alias("unique_people"),
                    F.col("n_unique_people").cast("bigint").alias("n_unique_people"))


@query("a03_articles_by_source", "SELECT source, count(*) AS articles FROM documents GROUP BY source")
def _(t):
    return stats.articles_by_source(t.articles)


@query("a04_top_mentions", tagged("""SELECT x AS "value", count(*) AS "count" FROM (SELECT unnest(parties) AS x FROM tagged) GROUP BY x ORDER BY 2 DESC, 1 LIMIT 10"""))
def _(t):
    return stats.top_mentions(t.tagged, 10)


def top_sql(label: str, expr: str, n: int | None, source: str) -> str:
    limit = f" ORDER BY 3 DESC, 2 LIMIT {n}" if n else ""
    return f"""(SELECT '{label}' AS facet, x AS "value", count(*)::DOUBLE AS "count" FROM (SELECT unnest({expr}) AS x FROM {source}) GROUP BY x{limit})"""


def num_sql(label: str, expr: str, source: str) -> str:
    return f"""SELECT '{label}', NULL, ({expr})::DOUBLE FROM {source}"""


SUMMARY_SQL = " UNION ALL ".join([
    top_sql("top_categories", "ai_categories", 10, "kf"), num_sql("total_articles", "count(*)", "kf"),
    num_sql("speech_articles", "count(*) FILTER (is_speech)", "kf"), num_sql("stance_articles", "count(*) FILTER (is_stance)", "kf"),
    top_sql("top_parties", "parties", 10, "kf"), top_sql("top_people", "people", 10, "kf"), top_sql("top_keywords", "keywords", 20, "kf"),
    num_sql("avg_categories_per_article", "avg(len(ai_categories))", "kf"), num_sql("avg_people_per_article", "avg(len(people))", "kf")])


@query("a05_categorization_summary", with_(*ARTICLES, FLAGS, FREQ, KEYWORDS, ("kf", "SELECT kw.*, is_speech, is_stance FROM kw LEFT JOIN flags USING (id)")) + SUMMARY_SQL)
def _(t):
    return stats.categorization_summary(with_keywords(t.tagged_flagged).withColumnRenamed("ai_categories", "categories"))


FIGURES = """, per AS (SELECT unnest(parties) AS party, people FROM tagged), pf AS (SELECT party, unnest(people) AS figure FROM per),
 own AS (SELECT DISTINCT party, figure FROM pf JOIN home ON home.canonical = figure AND home.home = party) """


@query("a06_party_activity", tagged(FIGURES + """
SELECT p.party, count(*) AS total_articles, coalesce((SELECT string_agg(figure, '|' ORDER BY figure) FROM own WHERE own.party = p.party), '') AS figures FROM per p GROUP BY p.party"""))
def _(t):
    return stats.party_activity(t.tagged).select("party", "total_articles", text_of("figures").alias("figures"))


@query("a07_party_popular_figures", tagged(FIGURES + """
SELECT * FROM (SELECT party, figure, count(*) AS mentions, row_number() OVER (PARTITION BY party ORDER BY count(*) DESC, figure) AS rank FROM pf GROUP BY party, figure) WHERE rank <= 3"""))
def _(t):
    return stats.party_popular_figures(t.tagged, ALIASES, 3).select("party", "figure", "mentions", F.col("rank").cast("bigint").alias("rank"))


@query("a08_party_figure_breakdown", tagged(FIGURES + """
SELECT p.party, coalesce((SELECT string_agg(figure, '|' ORDER BY figure) FROM own WHERE own.party = p.party), '') AS figures FROM (SELECT DISTINCT party FROM per WHERE len(people) > 0) p"""))
def _(t):
    return stats.party_figure_breakdown(t.tagged).select("party", text_of("figures").alias("figures"))


@query("a09_party_figure_breakdown_inferred", tagged("""
, r AS (SELECT id, parties, unnest(people) AS figure FROM tagged), x AS (SELECT parties, figure, CASE WHEN id % 2 = 0 THEN h.home WHEN len(parties) = 1 THEN parties[1] WHEN list_contains(parties, h.home) THEN h.home END AS party
 FROM r LEFT JOIN home h ON h.canonical = r.figure), seen AS (SELECT DISTINCT unnest(parties) AS party FROM r), f AS (SELECT party, string_agg(DISTINCT figure, '|' ORDER BY figure) AS figures FROM x WHERE party IS NOT NULL GROUP BY party)
SELECT party, coalesce(figures, '') AS figures FROM seen FULL JOIN f USING (party)"""))
def _(t):
    none = F.create_map().cast("map<string,string>")
    a = t.tagged.withColumn("people_affiliations", F.when(F.col("id") % 2 == 0, F.col("people_affiliations")).otherwise(none))
    return stats.party_figure_breakdown_inferred(a, GAZ).select("party", text_of("figures").alias("figures"))


@query("a10_party_figure_cooccurrence", tagged(FIGURES + "SELECT party, string_agg(DISTINCT figure, '|' ORDER BY figure) AS figures FROM pf GROUP BY party"))
def _(t):
    return stats.party_figure_cooccurrence(t.tagged).select("party", text_of("figures").alias("figures"))


RANGE = "date BETWEEN DATE '2024-09-01' AND DATE '2025-06-30'"
TAX_VALUES = "(VALUES " + ", ".join(f"({quote(r['category'])})" for r in TAXONOMY.dicts()) + ") AS tx(category)"


@query("a11_category_stats", tagged(f"""
, r AS (SELECT * FROM tagged WHERE {RANGE}), per AS (SELECT unnest(ai_categories) AS category, parties, date FROM r)
SELECT category, 'total_articles' AS measure, NULL AS key, (SELECT count(*) FROM per WHERE per.category = tx.category) AS "count" FROM {TAX_VALUES}
UNION ALL SELECT category, 'as_primary', NULL, (SELECT count(*) FROM r WHERE primary_category = tx.category) FROM {TAX_VALUES}
UNION ALL SELECT category, 'party', x, count(*) FROM (SELECT category, unnest(parties) AS x FROM per) GROUP BY ALL
UNION ALL SELECT category, 'month', strftime(date, '%Y-%m'), count(*) FROM per GROUP BY ALL
UNION ALL SELECT NULL, 'total_articles', NULL, count(*) FROM r UNION ALL SELECT NULL, 'categorized_articles', NULL, count(*) FROM r UNION ALL SELECT NULL, 'uncategorized_articles', NULL, 0"""))
def _(t):
    return stats.category_stats(t.tagged, TAXONOMY, "2024-09-01", "2025-06-30")


@query("a11_top_categories", tagged("""SELECT x AS "value", count(*) AS "count" FROM (SELECT unnest(ai_categories) AS x FROM tagged) GROUP BY x ORDER BY 2 DESC, 1 LIMIT 9"""))
def _(t):
    return stats.top_categories(t.tagged)


IN_T1 = "list_contains(ai_categories, 'T1')"


@query("a12_category_party_breakdown", tagged(f"""
, p AS (SELECT unnest(parties) AS party FROM tagged WHERE {IN_T1} AND {RANGE})
SELECT party, count(*) AS "count", (SELECT count(*) FROM p) AS total FROM p GROUP BY party ORDER BY 2 DESC, 1 LIMIT 10"""))
def _(t):
    return stats.category_party_breakdown(t.tagged, "T1", TAXONOMY, "2024-09-01", "2025-06-30")


@query("a13_category_party_month_pivot", tagged(f"""
, p AS (SELECT strftime(date, '%Y-%m') AS month, unnest(parties) AS party FROM tagged WHERE {IN_T1})
SELECT month, {', '.join(f"count(*) FILTER (party = '{p}') AS {p}" for p in PARTIES)} FROM p GROUP BY month"""))
def _(t):
    return stats.category_party_month_pivot(t.tagged, "T1", PARTIES)


@query("a13_event_month_pivot", """
SELECT strftime(ts, '%Y-%m') AS month, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'error') AS error FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1""")
def _(t):
    e = t.events.select(F.array(F.lit("x")).alias("ai_categories"), F.array("event_type").alias("parties"), F.to_date("ts").alias("date"))
    return stats.category_party_month_pivot(e, "x", ["click", "view", "error"])


DETAIL = f"(SELECT * FROM kw WHERE {IN_T1})"


@query("a14_category_detail", with_(*ARTICLES, FREQ, KEYWORDS) + " UNION ALL ".join([
    top_sql("top_parties", "parties", 10, DETAIL), num_sql("total_articles", "count(*)", DETAIL),
    num_sql("as_primary", "count(*) FILTER (primary_category = 'T1')", DETAIL), num_sql("as_secondary", "count(*) FILTER (primary_category <> 'T1')", DETAIL),
    top_sql("top_people", "people", 10, DETAIL), top_sql("all_people", "people", None, DETAIL), top_sql("sources", "[source]", None, DETAIL),
    top_sql("monthly_trend", "[strftime(date, '%Y-%m')]", None, DETAIL), top_sql("top_keywords", "keywords", 20, DETAIL)]))
def _(t):
    return stats.category_detail(with_keywords(t.tagged), "T1", TAXONOMY, ALIASES)


@query("a15_category_distribution", tagged(" UNION ALL ".join([
    top_sql("category_distribution", "ai_categories", None, "tagged"), top_sql("primary_category_distribution", "[primary_category]", None, "tagged"),
    num_sql("total_articles", "count(*)", "tagged"), num_sql("avg_categories_per_article", "avg(len(ai_categories))", "tagged"),
    f"SELECT 'articles_per_category', category, (SELECT count(*) FROM (SELECT unnest(ai_categories) AS x FROM tagged) WHERE x = category)::DOUBLE FROM {TAX_VALUES}"])))
def _(t):
    return stats.category_distribution(t.tagged.withColumnRenamed("ai_categories", "categories"), TAXONOMY)


REPORT = with_(BASE) + score_sql() + f"""
, mine AS (SELECT b.* FROM base b JOIN best USING (id) WHERE party_id = 'P1'), {simple_cte('mine')[0]} AS ({simple_cte('mine')[1]}),
an AS (SELECT id, title, {topics_sql()} AS topics, {STANCE_SQL} AS stance FROM mine)
SELECT 'articles_analyzed' AS facet, NULL AS "value", count(*)::DOUBLE AS "count" FROM an UNION ALL """ + " UNION ALL ".join([
    top_sql("top_topics", "topics", 10, "an"), top_sql("top_keywords", "[w]", 20, "(SELECT w FROM simple WHERE rn <= 10)"), top_sql("stances", "[stance]", None, "an"),
    "(SELECT 'recent_analyses', title, id::DOUBLE FROM an ORDER BY id LIMIT 5)"])


@query("a16_entity_report", REPORT)
def _(t):
    a = analyze_entity(assign_party(t.articles, GAZ), TOPIC_LEXICON, "P1", verbs=VERBS, positive=SPEECH, negative=STANCE, neutral=NEUTRAL)
    return stats.entity_report(a)


@query("a17_party_store_stats", base(score_sql() + """
, g(party, figure) AS (VALUES """ + ", ".join(f"({quote(r['party'])}, {quote(r['canonical'])})" for r in {(r["party"], r["canonical"]): r for r in GAZ.dicts() if r["kind"] == "figure"}.values()) + f""")
SELECT p AS party, NULL AS figure, (SELECT count(*) FROM best WHERE party_id = p) AS articles FROM (SELECT unnest({PARTIES}) AS p)
UNION ALL SELECT party, figure, (SELECT count(*) FROM best WHERE party_id = g.party AND contains(figures, g.figure)) FROM g
UNION ALL SELECT NULL, NULL, count(*) FROM best"""))
def _(t):
    return stats.party_store_stats(assign_party(t.articles, GAZ), GAZ)


@query("a18_coverage_window", base("""
SELECT CAST(min(date) AS VARCHAR) AS earliest, CAST(max(date) AS VARCHAR) AS latest, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, count(*) AS articles_count,
 (SELECT string_agg(title, '|' ORDER BY date DESC, id DESC) FROM (SELECT * FROM base ORDER BY date DESC, id DESC LIMIT 5)) AS titles FROM base"""))
def _(t):
    w = stats.coverage_window(t.articles)
    return w.select(F.col("earliest").cast("string").alias("earliest"), F.col("latest").cast("string").alias("latest"),
                    text_of("sources").alias("sources"), "articles_count", text_of("sample_titles").alias("titles"))


@query("a19_bulk_store_counts", base(score_sql() + """
SELECT party_id, count(*) FILTER (party_id IS NOT NULL) AS success, count(*) FILTER (party_id IS NULL) AS failed FROM base LEFT JOIN best USING (id) GROUP BY party_id"""))
def _(t):
    return stats.bulk_store_counts(assign_party(t.articles, GAZ))


def ordered_sql(label: str, column: str, n: int) -> str:
    return f"""(SELECT '{label}' AS facet, x AS "value", (row_number() OVER (ORDER BY first_at, x))::DOUBLE AS "count" FROM (SELECT x, min((id, n)) AS first_at FROM (
 SELECT id, unnest({column}) AS x, generate_subscripts({column}, 1) AS n FROM kw) GROUP BY x) ORDER BY first_at, x LIMIT {n})"""


@query("a20_profile_facets", with_(*ARTICLES, FREQ, KEYWORDS) + " UNION ALL ".join([
    ordered_sql("keywords", "keywords", 20), ordered_sql("topics", "themes", 10),
    "SELECT 'earliest', CAST(min(date) AS VARCHAR), NULL FROM kw", "SELECT 'latest', CAST(max(date) AS VARCHAR), NULL FROM kw",
    num_sql("speech_count", "count(*) FILTER (len(list_filter(keywords, lambda k: contains(k, 'thing'))) > 0)", "kw")]))
def _(t):
    return stats.profile_facets(with_keywords(t.tagged).withColumn("topics", F.col("themes")), "thing")


@query("a21_trend_summary", """
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)
SELECT count(*) AS total_months, (SELECT month FROM m ORDER BY n DESC, month LIMIT 1) AS peak_month, max(n) AS peak_count, CAST(floor(avg(n) + 0.5) AS BIGINT) AS avg_per_month FROM m""")
def _(t):
    return stats.trend_summary(stats.monthly_counts(t.orders.select(F.to_date("o_orderdate").alias("date"))))


@query("a22_share_and_rank", """
WITH c AS (SELECT event_type AS "value", count(*) AS "count" FROM events GROUP BY 1)
SELECT "value", "count", row_number() OVER (ORDER BY "count" DESC, "value") AS rank, round("count" / (SELECT sum("count") FROM c)::DOUBLE * 100, 1) AS share_pct, CAST(floor((SELECT avg("count") FROM c) + 0.5) AS BIGINT) AS mean_count FROM c""")
def _(t):
    counts = t.events.groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("count"))
    return stats.share_and_rank(counts).withColumn("rank", F.col("rank").cast("bigint"))


@query("a23_language_recent_sample", base("""
SELECT id, title, CAST(date AS VARCHAR) AS date, language, (SELECT count(*) FROM base) AS total_articles, (SELECT count(*) FROM base WHERE language = 'fr') AS language_count FROM base ORDER BY base.date DESC, id DESC LIMIT 5"""))
def _(t):
    return stats.language_recent_sample(t.articles, "fr").withColumn("date", F.col("date").cast("string"))


@query("a24_session_counts", "SELECT count(DISTINCT conv_id) AS sessions, count(*) AS messages FROM conversations")
def _(t):
    return stats.session_counts(t.conversations)


@query("a25_ingest_report", base("""
, s AS (SELECT source, count(*) AS scraped, count(*) FILTER (id IN (SELECT doc_id FROM labels)) AS stored FROM base GROUP BY source)
SELECT * FROM s UNION ALL SELECT NULL, sum(scraped)::BIGINT, sum(stored)::BIGINT FROM s"""))
def _(t):
    kept = t.articles.join(t.labels.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return stats.ingest_report(t.articles, kept)


# --- profiles and pages -------------------------------------------------------------------------------

PARTY_ROWS = """, m AS (SELECT * FROM tagged WHERE list_contains(parties, 'P1')), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM m) WHERE rn = 1 OR url = ''),
 f AS (SELECT * FROM u WHERE date >= DATE '2024-10-01') """
PREVIEW = "CASE WHEN length(content) > 300 THEN left(content, 300) || '...' ELSE content END"


def with_tags_as_keywords(df):
    return df.withColumn("keywords", F.col("themes"))


@query("o07_party_profile", tagged(PARTY_ROWS + f"""
SELECT id, title, CAST(date AS VARCHAR) AS date, {PREVIEW} AS preview, array_to_string(themes, '|') AS keywords, (SELECT count(*) FROM f) AS total FROM f ORDER BY f.date DESC, id DESC LIMIT 20 OFFSET 20"""))
def _(t):
    p = profiles.party_profile(with_tags_as_keywords(t.tagged), GAZ, "P1", date_from="2024-10-01", page=2)
    return p.select("id", "title", F.col("date").cast("string").alias("date"), "preview", text_of("best_keywords").alias("keywords"), "total")


@query("o07_party_timeline", tagged(PARTY_ROWS + """
SELECT CAST(date AS VARCHAR) AS date, string_agg(title, '|' ORDER BY id DESC) AS titles FROM (SELECT * FROM f ORDER BY date DESC, id DESC LIMIT 20) GROUP BY date"""))
def _(t):
    p = profiles.party_profile(with_tags_as_keywords(t.tagged), GAZ, "P1", date_from="2024-10-01")
    line = profiles.profile_timeline(p)
    return line.select(F.col("date").cast("string").alias("date"), text_of(F.transform("articles", lambda a: a["title"])).alias("titles"))


FIGURE_ROWS = PARTY_ROWS.replace("list_contains(parties, 'P1')", "list_contains(people, 'F1')")


@query("o08_figure_profile", tagged(FIGURE_ROWS + f"""
SELECT id, title, {PREVIEW} AS preview, 'F1' AS figure FROM f ORDER BY date DESC, id DESC LIMIT 50"""))
def _(t):
    p = profiles.figure_profile(with_tags_as_keywords(t.tagged), GAZ, "P1", "F1", date_from="2024-10-01", top_k=50)
    return p.select("id", "title", "preview", "figure")


@query("o08_figure_profile_paged", tagged("""
, m AS (SELECT * FROM tagged WHERE list_contains(people, 'F1'))
SELECT id, (SELECT count(*) FROM m) AS total, CAST(ceil((SELECT count(*) FROM m) / 50.0) AS BIGINT) AS total_pages FROM m ORDER BY date DESC, id DESC LIMIT 50 OFFSET 100"""))
def _(t):
    p = profiles.figure_profile(with_tags_as_keywords(t.tagged), GAZ, "P1", "F1", page=3, size=50, dedup=False)
    return p.select("id", "total", "total_pages")


@query("o09_category_articles", tagged(f"""
, m AS (SELECT * FROM tagged WHERE {IN_T1} AND list_contains(parties, 'P1') AND {RANGE})
SELECT id, primary_category = 'T1' AS is_primary, CASE WHEN id % 2 = 0 THEN left(content, 40) ELSE '' END AS relevant_excerpt, (SELECT count(*) FROM m) AS total FROM m ORDER BY date DESC, id DESC LIMIT 20"""))
def _(t):
    ex = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("T1"), F.substring("content", 1, 40)))
    a = t.tagged.withColumn("category_excerpts", ex)
    return profiles.category_articles(a, TAXONOMY, "T1", "P1", "2024-09-01", "2025-06-30").select(
        "id", "is_primary", "relevant_excerpt", "total")


@query("o10_categorization_audit", tagged("""
SELECT id, title, array_to_string(parties, ', ') AS parties, array_to_string(people, ', ') AS people, left(array_to_string(themes, ', '), 100) AS keywords, left(content, 200) AS content_preview
FROM tagged ORDER BY date DESC, id DESC LIMIT 50"""))
def _(t):
    a = profiles.categorization_audit(with_tags_as_keywords(t.tagged), 50)
    return a.select("id", "title", "parties", "people", "keywords", "content_preview")


@query("o10_audit_issues", tagged("""
SELECT DISTINCT 'P1' AS party, 'F2' AS figure FROM tagged WHERE list_contains(people, 'F2')"""))
def _(t):
    partial = dims.Dim(GAZ.schema, tuple(r for r in GAZ.rows if r[4] != "F2"))
    return profiles.audit_issues(t.tagged, partial)


@query("a12_party_month_counts", tagged("""
SELECT party, strftime(date, '%Y-%m') AS month, count(*) AS articles FROM (SELECT unnest(parties) AS party, date FROM tagged) GROUP BY ALL"""))
def _(t):
    return party_month_counts(t)


def party_month_counts(t):
    """The flagship: tagged articles counted per party and month."""
    return stats.unnest(t.tagged, "parties", "party", month_key("date").alias("month")).groupBy("party", "month").agg(
        F.count("*").alias("articles"))
