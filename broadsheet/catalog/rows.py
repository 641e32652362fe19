"""Stores, row identity, filters, ordering and paging over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.catalog.base import (
    ALIAS_CTE, ALIASES, FLAGS, GAZ, PARTIES, SQL, base, query, quote, tagged, text_of,
)
from broadsheet.functions.arrays import distinct_ci
from broadsheet.functions.dates import within_date_range
from broadsheet.operators import filters as flt
from broadsheet.operators import identity, paging
from broadsheet.operators.entities import assign_party
from broadsheet.operators.names import distinct_names
from broadsheet.plans.profiles import browse_partition
from broadsheet.session import scratch_path
from broadsheet.sources import store


@query("s11_union_sources", """
SELECT source, count(*) AS n, count(lang) AS with_lang FROM
 (SELECT source, lang FROM documents UNION ALL SELECT 'web', NULL FROM pages) GROUP BY source""")
def _(t):
    web = t.pages.select(F.lit("web").alias("source"))
    both = store.union_sources(t.documents.select("source", "lang"), None, web)
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"))


@query("s13_write_read_articles", base("SELECT id, title, CAST(date AS VARCHAR) AS date, url FROM base"))
def _(t):
    path = scratch_path(t.spark, "articles")
    even = F.col("id") % 2 == 0
    store.write_articles(t.articles.where(even), path)
    store.write_articles(t.articles.where(~even), path)
    return store.read_articles(t.spark, path).select("id", "title", F.col("date").cast("string").alias("date"), "url")


@query("s14_export_json", base("SELECT id, title, source, length(content) AS content_chars FROM base"))
def _(t):
    path = store.export_json(t.articles, scratch_path(t.spark, "export"))
    back = t.spark.read.schema("id bigint, title string, content string, source string").json(path)
    return back.select("id", "title", "source", F.length("content").cast("bigint").alias("content_chars"))


@query("s14_export_envelope", tagged("""
SELECT count(*) AS total_articles, count(*) FILTER (len(parties) > 0) AS with_parties, count(*) FILTER (len(people) > 0) AS with_people,
  count(*) FILTER (len(themes) > 0) AS with_themes, CAST(min(date) AS VARCHAR) AS earliest, CAST(max(date) AS VARCHAR) AS latest FROM tagged"""))
def _(t):
    return store.export_envelope(t.tagged)


@query("s15_write_read_embeddings", """
SELECT vec_id, label, len(embedding) AS dim, 'driver' AS model_name, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings""")
def _(t):
    path = store.write_embeddings(t.embeddings, scratch_path(t.spark, "vectors"), "driver")
    e = store.read_embeddings(t.spark, path, "driver")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return e.select("vec_id", "label", F.col("dim").cast("bigint").alias("dim"), "model_name", F.round(total, 5).alias("total"))


def score_sql(figure_rule: bool = True) -> str:
    """T15 in SQL: per article the best party by score, then ordinal."""
    parts = []
    for i, p in enumerate(PARTIES):
        rows = [r for r in GAZ.dicts() if r["party"] == p]
        hit = lambda r: f"CAST(contains(low, {quote(r['variant'])}) AS INTEGER)"
        score = " + ".join(f"{2 if r['kind'] == 'party' else 5} * {hit(r)}" for r in rows)
        figs = " + ".join(hit(r) for r in rows if r["kind"] == "figure")
        if rows[0]["requires_figure"] and figure_rule:
            score = f"CASE WHEN {figs} > 0 THEN {score} ELSE 0 END"
        names = dict.fromkeys(r["canonical"] for r in rows if r["kind"] == "figure")
        listed = ", ".join(
            "CASE WHEN " + " OR ".join(f"contains(low, {quote(r['variant'])})" for r in rows if r["canonical"] == n and r["kind"] == "figure")
            + f" THEN {quote(n)} END" for n in names)
        parts.append(f"SELECT id, {quote(p)} AS party, {i} AS ord, {score} AS score, concat_ws('|', {listed}) AS figures FROM low_text")
    union = " UNION ALL ".join(parts)
    return (
        ", low_text AS (SELECT id, lower(both_text) AS low FROM base), scored AS (" + union + "), "
        "best AS (SELECT id, party AS party_id, score AS party_score, figures FROM (SELECT *, row_number() OVER "
        "(PARTITION BY id ORDER BY score DESC, ord) AS rn FROM scored WHERE score > 0) WHERE rn = 1) "
    )


@query("s16_write_party_partitioned", base(score_sql() + "SELECT b.id, b.title, party_id FROM base b JOIN best USING (id)"))
def _(t):
    path = scratch_path(t.spark, "parties")
    store.write_party_partitioned(assign_party(t.articles, GAZ), path)
    return t.spark.read.parquet(path).select("id", "title", "party_id")


@query("s16_party_counts", base(score_sql() + "SELECT party_id, count(*) AS articles FROM best GROUP BY 1"))
def _(t):
    return store.party_counts(assign_party(t.articles, GAZ))


@query("s17_drop_party_partition", base(score_sql() + "SELECT party_id, count(*) AS articles FROM best WHERE party_id <> 'P1' GROUP BY 1"))
def _(t):
    path = scratch_path(t.spark, "parties")
    store.write_party_partitioned(assign_party(t.articles, GAZ), path)
    store.drop_party_partition(t.spark, path, "P1")
    return store.party_counts(t.spark.read.parquet(path))


@query("s17_reset_store", "SELECT count(*) AS before, 0 AS after FROM documents")
def _(t):
    path = store.write_articles(t.articles, scratch_path(t.spark, "reset"))
    before = t.spark.read.parquet(path).agg(F.count("*").alias("before"))
    out = t.spark.createDataFrame([tuple(before.first())], "before bigint")
    store.reset_store(t.spark, path, "DELETE_ALL")
    after = t.spark.read.schema(t.articles.schema).parquet(path).agg(F.count("*").alias("after"))
    return out.withColumn("after", after.scalar())


# --- row identity -------------------------------------------------------------------------------------

@query("r01_assign_article_id", base("""
SELECT CAST(id AS VARCHAR) AS row_id, CASE WHEN id % 3 = 0 THEN CAST(id AS VARCHAR) WHEN url <> '' THEN sha256(url) ELSE sha256(content) END AS article_id FROM base"""))
def _(t):
    a = t.articles.withColumn("row_id", F.col("id").cast("string")).withColumn(
        "article_id", F.when(F.col("id") % 3 == 0, F.col("id").cast("string")))
    return identity.assign_article_id(a, "article_id").select("row_id", "article_id")


DEDUP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM {0}) WHERE rn = 1 OR url = ''"


@query("r02_dedup_by_url", base("SELECT id, url FROM (" + DEDUP.format("base") + ")"))
def _(t):
    return identity.dedup_by_url(t.articles).select("id", "url")


HALVES = """, store AS (SELECT * FROM base WHERE source < 'src2'), batch AS (SELECT * FROM base WHERE source >= 'src2' OR lang_key = 'en'),
 uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM batch) WHERE rn = 1 OR url = ''),
 fresh AS (SELECT * FROM uniq WHERE url = '' OR url NOT IN (SELECT url FROM store WHERE url <> '')) """
HALVES = HALVES.replace("lang_key", "language")


def halves(t):
    a = t.articles
    return a.where("source < 'src2'"), a.where("source >= 'src2' or language = 'en'")


@query("r03_insert_new", base(HALVES + "SELECT id, url FROM fresh"))
def _(t):
    return identity.insert_new(*halves(t)).select("id", "url")


@query("r04_ingest_stats", base(HALVES + """
SELECT (SELECT count(*) FROM batch) AS total, (SELECT count(*) FROM uniq) AS "unique", (SELECT count(*) FROM batch) - (SELECT count(*) FROM fresh) AS duplicates,
 (SELECT count(*) FROM fresh) AS stored, (SELECT count(*) FROM store) + (SELECT count(*) FROM fresh) AS collection_size"""))
def _(t):
    return identity.ingest_stats(*halves(t))


def bucketed_halves(t):
    """The same halves, the store laid out by URL."""
    old, batch = halves(t)
    return store.open_bucketed(t.spark, store.write_bucketed(old, scratch_path(t.spark, "bucketed"))), batch


@query("r03_insert_into_buckets", SQL["r03_insert_new"])
def _(t):
    return identity.insert_new(*bucketed_halves(t)).select("id", "url")


@query("r04_ingest_stats_of_buckets", SQL["r04_ingest_stats"])
def _(t):
    return identity.ingest_stats(*bucketed_halves(t))


@query("r05_get_by_id", base("SELECT id, title, url FROM base WHERE id = 77"))
def _(t):
    return identity.get_by_id(t.articles, 77).select("id", "title", "url")


@query("r06_delete_by_id", base("SELECT id FROM base WHERE id NOT IN (SELECT doc_id FROM labels)"))
def _(t):
    return identity.delete_by_id(t.articles, t.labels.select(F.col("doc_id").alias("id"))).select("id")


@query("r07_merge_columns", base("""
SELECT b.id, CASE WHEN l.quality = 1 THEN 'good' ELSE b.category END AS category, l.toxic AS toxic, b.title FROM base b LEFT JOIN labels l ON l.doc_id = b.id"""))
def _(t):
    updates = t.labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").alias("category"), "toxic")
    return identity.merge_columns(t.articles, updates).select("id", "category", "toxic", "title")


@query("r08_replace_document", base("""
SELECT b.id, CASE WHEN l.doc_id IS NOT NULL THEN left(content, 50) || ' v2' ELSE content END AS content,
  CASE WHEN l.doc_id IS NOT NULL THEN content END AS original_content, l.doc_id IS NOT NULL AS is_summarized
FROM base b LEFT JOIN labels l ON l.doc_id = b.id"""))
def _(t):
    labelled = t.articles.join(t.labels.select(F.col("doc_id").alias("id")), "id")
    once = identity.replace_document(t.articles, labelled.select("id", F.substring("content", 1, 50).alias("summary")))
    again = labelled.select("id", F.concat(F.substring("content", 1, 50), F.lit(" v2")).alias("summary"))
    return identity.replace_document(once, again).select("id", "content", "original_content", "is_summarized")


@query("r09_clear_columns", tagged("""
SELECT id, CASE WHEN id % 2 = 1 THEN NULL WHEN false THEN '' END AS primary_category, CASE WHEN id % 2 = 1 THEN NULL ELSE '' END AS ai_categories,
  CASE WHEN id % 2 = 0 AND len(parties) = 0 AND len(people) = 0 THEN 0 END AS n_people FROM tagged"""))
def _(t):
    odd = F.col("id") % 2 == 1
    a = t.tagged.withColumn("primary_category", F.when(odd, F.col("primary_category"))).withColumn(
        "ai_categories", F.when(odd, F.col("ai_categories")).otherwise(F.array().cast("array<string>")))
    out = identity.clear_columns(a, also_people=True)
    return out.select("id", "primary_category",
                      F.when(odd, text_of("ai_categories")).when(F.col("ai_categories").isNull() & ~odd, "").otherwise(
                          text_of("ai_categories")).alias("ai_categories"),
                      F.when(~odd & F.col("people").isNotNull(), F.size("people")).alias("n_people"))


@query("r09_clear_counts", tagged("""
SELECT count(*) AS total_articles, count(*) FILTER (primary_category <> 'Others' OR len(people) > 0 OR len(parties) > 0) AS cleared_count,
 count(*) FILTER (NOT (primary_category <> 'Others' OR len(people) > 0 OR len(parties) > 0)) AS untouched_count FROM tagged"""))
def _(t):
    others = F.col("primary_category") == "Others"
    a = t.tagged.withColumn("primary_category", F.when(~others, F.col("primary_category"))).withColumn(
        "ai_categories", F.when(~others, F.col("ai_categories")))
    return identity.clear_counts(a, also_people=True)


WORDS = "list_filter(regexp_extract_all(title, '[A-Za-z]+'), lambda x: x <> '')"


@query("r10_distinct_array", base(f"""
, w AS (SELECT id, {WORDS} AS ws FROM base), u AS (SELECT id, unnest(ws) AS x, generate_subscripts(ws, 1) AS n FROM w),
f AS (SELECT id, lower(x) AS k, arg_min(x, n) AS x, min(n) AS n FROM u GROUP BY id, lower(x))
SELECT w.id, coalesce(string_agg(x, '|' ORDER BY n), '') AS names FROM w LEFT JOIN f USING (id) GROUP BY w.id"""))
def _(t):
    words = F.regexp_extract_all("title", F.lit("[A-Za-z]+"), 0)
    a = t.articles.select("id", words.alias("w"))
    return a.select("id", text_of(distinct_ci("w")).alias("names"))


@query("r10_distinct_names", base(f"""
, {ALIAS_CTE[0]} AS ({ALIAS_CTE[1]}), w AS (SELECT id, {WORDS} AS ws FROM base), u AS (SELECT id, unnest(ws) AS x, generate_subscripts(ws, 1) AS n FROM w),
m AS (SELECT x, coalesce((SELECT arg_min(canonical, ordinal) FROM aliases WHERE variant = x), CASE WHEN x IN (SELECT canonical FROM aliases) THEN x END,
  (SELECT arg_min(canonical, ordinal) FROM aliases WHERE lower(variant) = lower(x) OR lower(canonical) = lower(x)), x) AS c FROM (SELECT DISTINCT x FROM u)),
f AS (SELECT id, lower(c) AS k, arg_min(c, n) AS c, min(n) AS n FROM u JOIN m USING (x) GROUP BY id, lower(c))
SELECT w.id, coalesce(string_agg(c, '|' ORDER BY n), '') AS names FROM w LEFT JOIN f USING (id) GROUP BY w.id"""))
def _(t):
    words = F.regexp_extract_all("title", F.lit("[A-Za-z]+"), 0)
    return distinct_names(t.articles.select("id", words.alias("names")), "id", "names", ALIASES).select(
        "id", text_of("names").alias("names"))


# --- filters ------------------------------------------------------------------------------------------

WITH_FLAGS = f", flags AS ({FLAGS[1]}), a AS (SELECT b.*, is_speech, is_stance FROM base b LEFT JOIN flags USING (id)) "


@query("f01_filter_articles", base(WITH_FLAGS + """
SELECT id FROM a WHERE language = 'en' AND is_speech AND date BETWEEN DATE '2024-09-01' AND DATE '2025-03-31'"""))
def _(t):
    return flt.filter_articles(t.flagged, language="en", is_speech=True, date_from="2024-09-01", date_to="2025-03-31").select("id")


@query("f02_filter_any", tagged("""
SELECT id FROM tagged WHERE (list_contains(parties, 'P1') OR list_contains(parties, 'P3')) AND (list_contains(people, 'F1') OR list_contains(people, 'F4'))
 AND list_contains(themes, 'T1')"""))
def _(t):
    return flt.filter_any(t.tagged, ["P1", "P3"], ["F1", "F4"], ["T1"]).select("id")


NULL_DATES = ", d AS (SELECT id, CASE WHEN id % 9 <> 0 THEN CAST(date AS VARCHAR) ELSE '' END AS date FROM base) "


def text_dates(t):
    return t.articles.withColumn("date", F.when(F.col("id") % 9 != 0, F.col("date").cast("string")).otherwise(""))


@query("f03_filter_date_lexical", base(NULL_DATES + "SELECT id FROM d WHERE date <= '2025-01-31'"))
def _(t):
    return flt.filter_date_lexical(text_dates(t), None, "2025-01-31").select("id")


@query("f04_filter_date_strict", base(NULL_DATES + "SELECT id FROM d WHERE date <> '' AND date <= '2025-01-31'"))
def _(t):
    return flt.filter_date_strict(text_dates(t), None, "2025-01-31").select("id")


@query("f05_filter_affiliated", tagged("""
SELECT id FROM tagged WHERE list_contains(people, 'F1')"""))
def _(t):
    return flt.filter_affiliated(t.tagged, "F1", "P1").select("id")


@query("f06_filter_source_ci", "SELECT doc_id AS id FROM documents WHERE lower(source) = 'src3'")
def _(t):
    return flt.filter_source_ci(t.articles, "SRC3").select("id")


@query("f07_filter_presence", tagged("SELECT id FROM tagged WHERE len(people) = 0 AND len(parties) > 0"))
def _(t):
    return flt.filter_presence(t.tagged, has_people=False, has_parties=True).select("id")


@query("f08_filter_contains", tagged("""
SELECT id FROM tagged WHERE contains(array_to_string(parties, ', '), '1, P') AND date >= DATE '2024-10-01'"""))
def _(t):
    return flt.filter_contains(t.tagged, "parties", "1, P", "2024-10-01").select("id")


@query("f09_filter_generic", tagged("""
SELECT id FROM tagged WHERE language = 'en' AND (list_contains(themes, 'T1') OR list_contains(themes, 'T3')) AND source IN ('src1', 'src2', 'src3')"""))
def _(t):
    return flt.filter_generic(t.tagged, {"language": "en", "themes": ["T1", "T3"], "source": ["src1", "src2", "src3"], "url": None}).select("id")


@query("f10_text_search", base("SELECT id FROM base WHERE contains(lower(title), 'onan') OR contains(lower(content), 'onan')"))
def _(t):
    return flt.text_search(t.articles, "ONAN").select("id")


@query("f10_session_search", """
SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(contains(lower(text), 'erin')) AND count(*) FILTER (role = 'user') > 0""")
def _(t):
    first = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"))
    return flt.session_search(t.conversations, first, "Erin").select("conv_id")


@query("f11_filter_uncategorized", base("""
SELECT id FROM base WHERE date BETWEEN DATE '2024-09-01' AND DATE '2025-06-30' AND id NOT IN (SELECT doc_id FROM labels) ORDER BY id LIMIT 50"""))
def _(t):
    done = t.labels.select(F.col("doc_id").alias("id"), F.lit("T1").alias("primary_category"))
    a = t.articles.join(done, "id", "left").withColumn("ai_categories", F.lit(None).cast("array<string>"))
    return flt.filter_uncategorized(a, "2024-09-01", "2025-06-30", limit=50).select("id")


@query("f12_filter_people_fuzzy", tagged("SELECT id FROM tagged WHERE len(list_filter(people, lambda p: contains('xf1y', lower(p)) OR contains(lower(p), 'xf1y'))) > 0"))
def _(t):
    return flt.filter_people_fuzzy(t.tagged, "xF1y").select("id")


@query("f13_within_date_range", "SELECT event_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-05'")
def _(t):
    return t.events.where(within_date_range("ts", "2024-01-02", "2024-01-05")).select("event_id")


@query("f14_filter_by_source_name", "SELECT doc_id AS id FROM documents WHERE source IN ('src1', 'src4')")
def _(t):
    return flt.filter_by_source_name(t.articles, ["src1", "nowhere", "src4"], known={f"src{i}" for i in range(20)}).select("id")


# --- ordering and paging ------------------------------------------------------------------------------

@query("o01_newest_first", base("SELECT id, CAST(date AS VARCHAR) AS date FROM base ORDER BY base.date DESC, id DESC"))
def _(t):
    return paging.newest_first(t.articles).select("id", F.col("date").cast("string").alias("date"))


@query("o02_paginate", base("""
SELECT id, (SELECT count(*) FROM base) AS total, CAST(ceil((SELECT count(*) FROM base) / 20.0) AS BIGINT) AS total_pages
FROM base ORDER BY date DESC, id DESC LIMIT 20 OFFSET 40"""))
def _(t):
    return paging.paginate(t.articles, 3, 20).select("id", "total", "total_pages")


@query("o02_indexed_page", SQL["o02_paginate"])
def _(t):
    stored = t.spark.read.parquet(paging.write_newest_first(t.articles, scratch_path(t.spark, "newest")))
    return paging.indexed_page(stored, paging.page_index(stored, 20), 3, 20).select("id", "total", "total_pages")


@query("o03_offset_limit", base("SELECT id, title FROM base ORDER BY id DESC LIMIT 25 OFFSET 10"))
def _(t):
    return paging.offset_limit(t.articles, 10, 25).select("id", "title")


@query("o03_offset_limit_stats", tagged("""
SELECT count(*) AS "count", count(*) FILTER (len(parties) > 0) AS with_parties, count(*) FILTER (len(people) > 0) AS with_people,
 count(*) FILTER (len(people) > 0) AS with_affiliations, (SELECT count(*) FROM tagged) AS total FROM (SELECT * FROM tagged ORDER BY id DESC LIMIT 25 OFFSET 10)"""))
def _(t):
    return paging.offset_limit_stats(t.tagged, 10, 25)


@query("o04_latest_n", base("SELECT id FROM base ORDER BY date DESC, id DESC LIMIT 500"))
def _(t):
    return paging.latest_n(t.articles, 500).select("id")


@query("o05_group_by_date", base("""
SELECT CAST(date AS VARCHAR) AS date, count(*) AS n, string_agg(title || '@' || source, '|' ORDER BY id DESC) AS entries
FROM base WHERE date IS NOT NULL GROUP BY date"""))
def _(t):
    g = paging.group_by_date(t.articles)
    return g.select(F.col("date").cast("string").alias("date"), F.size("articles").cast("bigint").alias("n"),
                    text_of(F.transform("articles", lambda e: F.concat(e["title"], F.lit("@"), e["source"]))).alias("entries"))


@query("o06_top_counts", "SELECT event_type AS \"value\", count(*) AS \"count\" FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(t):
    from broadsheet.operators.stats import top_counts

    return top_counts(t.events, "event_type", 3)


@query("o11_browse_partition", base(score_sql() + """
SELECT b.id, title FROM base b JOIN best USING (id) WHERE party_id = 'P1' AND contains(figures, 'F1') AND language = 'en' ORDER BY b.id LIMIT 10"""))
def _(t):
    return browse_partition(assign_party(t.articles, GAZ), "P1", "F1", {"language": "en"}, 10).select("id", "title")
