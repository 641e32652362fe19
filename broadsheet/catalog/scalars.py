"""Extraction, projections and scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.catalog.base import base, collapsed, query, quote, tagged, text_of, trimmed, with_
from broadsheet.functions.arrays import (
    export_metadata, first_non_empty, join_list, parse_affiliations, split_list,
)
from broadsheet.functions.dates import (
    chunk_ranges, extract_dates, format_display_date, month_chunks, month_key, parse_multi_format_date,
)
from broadsheet.functions.text import (
    TOKEN, WS, clean_text, detect_language, document_text, locate_excerpt, prefer_full_content, preview, resolve_url,
    session_title, strip, strip_boilerplate, url_domain,
)
from broadsheet.operators.filters import filter_section
from broadsheet.plans.cards import article_card, flatten_article, unflatten_article
from broadsheet.sources.html import (
    PageRules, extract_articles, extract_author_category, extract_links, extract_pages, extract_published_date, extract_title,
)
from broadsheet.sources.story import parse_story_json

PAGE_RULES = PageRules(source="web", body=("article",), min_content=100)


def unescaped(expr: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        expr = f"replace({expr}, {quote(entity)}, {quote(char)})"
    return expr


def plain(expr: str) -> str:
    return trimmed(unescaped(f"regexp_replace({expr}, '<[^>]*>', '', 'g')"))


#: The pages' paragraphs: one that is not closed holds all that follow it. Without any, the text of the block beside.
BODIES = ("bodies", f"""
SELECT page_id, url, nullif({plain(r"regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, '') AS title,
 CASE WHEN len(pieces) > 0 THEN array_to_string(pieces, chr(10) || chr(10)) WHEN length(beside) > 30 THEN beside END AS content
FROM (SELECT page_id, url, html, beside, list_filter(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN contains(parts[i], '</p>') THEN texts[i] ELSE array_to_string(texts[i:], '') END),
  lambda x: length(x) > 20) AS pieces
 FROM (SELECT *, list_transform(parts, lambda s: {plain('s')}) AS texts, {plain(r"regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")} AS beside
  FROM (SELECT *, list_slice(string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>'), 2, 100000) AS parts FROM pages)))""")


@query("s01_extract_articles", with_(BODIES) + """
SELECT page_id, url, title, length(content) AS content_chars, 'politics' AS category, 'web' AS source, 'English' AS language FROM bodies
WHERE title IS NOT NULL AND length(content) >= 100""")
def _(t):
    return extract_articles(t.pages, PAGE_RULES).select(
        "page_id", "url", "title", F.length("content").alias("content_chars"), "category", "source", "language")


@query("s02_extract_title", f"""
SELECT page_id, nullif({plain(r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1)")}, '') AS title FROM pages""")
def _(t):
    return t.pages.select("page_id", extract_title("html").alias("title"))


@query("s03_extract_body", with_(BODIES) + "SELECT page_id, length(content) AS content_chars, md5(content) AS content_md5 FROM bodies")
def _(t):
    return extract_pages(t.pages, PAGE_RULES).select(
        "page_id", F.length("content").alias("content_chars"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("s04_extract_published_date", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS published FROM orders""")
def _(t):
    d = F.col("o_orderdate")
    html = F.when(F.col("o_orderkey") % 3 == 0, F.concat(
        F.lit('<head><meta property="article:published_time" content="'), F.date_format(d, "yyyy-MM-dd"),
        F.lit('T10:00:00+06:00"></head>'))).when(F.col("o_orderkey") % 3 == 1, F.concat(
            F.lit('<p><time class="x" datetime="'), F.date_format(d, "yyyy-MM-dd"), F.lit('">then</time></p>'))).otherwise(
        F.concat(F.lit('<div class="date">'), F.date_format(d, "EEE MMM d, yyyy"),
                 F.lit(" 01:55 PM Last update on: Fri Jan 1, 2021 02:00 AM</div>")))
    return t.orders.select("o_orderkey", extract_published_date(html).cast("string").alias("published"))


@query("s05_extract_author_category", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'By ' || page_id END AS author,
       CASE WHEN page_id % 3 = 0 THEN 'desk' ELSE 'general' END AS category FROM pages""")
def _(t):
    head = F.concat(
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<p class="byline big">By '), F.col("page_id"), F.lit("</p>"))).otherwise(""),
        F.when(F.col("page_id") % 3 == 0, F.lit('<a href="/d" class="news-category">desk</a>')).otherwise(""), F.col("html"))
    found = extract_author_category(head, default_category="general")
    return t.pages.select("page_id", found["author"].alias("author"), found["category"].alias("category"))


LINK = r"(?is)<a\b[^>]*?\bhref\s*=\s*\"([^\"]*)\""


@query("s06_extract_links", f"""
WITH raw AS (SELECT page_id, unnest(regexp_extract_all(html, {quote(LINK.replace(chr(92) + '"', '"'))}, 1)) AS h FROM pages),
numbered AS (SELECT page_id, {unescaped('h')} AS h, row_number() OVER () AS n FROM raw),
absolute AS (SELECT page_id, n, CASE WHEN h LIKE 'https://%' THEN h WHEN h LIKE '//%' THEN 'https:' || h
   WHEN h LIKE '/%' THEN 'https://news.example' || h END AS link FROM numbered WHERE length(h) > 5)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY min(n)) - 1 AS "position", link FROM absolute
WHERE link IS NOT NULL GROUP BY page_id, link""")
def _(t):
    return extract_links(t.pages, "https://news.example", min_length=5)


def stories(t):
    """Documents as API stories in JSON, every third one in the section of interest."""
    d = t.documents
    section = F.when(F.col("doc_id") % 3 == 0, "Politics").otherwise("Sport")
    story = F.struct(
        F.when(F.col("doc_id") % 7 != 0, F.substring("text", 1, 40)).alias("headline"),
        F.concat(F.when(F.col("doc_id") % 5 == 0, "x/politics/").otherwise("x/sport/"), F.col("doc_id")).alias("slug"),
        F.array(F.struct(section.alias("name"), F.lower(section).alias("slug"))).alias("sections"),
        (F.lit(1_722_816_000_000) + F.col("doc_id") * 86_400_000).alias("published-at"),
        F.substring("text", 1, 150).alias("summary"),
    )
    return d.select("doc_id", F.to_json(story).alias("raw"), F.col("text").alias("full_text"))


@query("s07_parse_story_json", """
SELECT doc_id, left(text, 40) AS title, strftime(DATE '2024-08-05' + CAST(doc_id AS INTEGER), '%Y-%m-%d') AS date,
  'https://news.example/x/' || CASE WHEN doc_id % 5 = 0 THEN 'politics/' ELSE 'sport/' END || doc_id AS url,
  CASE WHEN doc_id % 3 = 0 THEN 'Politics' ELSE 'politics' END AS category, length(text) AS content_chars
FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 3 = 0 OR doc_id % 5 = 0) AND length(text) >= 100
  AND CASE WHEN length(text) > 100 THEN true ELSE length(left(text, 150)) >= 100 END
  AND DATE '2024-08-05' + CAST(doc_id AS INTEGER) <= DATE '2026-12-31' AND left(text, 40) <> ''""")
def _(t):
    out = parse_story_json(stories(t), "raw", full_content="full_text", end="2026-12-31")
    return out.select("doc_id", "title", F.col("date").cast("string").alias("date"), "url", "category",
                      F.length("content").cast("bigint").alias("content_chars"))


@query("s08_filter_section", """
SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0""")
def _(t):
    parsed = stories(t).select("doc_id", F.from_json("raw", "slug string, sections array<struct<name:string,slug:string>>").alias("s"))
    return filter_section(parsed.select("doc_id", "s.*"), ("politics",)).select("doc_id")


@query("s09_prefer_full_content", """
SELECT * FROM (SELECT doc_id, CASE WHEN length(text) > 100 THEN text ELSE left(text, 120) END AS chosen FROM documents)
WHERE length(chosen) >= 100""")
def _(t):
    chosen = prefer_full_content("text", F.substring("text", 1, 120))
    return t.documents.select("doc_id", chosen.alias("chosen")).where("chosen is not null")


@query("s10_strip_boilerplate", rf"""
WITH a AS (SELECT doc_id, regexp_replace(text, '(?s)the.{{1,20}}?of', '', 'g') AS c FROM documents),
b AS (SELECT doc_id, CASE WHEN contains(left(c, 200), 'with') THEN substring(c, strpos(c, 'with') + 4) ELSE c END AS c FROM a),
d AS (SELECT doc_id, CASE WHEN strpos(c, 'ation') > 0 THEN left(c, CAST(strpos(c, 'ation') - 1 AS INTEGER)) ELSE c END AS c FROM b)
SELECT doc_id, {trimmed("regexp_replace(regexp_replace(c, chr(10) || '+', chr(10), 'g'), ' +', ' ', 'g')")} AS cleaned FROM d""")
def _(t):
    return t.documents.select("doc_id", strip_boilerplate("text", ["the.{1,20}?of"], "with", "ation").alias("cleaned"))


@query("s12_month_chunks", """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(CAST(o_orderdate AS DATE) + 75 AS DATE) AS e FROM orders),
m AS (SELECT o_orderkey, s, e, CAST(unnest(generate_series(date_trunc('month', s), CAST(e AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m FROM o)
SELECT o_orderkey, CAST(greatest(m, s) AS VARCHAR) AS chunk_start, CAST(least(last_day(m), e) AS VARCHAR) AS chunk_end FROM m""")
def _(t):
    o = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("s"))
    out = chunk_ranges(o.withColumn("e", F.date_add("s", 75)), "s", "e")
    return out.select("o_orderkey", F.col("chunk_start").cast("string").alias("chunk_start"),
                      F.col("chunk_end").cast("string").alias("chunk_end"))


@query("s12_articles_per_chunk", base("""
, m AS (SELECT CAST(unnest(generate_series(DATE '2024-08-01', TIMESTAMP '2025-09-30', INTERVAL 1 MONTH)) AS DATE) AS m),
c AS (SELECT greatest(m, DATE '2024-08-05') AS s, least(last_day(m), DATE '2025-09-30') AS e FROM m)
SELECT CAST(c.s AS VARCHAR) AS chunk_start, CAST(c.e AS VARCHAR) AS chunk_end, count(b.id) AS articles
FROM c LEFT JOIN base b ON b.date BETWEEN c.s AND c.e GROUP BY ALL"""))
def _(t):
    chunks = month_chunks(t.spark, "2024-08-05", "2025-09-30").withColumn("month", F.trunc("chunk_start", "month"))
    per_day = t.articles.groupBy("date").agg(F.count("*").alias("n")).withColumn("month", F.trunc("date", "month"))
    inside = F.col("date").between(F.col("chunk_start"), F.col("chunk_end"))
    return chunks.join(per_day, "month", "left").groupBy("chunk_start", "chunk_end").agg(
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("articles")
    ).select(F.col("chunk_start").cast("string").alias("chunk_start"), F.col("chunk_end").cast("string").alias("chunk_end"), "articles")


@query("p01_document_text", base(f"""
SELECT id, {trimmed("title || chr(10) || chr(10) || content")} AS document, {trimmed("title || ' ' || content")} AS embed_text FROM base"""))
def _(t):
    return t.articles.select("id", document_text("title", "content").alias("document"),
                             document_text("title", "content", " ").alias("embed_text"))


@query("p02_detect_language", """
SELECT doc_id, CASE WHEN regexp_matches(text, '[ঀ-৿]') THEN 'Bangla'
  WHEN regexp_matches(text, '[à-ÿ]') THEN 'Accented' ELSE 'Plain' END AS language FROM documents""")
def _(t):
    blocks = {"Bangla": "ঀ-৿", "Accented": "à-ÿ"}
    return t.documents.select("doc_id", detect_language("text", blocks, "Plain").alias("language"))


def cleaned(expr: str) -> str:
    c = f"regexp_replace({expr}, {quote(f'http[^{WS}]+|www[^{WS}]+')}, '', 'g')"
    c = f"regexp_replace({c}, {quote(f'[^{WS}]+@[^{WS}]+')}, '', 'g')"
    c = f"regexp_replace({c}, {quote(f'[^{TOKEN}{WS}]')}, ' ', 'g')"
    return trimmed(collapsed(c))


@query("p03_clean_text", f"SELECT doc_id, {cleaned('text')} AS cleaned FROM documents")
def _(t):
    return t.documents.select("doc_id", clean_text("text").alias("cleaned"))


@query("p04_preview", """
SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END AS preview,
  left(text, 500) || '...' AS always FROM documents""")
def _(t):
    return t.documents.select("doc_id", preview("text", 300).alias("preview"), preview("text", 500, always=True).alias("always"))


@query("p05_split_list", f"""
SELECT doc_id, len(parts) AS n, array_to_string(parts, '|') AS parts FROM (SELECT doc_id,
  list_filter(list_transform(string_split(text, ','), lambda x: {trimmed('x')}), lambda x: x <> '') AS parts FROM documents)""")
def _(t):
    p = t.documents.select("doc_id", split_list("text").alias("parts"))
    return p.select("doc_id", F.size("parts").cast("bigint").alias("n"), text_of("parts").alias("parts"))


@query("p06_join_list", """
SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 20), ', ') AS joined FROM documents""")
def _(t):
    return t.documents.select("doc_id", join_list(F.split("text", " "), 20).alias("joined"))


@query("p07_parse_affiliations", """
SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN json_extract_string(props, '$.k') END AS k,
  CASE WHEN event_id % 4 <> 0 THEN 1 ELSE 0 END AS entries FROM events""")
def _(t):
    broken = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("{bad"), F.col("props"))).otherwise(F.col("props"))
    m = t.events.select("event_id", parse_affiliations(broken).alias("m"))
    return m.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.size("m").cast("bigint").alias("entries"))


def nested(t):
    """Articles in the nested input shape, with model output beside every second one."""
    a = t.tagged_flagged
    model = F.struct(
        F.substring("content", 1, 600).alias("summary"), F.array(F.lit("first"), F.lit("second")).alias("key_points"),
        F.lit("for").alias("stance_analysis"), F.get("people", F.lit(0)).alias("political_figure"),
        F.get("parties", F.lit(0)).alias("political_party"))
    words = F.struct(F.array(F.lit("k1"), F.lit("k2")).alias("keywords"), F.array(F.lit("p1")).alias("phrases"),
                     F.array(F.lit("t1")).alias("topics"))
    even = F.col("id") % 2 == 0
    return a.withColumn("llm_summary", F.when(even, model)).withColumn("llm_keywords", F.when(even, words)).withColumn(
        "keywords", F.when(F.col("id") % 3 == 0, F.slice(F.split("title", " "), 1, 25)))


JOINED = "array_to_string({}, ', ')"


@query("p08_flatten_article", tagged(f"""
, k AS (SELECT *, list_slice(string_split(title, ' '), 1, 25) AS words FROM tagged)
SELECT k.id, k.title, CAST(k.date AS VARCHAR) AS date, epoch(k.date)::BIGINT AS date_ts, {JOINED.format('k.parties')} AS parties,
  {JOINED.format('k.people')} AS people, {JOINED.format('k.themes')} AS themes,
  CASE WHEN k.id % 3 = 0 THEN {JOINED.format('list_slice(k.words, 1, 20)')} WHEN k.id % 2 = 0 THEN 'k1, k2' END AS keywords,
  CASE WHEN f.is_speech THEN 'True' WHEN NOT f.is_speech THEN 'False' END AS is_speech,
  CASE WHEN k.id % 2 = 0 THEN nullif(left(left(k.content, 600), 500), '') END AS llm_summary,
  CASE WHEN k.id % 2 = 0 THEN 'first, second' END AS llm_key_points,
  CASE WHEN k.id % 2 = 0 AND k.id % 3 = 0 THEN 'k1, k2' END AS llm_extra_keywords
FROM k LEFT JOIN flags f USING (id)""").replace("WITH base", "WITH flags AS (SELECT doc_id AS id, quality = 1 AS is_speech FROM labels), base", 1))
def _(t):
    return flatten_article(nested(t), chars=500, n_keywords=20, n_model_keywords=15).select("id", "title", "date", "date_ts", "parties", "people", "themes", "keywords",
                                             "is_speech", "llm_summary", "llm_key_points", "llm_extra_keywords")


@query("p09_unflatten_article", tagged("""
SELECT id, title, array_to_string(parties, '|') AS parties, array_to_string(people, '|') AS people,
  array_to_string(themes, '|') AS themes, CASE WHEN id % 2 = 0 THEN 'first|second' END AS key_points,
  CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN 'k1|k2' END AS model_keywords,
  CASE WHEN id % 2 = 0 THEN 'for' END AS stance FROM tagged"""))
def _(t):
    back = unflatten_article(flatten_article(nested(t)))
    return back.select("id", "title", text_of("parties").alias("parties"), text_of("people").alias("people"),
                       text_of("themes").alias("themes"), text_of("llm_summary.key_points").alias("key_points"),
                       text_of("llm_keywords.keywords").alias("model_keywords"),
                       F.col("llm_summary.stance_analysis").alias("stance"))


@query("p10_best_keywords", tagged("""
SELECT id, array_to_string(CASE WHEN len(themes) > 0 THEN themes WHEN len(people) > 0 THEN people ELSE parties END, '|') AS best
FROM tagged"""))
def _(t):
    return t.tagged.select("id", text_of(first_non_empty("themes", "people", "parties")).alias("best"))


@query("p11_article_card", tagged("""
SELECT id, title, id % 5 = 0 AS is_summarized, CASE WHEN id % 5 = 0 THEN content WHEN id % 2 = 0 THEN left(content, 600) ELSE '' END AS summary,
  CASE WHEN id % 5 = 0 THEN '' WHEN id % 2 = 0 THEN 'first|second' ELSE '' END AS key_points,
  CASE WHEN id % 5 = 0 THEN '' WHEN id % 2 = 0 THEN 'k1|k2' WHEN id % 3 = 0
    THEN array_to_string(list_slice(string_split(title, ' '), 1, 25), '|') ELSE '' END AS keywords FROM tagged"""))
def _(t):
    src = nested(t).withColumn("is_summarized", F.col("id") % 5 == 0).withColumn("similarity", F.lit(1.0))
    return article_card(src).select("id", "title", "is_summarized", "summary", text_of("key_points").alias("key_points"),
                                    text_of("keywords").alias("keywords"))


@query("p12_parse_multi_format_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""")
def _(t):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    raw = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd-MM-yyyy"))
           .when(k == 2, F.date_format(d, "yyyy/MM/dd")).when(k == 3, F.date_format(d, "dd/MM/yyyy")).otherwise("2024-02-31"))
    return t.orders.select("o_orderkey", parse_multi_format_date(raw).cast("string").alias("parsed"))


@query("p13_month_key", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def _(t):
    return t.orders.select("o_orderkey", month_key("o_orderdate").alias("month"))


@query("p14_url_domain", r"""
SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') AS domain FROM pages""")
def _(t):
    return t.pages.select("page_id", url_domain("url").alias("domain"))


@query("p15_display_date", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS shown FROM orders")
def _(t):
    return t.orders.select("o_orderkey", format_display_date("o_orderdate").alias("shown"))


@query("p16_locate_excerpt", f"""
WITH x AS (SELECT item_id, {trimmed(collapsed("text"))} AS w, left({trimmed(collapsed("text"))}, 10) AS k FROM benchmark),
d AS (SELECT doc_id, {collapsed("text")} AS body FROM documents),
f AS (SELECT doc_id, item_id, w, body, coalesce(nullif(strpos(body, left(w, 40)), 0), nullif(strpos(body, left(w, 25)), 0),
   nullif(strpos(lower(body), lower(left(w, 40))), 0)) AS s FROM d JOIN x ON contains(lower(body), lower(left(w, 25))))
SELECT doc_id, item_id, CAST(s AS BIGINT) AS "start", CAST(least(length(w), length(body) - s + 1) AS BIGINT) AS "length" FROM f WHERE s IS NOT NULL""")
def _(t):
    return excerpt_hits(t)


def excerpt_hits(t):
    """Documents are matched with excerpts on the excerpts' first characters, then located exactly."""
    from broadsheet.functions.text import collapse_spaces, excerpt_text
    from broadsheet.operators.matching import match_terms

    x = t.benchmark.select("item_id", excerpt_text("text").alias("w")).where(F.length("w") >= 10)
    heads = x.select("item_id", "w", F.lower(F.substring("w", 1, 25)).alias("head"))
    docs = t.documents.select("doc_id", collapse_spaces("text").alias("body"))
    pairs = match_terms(docs, "doc_id", "body", heads, "head", "substring").join(heads, "head").join(docs, "doc_id")
    at = pairs.select("doc_id", "item_id", locate_excerpt("body", "w").alias("p")).where("p is not null")
    return at.select("doc_id", "item_id", F.col("p.start").cast("bigint").alias("start"), F.col("p.length").cast("bigint").alias("length"))


@query("p17_resolve_url", """
WITH h AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '//x.example/' || page_id WHEN 2 THEN '/a/' || page_id
  ELSE 'rel' || page_id END AS href FROM pages)
SELECT page_id, CASE WHEN href LIKE 'https://%' THEN href WHEN href LIKE '//%' THEN 'https:' || href
  WHEN href LIKE '/%' THEN 'https://news.example' || href END AS resolved FROM h""")
def _(t):
    k = F.col("page_id") % 4
    href = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("//x.example/"), F.col("page_id"))).when(
        k == 2, F.concat(F.lit("/a/"), F.col("page_id"))).otherwise(F.concat(F.lit("rel"), F.col("page_id")))
    return t.pages.select("page_id", resolve_url("https://news.example/", href).alias("resolved"))


@query("p18_coerce_metadata", tagged("""
SELECT id, source, array_to_string(parties, ',') AS parties, CASE WHEN id % 2 = 0 THEN title END AS title,
  CASE WHEN id % 2 = 0 THEN 4 ELSE 3 END AS entries, CAST(id AS VARCHAR) AS id_text FROM tagged"""))
def _(t):
    src = t.tagged.withColumn("title", F.when(F.col("id") % 2 == 0, F.col("title")))
    m = export_metadata(src, ["source", "parties", "title", "id"])
    get = lambda k: F.try_element_at("metadata", F.lit(k))
    return m.select("id", get("source").alias("source"), get("parties").alias("parties"), get("title").alias("title"),
                    F.size("metadata").cast("bigint").alias("entries"), get("id").alias("id_text"))


@query("p19_session_title", """
SELECT conv_id, CASE WHEN length(txt) > 50 THEN left(txt, 50) || '...' ELSE txt END AS title FROM
 (SELECT conv_id, arg_min(text, turn) AS txt FROM conversations WHERE role = 'user' GROUP BY conv_id)""")
def _(t):
    first = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("txt"))
    return first.select("conv_id", session_title("txt").alias("title"))


@query("t08_extract_dates", r"""
WITH j AS (SELECT d.doc_id, d.text, o.o_orderdate AS dt FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id),
x AS (SELECT doc_id, text || ' on ' || strftime(dt, '%Y-%m-%d') || ' and ' || strftime(dt + INTERVAL 1 DAY, '%d/%m/%Y') || ' and '
  || strftime(dt + INTERVAL 2 DAY, '%B %-d, %Y') || ' and ' || strftime(dt + INTERVAL 3 DAY, '%-d %B %Y') || ' and 2024-02-31, 2024-13-01.' AS s FROM j),
a AS (SELECT doc_id, unnest(regexp_extract_all(s, '\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b')) AS h, 1 AS k FROM x
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(s, '\b\d{1,2}[-/]\d{1,2}[-/]\d{4}\b')), 2 FROM x
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(s, '(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b')), 3 FROM x
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(s, '(?i)\b\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b')), 4 FROM x),
w AS (SELECT doc_id, k, regexp_extract_all(h, '\d+') AS n, list_position(['january','february','march','april','may','june','july','august','september','october','november','december'], lower(regexp_extract(h, '[A-Za-z]+'))) AS mon FROM a),
p AS (SELECT doc_id, CAST(CASE k WHEN 1 THEN n[1] WHEN 2 THEN n[3] ELSE n[2] END AS INTEGER) AS y,
  CASE WHEN k <= 2 THEN CAST(n[2] AS INTEGER) ELSE mon END AS m, CAST(CASE k WHEN 1 THEN n[3] ELSE n[1] END AS INTEGER) AS d FROM w),
q AS (SELECT DISTINCT doc_id, printf('%04d-%02d-%02d', y, m, d) AS iso FROM p WHERE y BETWEEN 1900 AND 2100 AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31)
SELECT x.doc_id, coalesce(string_agg(iso, '|' ORDER BY iso), '') AS dates FROM x LEFT JOIN q USING (doc_id) GROUP BY x.doc_id""")
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("dt"))
    fmt = lambda n, f: F.date_format(F.date_add("dt", n), f)
    s = F.concat(F.col("text"), F.lit(" on "), fmt(0, "yyyy-MM-dd"), F.lit(" and "), fmt(1, "dd/MM/yyyy"), F.lit(" and "),
                 fmt(2, "MMMM d, yyyy"), F.lit(" and "), fmt(3, "d MMMM yyyy"), F.lit(" and 2024-02-31, 2024-13-01."))
    j = t.documents.join(o, "doc_id")
    return j.select("doc_id", text_of(extract_dates(s)).alias("dates"))
