"""Entity, name, theme and keyword operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet import dims
from broadsheet import fixed_values as fixed
from broadsheet.catalog.base import (
    ALIAS_CTE, ALIASES, ARTICLES, BASE, EDGE, ENTS, FIGURE_HITS, GAZ, GAZ_CTE, LEX_CTE, LEXICON, NEUTRAL, SPEECH, STANCE,
    TAXONOMY, THEMES, base, hits, listing, query, quote, tagged, text_of, trimmed, values, with_,
)
from broadsheet.catalog.rows import score_sql
from broadsheet.catalog.scalars import cleaned
from broadsheet.functions.arrays import unnest
from broadsheet.functions.text import WS, normalize_name
from broadsheet.operators import entities as ent
from broadsheet.operators import names, themes
from broadsheet.operators.keywords import (
    key_points, keywords_by_frequency, keywords_combined, keywords_simple, keywords_tfidf,
)
from broadsheet.operators.stats import party_figure_cooccurrence
from broadsheet.operators.tagging import analyze_entity, analyze_rule_based, categorize
from broadsheet.functions.text import summary_lead

LOOSE = dims.Dim(GAZ.schema, tuple((r[0], r[1], False, *r[3:]) for r in GAZ.rows))
VERBS = ["thing", "erin", "which"]
TOPIC_LEXICON = dims.lexicon({"alpha": ["ther"], "beta": ["attion", "zzzz"], "gamma": ["les"], "delta": ["the"], "eps": ["of"], "zeta": ["er"]})


def entity_rows(tagged):
    return ent.entity_rows(tagged).select("id", "party", "party_mentioned", text_of("figures").alias("figures"))


ENT_SELECT = "SELECT id, party, party_mentioned, array_to_string(figures, '|') AS figures FROM ents"


@query("j01_tag_entities_word", with_(BASE, GAZ_CTE, hits(), FIGURE_HITS, ENTS) + ENT_SELECT)
def _(t):
    return entity_rows(ent.tag_entities_word(t.articles, GAZ))


@query("j01_party_mentions", with_(BASE, GAZ_CTE, hits(), FIGURE_HITS, ENTS) + "SELECT b.id, coalesce(string_agg(party, '|' ORDER BY ord), '') AS parties FROM base b LEFT JOIN ents e ON e.id = b.id GROUP BY b.id")
def _(t):
    tags = ent.tag_entities_word(t.articles, GAZ)
    return tags.select("id", text_of(ent.party_list()).alias("parties"))


@query("j02_tag_entities_substring", with_(BASE, GAZ_CTE, hits("substring"), FIGURE_HITS, ENTS) + ENT_SELECT)
def _(t):
    return entity_rows(ent.tag_entities_substring(t.articles, GAZ))


SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "es", "or", "en", "at"]


def many_terms(n: int) -> list[str]:
    """Made-up words from two and three syllables, as many as asked for."""
    made = [a + b for a in SYLLABLES for b in SYLLABLES] + [a + b + c for a in SYLLABLES for b in SYLLABLES for c in SYLLABLES]
    return made[:n]


def many_gazetteer(n: int) -> dims.Dim:
    return dims.gazetteer({f"N{i:04d}": {"names": [t]} for i, t in enumerate(many_terms(n))})


def many_sql(n: int, mode: str) -> str:
    terms = ", ".join(f"('N{i:04d}', {quote(t)})" for i, t in enumerate(many_terms(n)))
    test = "list_contains(ws, v)" if mode == "word" else "contains(low, v)"
    return with_(BASE) + f"""
SELECT b.id, coalesce(string_agg(party, '|' ORDER BY party), '') AS parties FROM (SELECT id, low, regexp_split_to_array(low, '{EDGE}+') AS ws FROM (SELECT id, lower(both_text) AS low FROM base)) b
LEFT JOIN (VALUES {terms}) AS t(party, v) ON {test} GROUP BY b.id"""


def _many(name: str, n: int, mode: str):
    @query(name, many_sql(n, mode))
    def _(t):
        return ent.tag_entities(t.articles, many_gazetteer(n), mode).select("id", text_of(ent.party_list()).alias("parties"))


# one row for each way of matching: an automaton per text, and a join on anchors
_many("j01_tag_30_terms", 30, "word")
_many("j01_tag_500_terms", 500, "word")
_many("j02_tag_500_terms", 500, "substring")


def many_lexicon(n: int) -> dims.Dim:
    """The made-up words as keywords, ten a theme."""
    terms = many_terms(n)
    return dims.lexicon({f"T{i // 10:04d}": terms[i:i + 10] for i in range(0, n, 10)})


def many_parties(n: int) -> dims.Dim:
    """The made-up words as party names and figures in turn, five a party; every third party needs a figure."""
    terms = many_terms(n)
    return dims.gazetteer({f"P{i // 5:04d}": {
        "names": terms[i:i + 2], "figures": {f"F{i + j:04d}": [terms[i + j]] for j in range(2, 5)}, "requires_figure": i % 15 == 0} for i in range(0, n, 5)})


@query("t01_theme_500_terms", with_(BASE, ("lex", f"SELECT * FROM {values(many_lexicon(500))}"), THEMES) + "SELECT id, theme, score FROM themes")
def _(t):
    scored = themes.theme_scores(t.articles, many_lexicon(500))
    return scored.select("id", F.explode("theme_scores").alias("theme", "score")).select("id", "theme", F.col("score").cast("bigint").alias("score"))


@query("t10_topics_500_terms", with_(BASE, ("lex", f"SELECT * FROM {values(many_lexicon(500))}")) + """
, f AS (SELECT id, theme, row_number() OVER (PARTITION BY id ORDER BY theme_ordinal) AS rn FROM (SELECT DISTINCT b.id, l.theme, l.theme_ordinal FROM base b JOIN lex l ON contains(lower(b.content), l.keyword)))
SELECT b.id, coalesce(string_agg(theme, '|' ORDER BY rn), '') AS topics FROM base b LEFT JOIN f ON f.id = b.id AND rn <= 5 GROUP BY b.id""")
def _(t):
    return themes.topics(t.articles, many_lexicon(500)).select("id", text_of("topics").alias("topics"))


@query("t15_assign_500_terms", with_(BASE, ("gaz", f"SELECT * FROM {values(many_parties(500))}")) + """
, h AS (SELECT b.id, g.* FROM (SELECT id, lower(both_text) AS low FROM base) b JOIN gaz g ON contains(b.low, g.variant)),
s AS (SELECT id, party, party_ordinal, sum(CASE kind WHEN 'party' THEN 2 ELSE 5 END) AS score, string_agg(CASE kind WHEN 'figure' THEN canonical END, '|' ORDER BY variant_ordinal) AS figures,
      bool_or(kind = 'figure') AS any_figure, bool_or(requires_figure) AS req FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, party_ordinal) AS rn FROM s WHERE any_figure OR NOT req)
SELECT b.id, party AS party_id, CAST(score AS BIGINT) AS party_score, coalesce(figures, '') AS figures FROM base b LEFT JOIN r ON r.id = b.id AND rn = 1""")
def _(t):
    return ent.assign_party(t.articles, many_parties(500)).select(
        "id", "party_id", F.col("party_score").cast("bigint").alias("party_score"), text_of("mentioned_figures").alias("figures"))


def partial_sql(shown: str = "variant") -> str:
    """J03: first variant per figure, whole or through a part between delimiters; or the figure itself."""
    edge = "[" + WS + r",।.\-()]"
    branches = []
    figures = dict.fromkeys(r["canonical"] for r in GAZ.dicts() if r["kind"] == "figure")
    for place, name in enumerate(figures):
        whens = []
        for r in (r for r in GAZ.dicts() if r["canonical"] == name and r["kind"] == "figure"):
            v = r["variant"]
            tests = [f"contains(low, {quote(v)})"]
            parts = v.split()
            tests += [f"regexp_matches(low, {quote(f'(?:^|{edge}){p}(?:{edge}|$)')})" for p in parts if len(parts) > 1 and len(p) > 3]
            whens.append(f"WHEN {' OR '.join(tests)} THEN {quote(r[shown])}")
        branches.append(f"SELECT id, {place} AS place, CASE {' '.join(whens)} END AS v FROM low_text")
    return (", low_text AS (SELECT id, lower(both_text) AS low FROM base), found AS (" + " UNION ALL ".join(branches)
            + ") SELECT b.id, coalesce(string_agg(v, '|' ORDER BY place), '') AS people FROM base b LEFT JOIN found f ON f.id = b.id AND v IS NOT NULL GROUP BY b.id")


@query("j03_tag_people_partial", base(partial_sql()))
def _(t):
    return ent.tag_people_partial(t.articles, GAZ).select("id", text_of("people_raw").alias("people"))


@query("j04_require_figure_rule", with_(BASE, GAZ_CTE, hits(), FIGURE_HITS, ENTS) + ENT_SELECT)
def _(t):
    loose = ent.entity_rows(ent.tag_entities_word(t.articles, LOOSE))
    kept = ent.require_figure_rule(loose, GAZ)
    return kept.select("id", "party", "party_mentioned", text_of("figures").alias("figures"))


@query("j05_affiliate_people", tagged("""
, u AS (SELECT id, unnest(people) AS person FROM tagged)
SELECT u.id, u.person, home AS party FROM u JOIN home ON home.canonical = u.person"""))
def _(t):
    return t.tagged.select("id", F.explode("people_affiliations").alias("person", "party"))


def spoken(t):
    """Every word of every title as a name, some in other spellings."""
    w = F.explode(F.split("title", " ")).alias("w")
    return t.articles.select("id", w).where("w <> ''").select(
        "id", F.when((F.col("id") % 3 == 0) & F.col("w").rlike("^[A-Za-z]+$"), F.upper("w")).otherwise(F.lower("w")).alias("name"))


SPOKEN = ("spoken", "SELECT id, CASE WHEN id % 3 = 0 AND regexp_matches(w, '^[A-Za-z]+$') THEN upper(w) ELSE lower(w) END AS name FROM (SELECT id, unnest(string_split(title, ' ')) AS w FROM base) WHERE w <> ''")


@query("j06_canonicalize_exact", with_(BASE, ALIAS_CTE, SPOKEN) + """
SELECT canonical, count(*) AS mentions FROM (SELECT coalesce(a.c, s.name) AS canonical FROM spoken s
 LEFT JOIN (SELECT variant, arg_min(canonical, ordinal) AS c FROM aliases GROUP BY variant) a ON a.variant = s.name) GROUP BY canonical""")
def _(t):
    return names.canonicalize_exact(spoken(t), "name", ALIASES).groupBy("canonical").agg(F.count("*").alias("mentions"))


PAIRS = ("spoken2", "SELECT id, n, w || ' ' || lead(w) OVER (PARTITION BY id ORDER BY n) AS name FROM (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS n FROM (SELECT id, list_filter(string_split(lower(title), ' '), lambda x: x <> '') AS ws FROM base))")
FUZZY = ("fuzzy", f"""
SELECT name, CASE WHEN norm = '' THEN '' ELSE coalesce(
  (SELECT arg_min(canonical, ordinal) FROM aliases a WHERE a.variant = norm),
  CASE WHEN norm IN (SELECT canonical FROM aliases) THEN norm END,
  (SELECT arg_min(canonical, ordinal) FROM aliases a WHERE lower(norm) IN (lower(variant), lower(canonical)) OR (
     (contains(lower(variant), lower(norm)) OR contains(lower(norm), lower(variant)) OR contains(lower(canonical), lower(norm)) OR contains(lower(norm), lower(canonical)))
     AND greatest(len(list_intersect(string_split(lower(norm), ' '), string_split(lower(variant), ' ')))::DOUBLE / greatest(len(string_split(lower(norm), ' ')), len(string_split(lower(variant), ' '))),
        len(list_intersect(string_split(lower(norm), ' '), string_split(lower(canonical), ' ')))::DOUBLE / greatest(len(string_split(lower(norm), ' ')), len(string_split(lower(canonical), ' ')))) > 0.6)),
  norm) END AS canonical FROM (SELECT DISTINCT name, {trimmed("regexp_replace(name, '[" + WS + "]+', ' ', 'g')")} AS norm FROM all_names)""")


def phrases(t):
    """Neighbouring word pairs and single words of titles."""
    ws = F.filter(F.split(F.lower("title"), " "), lambda x: x != "")
    a = t.articles.select("id", ws.alias("ws"))
    two = a.where(F.size("ws") > 1).select("id", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("ws") - 1), lambda i: F.array_join(F.slice("ws", i, 2), " "))).alias("name"))
    return two.unionByName(spoken(t))


ALL_NAMES = ("all_names", "SELECT id, name FROM spoken2 WHERE name IS NOT NULL UNION ALL SELECT id, name FROM spoken")


@query("j07_canonicalize_fuzzy", with_(BASE, ALIAS_CTE, SPOKEN, PAIRS, ALL_NAMES, FUZZY) + """
SELECT canonical, count(*) AS mentions FROM all_names JOIN fuzzy USING (name) GROUP BY canonical""")
def _(t):
    return names.canonicalize_fuzzy(phrases(t), "name", ALIASES).groupBy("canonical").agg(F.count("*").alias("mentions"))


@query("j08_same_person", with_(BASE, ALIAS_CTE, ("all_names", "SELECT id, split_part(title, ' ', 1) AS name FROM base UNION ALL SELECT id, upper(split_part(content, ' ', 2)) FROM base"), FUZZY) + """
SELECT b.id, lower(x.canonical) = lower(y.canonical) AS same_person FROM base b JOIN fuzzy x ON x.name = split_part(b.title, ' ', 1)
JOIN fuzzy y ON y.name = upper(split_part(b.content, ' ', 2))""")
def _(t):
    a = t.articles.select("id", F.split_part("title", F.lit(" "), F.lit(1)).alias("a"),
                          F.upper(F.split_part("content", F.lit(" "), F.lit(2))).alias("b"))
    return names.same_person(a, "a", "b", ALIASES).select("id", "same_person")


@query("j09_normalize_name", f"""SELECT doc_id, {trimmed("regexp_replace(text, '[" + WS + "]+', ' ', 'g')")} AS name FROM documents""")
def _(t):
    return t.documents.select("doc_id", normalize_name("text").alias("name"))


ALLOWED = ["the", "of", "and", "thing", "erin"]


@query("j10_validate_against", f"""
SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda x: list_contains({listing(ALLOWED)}, x)), '|') AS kept,
 array_to_string(CASE WHEN len(list_filter(string_split(text, ' '), lambda x: list_contains(['thing'], x))) > 0
   THEN list_filter(string_split(text, ' '), lambda x: list_contains(['thing'], x)) ELSE ['Others'] END, '|') AS with_default FROM documents""")
def _(t):
    w = F.split("text", " ")
    return t.documents.select("doc_id", text_of(ent.validate_against(w, ALLOWED)).alias("kept"),
                              text_of(ent.validate_against(w, ["thing"], "Others")).alias("with_default"))


KNOWN = ["F1", "the thing", "Erin", "Onan Erble"]


@query("j11_match_known_entity", base(f"""
, w AS (SELECT id, unnest(string_split(title, ' ')) AS w FROM base), k AS (SELECT unnest({listing(KNOWN)}) AS k, generate_subscripts({listing(KNOWN)}, 1) AS n),
m AS (SELECT w.id, coalesce((SELECT first(k) FROM k WHERE k.k = w.w), (SELECT arg_min(k, n) FROM k WHERE lower(k.k) = lower(w.w)),
  (SELECT arg_min(k, n) FROM k WHERE contains(lower(k.k), lower(w.w)) OR contains(lower(w.w), lower(k.k)))) AS e FROM w)
SELECT b.id, coalesce(string_agg(DISTINCT e, '|' ORDER BY e), '') AS known FROM base b LEFT JOIN m ON m.id = b.id GROUP BY b.id"""))
def _(t):
    return t.articles.select("id", text_of(ent.match_known_entity(F.split("title", " "), KNOWN)).alias("known"))


@query("j12_missing_associations", tagged("""
, p AS (SELECT DISTINCT party, unnest(people) AS figure FROM (SELECT unnest(parties) AS party, people FROM tagged))
SELECT party, figure FROM p WHERE (party, figure) NOT IN (SELECT (party, canonical) FROM gaz WHERE kind = 'figure')"""))
def _(t):
    pairs = party_figure_cooccurrence(t.tagged).select("party", F.explode("figures").alias("figure"))
    return ent.missing_associations(pairs, GAZ)


@query("j13_attach_summary", tagged("""
, u AS (SELECT unnest(people) AS figure FROM tagged), c AS (SELECT figure, count(*) AS mentions FROM u GROUP BY figure),
s AS (SELECT unnest(themes) AS entity_name, count(*) FROM tagged GROUP BY 1 UNION ALL SELECT 'F1', 0)
SELECT c.figure, mentions, CASE WHEN c.figure IN (SELECT entity_name FROM s) THEN 'about ' || c.figure END AS ai_summary FROM c"""))
def _(t):
    counts = unnest(t.tagged, "people", "figure").groupBy("figure").agg(F.count("*").alias("mentions"))
    stored = unnest(t.tagged, "people", "entity_name").where("entity_name = 'F1'").distinct().select(
        "entity_name", F.concat(F.lit("about "), F.col("entity_name")).alias("summary"), F.array().alias("keywords"),
        F.array().alias("topics"), F.lit(None).alias("last_updated"))
    return ent.attach_summary(counts, stored, "figure").select("figure", "mentions", "ai_summary")


@query("j14_gazetteer_with_counts", tagged("""
, u AS (SELECT unnest(parties) AS party FROM tagged)
SELECT g.party, g.full_name, count(u.party) AS total_articles FROM
 (SELECT party, arg_min(variant, variant_ordinal) AS full_name FROM gaz WHERE kind = 'party' GROUP BY party) g LEFT JOIN u USING (party) GROUP BY ALL"""))
def _(t):
    return ent.gazetteer_with_counts(GAZ, t.tagged)


@query("j15_gazetteer_members", tagged("""
, u AS (SELECT unnest(people) AS figure FROM tagged)
SELECT g.canonical AS figure, count(u.figure) AS articles FROM (SELECT DISTINCT canonical FROM gaz WHERE party = 'P1' AND kind = 'figure') g
LEFT JOIN u ON u.figure = g.canonical GROUP BY 1"""))
def _(t):
    members = ent.gazetteer_members(t.spark, GAZ, "P1", must_exist=True)
    counts = unnest(t.tagged, "people", "figure").groupBy("figure").agg(F.count("*").alias("articles"))
    return members.join(counts, "figure", "left").fillna(0, ["articles"]).select("figure", "articles")


@query("j16_taxonomy_lookup", tagged("""
, t2 AS (SELECT * FROM """ + values(TAXONOMY, ["category", "description"]) + """)
SELECT t2.category, t2.description, count(u.c) AS articles FROM t2 LEFT JOIN (SELECT unnest(ai_categories) AS c FROM tagged) u ON u.c = t2.category GROUP BY ALL"""))
def _(t):
    counts = unnest(t.tagged, "ai_categories", "category").groupBy("category").agg(F.count("*").alias("articles"))
    return ent.taxonomy_lookup(t.spark, TAXONOMY).join(counts, "category", "left").fillna(0, ["articles"]).select(
        "category", "description", "articles")


# --- themes and flags ---------------------------------------------------------------------------------

@query("t01_theme_scores", with_(BASE, LEX_CTE, THEMES) + "SELECT id, theme, score FROM themes")
def _(t):
    scored = themes.theme_scores(t.articles, LEXICON)
    return scored.select("id", F.explode_outer("theme_scores").alias("theme", "score")).where("theme is not null").select("id", "theme", F.col("score").cast("bigint").alias("score"))


def hit_count(words, expr="lower(both_text)"):
    return " + ".join(f"CAST(contains({expr}, {quote(w)}) AS INTEGER)" for w in words)


@query("t02_speech_flag", base(f"SELECT id, {hit_count(SPEECH)} >= 2 AS is_speech FROM base"))
def _(t):
    return themes.is_keyword_article(t.articles, SPEECH, "is_speech").select("id", "is_speech")


@query("t03_stance_flag", base(f"SELECT id, {hit_count(STANCE)} >= 2 AS is_stance FROM base"))
def _(t):
    return themes.is_keyword_article(t.articles, STANCE, "is_stance").select("id", "is_stance")


FREQ = ("freq", f"""
SELECT id, w, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, w) AS rn FROM (
 SELECT id, w, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower({cleaned('both_text')}), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM base)
 WHERE length(w) >= 4 AND w NOT IN ({', '.join(quote(s) for s in fixed.STOPWORDS)}) GROUP BY id, w)""")


@query("t04_keywords_by_frequency", with_(BASE, FREQ) + """
SELECT b.id, coalesce(string_agg(w, '|' ORDER BY rn), '') AS keywords FROM base b LEFT JOIN freq f ON f.id = b.id AND rn <= 15 GROUP BY b.id""")
def _(t):
    return keywords_by_frequency(t.articles).select("id", text_of("keywords").alias("keywords"))


TERMS = ("terms", f"""
SELECT id, u.w AS w FROM (SELECT id, list_filter(regexp_extract_all(lower({cleaned('both_text')}), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
   lambda w: NOT list_contains({listing(fixed.STOPWORDS)}, w)) AS ws FROM base),
 LATERAL (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS w) u""")
TFIDF = ("tfidf", """
SELECT id, w, s, row_number() OVER (PARTITION BY id ORDER BY x DESC, w) AS rn FROM (
 SELECT id, w, x, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 9) AS s FROM (
  SELECT c.id, c.w, round(c.n * (ln((1 + (SELECT count(*) FROM base)) / (1 + v.df)::DOUBLE) + 1), 9) AS x
  FROM (SELECT id, w, n FROM (SELECT id, w, count(*) AS n, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, w) AS k FROM terms GROUP BY id, w) WHERE k <= 100) c
  JOIN (SELECT w, count(DISTINCT id) AS df FROM terms GROUP BY w) v USING (w)))""")


@query("t05_keywords_tfidf", with_(BASE, TERMS, TFIDF) + """
SELECT b.id, coalesce(string_agg(w, '|' ORDER BY rn), '') AS keywords, coalesce(max(s), 0) AS best FROM base b LEFT JOIN tfidf f ON f.id = b.id AND rn <= 15 GROUP BY b.id""")
def _(t):
    k = keywords_tfidf(t.articles)
    return k.select("id", text_of("keywords_tfidf").alias("keywords"),
                    F.coalesce(F.get("keywords_tfidf_scores", F.lit(0)), F.lit(0.0)).alias("best"))


@query("t06_keywords_combined", with_(BASE, FREQ, TERMS, TFIDF) + """
, m AS (SELECT id, w, min(rn) AS rn FROM (SELECT id, w, rn FROM freq WHERE rn <= 15 UNION ALL SELECT id, w, rn FROM tfidf WHERE rn <= 15) GROUP BY id, w),
r AS (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY rn, w) AS rn FROM m), c AS (SELECT id, sum(n) AS n FROM freq GROUP BY id),
f AS (SELECT r.id, w, rn FROM r JOIN c USING (id) WHERE c.n > 10 UNION ALL SELECT freq.id, w, rn FROM freq JOIN c USING (id) WHERE c.n <= 10)
SELECT b.id, coalesce(string_agg(w, '|' ORDER BY rn), '') AS keywords FROM base b LEFT JOIN f ON f.id = b.id AND rn <= 15 GROUP BY b.id""")
def _(t):
    return keywords_combined(t.articles).select("id", text_of("keywords_combined").alias("keywords"))


def simple_cte(source: str = "base") -> tuple[str, str]:
    return ("simple", f"""
SELECT id, w, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, w) AS rn FROM (
 SELECT id, w, count(*) AS n FROM (SELECT id, unnest(regexp_split_to_array(lower(content), {quote(f'[{WS}]+')})) AS w FROM {source})
 WHERE length(w) > 3 AND w NOT IN ({', '.join(quote(s) for s in fixed.SIMPLE_STOPWORDS)}) GROUP BY id, w)""")


@query("t07_keywords_simple", with_(BASE, simple_cte()) + """
SELECT b.id, coalesce(string_agg(w, '|' ORDER BY rn), '') AS keywords FROM base b LEFT JOIN simple f ON f.id = b.id AND rn <= 10 GROUP BY b.id""")
def _(t):
    return keywords_simple(t.articles).select("id", text_of("keywords_simple").alias("keywords"))


POINTS = ("points", f"""
SELECT id, list_slice(list_filter(list_transform(string_split(content, '.'), lambda s: {trimmed('s')}),
 lambda s: length(s) > 30 AND ({' OR '.join(f"contains(lower(s), {quote(v)})" for v in VERBS)})), 1, 5) AS p FROM base""")


@query("t09_key_points", with_(BASE, POINTS) + "SELECT id, array_to_string(list_transform(p, lambda s: s || '.'), '|') AS points FROM points")
def _(t):
    return key_points(t.articles, verbs=VERBS).select("id", text_of("key_points").alias("points"))


def topics_sql(expr: str = "lower(content)") -> str:
    rows = {}
    for r in TOPIC_LEXICON.dicts():
        rows.setdefault(r["theme"], []).append(r["keyword"])
    cases = ", ".join(
        "CASE WHEN " + " OR ".join(f"contains({expr}, {quote(k)})" for k in ks) + f" THEN {quote(n)} END" for n, ks in rows.items())
    return f"list_slice(list_filter([{cases}], lambda x: x IS NOT NULL), 1, 5)"


@query("t10_topics", base(f"SELECT id, array_to_string({topics_sql()}, '|') AS topics FROM base"))
def _(t):
    return themes.topics(t.articles, TOPIC_LEXICON).select("id", text_of("topics").alias("topics"))


STANCE_SQL = f"""CASE WHEN {hit_count(SPEECH, 'lower(content)')} > {hit_count(STANCE, 'lower(content)')} AND {hit_count(SPEECH, 'lower(content)')} > {hit_count(NEUTRAL, 'lower(content)')} THEN 'Supportive'
 WHEN {hit_count(STANCE, 'lower(content)')} > {hit_count(SPEECH, 'lower(content)')} AND {hit_count(STANCE, 'lower(content)')} > {hit_count(NEUTRAL, 'lower(content)')} THEN 'Critical/Opposing'
 ELSE 'Neutral/Informative' END"""


@query("t11_infer_stance", base(f"SELECT id, {STANCE_SQL} AS stance FROM base"))
def _(t):
    return themes.infer_stance(t.articles, SPEECH, STANCE, NEUTRAL).select("id", "stance")


@query("t12_stance_from_keywords", """
SELECT doc_id, CASE WHEN list_contains(w, 'thing') OR list_contains(w, 'the') THEN 'Supportive' WHEN list_contains(w, 'des') THEN 'Critical' ELSE 'Neutral' END AS stance
FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def _(t):
    return t.documents.select("doc_id", themes.stance_from_keywords(F.split("text", " "), ["thing", "the"], ["des"]).alias("stance"))


@query("t13_summary_lead", "SELECT doc_id, left(text, 300) || '...' AS lead FROM documents")
def _(t):
    return t.documents.select("doc_id", summary_lead("text").alias("lead"))


@query("t14_categorize", with_(*ARTICLES, FREQ) + f"""
, c AS (SELECT id, themes, parties, people, {hit_count(SPEECH)} >= 2 AS sp, {hit_count(STANCE)} >= 2 AS st FROM tagged),
k AS (SELECT id, count(*) AS n FROM freq WHERE rn <= 15 GROUP BY id),
r AS (SELECT *, list_sort(list_distinct(list_concat(parties, themes, CASE WHEN sp THEN ['Speech Analysis'] ELSE [] END, CASE WHEN st THEN ['Political Stance'] ELSE [] END))) AS cats FROM c)
SELECT r.id, array_to_string(cats, '|') AS categories, len(cats) AS total_categories, len(people) AS total_people, len(parties) AS total_parties,
 coalesce(k.n, 0) AS total_keywords, sp AS is_speech, st AS is_stance FROM r LEFT JOIN k USING (id)""")
def _(t):
    c = categorize(t.articles, GAZ, LEXICON, SPEECH, STANCE)
    return c.select("id", text_of("categories").alias("categories"), *[F.col(f"total_{n}").cast("bigint").alias(f"total_{n}") for n in (
        "categories", "people", "parties", "keywords")], "is_speech", "is_stance")


@query("t14_categorize_partial", base(partial_sql("canonical")))
def _(t):
    c = categorize(t.articles, GAZ, LEXICON, SPEECH, STANCE, people="partial", aliases=ALIASES)
    return c.select("id", text_of("people").alias("people"))


@query("t15_assign_party", base(score_sql() + """
SELECT b.id, party_id, CAST(party_score AS BIGINT) AS party_score, coalesce(figures, '') AS figures FROM base b LEFT JOIN best USING (id)"""))
def _(t):
    return ent.assign_party(t.articles, GAZ).select(
        "id", "party_id", F.col("party_score").cast("bigint").alias("party_score"), text_of("mentioned_figures").alias("figures"))


@query("t16_default_mentions", tagged("""
SELECT id, CASE WHEN len(parties) > 0 THEN array_to_string(parties, '|') ELSE 'General Politics' END AS mentions FROM tagged"""))
def _(t):
    return t.tagged.select("id", text_of(ent.default_mentions(F.col("parties"))).alias("mentions"))


@query("t17_analyze_rule_based", with_(BASE, POINTS, simple_cte()) + f"""
, k AS (SELECT id, string_agg(w, '|' ORDER BY rn) AS keywords FROM simple WHERE rn <= 10 GROUP BY id)
SELECT b.id, left(content, 300) || '...' AS summary, len(p) AS n_points, array_to_string({topics_sql()}, '|') AS topics,
 coalesce(keywords, '') AS keywords, {STANCE_SQL} AS stance FROM base b JOIN points USING (id) LEFT JOIN k USING (id)""")
def _(t):
    a = analyze_rule_based(t.articles, TOPIC_LEXICON, VERBS, SPEECH, STANCE, NEUTRAL)
    return a.select("id", "summary", F.size("key_points").cast("bigint").alias("n_points"), text_of("topics").alias("topics"),
                    text_of("keywords").alias("keywords"), "stance")


@query("t17_analyze_party", base(score_sql() + f"""
SELECT b.id, array_to_string({topics_sql()}, '|') AS topics, {STANCE_SQL} AS stance FROM base b JOIN best USING (id) WHERE party_id = 'P1' AND contains(figures, 'F1')"""))
def _(t):
    a = analyze_entity(ent.assign_party(t.articles, GAZ), TOPIC_LEXICON, "P1", "F1", verbs=VERBS, positive=SPEECH, negative=STANCE, neutral=NEUTRAL)
    return a.select("id", text_of("topics").alias("topics"), "stance")


@query("t18_party_post_filter", base(score_sql() + "SELECT id FROM best WHERE party_id = 'P2' AND contains(figures, 'F3')"))
def _(t):
    return ent.party_post_filter(ent.assign_party(t.articles, GAZ), "P2", "F3").select("id")


