"""Registry, table access and the shared SQL of the catalogue."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet import dims
from broadsheet.functions.text import WS, WS_CHARS
from broadsheet.schema import articles_from_documents, tagged_articles
from broadsheet.session import materialize, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Dimensions for the test tables, whose prose is invented.
GAZ = dims.gazetteer({
    "P1": {"names": ["thble"], "figures": {"F1": ["thing", "thly"], "F2": ["of the"]}},
    "P2": {"names": ["erin"], "figures": {"F3": ["onan"]}},
    "P3": {"names": ["anea"], "figures": {"F4": ["erble", "thnd"]}, "requires_figure": True},
    "P4": {"names": ["zzzz"], "figures": {"F5": ["qqqq"]}},
})
LEXICON = dims.lexicon({
    "T1": ["ther", "other"], "T2": ["attion", "thtion"], "T3": ["les"], "T4": ["zzzz"],
})
TAXONOMY = dims.taxonomy({
    "T1": ("texts with ther", ["ther", "other"]), "T2": ("texts with attion", ["attion", "thtion"]),
    "T3": ("texts with les", ["les"]), "T4": ("texts with zzzz", ["zzzz"]), "Others": ("everything else", []),
})
SPEECH = ["ernt", "eres", "erly"]
STANCE = ["anon", "onnd", "erwh"]
NEUTRAL = ["thing", "ther"]
ALIASES = dims.gazetteer_aliases(GAZ, [
    (r["variant"].upper(), r["canonical"]) for r in GAZ.dicts() if r["kind"] == "figure"
] + [("the thing", "F1")])
PARTIES = ["P1", "P2", "P3", "P4"]
NOW = "2025-10-01"


#: Tables whose texts are worth a core each, with their keys.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


class Tables:
    """The driver tables of one directory as DataFrames, and the article tables derived from them.

    Tagged articles are stored first and read back, as they are in production: dashboards and searches run
    over stored tags, so their filters and column lists reach the Parquet scan.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def articles(self) -> DataFrame:
        return articles_from_documents(self.documents)

    @cached_property
    def flagged(self) -> DataFrame:
        return articles_from_documents(self.documents, self.labels)

    @cached_property
    def tagged(self) -> DataFrame:
        return materialize(tagged_articles(self.articles, GAZ, LEXICON), "tagged")

    @cached_property
    def tagged_flagged(self) -> DataFrame:
        return materialize(tagged_articles(self.flagged, GAZ, LEXICON), "tagged")

    @cached_property
    def with_vectors(self) -> DataFrame:
        """Tagged articles that have a vector."""
        vectors = self.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")
        return materialize(tagged_articles(self.flagged.join(vectors, "id"), GAZ, LEXICON), "tagged")


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL where it has one."""
    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def text_of(c, sep: str = "|") -> Column:
    """A list column as text, for comparison."""
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)


# --- SQL ----------------------------------------------------------------------------------------------

def quote(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(dim: dims.Dim, columns: list[str] | None = None) -> str:
    names = columns or dim.columns
    rows = ", ".join("(" + ", ".join(quote(r[c]) for c in names) + ")" for r in dim.dicts())
    return f"(SELECT * FROM (VALUES {rows}) AS v({', '.join(names)}))"


def listing(items) -> str:
    return "[" + ", ".join(quote(i) for i in items) + "]"


TRIM = quote(WS_CHARS)


def trimmed(expr: str) -> str:
    return f"trim({expr}, {TRIM})"


def collapsed(expr: str) -> str:
    return f"regexp_replace({expr}, {quote(f'[{WS}]+')}, ' ', 'g')"


def with_(*ctes: tuple[str, str]) -> str:
    return "WITH " + ", ".join(f"{name} AS ({body})" for name, body in ctes) + " "


BASE = ("base", """
SELECT doc_id AS id, left(split_part(text, chr(10), 1), 80) AS title, text AS content,
       CAST(DATE '2024-08-05' + CAST(doc_id % 421 AS INTEGER) AS DATE) AS date, source, lang AS language,
       CASE WHEN doc_id % 50 = 0 THEN '' ELSE 'https://' || source || '.example/' || md5(text) END AS url,
       lang AS category, left(split_part(text, chr(10), 1), 80) || ' ' || text AS both_text
FROM documents""")
FLAGS = ("flags", "SELECT doc_id AS id, quality = 1 AS is_speech, toxic = 1 AS is_stance FROM labels")
GAZ_CTE = ("gaz", f"SELECT * FROM {values(GAZ)}")
ALIAS_CTE = ("aliases", f"SELECT * FROM {values(ALIASES)}")
LEX_CTE = ("lex", f"SELECT * FROM {values(LEXICON)}")
TAX_CTE = ("tax", f"SELECT * FROM {values(TAXONOMY, ['category', 'ordinal', 'description'])}")
EDGE = r"[^\p{L}\p{M}\p{N}_]"


def hits(mode: str = "word") -> tuple[str, str]:
    """Gazetteer rows found in each article; one branch per variant, so every pattern is a constant."""
    branches = []
    for row in GAZ.dicts():
        v = row["variant"]
        test = f"contains(low, {quote(v)})"
        if mode == "word":
            test += f" AND regexp_matches(low, {quote(f'(^|{EDGE}){v}({EDGE}|$)')})"
        shown = ", ".join(f"{quote(row[c])} AS {c}" for c in GAZ.columns)
        branches.append(f"SELECT id, {shown} FROM low_text WHERE {test}")
    return ("hits", "WITH low_text AS (SELECT id, lower(both_text) AS low FROM base) " + " UNION ALL ".join(branches))


FIGURE_HITS = ("fig", """
SELECT h.id, h.party, h.party_ordinal, h.canonical, o.pos FROM
 (SELECT DISTINCT id, party, party_ordinal, canonical FROM hits WHERE kind = 'figure') h
 JOIN (SELECT party, canonical, min(variant_ordinal) AS pos FROM gaz WHERE kind = 'figure' GROUP BY ALL) o
 USING (party, canonical)""")
ENTS = ("ents", """
SELECT p.id, p.party, p.ord, p.party_mentioned, coalesce(f.figures, []) AS figures FROM
 (SELECT id, party, min(party_ordinal) AS ord, bool_or(kind = 'party') AS party_mentioned,
         bool_or(requires_figure) AS req, bool_or(kind = 'figure') AS has_fig FROM hits GROUP BY id, party) p
 LEFT JOIN (SELECT id, party, list(canonical ORDER BY pos) AS figures FROM fig GROUP BY id, party) f
 ON p.id = f.id AND p.party = f.party
WHERE NOT p.req OR p.has_fig""")
THEMES = ("themes", """
SELECT * FROM (SELECT b.id, l.theme, CAST(sum((length(lower(b.both_text)) - length(replace(lower(b.both_text), lower(l.keyword), '')))
       // length(l.keyword)) AS BIGINT) AS score FROM base b, lex l GROUP BY b.id, l.theme) WHERE score > 0""")
TAGGED = ("tagged", """
SELECT b.*, coalesce(e.parties, []) AS parties, coalesce(f.people, []) AS people,
       coalesce(t.themes, []) AS themes, coalesce(t.themes, ['Others']) AS ai_categories,
       coalesce(t.top, 'Others') AS primary_category
FROM base b
LEFT JOIN (SELECT id, list(party ORDER BY ord) AS parties FROM ents GROUP BY id) e ON e.id = b.id
LEFT JOIN (SELECT g.id, list(g.canonical ORDER BY g.party_ordinal, g.pos) AS people FROM fig g
           JOIN ents en ON en.id = g.id AND en.party = g.party GROUP BY g.id) f ON f.id = b.id
LEFT JOIN (SELECT id, list(theme ORDER BY theme) AS themes, first(theme ORDER BY score DESC, theme) AS top
           FROM themes GROUP BY id) t ON t.id = b.id""")
#: person → party of the gazetteer
HOME = ("home", "SELECT canonical, first(party ORDER BY party_ordinal) AS home FROM gaz WHERE kind = 'figure' GROUP BY canonical")
ARTICLES = (BASE, GAZ_CTE, LEX_CTE, hits(), FIGURE_HITS, ENTS, THEMES, TAGGED, HOME)


def base(sql: str) -> str:
    return with_(BASE) + sql


def tagged(sql: str, *more: tuple[str, str]) -> str:
    return with_(*ARTICLES, *more) + sql
