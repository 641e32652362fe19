"""Model-based enrichment as table jobs: prompt columns in, response text out, parsed and validated natively.

The model is a plug-in: ``completer(prompts: pandas.Series) -> pandas.Series``. It runs once per row inside
the tasks, in Arrow batches. A batch that fails is retried row by row, and a row that fails keeps its
error text instead of a response.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.dims import config_rows, grouped
from broadsheet.functions.arrays import split_list
from broadsheet.functions.batches import by_pieces
from broadsheet.functions.text import WS, col, detect_language, strip
from broadsheet.operators.entities import match_known_entity, validate_against
from broadsheet.functions.dates import time_window

Completer = Callable[[pd.Series], pd.Series]

CLASSIFICATION_SCHEMA = (
    "categories array<string>, primary_category string, confidence_scores map<string,double>, reasoning string, "
    "relevant_excerpts map<string,string>, speaking_figures array<string>, speaking_parties array<string>"
)
INTENT_SCHEMA = (
    "type string, entities array<string>, topics array<string>, "
    "time_constraint struct<period:string,days:int,start:string,end:string>, comparison boolean, "
    "trend_analysis boolean, complexity string, confidence double, reasoning string"
)
ANALYSIS_SCHEMA = (
    "summary string, keywords array<string>, topics array<string>, parties array<string>, figures array<string>, "
    "has_election_impact boolean, election_impact_description string, election_impact_parties array<string>"
)
STRINGS = "array<string>"


def complete(df: DataFrame, completer: Completer, prompt: str = "prompt", out: str = "response",
             error: str = "error", batch_size: int = 32) -> DataFrame:
    """Run the model over a prompt column, ``batch_size`` prompts a call. NULL prompts get NULL responses. The
    prompts of a call that fails, or that answers too few or too many, are asked again one by one; other calls
    are not repeated."""

    @F.pandas_udf("response string, error string")
    def ask(prompts: pd.Series) -> pd.DataFrame:
        answers = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
        errors = answers.copy()
        wanted = prompts[prompts.notna()]
        for begin in range(0, len(wanted), batch_size):
            part = wanted.iloc[begin:begin + batch_size]
            try:
                found = list(completer(part))
                if len(found) != len(part):
                    raise ValueError(f"{len(found)} answers to {len(part)} prompts")
                answers.loc[part.index] = found
            except Exception:
                for at, text in part.items():
                    try:
                        (answers.at[at],) = completer(pd.Series([text]))
                    except Exception as failure:
                        errors.at[at] = str(failure) or type(failure).__name__
        return pd.DataFrame({"response": answers, "error": errors})

    # nondeterministic: the optimizer must never evaluate the call twice for one row
    asked = df.withColumn("_c", ask.asNondeterministic()(F.col(prompt)))
    return asked.withColumn(out, F.col("_c.response")).withColumn(error, F.col("_c.error")).drop("_c")


def _named(rows: list[dict], kind: str) -> list[str]:
    ordered = sorted(rows, key=lambda r: (r["party_ordinal"], r["variant_ordinal"]))
    return list(dict.fromkeys(r["canonical"] if kind == "figure" else r["party"] for r in ordered
                              if kind == "party" or r["kind"] == "figure"))


def party_names(gaz) -> list[str]:
    return _named(config_rows(gaz), "party")


def figure_names(gaz) -> list[str]:
    return _named(config_rows(gaz), "figure")


def _article_part(title: str, content: str, head: int | None) -> Column:
    body = F.coalesce(F.col(content), F.lit(""))
    return F.concat(F.lit("Title: "), F.coalesce(F.col(title), F.lit("")), F.lit("\nContent: "),
                    F.substring(body, 1, head) if head else body)


def build_classification_prompts(articles: DataFrame, taxonomy, gaz, head: int | None = None, out: str = "prompt",
                                 language: Column | None = None) -> DataFrame:
    """E01. Prompt per article: the categories with descriptions, the names that may be used, the title and
    the text (only its first ``head`` characters if asked for), in the wording for the article's language."""
    cats = sorted(config_rows(taxonomy), key=lambda r: r["ordinal"])
    menu = "\n".join(f"{i}. {c['category']}: {c['description']}" for i, c in enumerate(cats, 1))
    names = f"Parties: {', '.join(party_names(gaz))}\nFigures: {', '.join(figure_names(gaz))}"
    fields = ", ".join(f.split(" ")[0] for f in CLASSIFICATION_SCHEMA.split(", "))

    def wording(tongue: str, markers: str) -> str:
        return (
            f"Sort this {tongue} news article into one or more of the categories below, but only where it reports "
            f"what a listed person or party said ({markers}). Use 'Others' when nothing fits.\n\n"
            f"Categories:\n{menu}\n\nAllowed names:\n{names}\n\n"
            f"Answer with one JSON object with the fields {fields}. Confidence runs from 0 to 100.\n\n"
        )

    lang = detect_language("content") if language is None else language
    intro = F.when(lang == "Bangla", wording("Bangla", "বলেন, জানান, তার মতে")).otherwise(
        wording("English", "said, stated, according to"))
    return articles.withColumn(out, F.concat(intro, _article_part("title", "content", head)))


def parse_json_response(response, schema: str) -> Column:
    """E02. JSON object in a model response: the text itself, the inside of a code fence, or everything from
    the first brace to the last. NULL when none is a JSON object."""
    c = col(response)
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)\{.*\}", 0)

    def parsed(text: Column) -> Column:
        t = strip(text)
        usable = t.startswith("{") & t.endswith("}") & F.get_json_object(t, "$").isNotNull()
        return F.when(usable, F.from_json(t, schema))

    return F.coalesce(parsed(c), parsed(fenced), parsed(braces))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(STRINGS))


def validate_classification(df: DataFrame, taxonomy, gaz, parsed: str = "parsed", fallback: str = "Others") -> DataFrame:
    """E03. Known categories only (``fallback`` when none), a valid primary, known figures and parties."""
    cats = [r["category"] for r in sorted(config_rows(taxonomy), key=lambda r: r["ordinal"])]
    p = F.col(parsed)
    valid = validate_against(_list(p["categories"]), cats, fallback)
    return (
        df.withColumn("categories", valid)
        .withColumn("primary_category", F.when(p["primary_category"].isin(cats), p["primary_category"]).otherwise(
            F.get("categories", F.lit(0))))
        .withColumn("confidence_scores", F.coalesce(p["confidence_scores"], F.create_map().cast("map<string,double>")))
        .withColumn("reasoning", F.coalesce(p["reasoning"], F.lit("")))
        .withColumn("relevant_excerpts", F.coalesce(p["relevant_excerpts"], F.create_map().cast("map<string,string>")))
        .withColumn("speaking_figures", validate_against(_list(p["speaking_figures"]), figure_names(gaz)))
        .withColumn("speaking_parties", validate_against(_list(p["speaking_parties"]), party_names(gaz)))
    )


def classify_responses(df: DataFrame, taxonomy, gaz, response: str = "response", error: str = "error") -> DataFrame:
    """E02 + E03 with E04's failure rule: no usable response → ``Others``, confidence 0, the error text."""
    parsed = df.withColumn("parsed", parse_json_response(response, CLASSIFICATION_SCHEMA))
    usable = F.col("parsed.categories").isNotNull() & F.col("parsed.primary_category").isNotNull()
    failed = F.when(~F.coalesce(usable, F.lit(False)), F.coalesce(F.col(error), F.lit("invalid JSON response")))
    out = validate_classification(parsed, taxonomy, gaz).withColumn(error, failed)
    bad = F.col(error).isNotNull()
    others = F.array(F.lit("Others"))
    return (
        out.withColumn("categories", F.when(bad, others).otherwise(F.col("categories")))
        .withColumn("primary_category", F.when(bad, "Others").otherwise(F.col("primary_category")))
        .withColumn("confidence_scores", F.when(bad, F.create_map(F.lit("Others"), F.lit(0.0))).otherwise(
            F.col("confidence_scores")))
        .withColumn("reasoning", F.when(bad, F.concat(F.lit("Error: "), F.col(error))).otherwise(F.col("reasoning")))
        .drop("parsed")
    )


def classify_batch(articles: DataFrame, completer: Completer, taxonomy, gaz) -> DataFrame:
    """E04. Classification of articles: id, title, date and the result columns."""
    asked = complete(build_classification_prompts(articles, taxonomy, gaz), completer)
    return classify_responses(asked, taxonomy, gaz).select(
        "id", "title", "date", "categories", "primary_category", "confidence_scores", "reasoning", "relevant_excerpts",
        "speaking_figures", "speaking_parties", "error")


def classification_updates(classified: DataFrame, now=None) -> DataFrame:
    """E04's stored columns, to be merged by R07; failed rows change nothing. E05 is applied."""
    ok = classified.where("error is null")
    keep = lambda c: F.when(F.size(c) > 0, F.col(c))
    return ok.select(
        "id", F.col("categories").alias("ai_categories"), "primary_category",
        F.to_json("confidence_scores").alias("category_confidence"), F.col("reasoning").alias("category_reasoning"),
        (F.current_timestamp() if now is None else F.lit(now)).cast("string").alias("categorized_at"),
        F.when(F.size("relevant_excerpts") > 0, F.col("relevant_excerpts")).alias("category_excerpts"),
        keep("speaking_figures").alias("people"), keep("speaking_parties").alias("parties"),
    )


def speakers_override(df: DataFrame) -> DataFrame:
    """E05. Non-empty speaker lists replace people and parties."""
    return df.withColumn("people", F.when(F.size("speaking_figures") > 0, F.col("speaking_figures")).otherwise(
        F.col("people"))).withColumn("parties", F.when(F.size("speaking_parties") > 0, F.col("speaking_parties")).otherwise(
            F.col("parties")))


# What marks the head of each section in a summary response, tried in this order.
SUMMARY_MARKS = {
    "summary": ["## summary", "**summary**", "1. summary", "1. **summary", "summary:", "**সারসংক্ষেপ**",
                "সারসংক্ষেপ:", "## সারসংক্ষেপ"],
    "key_points": ["## key point", "**key point", "2. key point", "2. **key", "key points:", "**মূল পয়েন্ট**",
                   "মূল পয়েন্ট:", "## মূল পয়েন্ট", "২. মূল পয়েন্ট"],
    "keywords": ["## keyword", "**keyword", "3. keyword", "3. **keyword", "keywords:", "**মূল শব্দ**", "মূল শব্দ:",
                 "## মূল শব্দ", "৩. মূল শব্দ"],
    "topics": ["## topic", "**topic", "4. topic", "4. **topic", "topics covered:", "topics:", "**আলোচিত বিষয়**",
               "আলোচিত বিষয়:", "## আলোচিত বিষয়", "৪. আলোচিত বিষয়"],
    "stance_analysis": ["## stance", "**stance", "5. stance", "5. **stance", "stance analysis:",
                        "**অবস্থান বিশ্লেষণ**", "অবস্থান বিশ্লেষণ:", "## অবস্থান বিশ্লেষণ", "৫. অবস্থান বিশ্লেষণ"],
}
# The same for a keyword response.
KEYWORD_MARKS = {
    "keywords": ["**keywords**", "1. keywords", "1. **keywords", "keywords:"],
    "phrases": ["**key phrase", "**phrase", "2. key phrase", "2. **key", "key phrases:", "phrases:"],
    "topics": ["**main topic", "**topic", "3. main topic", "3. **main", "main topics:", "topics:"],
}
# Characters taken off the start and the ends of a list line.
BULLET_CHARS, EMPHASIS_CHARS = "•-*#123456789. ", "*_"


def sections_of(response: str, marks: dict[str, list[str]]) -> dict[str, list[str]]:
    """Lines of a response by section. A line with a section's mark opens it; what follows the colon on
    that line is kept with a leading NUL, since only prose sections read it."""
    out: dict[str, list[str]] = {}
    current = None
    for line in filter(None, (raw.strip() for raw in response.split("\n"))):
        lowered = line.lower()
        opened = next((name for name, words in marks.items() if any(w in lowered for w in words)), None)
        if opened is None:
            if current is not None:
                out.setdefault(current, []).append(line)
            continue
        current = opened
        rest = line.partition(":")[2].strip()
        if rest:
            out.setdefault(opened, []).append(f"\0{rest}")
    return out


def _plain(line: str) -> str:
    return line.lstrip(BULLET_CHARS).strip(EMPHASIS_CHARS)


def _prose(lines: list[str]) -> str:
    return " ".join(x.lstrip("\0") for x in lines if x.startswith("\0") or not x.startswith("#"))


def _items(lines: list[str], shortest: int, commas: bool) -> list[str]:
    found = []
    for line in (x for x in lines if not x.startswith("\0")):
        text = _plain(line)
        parts = [p.strip() for p in text.split(",")] if commas and "," in text else [text]
        found.extend(p for p in parts if p and not text.startswith(("**", "#")) and len(p) > shortest)
    return found


def read_summary(response: str | None) -> dict:
    parts = sections_of(response or "", SUMMARY_MARKS)
    out = {
        "summary": _prose(parts.get("summary", [])),
        "key_points": _items(parts.get("key_points", []), 5, False),
        "keywords": _items(parts.get("keywords", []), 2, True),
        "topics": _items(parts.get("topics", []), 2, True),
        "stance_analysis": _prose(parts.get("stance_analysis", [])),
    }
    if not out["summary"] and not out["key_points"]:
        out["summary"] = next((p.strip() for p in (response or "").split("\n\n") if p.strip()), "")
    return out


def read_keywords(response: str | None, n: int, n_phrases: int = 5, n_topics: int = 3) -> dict:
    parts = sections_of(response or "", KEYWORD_MARKS)
    items = lambda name: [
        t for x in parts.get(name, []) if not x.startswith(("\0", "#")) and not (x.startswith("**") and x.endswith("**"))
        for t in [_plain(x)] if t]
    out = {"keywords": items("keywords"), "phrases": items("phrases"), "topics": items("topics")}
    if not out["keywords"] and not out["phrases"]:
        lines = (raw.strip().lstrip(BULLET_CHARS) for raw in (response or "").split("\n"))
        out["keywords"] = [w.strip() for x in lines if x and not x.startswith(("**", "#"))
                           for w in x.split(",") if w.strip()]
    return {"keywords": out["keywords"][:n], "phrases": out["phrases"][:n_phrases], "topics": out["topics"][:n_topics]}


def parse_sectioned_summary(response) -> Column:
    """E06. Summary response → struct(summary, key_points, keywords, topics, stance_analysis)."""
    names = ["summary", "key_points", "keywords", "topics", "stance_analysis"]

    kinds = [pa.string(), *[pa.list_(pa.string())] * 3, pa.string()]

    @F.arrow_udf("summary string, key_points array<string>, keywords array<string>, topics array<string>, "
                 "stance_analysis string")
    def parse(responses: pa.Array) -> pa.Array:
        return by_pieces(lambda part: _fields([read_summary(r) for r in part.to_pylist()], names, kinds), responses)

    return parse(col(response))


def _fields(rows: list[dict], names: list[str], kinds: list[pa.DataType]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in zip(names, kinds, strict=True)], names=names)


def parse_keyword_lists(response, n: int = 10, n_phrases: int = 5, n_topics: int = 3) -> Column:
    """E07. Keyword response → struct(keywords ≤ n, phrases ≤ n_phrases, topics ≤ n_topics)."""

    names, kinds = ["keywords", "phrases", "topics"], [pa.list_(pa.string())] * 3

    @F.arrow_udf("keywords array<string>, phrases array<string>, topics array<string>")
    def parse(responses: pa.Array) -> pa.Array:
        return by_pieces(lambda part: _fields([read_keywords(r, n, n_phrases, n_topics) for r in part.to_pylist()], names, kinds), responses)

    return parse(col(response))


def parse_marked_sections(response, max_keywords: int = 10) -> Column:
    """E08. Digest response → struct(keywords ≤ 10, topics, summary)."""
    def section(name: str) -> Column:
        return strip(F.regexp_extract(col(response), rf"(?s)\*\*{name}\*\*\s*\n(.*?)(?=\n\*\*|\z)", 1))

    return F.struct(
        F.slice(split_list(section("TOP_KEYWORDS")), 1, max_keywords).alias("keywords"),
        split_list(section("TOPICS_COVERED")).alias("topics"), section("SUMMARY").alias("summary"),
    )


# Headings of a period response, in both languages, tried in this order.
PERIOD_HEADINGS = {
    "summary": ["SUMMARY:", "সারসংক্ষেপ:", "**সারসংক্ষেপ**", "সারসংক্ষেপঃ"],
    "key_points": ["KEY POINTS:", "মূল পয়েন্ট:", "**মূল পয়েন্ট**", "মূল পয়েন্টঃ"],
    "keywords": ["KEYWORDS:", "মূল শব্দ:", "**মূল শব্দ**", "মূল শব্দঃ"],
    "topics": ["TOPICS:", "আলোচিত বিষয়:", "**আলোচিত বিষয়**", "আলোচিত বিষয়ঃ"],
}


def _tidy(c: Column) -> Column:
    return strip(F.regexp_replace(F.replace(c, F.lit("###"), F.lit("")), f"[{WS}]+", " "))


def parse_period_sections(response) -> Column:
    """E09. Period response in blank-line blocks → struct(summary, key_points, keywords, topics)."""
    blocks = F.transform(F.split(col(response), "\n\n"), lambda b: strip(b))

    def has(b: Column, name: str) -> Column:
        hit = F.lit(False)
        for heading in PERIOD_HEADINGS[name]:
            hit = hit | F.contains(b, F.lit(heading))
        return hit

    order = list(PERIOD_HEADINGS)

    def block(name: str) -> Column:
        """The last block of the section, without its heading; a block belongs to its first match."""
        def mine(b: Column) -> Column:
            ok = has(b, name)
            for earlier in order[: order.index(name)]:
                ok = ok & ~has(b, earlier)
            return ok

        b = F.try_element_at(F.filter(blocks, mine), F.lit(-1))
        out = None
        for heading in PERIOD_HEADINGS[name]:
            hit = F.contains(b, F.lit(heading))
            cut = F.replace(b, F.lit(heading), F.lit(""))
            out = F.when(hit, cut) if out is None else out.when(hit, cut)
        return out

    bullet = F.lit("- •")
    lines = F.transform(F.split(strip(block("key_points")), "\n"), lambda x: strip(x))
    points = F.filter(lines, lambda x: x.startswith("-") | x.startswith("•"))
    comma = lambda name: F.transform(F.filter(F.split(block(name), ","), lambda x: strip(x) != ""), _tidy)
    return F.struct(
        F.coalesce(_tidy(block("summary")), F.lit("")).alias("summary"),
        _list(F.transform(points, lambda x: _tidy(F.btrim(x, bullet)))).alias("key_points"),
        _list(comma("keywords")).alias("keywords"), _list(comma("topics")).alias("topics"),
    )


def validate_article_analysis(
    df: DataFrame, gaz, parsed: str = "parsed", n_keywords: int | None = None, n_topics: int | None = None,
    n_figures: int | None = None, keyword_chars: int | None = None, topic_chars: int | None = None,
) -> DataFrame:
    """E10. Caps on counts and lengths where they are given, known names only, impact fields only when the flag is set. A NULL
    ``parsed`` gives the empty analysis."""
    p = F.col(parsed)
    def cut(c, n, chars=None):
        c = _list(c) if n is None else F.slice(_list(c), 1, n)
        return c if chars is None else F.transform(c, lambda x: F.substring(x, 1, chars))

    parties, figures = party_names(gaz), figure_names(gaz)
    flag = F.coalesce(p["has_election_impact"], F.lit(False))
    return (
        df.withColumn("summary", F.coalesce(p["summary"], F.lit("")))
        .withColumn("keywords", cut(p["keywords"], n_keywords, keyword_chars)).withColumn("topics", cut(p["topics"], n_topics, topic_chars))
        .withColumn("parties", validate_against(_list(p["parties"]), parties))
        .withColumn("figures", cut(validate_against(_list(p["figures"]), figures), n_figures))
        .withColumn("has_election_impact", flag)
        .withColumn("election_impact_description", F.when(
            flag, F.coalesce(p["election_impact_description"], F.lit(""))).otherwise(""))
        .withColumn("election_impact_parties", F.when(
            flag, validate_against(_list(p["election_impact_parties"]), parties)).otherwise(F.array().cast(STRINGS)))
    )


def analyze_articles(articles: DataFrame, completer: Completer, gaz) -> DataFrame:
    """E20's analysis prompt → model → E02 → E10; a failed row gets the empty analysis."""
    asked = complete(build_analysis_prompts(articles, gaz), completer)
    parsed = asked.withColumn("parsed", parse_json_response("response", ANALYSIS_SCHEMA))
    return validate_article_analysis(parsed, gaz).drop("parsed", "prompt", "response")


def _context(*parts: tuple[str, Column]) -> Column:
    """``label: value`` lines for the values that exist."""
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{label}: "), v)) for label, v in parts]
    return F.concat_ws("\n", *lines)


def _by_language(language: Column, bangla: str, english: str) -> Column:
    return F.when(F.lower(language) == "bangla", bangla).otherwise(english)


def build_summary_prompts(articles: DataFrame, out: str = "prompt") -> DataFrame:
    """E20. Prompt for the five-section summary of a speech."""
    ask = (
        "Summarise the political speech or statement below under these headings: **Summary** (2-3 sentences), "
        "**Key Points** (3-5 bullets), **Keywords** (5-8 concepts, no names), **Topics Covered** (3-5), "
        "**Stance Analysis** (2-3 sentences)."
    )
    intro = _by_language(F.col("language"), ask + " Answer in Bangla (বাংলায় উত্তর দিন).", ask)
    context = _context(
        ("Article Title", F.col("title")), ("Political Figure", F.get("people", F.lit(0))),
        ("Political Party", F.get("parties", F.lit(0))),
        ("Key Issues", F.when(F.size("themes") > 0, F.array_join("themes", ", "))),
    )
    return articles.withColumn(out, F.concat(intro, F.lit("\n\n"), context, F.lit("\n\nArticle Content:\n"),
                                             F.coalesce("content", F.lit(""))))


def build_keyword_prompts(articles: DataFrame, n: int = 10, out: str = "prompt") -> DataFrame:
    """E20. Prompt for keywords, phrases and topics."""
    ask = (
        f"List what the political article below is about, one item per line, without explanations: **Keywords** ({n} "
        "single words), **Key Phrases** (5 phrases of 2-3 words), **Main Topics** (3)."
    )
    intro = _by_language(F.col("language"), ask + " Answer in Bangla (বাংলায় উত্তর দিন).", ask)
    who = F.concat_ws(" - ", F.get("parties", F.lit(0)), F.get("people", F.lit(0)))
    both = (F.size("parties") > 0) & (F.size("people") > 0)
    context = _context(("Article Title", F.col("title")), ("Political Context", F.when(both, who)))
    return articles.withColumn(out, F.concat(intro, F.lit("\n\n"), context, F.lit("\n\nArticle Content:\n"),
                                             F.coalesce("content", F.lit(""))))


def build_analysis_prompts(articles: DataFrame, gaz, out: str = "prompt") -> DataFrame:
    """E20. Prompt for the structured analysis, with the names that may be used."""
    rows = config_rows(gaz)
    listing = "\n".join(
        f"- {party}: " + ", ".join(dict.fromkeys(r["canonical"] for r in members if r["kind"] == "figure"))
        for party, members in grouped(rows, "party", "party_ordinal"))
    fields = ", ".join(f.split(" ")[0] for f in ANALYSIS_SCHEMA.split(", "))
    intro = (
        "Analyse the article below. Use only these parties and figures:\n" + listing
        + f"\n\nAnswer with one JSON object with the fields {fields}: a short summary, 2-3 keywords, 2 topics, the listed "
        "names that occur, and whether and how it bears on the coming election.\n\n"
    )
    return articles.withColumn(out, F.concat(F.lit(intro), _article_part("title", "content", None)))


def enrich_articles(articles: DataFrame, completer: Completer, want_summary: bool = True, want_keywords: bool = True,
                    n_keywords: int = 10, speeches_only: bool = True) -> DataFrame:
    """E11. Summaries (of speeches) and keywords (of all) beside each article, with both lengths and the
    stance read off the keywords. A failed call leaves its field NULL and keeps the row."""
    from broadsheet.operators.themes import stance_from_keywords

    work = articles.withColumn("original_length", F.length("content"))
    if want_summary:
        work = build_summary_prompts(work, "_p")
        if speeches_only:
            work = work.withColumn("_p", F.when(F.coalesce("is_speech", F.lit(False)), F.col("_p")))
        work = complete(work, completer, "_p", "_r", "summary_error")
        work = work.withColumn("llm_summary", F.when(F.col("_r").isNotNull(), parse_sectioned_summary("_r"))).drop("_p", "_r")
        work = work.withColumn("summary_length", F.length("llm_summary.summary"))
    if want_keywords:
        work = complete(build_keyword_prompts(work, n_keywords, "_p"), completer, "_p", "_r", "keyword_error")
        work = work.withColumn("llm_keywords", F.when(F.col("_r").isNotNull(), parse_keyword_lists("_r", n_keywords))).drop(
            "_p", "_r")
        work = work.withColumn("stance", stance_from_keywords(_list(F.col("llm_keywords.keywords"))))
    return work


def intents_from_responses(df: DataFrame, known: list[str], now, text: str = "query", response: str = "response",
                           error: str = "error") -> DataFrame:
    """E18's second half: response text → intent columns, entities matched to known names (J11), the time
    constraint resolved (V17). Blank questions give an empty intent, failures a general one."""
    p = F.col("_p")
    blank = strip(F.coalesce(F.col(text), F.lit(""))) == ""
    parsed = df.withColumn("_p", parse_json_response(response, INTENT_SCHEMA))
    ok = p.isNotNull() & ~blank
    t = p["time_constraint"]
    window = time_window(F.coalesce(t["period"], F.lit("recent")), F.coalesce(t["days"], F.lit(7)),
                         now if isinstance(now, Column) else F.lit(now), F.try_to_date(t["start"]), F.try_to_date(t["end"]))
    constraint = F.struct(
        F.coalesce(t["period"], F.lit("recent")).alias("period"), F.coalesce(t["days"], F.lit(7)).alias("days"),
        window["start"].alias("start"), window["end"].alias("end"))
    pick = lambda field, default: F.when(ok, F.coalesce(p[field], F.lit(default))).otherwise(default)
    return (
        parsed.withColumn("type", pick("type", "general"))
        .withColumn("entities", F.when(ok, match_known_entity(_list(p["entities"]), known)).otherwise(F.array().cast(STRINGS)))
        .withColumn("topics", F.when(ok, _list(p["topics"])).otherwise(F.array().cast(STRINGS)))
        .withColumn("time_constraint", F.when(ok & t.isNotNull(), constraint))
        .withColumn("comparison", pick("comparison", False)).withColumn("trend_analysis", pick("trend_analysis", False))
        .withColumn("complexity", F.when(blank, "simple").otherwise(pick("complexity", "medium")))
        .withColumn("confidence", F.when(blank, 0.0).when(~ok, 0.3).otherwise(F.coalesce(p["confidence"], F.lit(0.8))))
        .withColumn("classification_method", F.when(blank, "empty").when(ok, "llm").otherwise("error_fallback"))
        .drop("_p")
    )


def build_intent_prompts(queries: DataFrame, known: list[str], topics: list[str], text: str = "query",
                         out: str = "prompt") -> DataFrame:
    fields = ", ".join(["type", "entities", "topics", "time_constraint", "comparison", "trend_analysis", "complexity",
                        "confidence", "reasoning"])
    intro = (
        "Read the intent of a question about political news.\nKnown entities: " + ", ".join(known)
        + "\nKnown topics: " + ", ".join(topics) + "\nTypes: entity_focus, topic_focus, comparison, time_range, "
        f"trend_analysis, general.\nAnswer with one JSON object with the fields {fields}; time_constraint is null or has "
        "period, days, start, end.\n\nQuestion: "
    )
    body = F.concat(F.lit(intro), F.col(text))
    return queries.withColumn(out, F.when(strip(F.coalesce(F.col(text), F.lit(""))) != "", body))


def classify_queries(queries: DataFrame, completer: Completer, known: list[str], topics: list[str], now,
                     text: str = "query") -> DataFrame:
    """E18. Intent of many questions in one job."""
    asked = complete(build_intent_prompts(queries, known, topics, text), completer)
    return intents_from_responses(asked, known, now, text).drop("prompt", "response")


def answer_prompt(context: str = "context", text: str = "query") -> Column:
    """E19's prompt: the instruction for the question's type and language, the context, the question."""
    task = (
        F.when(F.col("type") == "comparison", "Compare the entities: what they share and where they differ.")
        .when(F.col("trend_analysis"), "Show how the matter changed over time.")
        .when(F.col("type") == "entity_focus", "Concentrate on what this entity did, said and stands for.")
        .otherwise("Give a complete answer from the articles.")
    )
    ascii_only = ~F.col(text).rlike(r"[^\x00-\x7F]")
    language = F.when(F.coalesce(F.col("language"), F.lit("")) != "", F.concat(
        F.lit("Answer in "), F.col("language"), F.lit("."))).when(ascii_only, "Answer in English.").otherwise(
        "Answer in Bangla (বাংলায় উত্তর দিন).")
    return F.concat(F.lit("Question: "), F.col(text), F.lit("\n\n"), language, F.lit("\n"), task,
                    F.lit("\n\nRelevant Articles:\n"), F.col(context), F.lit("\n\nAnswer:"))


NO_HITS_CONTEXT = "No specific articles found in database."

