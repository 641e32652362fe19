"""Gazetteer operators: tagging texts with parties and people, and the lookups around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from broadsheet import fixed_values as fixed
from broadsheet.dims import UNROLL_LIMIT, config_rows, dim_frame, dim_rows, grouped, holds
from broadsheet.functions.arrays import literal_array, unnest
from broadsheet.functions.text import WS, escape
from broadsheet.operators.matching import NAME_EDGE, TESTS, any_test, match_by_join, term_tests

ENTITY = "array<struct<party:string,party_mentioned:boolean,figures:array<string>>>"


def combined_text(title: str = "title", content: str = "content") -> Column:
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(content), F.lit("")))


def _figures(rows: list[dict], test) -> Column:
    by_name: dict = {}
    for row in rows:
        if row["kind"] == "figure":
            by_name.setdefault(row["canonical"], []).append(row["variant"])
    hits = [F.when(any_test(test, variants), F.lit(name)) for name, variants in by_name.items()]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def _kept(requires: Column, mentioned: Column, figures: Column) -> Column:
    """J04. A flagged party counts only through one of its figures."""
    return F.when(requires, F.size(figures) > 0).otherwise(mentioned | (F.size(figures) > 0))


def tag_entities(
    articles: DataFrame, gaz, mode: str = "word", key: str = "id", text: Column | None = None,
    out: str = "entities", require_figure: bool = True, unroll_limit: int = UNROLL_LIMIT,
) -> DataFrame:
    """J01 (``mode='word'``) and J02 (``mode='substring'``) with J04: per article the parties found, each
    with whether its name occurs and which figures do, in gazetteer order."""
    if mode not in TESTS:
        raise ValueError(f"unknown matching mode {mode!r}")
    text = combined_text() if text is None else text
    rows = dim_rows(gaz, unroll_limit)
    if rows is None:
        return _tag_by_join(articles, gaz, mode, key, text, out, require_figure)
    work, test = term_tests(
        articles.withColumn("_lower", F.lower(text)), "_lower", [r["variant"] for r in rows], mode)
    found = []
    for party, members in grouped(rows, "party", "party_ordinal"):
        members = sorted(members, key=lambda r: r["variant_ordinal"])
        names = [r["variant"] for r in members if r["kind"] == "party"]
        found.append(
            F.struct(
                F.lit(party).alias("party"),
                F.lit(bool(members[0]["requires_figure"]) and require_figure).alias("requires"),
                any_test(test, names).alias("party_mentioned"),
                _figures(members, test).alias("figures"),
            )
        )
    kept = F.filter(F.array(*found), lambda e: _kept(e["requires"], e["party_mentioned"], e["figures"]))
    slim = F.transform(
        kept,
        lambda e: F.struct(
            e["party"].alias("party"), e["party_mentioned"].alias("party_mentioned"), e["figures"].alias("figures")
        ),
    )
    return work.withColumn(out, slim.cast(ENTITY)).drop("_lower", "_found")


def _gazetteer_hits(articles: DataFrame, gaz, mode: str, key: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """Gazetteer rows found in each article, and the gazetteer with its variants in lower case as _v."""
    terms = dim_frame(articles.sparkSession, gaz).withColumn("_v", F.lower("variant"))
    texts = articles.select(key, text.alias("_text"))
    return match_by_join(texts, key, "_text", terms, "_v", mode).join(terms, "_v"), terms


def _listed_figures(hits: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, party, figures): the figures of each party found in an article, in gazetteer order."""
    figures = (
        hits.where(F.col("kind") == "figure")
        .groupBy(key, "party", "canonical").agg(F.min("variant_ordinal").alias("at"))
    )
    first_at = terms.where("kind = 'figure'").groupBy("party", "canonical").agg(F.min("variant_ordinal").alias("place"))
    return (
        figures.join(first_at, ["party", "canonical"]).groupBy(key, "party")
        .agg(F.sort_array(F.collect_list(F.struct("place", "canonical"))).alias("f"))
        .select(key, "party", F.transform("f", lambda x: x["canonical"]).alias("figures"))
    )


def _tag_by_join(articles, gaz, mode, key, text, out, require_figure) -> DataFrame:
    hits, terms = _gazetteer_hits(articles, gaz, mode, key, text)
    listed = _listed_figures(hits, terms, key)
    parties = hits.groupBy(key, "party").agg(
        F.min("party_ordinal").alias("ordinal"), F.bool_or("requires_figure").alias("requires"),
        F.bool_or(F.col("kind") == "party").alias("party_mentioned"),
    )
    per = parties.join(listed, [key, "party"], "left").withColumn(
        "figures", F.coalesce("figures", F.array().cast("array<string>"))
    )
    per = per.where(_kept(F.col("requires") & F.lit(require_figure), F.col("party_mentioned"), F.col("figures")))
    tags = per.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "party", "party_mentioned", "figures"))).alias("e")
    ).select(key, F.transform("e", lambda e: F.struct(e["party"].alias("party"),
             e["party_mentioned"].alias("party_mentioned"), e["figures"].alias("figures"))).cast(ENTITY).alias(out))
    return articles.join(tags, key, "left").withColumn(out, F.coalesce(out, F.array().cast(ENTITY)))


def tag_entities_word(articles: DataFrame, gaz, **kw) -> DataFrame:
    """J01."""
    return tag_entities(articles, gaz, "word", **kw)


def tag_entities_substring(articles: DataFrame, gaz, **kw) -> DataFrame:
    """J02."""
    return tag_entities(articles, gaz, "substring", **kw)


def entity_rows(tagged: DataFrame, keep=("id",), entities: str = "entities") -> DataFrame:
    """One row per (article, party)."""
    return unnest(tagged, entities, "_e", *keep).select(*keep, "_e.*")


def entity_map(entities="entities") -> Column:
    """Entities as map party → struct(party_mentioned, figures)."""
    return F.map_from_entries(F.transform(F.col(entities), lambda e: F.struct(
        e["party"], F.struct(e["party_mentioned"].alias("party_mentioned"), e["figures"].alias("figures")))))


def party_list(entities="entities") -> Column:
    return F.transform(F.col(entities), lambda e: e["party"])


def figure_list(entities="entities") -> Column:
    return F.array_distinct(F.flatten(F.transform(F.col(entities), lambda e: e["figures"])))


def require_figure_rule(tags: DataFrame, gaz) -> DataFrame:
    """J04 on (article, party, party_mentioned, figures) rows that were tagged without it."""
    flags = dim_frame(tags.sparkSession, gaz).groupBy("party").agg(F.bool_or("requires_figure").alias("_req"))
    return (
        tags.join(flags, "party", "left")
        .where(_kept(F.coalesce("_req", F.lit(False)), F.col("party_mentioned"), F.col("figures")))
        .select(*tags.columns)
    )


def tag_people_partial(articles: DataFrame, gaz, text: Column | None = None, out: str = "people_raw", key: str = "id",
                       unroll_limit: int = UNROLL_LIMIT) -> DataFrame:
    """J03. First variant of each figure found whole, or through a part of more than three characters
    that stands between delimiters. A gazetteer of more than ``unroll_limit`` rows is joined, by the articles'
    unique ``key``."""
    text = combined_text() if text is None else text
    rows = dim_rows(gaz, unroll_limit)
    if rows is None:
        return _people_by_join(articles, gaz, text, out, key)
    edge = NAME_EDGE
    variants: dict = {}
    for row in sorted(rows, key=lambda r: (r["party_ordinal"], r["variant_ordinal"])):
        if row["kind"] == "figure":
            variants.setdefault(row["canonical"], []).append(row["variant"])
    work = articles.withColumn("_lower", F.lower(text))
    low = F.col("_lower")
    picks = []
    for names in variants.values():
        pick = None
        for name in names:
            hit = F.contains(low, F.lit(name.lower()))
            parts = name.lower().split()
            for part in (p for p in parts if len(parts) > 1 and len(p) > 3):
                hit = hit | (F.contains(low, F.lit(part)) & low.rlike(f"(?:^|{edge}){escape(part)}(?:{edge}|$)"))
            pick = F.when(hit, name) if pick is None else pick.when(hit, name)
        picks.append(pick)
    raw = F.array_compact(F.array(*picks)) if picks else F.array()
    return work.withColumn(out, raw.cast("array<string>")).drop("_lower")


def _people_by_join(articles: DataFrame, gaz, text: Column, out: str, key: str) -> DataFrame:
    """Whole variants and parts of variants are looked up apart; each figure's first variant in gazetteer order stays."""
    variants = (
        dim_frame(articles.sparkSession, gaz).where("kind = 'figure'")
        .select("canonical", "variant", F.struct("party_ordinal", "variant_ordinal").alias("place"))
        .withColumn("_t", F.lower("variant"))
    )
    words = F.filter(F.split("_t", f"[{WS}]+"), lambda w: w != "")
    parts = variants.withColumn("_words", words).where(F.size("_words") > 1)
    parts = parts.withColumn("_t", F.explode(F.filter("_words", lambda w: F.length(w) > 3))).drop("_words")
    texts = articles.select(key, text.alias("_text"))
    whole = match_by_join(texts, key, "_text", variants, "_t", "substring").join(variants, "_t")
    partly = match_by_join(texts, key, "_text", parts, "_t", "name_part").join(parts, "_t")
    first = whole.unionByName(partly).groupBy(key, "canonical").agg(F.min(F.struct("place", "variant")).alias("first"))
    places = variants.groupBy("canonical").agg(F.min("place").alias("at"))
    found = first.join(places, "canonical").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "first.variant"))).alias("_f"))
    found = found.select(key, F.transform("_f", lambda f: f["variant"]).alias(out))
    return articles.drop(out).join(found, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def affiliations_of(people: Column, gaz) -> Column:
    """J05. map person → first party that lists the person; people of no party are left out."""
    party_of: dict = {}
    for row in sorted(config_rows(gaz), key=lambda r: r["party_ordinal"]):
        if row["kind"] == "figure":
            party_of.setdefault(row["canonical"], row["party"])
    if not party_of:
        return F.create_map().cast("map<string,string>")
    known = F.create_map(*[F.lit(x) for pair in party_of.items() for x in pair])
    listed = F.array_distinct(F.filter(people, lambda p: F.map_contains_key(known, p)))
    return F.map_from_arrays(listed, F.transform(listed, lambda p: F.try_element_at(known, p)))


def affiliate_people(articles: DataFrame, gaz, people: str = "people", out: str = "people_affiliations") -> DataFrame:
    return articles.withColumn(out, affiliations_of(F.col(people), gaz))


def validate_against(values: Column, allowed, default: str | None = None) -> Column:
    """J10. Only elements of the allowed list; ``[default]`` when none is left."""
    ok = F.filter(values, lambda v: F.array_contains(literal_array(allowed), v)) if allowed else F.array().cast(
        "array<string>")
    if default is None:
        return ok
    return F.when(F.size(ok) > 0, ok).otherwise(F.array(F.lit(default)))


def match_known_entity(names: Column, known: list[str]) -> Column:
    """J11. Each name by exact, case-insensitive, then either-way containment match; sorted, distinct."""
    names_lit = literal_array(known)
    lower_lit = literal_array([k.lower() for k in known])

    def one(n: Column) -> Column:
        low = F.lower(n)
        same = F.array_position(lower_lit, low)
        near = F.filter(names_lit, lambda k: F.contains(F.lower(k), low) | F.contains(low, F.lower(k)))
        return (
            F.when(F.array_contains(names_lit, n), n)
            .when(same > 0, F.get(names_lit, (same - 1).cast("int")))
            .otherwise(F.get(near, F.lit(0)))
        )

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(names, one))))


def missing_associations(actual: DataFrame, gaz) -> DataFrame:
    """J12. (party, figure) pairs that occur in data but not in the gazetteer."""
    expected = (
        dim_frame(actual.sparkSession, gaz).where("kind = 'figure'")
        .select("party", F.col("canonical").alias("figure")).distinct()
    )
    return actual.select("party", "figure").distinct().join(expected, ["party", "figure"], "left_anti")


def attach_summary(profile: DataFrame, summaries: DataFrame, name: str) -> DataFrame:
    """J13. Stored summary columns beside a profile; profiles without one keep NULLs."""
    s = summaries.select(
        F.col("entity_name").alias("_name"), F.col("summary").alias("ai_summary"), F.col("keywords").alias("ai_keywords"),
        F.col("topics").alias("ai_topics"), F.col("last_updated").alias("last_analyzed"),
    )
    return profile.join(s, F.col(name) == F.col("_name"), "left").drop("_name")


def gazetteer_with_counts(gaz, articles: DataFrame) -> DataFrame:
    """J14. Every gazetteer party with its article count, zero included, most covered first."""
    spark = articles.sparkSession
    parties = dim_frame(spark, gaz).groupBy("party").agg(
        F.min("party_ordinal").alias("party_ordinal"),
        F.min_by(F.when(F.col("kind") == "party", F.col("variant")),
                 F.when(F.col("kind") == "party", F.col("variant_ordinal"))).alias("full_name"),
    )
    counts = articles.select(F.explode(F.array_distinct("parties")).alias("party")).groupBy("party").agg(
        F.count("*").alias("total_articles"))
    return (
        parties.join(counts, "party", "left").fillna(0, ["total_articles"])
        .withColumn("full_name", F.coalesce("full_name", "party"))
        .orderBy(F.desc("total_articles"), "party_ordinal")
        .select("party", "full_name", "total_articles")
    )


def gazetteer_members(spark: SparkSession, gaz, party: str, must_exist: bool = False) -> DataFrame:
    """J15. Figures of a party in gazetteer order."""
    if must_exist and not holds(gaz, "party", party):
        raise ValueError(f"unknown party {party!r}")
    return (
        dim_frame(spark, gaz).where((F.col("kind") == "figure") & (F.col("party") == party))
        .groupBy("party", "canonical").agg(F.min("variant_ordinal").alias("position"))
        .orderBy("position").select("party", F.col("canonical").alias("figure"), "position")
    )


def taxonomy_lookup(spark: SparkSession, taxonomy, name: str | None = None) -> DataFrame:
    """J16. The categories with descriptions and keywords, or one of them; an unknown name is an error."""
    if name is not None:
        check_category(taxonomy, name)
    t = dim_frame(spark, taxonomy)
    return (t if name is None else t.where(F.col("category") == name)).orderBy("ordinal")


def check_category(taxonomy, name: str) -> None:
    if not holds(taxonomy, "category", name):
        raise ValueError(f"invalid category {name!r}")


def default_mentions(parties: Column, label: str = fixed.DEFAULT_MENTION) -> Column:
    """T16. The parties, or the default label when there are none."""
    return F.when(F.size(parties) > 0, parties).otherwise(F.array(F.lit(label)))


def assign_party(
    articles: DataFrame, gaz, key: str = "id", text: Column | None = None,
    keyword_weight: int = 2, figure_weight: int = 5, unroll_limit: int = UNROLL_LIMIT,
) -> DataFrame:
    """T15. The best-scoring party: 2 per party name found, 5 per figure alias found; flagged parties
    need a figure; ties go to the party listed first. Adds party_id, party_score, mentioned_figures
    (NULL, NULL, empty when nothing scored). A gazetteer of more than ``unroll_limit`` rows is joined, by the articles'
    unique ``key``."""
    text = combined_text() if text is None else text
    rows = dim_rows(gaz, unroll_limit)
    if rows is None:
        return _assign_by_join(articles, gaz, key, text, keyword_weight, figure_weight)
    work, test = term_tests(
        articles.withColumn("_lower", F.lower(text)), "_lower", [r["variant"] for r in rows], "substring")
    scored = []
    for party, members in grouped(rows, "party", "party_ordinal"):
        members = sorted(members, key=lambda r: r["variant_ordinal"])
        flags = [test(r["variant"]).cast("int") for r in members]
        score, figures = F.lit(0), F.lit(0)
        for row, hit in zip(members, flags):
            score = score + hit * (keyword_weight if row["kind"] == "party" else figure_weight)
            if row["kind"] == "figure":
                figures = figures + hit
        if members[0]["requires_figure"]:
            score = F.when(figures > 0, score).otherwise(0)
        scored.append(
            F.struct(
                (-score).alias("neg"), F.lit(members[0]["party_ordinal"]).alias("ordinal"), F.lit(party).alias("party"),
                _figures(members, test).alias("figures"),
            )
        )
    best = F.array_min(F.filter(F.array(*scored), lambda s: s["neg"] < 0))
    return (
        work.withColumn("_best", best)
        .withColumn("party_id", F.col("_best.party"))
        .withColumn("party_score", -F.col("_best.neg"))
        .withColumn("mentioned_figures", F.coalesce(F.col("_best.figures"), F.array().cast("array<string>")))
        .drop("_best", "_lower", "_found")
    )


def _assign_by_join(articles: DataFrame, gaz, key: str, text: Column, keyword_weight: int, figure_weight: int) -> DataFrame:
    hits, terms = _gazetteer_hits(articles, gaz, "substring", key, text)
    is_figure = F.col("kind") == "figure"
    scores = hits.groupBy(key, "party").agg(
        F.min("party_ordinal").alias("ordinal"), F.bool_or(is_figure).alias("has_figure"),
        F.sum(F.when(is_figure, figure_weight).otherwise(keyword_weight)).cast("int").alias("score"),
    )
    flags = terms.groupBy("party").agg(F.min_by("requires_figure", "variant_ordinal").alias("requires"))
    counted = scores.join(flags, "party").where((~F.coalesce("requires", F.lit(False)) | F.col("has_figure")) & (F.col("score") > 0))
    none = F.array().cast("array<string>")
    listed = counted.join(_listed_figures(hits, terms, key), [key, "party"], "left").withColumn("figures", F.coalesce("figures", none))
    best = listed.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("neg"), "ordinal", "party", "figures")).alias("_best"))
    best = best.select(key, F.col("_best.party").alias("party_id"), (-F.col("_best.neg")).alias("party_score"), F.col("_best.figures").alias("mentioned_figures"))
    work = articles.drop("party_id", "party_score", "mentioned_figures").join(best, key, "left")
    return work.withColumn("mentioned_figures", F.coalesce("mentioned_figures", none))


def party_post_filter(assigned: DataFrame, party: str | None = None, figure: str | None = None) -> DataFrame:
    """T18. Articles whose winning party is ``party`` and that mention ``figure``."""
    out = assigned.where(F.col("party_id").isNotNull())
    if party is not None:
        out = out.where(F.col("party_id") == party)
    if figure is not None:
        out = out.where(F.array_contains("mentioned_figures", figure))
    return out


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """First row of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
