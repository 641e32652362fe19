"""Aggregations behind the dashboards. Every count is partial before it is shuffled; lists come only
from dimensions or from values already made distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from broadsheet.dims import config_rows, dim_frame
from broadsheet.functions.arrays import unnest
from broadsheet.functions.dates import as_date, month_key
from broadsheet.operators.entities import check_category
from broadsheet.operators.filters import filter_date_lexical
from broadsheet.operators.names import canonicalize_fuzzy
from broadsheet.operators.ranges import number_rows
from broadsheet.session import materialize


def exploded(df: DataFrame, column: str, *keep: str, name: str = "value") -> DataFrame:
    return unnest(df, column, name, *keep)


def value_counts(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    return exploded(df, column, name=name).groupBy(name).agg(F.count("*").alias("count"))


def top_of(counts: DataFrame, n: int, name: str = "value", count: str = "count") -> DataFrame:
    """O06's order: most frequent first, equal counts by name."""
    return counts.orderBy(F.desc(count), name).limit(n)


def top_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    """O06."""
    is_list = df.schema[column].dataType.typeName() == "array"
    counts = value_counts(df, column) if is_list else df.groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("count"))
    return top_of(counts.where(F.col("value").isNotNull()), n)


def facet(counts: DataFrame, label: str, value: str = "value", count: str = "count") -> DataFrame:
    """One facet of a report in the common shape (facet, value, count)."""
    return counts.select(F.lit(label).alias("facet"), F.col(value).cast("string").alias("value"),
                         F.col(count).cast("double").alias("count"))


def facets(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def number(df: DataFrame, label: str, value: Column) -> DataFrame:
    """A single-number facet."""
    return df.agg(value.cast("double").alias("count")).select(
        F.lit(label).alias("facet"), F.lit(None).cast("string").alias("value"), "count")


def _entry(facet: str, value: Column, w: Column) -> Column:
    return F.struct(F.lit(facet).alias("facet"), value.cast("string").alias("value"), w.cast("double").alias("w"))


def _present(values: Column) -> Column:
    return F.filter(F.coalesce(values.cast("array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())


def facet_report(df: DataFrame, lists: dict[str, tuple[Column, int | None]], sums: dict[str, Column] | None = None,
                 means: dict[str, Column] | None = None) -> DataFrame:
    """(facet, value, count) of several facets in one pass over ``df``: every row becomes its facets' entries, one aggregate
    adds them up, and a window group limit cuts each facet to its most frequent values (O06's order).

    ``lists``: the values each row has for a facet, and how many values stay (None: all). ``sums`` and ``means``: facets of one
    number, 0 for an empty table.
    """
    spark, none, one = df.sparkSession, F.lit(None).cast("string"), F.lit(1)
    sums, means = sums or {}, means or {}
    listed = lambda f, values: F.transform(_present(values), lambda x: _entry(f, x, one))
    entries = [listed(f, values) for f, (values, _) in lists.items()]
    entries += [F.array(_entry(f, none, w)) for f, w in {**sums, **means}.items()]
    # an outer explode: for a plain one the optimizer tests the lists' size below and so makes them twice
    rows = df.select(F.explode_outer(F.concat(*entries)).alias("e")).select("e.*").where("facet is not null")
    if sums or means:
        zero = [_entry(f, none, F.lit(0)) for f in sums] + [_entry(f, none, F.lit(None)) for f in means]
        rows = rows.unionByName(spark.range(1).select(F.explode(F.array(*zero)).alias("e")).select("e.*"))
    total = F.coalesce(F.sum("w"), F.lit(0.0))
    mean = F.coalesce(F.avg("w"), F.lit(0.0))
    counted = rows.groupBy("facet", "value").agg(total.alias("_s"), mean.alias("_m")).select(
        "facet", "value", F.when(F.col("facet").isin(list(means)), F.col("_m")).otherwise(F.col("_s")).alias("count"))
    limits = {f: n for f, (_, n) in lists.items() if n is not None}
    if not limits:
        return counted
    limited = F.col("facet").isin(list(limits))
    apart = F.when(~limited, F.coalesce("value", F.lit("")))  # a value of a facet that is not cut ranks alone
    ranked = counted.withColumn("_rank", F.row_number().over(W.partitionBy("facet", apart).orderBy(F.desc("count"), "value")))
    most = F.coalesce(*[F.when(F.col("facet") == f, n) for f, n in limits.items()], F.lit(1))
    return ranked.where(F.col("_rank") <= max(limits.values())).where(F.col("_rank") <= most).drop("_rank")


def corpus_stats(articles: DataFrame) -> DataFrame:
    """A01. One row: article count and the distinct sources, languages and categories, sorted."""
    names = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    return articles.agg(
        F.count("*").alias("total_articles"), names("source").alias("sources"), names("language").alias("languages"),
        names("category").alias("categories"),
    )


def coverage_stats(articles: DataFrame) -> DataFrame:
    """A02. One row: articles with parties, people and affiliations, their shares, the distinct names."""
    has = lambda c: F.count_if(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0)
    counts = articles.agg(
        F.count("*").alias("total_articles"), has("parties").alias("articles_with_parties"),
        has("people").alias("articles_with_people"),
        F.count_if(F.coalesce(F.size("people_affiliations"), F.lit(0)) > 0).alias("articles_with_affiliations"),
    )
    names = lambda c: exploded(articles, c).agg(F.array_sort(F.collect_set("value")).alias("v"))
    share = lambda c: F.when(F.col("total_articles") > 0, F.round(
        F.col(f"articles_with_{c}") / F.col("total_articles") * 100, 1)).otherwise(0.0).alias(f"pct_with_{c}")
    return counts.withColumn("unique_parties", names("parties").scalar()).withColumn(
        "unique_people", names("people").scalar()
    ).select(
        "*", share("parties"), share("people"), share("affiliations"),
        F.size("unique_parties").alias("n_unique_parties"), F.size("unique_people").alias("n_unique_people"),
    )


def articles_by_source(articles: DataFrame) -> DataFrame:
    """A03."""
    return articles.groupBy("source").agg(F.count("*").alias("articles"))


def top_mentions(articles: DataFrame, n: int = 10, column: str = "parties") -> DataFrame:
    """A04."""
    return top_counts(articles, column, n)


def categorization_summary(categorized: DataFrame) -> DataFrame:
    """A05. (facet, value, count): totals, flags, top lists and mean list sizes of categorised articles, in one scan."""
    flag = lambda c: F.when(F.col(c), 1).otherwise(0)
    return facet_report(
        categorized,
        {"top_categories": (F.col("categories"), 10), "top_parties": (F.col("parties"), 10), "top_people": (F.col("people"), 10),
         "top_keywords": (F.col("keywords"), 20)},
        {"total_articles": F.lit(1), "speech_articles": flag("is_speech"), "stance_articles": flag("is_stance")},
        {"avg_categories_per_article": F.size("categories"), "avg_people_per_article": F.size("people")},
    )


def party_activity(articles: DataFrame) -> DataFrame:
    """A06. Per party: its articles and the distinct figures affiliated with it in them."""
    per = unnest(articles, "parties", "party", "people", "people_affiliations")
    counts = per.groupBy("party").agg(F.count("*").alias("total_articles"))
    return counts.join(affiliated_figures(per), "party", "left").withColumn(
        "figures", F.coalesce("figures", F.array().cast("array<string>")))


def affiliated_figures(per_party: DataFrame) -> DataFrame:
    ours = F.filter("people", lambda p: F.try_element_at(F.col("people_affiliations"), p) == F.col("party"))
    return per_party.select("party", F.explode(ours).alias("figure")).distinct().groupBy("party").agg(
        F.array_sort(F.collect_list("figure")).alias("figures"))


def party_popular_figures(articles: DataFrame, aliases=None, n: int = 5) -> DataFrame:
    """A07. Per party the n people who occur most often in its articles: (party, figure, mentions, rank)."""
    pairs = unnest(unnest(articles, "parties", "party", "people"), "people", "figure", "party")
    counted = pairs.groupBy("party", "figure").agg(F.count("*").alias("mentions"))
    if aliases is not None:
        counted = canonicalize_fuzzy(counted, "figure", aliases, "_c").groupBy(
            "party", F.col("_c").alias("figure")).agg(F.sum("mentions").alias("mentions"))
    w = W.partitionBy("party").orderBy(F.desc("mentions"), "figure")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def party_figure_breakdown(articles: DataFrame) -> DataFrame:
    """A08. Party → its affiliated figures, sorted; parties of articles with people but no affiliated
    figure stay with an empty list."""
    both = articles.where((F.size("parties") > 0) & (F.size("people") > 0))
    per = unnest(both, "parties", "party", "people", "people_affiliations")
    parties = per.select("party").distinct()
    return parties.join(affiliated_figures(per), "party", "left").withColumn(
        "figures", F.coalesce("figures", F.array().cast("array<string>")))


def party_figure_breakdown_inferred(articles: DataFrame, gaz) -> DataFrame:
    """A09. As A08, but a person without an affiliation joins the article's only party, or else the
    gazetteer's party for that person when the article names it, or else nobody."""
    home: dict = {}
    for row in sorted(config_rows(gaz), key=lambda r: r["party_ordinal"]):
        if row["kind"] == "figure":
            home.setdefault(row["canonical"], row["party"])
    own = F.create_map(*[F.lit(x) for kv in home.items() for x in kv]) if home else F.create_map().cast("map<string,string>")
    rows = unnest(articles, "people", "figure", "parties", "people_affiliations")
    listed = F.try_element_at(own, F.col("figure"))
    party = (
        F.when(F.coalesce(F.try_element_at("people_affiliations", "figure"), F.lit("")) != "",
               F.try_element_at("people_affiliations", "figure"))
        .when(F.size("parties") == 1, F.get("parties", F.lit(0)))
        .when(F.array_contains("parties", listed), listed)
    )
    resolved = rows.select(party.alias("party"), "figure").where("party is not null").distinct()
    seen = unnest(rows, "parties", "party").distinct()
    figures = resolved.groupBy("party").agg(F.array_sort(F.collect_list("figure")).alias("figures"))
    return seen.join(figures, "party", "full").withColumn(
        "figures", F.coalesce("figures", F.array().cast("array<string>")))


def party_figure_cooccurrence(articles: DataFrame) -> DataFrame:
    """A10. Every person of an article under every party of it."""
    pairs = unnest(unnest(articles, "parties", "party", "people"), "people", "figure", "party").distinct()
    return pairs.groupBy("party").agg(F.array_sort(F.collect_list("figure")).alias("figures"))


def categorised(articles: DataFrame, start=None, end=None) -> DataFrame:
    df = filter_date_lexical(articles, start, end)
    return df.where((F.size("ai_categories") > 0) & (F.coalesce("primary_category", F.lit("")) != ""))


def category_stats(articles: DataFrame, taxonomy, start=None, end=None) -> DataFrame:
    """A11. (category, measure, key, count): total and as_primary for every category of the taxonomy, zeros
    included, plus party and month counts; corpus totals under category NULL. One scan of the articles."""
    spark, none, text = articles.sparkSession, F.lit(None).cast("string"), "array<string>"
    ranged = filter_date_lexical(articles, start, end)

    def entry(category: Column, measure: str, key: Column = none, w: Column | int = 1) -> Column:
        w = F.lit(w) if isinstance(w, int) else w
        return F.struct(category.cast("string").alias("category"), F.lit(measure).alias("measure"), key.cast("string").alias("key"), w.cast("bigint").alias("w"))

    done = F.coalesce((F.size("ai_categories") > 0) & (F.coalesce("primary_category", F.lit("")) != ""), F.lit(False))
    whole = F.when(done, F.lit(1)).otherwise(0)
    parties, month = _present(F.col("parties")), F.array_compact(F.array(month_key("date")))
    of = lambda c: F.concat(
        F.array(entry(c, "total_articles")), F.transform(parties, lambda p: entry(c, "party", p)), F.transform(month, lambda m: entry(c, "month", m)))
    per_category = F.flatten(F.transform(_present(F.col("ai_categories")), of))
    tagged = F.when(done, F.concat(per_category, F.array(entry(F.col("primary_category"), "as_primary"))))
    corpus = F.array(entry(none, "total_articles"), entry(none, "categorized_articles", none, whole), entry(none, "uncategorized_articles", none, 1 - whole))
    rows = ranged.select(F.explode_outer(F.concat(corpus, F.coalesce(tagged, F.array().cast(
        "array<struct<category:string,measure:string,key:string,w:bigint>>")))).alias("e")).select("e.*").where("measure is not null")
    names = dim_frame(spark, taxonomy).select("category").distinct()
    zeros = names.select(F.explode(F.array(entry(F.col("category"), "total_articles", none, 0), entry(F.col("category"), "as_primary", none, 0))).alias("e")).select("e.*")
    empty = spark.range(1).select(F.explode(F.array(*[entry(none, m, none, 0) for m in ("total_articles", "categorized_articles", "uncategorized_articles")])).alias("e")).select("e.*")
    counts = rows.unionByName(zeros).unionByName(empty).groupBy("category", "measure", "key").agg(F.sum("w").alias("count"))
    known = counts.join(names.select(F.col("category").alias("_known")), F.col("category") == F.col("_known"), "left")
    return known.where(F.col("category").isNull() | F.col("_known").isNotNull()).drop("_known")


def top_categories(articles: DataFrame, n: int = 9, start=None, end=None) -> DataFrame:
    """A11's ranking of categories."""
    return top_counts(categorised(articles, start, end), "ai_categories", n)


def in_category(articles: DataFrame, category: str, start=None, end=None) -> DataFrame:
    return filter_date_lexical(articles.where(F.array_contains("ai_categories", category)), start, end)


def category_party_breakdown(articles: DataFrame, category: str, taxonomy=None, start=None, end=None,
                             n: int = 10) -> DataFrame:
    """A12. (party, count, total): top n parties of a category; total counts party mentions over all."""
    if taxonomy is not None:
        check_category(taxonomy, category)
    counts = value_counts(in_category(articles, category, start, end), "parties", "party")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("t"))
    return top_of(counts, n, "party").withColumn("total", total.scalar())


def category_party_month_pivot(articles: DataFrame, category: str, parties: list[str], start=None,
                               end=None) -> DataFrame:
    """A13. One row per month, one column per listed party. The party list comes from the gazetteer, so
    the pivot needs no extra pass to find its columns."""
    rows = in_category(articles, category, start, end).where("date is not null")
    per = unnest(rows, "parties", "party", month_key("date").alias("month"))
    return per.groupBy("month").pivot("party", parties).agg(F.count(F.lit(1))).fillna(0).orderBy("month")


def category_detail(articles: DataFrame, category: str, taxonomy=None, aliases=None) -> DataFrame:
    """A14. (facet, value, count) report on one category, in one scan. People are canonical names."""
    if taxonomy is not None:
        check_category(taxonomy, category)
    rows = articles.where(F.array_contains("ai_categories", category))
    primary = F.when(F.coalesce(F.col("primary_category") == category, F.lit(False)), 1).otherwise(0)
    people = F.col("people")
    lists = {
        "top_parties": (F.col("parties"), 10), "top_people": (people, 10), "all_people": (people, None),
        "sources": (F.filter(F.array("source"), lambda x: x != ""), None), "monthly_trend": (F.array(month_key("date")), None),
        "top_keywords": (F.col("keywords"), 20),
    }
    if aliases is not None:
        del lists["top_people"]
    report = facet_report(rows, lists, {"total_articles": F.lit(1), "as_primary": primary, "as_secondary": 1 - primary})
    if aliases is None:
        return report
    # names become canonical once they are counted; the report is stored, so that this reads the counts and not the articles
    report = materialize(report, "report")
    named = report.where("facet = 'all_people'").select("value", "count")
    named = canonicalize_fuzzy(named, "value", aliases, "_c").groupBy(F.col("_c").alias("value")).agg(F.sum("count").alias("count"))
    return facets(report.where("facet <> 'all_people'"), facet(top_of(named, 10), "top_people"), facet(named, "all_people"))


def category_distribution(classified: DataFrame, taxonomy=None) -> DataFrame:
    """A15. (facet, value, count): per category, per primary category, mean categories per article."""
    counts = value_counts(classified, "categories")
    primary = classified.where("primary_category is not null").groupBy(F.col("primary_category").alias("value")).agg(
        F.count("*").alias("count"))
    parts = [
        number(classified, "total_articles", F.count("*")), facet(counts, "category_distribution"),
        facet(primary, "primary_category_distribution"),
        number(classified, "avg_categories_per_article", F.coalesce(F.avg(F.size("categories")), F.lit(0.0))),
    ]
    if taxonomy is not None:
        every = dim_frame(classified.sparkSession, taxonomy).select(F.col("category").alias("value")).join(
            counts, "value", "left").fillna(0, ["count"])
        parts.append(facet(every, "articles_per_category"))
    return facets(*parts)


def entity_report(analyses: DataFrame) -> DataFrame:
    """A16. (facet, value, count) over rule-based analyses (T17) of one entity's articles."""
    stances = analyses.groupBy(F.col("stance").alias("value")).agg(F.count("*").alias("count"))
    first = analyses.orderBy("id").limit(5)
    return facets(
        number(analyses, "articles_analyzed", F.count("*")), facet(top_counts(analyses, "topics", 10), "top_topics"),
        facet(top_counts(analyses, "keywords", 20), "top_keywords"), facet(stances, "stances"),
        facet(first.select(F.col("title").alias("value"), F.col("id").alias("count")), "recent_analyses"),
    )


def party_store_stats(assigned: DataFrame, gaz) -> DataFrame:
    """A17. (party, figure, articles): each party's total (figure NULL), each figure's count, zeros
    included, and the grand total (party NULL)."""
    spark = assigned.sparkSession
    g = dim_frame(spark, gaz)
    stored = assigned.where("party_id is not null")
    totals = stored.rollup(F.col("party_id").alias("party")).agg(F.count("*").alias("articles"))
    parties = g.select("party").distinct()
    per_party = parties.join(totals, "party", "left").select(
        "party", F.lit(None).cast("string").alias("figure"), F.coalesce("articles", F.lit(0)).alias("articles"))
    grand = stored.agg(F.count("*").alias("articles")).select(
        F.lit(None).cast("string").alias("party"), F.lit(None).cast("string").alias("figure"), "articles")
    figures = g.where("kind = 'figure'").select("party", F.col("canonical").alias("figure")).distinct()
    mentions = unnest(stored, "mentioned_figures", "figure", F.col("party_id").alias("party")).groupBy(
        "party", "figure").agg(F.count("*").alias("articles"))
    per_figure = figures.join(mentions, ["party", "figure"], "left").fillna(0, ["articles"])
    return facets(per_party, per_figure.select("party", "figure", "articles"), grand)


def coverage_window(articles: DataFrame, n_titles: int = 5) -> DataFrame:
    """A18. One row: earliest and latest date, distinct sources, the titles of the newest articles."""
    titles = articles.orderBy(F.desc_nulls_last("date"), F.desc("id")).limit(n_titles)
    listed = titles.agg(F.sort_array(F.collect_list(F.struct(
        (-F.unix_date(F.coalesce("date", F.to_date(F.lit("0001-01-01"))))).alias("d"), (-F.col("id")).alias("i"),
        "title"))).alias("t"))
    return articles.agg(
        F.min("date").alias("earliest"), F.max("date").alias("latest"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("articles_count"),
    ).withColumn("_t", listed.scalar()).withColumn(
        "sample_titles", F.transform("_t", lambda x: x["title"])).drop("_t")


def bulk_store_counts(assigned: DataFrame) -> DataFrame:
    """A19. Per party: stored articles; articles of no party count as failed under party NULL."""
    return assigned.groupBy("party_id").agg(
        F.count_if(F.col("party_id").isNotNull()).alias("success"),
        F.count_if(F.col("party_id").isNull()).alias("failed"),
    )


def first_distinct(df: DataFrame, column: str, n: int, order: str = "id") -> DataFrame:
    """First n distinct elements of a list column in reading order: (position, value)."""
    rows = df.select(order, F.posexplode(column).alias("pos", "value"))
    seen = rows.groupBy("value").agg(F.min(F.struct(order, "pos")).alias("at"))
    top = seen.orderBy("at", "value").limit(n)
    w = W.orderBy("at", "value")  # at most n rows
    return top.withColumn("position", F.row_number().over(w)).select("position", "value")


def profile_facets(articles: DataFrame, word: str = "speech", order: str = "id") -> DataFrame:
    """A20. (facet, value, count): date span, articles with a keyword that holds ``word``, the first 20
    distinct keywords and 10 distinct topics in reading order. One scan; places and dates travel as one aggregate's."""
    spark, none = articles.sparkSession, F.lit(None)
    place = f"struct<o:{articles.schema[order].dataType.simpleString()},p:int>"
    limits = {"keywords": 20, "topics": 10}

    def entry(label: str, value=none, w=none, day=none, at=none) -> Column:
        return F.struct(F.lit(label).alias("facet"), value.cast("string").alias("value"), w.cast("double").alias("w"), day.cast("date").alias("day"), at.cast(place).alias("at"))

    listed = lambda c: F.transform(F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")), lambda x, i: entry(
        c, x, at=F.when(x.isNotNull(), F.struct(F.col(order).alias("o"), i.alias("p")))))
    spoken = F.when(F.exists("keywords", lambda k: F.contains(F.lower(k), F.lit(word))), 1).otherwise(0)
    single = [entry("earliest", day=F.col("date")), entry("latest", day=F.col("date")), entry("speech_count", w=spoken)]
    rows = articles.select(F.explode_outer(F.concat(*[listed(c) for c in limits], F.array(*single))).alias("e")).select("e.*")
    rows = rows.where(~F.col("facet").isin(list(limits)) | F.col("value").isNotNull())
    empty = spark.range(1).select(F.explode(F.array(entry("earliest"), entry("latest"), entry("speech_count", w=F.lit(0)))).alias("e")).select("e.*")
    found = rows.unionByName(empty).groupBy("facet", "value").agg(
        F.sum("w").alias("w"), F.min("day").alias("first"), F.max("day").alias("last"), F.min("at").alias("at"))
    ranked = found.withColumn("_rank", F.row_number().over(W.partitionBy("facet").orderBy("at", "value"))).where(F.col("_rank") <= max(limits.values()))
    most = F.coalesce(*[F.when(F.col("facet") == f, n) for f, n in limits.items()], F.lit(1))
    in_list = F.col("facet").isin(list(limits))
    value = F.when(F.col("facet") == "earliest", F.col("first").cast("string")).when(F.col("facet") == "latest", F.col("last").cast("string")).otherwise(F.col("value"))
    return ranked.where(F.col("_rank") <= most).select("facet", value.alias("value"), F.when(in_list, F.col("_rank").cast("double")).otherwise(F.col("w")).alias("count"))


def trend_summary(monthly: DataFrame) -> DataFrame:
    """A21. One row from (month, count): months, the first peak month, its count, the rounded mean."""
    return monthly.agg(
        F.count("*").alias("total_months"),
        F.min_by("month", F.struct((-F.col("count")).alias("c"), F.col("month").alias("m"))).alias("peak_month"),
        F.coalesce(F.max("count"), F.lit(0)).alias("peak_count"),
        F.coalesce(F.floor(F.avg("count") + 0.5), F.lit(0)).cast("bigint").alias("avg_per_month"),
    )


def share_and_rank(counts: DataFrame, name: str = "value", count: str = "count") -> DataFrame:
    """A22. Share of the total in percent, rank, and the rounded mean, beside each count. Ranks are numbered by ranges
    (:mod:`broadsheet.operators.ranges`), so ``counts`` may be of any length."""
    everything = counts.agg(F.sum(count).alias("t"), F.floor(F.avg(count) + 0.5).cast("bigint").alias("m"))
    ranked = number_rows(counts, [F.desc(count), F.asc(name)], "rank")
    return ranked.withColumn("_t", everything.select("t").scalar()).withColumn(
        "mean_count", everything.select("m").scalar()
    ).withColumn("share_pct", F.round(F.col(count) / F.col("_t") * 100, 1)).drop("_t")


def language_recent_sample(articles: DataFrame, language: str, n: int = 5) -> DataFrame:
    """A23. The n newest articles with the number of all articles and of those in one language."""
    counts = articles.agg(F.count("*").alias("t"), F.count_if(F.col("language") == language).alias("l"))
    recent = articles.orderBy(F.desc_nulls_last("date"), F.desc("id")).limit(n)
    return recent.select("id", "title", "date", "language").withColumn(
        "total_articles", counts.select("t").scalar()).withColumn("language_count", counts.select("l").scalar())


def session_counts(messages: DataFrame) -> DataFrame:
    """A24."""
    return messages.agg(F.countDistinct("conv_id").alias("sessions"), F.count("*").alias("messages"))


def ingest_report(scraped: DataFrame, stored: DataFrame) -> DataFrame:
    """A25. (source, scraped, stored) and the total under source NULL."""
    a = scraped.groupBy("source").agg(F.count("*").alias("scraped"))
    b = stored.groupBy("source").agg(F.count("*").alias("stored"))
    per = a.join(b, "source", "full").fillna(0, ["scraped", "stored"])
    total = per.agg(F.sum("scraped").alias("scraped"), F.sum("stored").alias("stored")).select(
        F.lit(None).cast("string").alias("source"), "scraped", "stored")
    return per.unionByName(total)


def monthly_counts(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date) if df.schema[date].dataType.typeName() == "date" else as_date(date)
    return df.where(d.isNotNull()).groupBy(month_key(d).alias("month")).agg(F.count("*").alias("count"))
