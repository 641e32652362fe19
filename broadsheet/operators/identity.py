"""Row identity, duplicates, and changes to stored articles. Every function returns the table as it is
after the change; :mod:`broadsheet.sources.store` persists it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CATEGORY_COLUMNS = ["ai_categories", "primary_category", "category_confidence", "category_reasoning", "categorized_at"]
PEOPLE_COLUMNS = ["people", "parties", "people_affiliations"]


def non_empty(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(c, F.lit(""))


def assign_article_id(df: DataFrame, id: str = "id", url: str = "url", text: str = "content") -> DataFrame:
    """R01. The given id, else a hash of the URL, else a hash of the text: the same article always gets
    the same id."""
    derived = F.sha2(F.coalesce(non_empty(url), F.col(text), F.lit("")), 256)
    given = non_empty(F.col(id).cast("string")) if id in df.columns else F.lit(None).cast("string")
    return df.withColumn(id, F.coalesce(given, derived))


def dedup_by_url(df: DataFrame, url: str = "url", order: str = "id") -> DataFrame:
    """R02. First row of each URL. Every task keeps one row per URL before it shuffles (a window group limit), so a URL
    with very many copies never gathers them, and only the columns that are used later travel. Rows without a
    URL are never duplicates: they bypass the shuffle, so they cannot pile up in one task either."""
    has = F.coalesce(F.col(url), F.lit("")) != ""
    first = F.row_number().over(W.partitionBy(url).orderBy(F.asc_nulls_last(order)))
    return df.where(has).withColumn("_first", first).where("_first = 1").drop("_first").unionByName(df.where(~has))


#: Column that a bucketed store is laid out by: the URL, or something of its own for a row without one.
STORE_KEY = "url_key"


def store_key(url: str = "url", id: str = "id") -> Column:
    """The key of a row in a bucketed store. Rows without a URL share none, so they spread over all buckets."""
    return F.coalesce(non_empty(url), F.concat(F.lit("\x00"), F.coalesce(F.col(id).cast("string"), F.lit("")), F.uuid()))


def _known(store: DataFrame, url: str) -> DataFrame:
    """URLs of a store as ``_known``. A bucketed store's key is taken as it lies, without an exchange."""
    name = STORE_KEY if STORE_KEY in store.columns else url
    return store.select(F.col(name).alias("_known"))


def insert_new(store: DataFrame, batch: DataFrame, url: str = "url", order: str = "id") -> DataFrame:
    """R03. Rows of a batch that are new: distinct by URL within the batch and absent from the store.
    Rows without a URL are always new and stay out of the join. With a store from
    :func:`broadsheet.sources.store.open_bucketed` only the batch is shuffled."""
    has = F.coalesce(F.col(url), F.lit("")) != ""
    fresh = dedup_by_url(batch.where(has), url, order).join(_known(store, url), F.col(url) == F.col("_known"), "left_anti")
    return fresh.unionByName(batch.where(~has))


def ingest_stats(store: DataFrame, batch: DataFrame, url: str = "url", order: str = "id") -> DataFrame:
    """R04. One row: total, unique, duplicates, stored, collection_size. URLs are counted once, and the counts meet the
    store's URLs; no other column is read."""
    has = F.coalesce(F.col(url), F.lit("")) != ""
    per_url = batch.where(has).groupBy(F.col(url).alias("_u")).agg(F.count("*").alias("n"))
    known = _known(store, url).distinct().withColumn("_stored", F.lit(True))
    with_url = per_url.join(known, F.col("_u") == F.col("_known"), "left").select("n", F.lit(1).alias("u"), F.when(F.col("_stored"), 0).otherwise(1).alias("s"))
    without = batch.where(~has).agg(F.count("*").alias("n")).select("n", F.col("n").alias("u"), F.col("n").alias("s"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    row = with_url.unionByName(without).agg(zero("n"), zero("u"), zero("s")).withColumn("_size", store.agg(F.count("*").alias("n")).scalar())
    return row.select(F.col("n").alias("total"), F.col("u").alias("unique"), (F.col("n") - F.col("s")).alias("duplicates"), F.col("s").alias("stored"),
                      (F.col("_size") + F.col("s")).alias("collection_size"))


def get_by_id(store: DataFrame, value, id: str = "id") -> DataFrame:
    """R05. The row with this id, or none."""
    return store.where(F.col(id) == F.lit(value))


def delete_by_id(store: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """R06. The store without the listed ids; ids that are absent do no harm."""
    return store.join(ids.select(id).distinct(), id, "left_anti")


def merge_columns(store: DataFrame, updates: DataFrame, id: str = "id") -> DataFrame:
    """R07. Partial update: supplied, non-NULL fields replace stored ones, the rest stays."""
    changed = [c for c in updates.columns if c != id]
    u = updates.select(id, *[F.col(c).alias(f"_new_{c}") for c in changed])
    joined = store.join(u, id, "left")
    merged = [
        F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in store.columns
    ]
    added = [F.col(f"_new_{c}").alias(c) for c in changed if c not in store.columns]
    return joined.select(*merged, *added)


def replace_document(store: DataFrame, summaries: DataFrame, id: str = "id", document: str = "content", also: tuple[str, ...] = ()) -> DataFrame:
    """R08. The document becomes its summary; the first original is kept once, so a second run changes
    nothing that matters. Columns named in ``also`` come with the summary, as in R07, in the same join."""
    base = store
    if "original_content" not in base.columns:
        base = base.withColumn("original_content", F.lit(None).cast("string"))
    if "is_summarized" not in base.columns:
        base = base.withColumn("is_summarized", F.lit(False))
    s = summaries.select(id, F.col("summary").alias("_summary"), *[F.col(c).alias(f"_new_{c}") for c in also])
    hit = F.col("_summary").isNotNull()
    new = {c: F.when(hit, F.coalesce(f"_new_{c}", c) if c in base.columns else F.col(f"_new_{c}")).otherwise(
        F.col(c) if c in base.columns else F.lit(None)) for c in also}
    return (
        base.join(s, id, "left")
        .withColumns(new)
        .withColumn("original_content", F.when(hit, F.coalesce("original_content", document)).otherwise(
            F.col("original_content")))
        .withColumn(document, F.coalesce("_summary", document))
        .withColumn("is_summarized", hit | F.coalesce("is_summarized", F.lit(False)))
        .drop("_summary", *[f"_new_{c}" for c in also])
    )


def _filled(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(False)
    kind = df.schema[name].dataType.typeName()
    if kind in ("array", "map"):
        return F.coalesce(F.size(F.col(name)) > 0, F.lit(False))
    return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""


def _needs_clearing(df: DataFrame, also_people: bool) -> Column:
    hit = _filled(df, "ai_categories") | _filled(df, "primary_category")
    return hit | _filled(df, "people") | _filled(df, "parties") if also_people else hit


def clear_columns(store: DataFrame, also_people: bool = False) -> DataFrame:
    """R09. Category columns set to NULL wherever an article has a category; people columns too on request."""
    cleared = _needs_clearing(store, also_people)
    names = CATEGORY_COLUMNS + (PEOPLE_COLUMNS if also_people else [])
    flagged = store.withColumn("_clear", cleared)
    return flagged.withColumns({
        c: F.when(~F.col("_clear"), F.col(c)) for c in names if c in store.columns
    }).drop("_clear")


def clear_counts(store: DataFrame, also_people: bool = False) -> DataFrame:
    """R09's report: total_articles, cleared_count, untouched_count."""
    return store.select(_needs_clearing(store, also_people).alias("c")).agg(
        F.count("*").alias("total_articles"),
        F.count_if("c").alias("cleared_count"),
        F.count_if(~F.col("c")).alias("untouched_count"),
    )


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
