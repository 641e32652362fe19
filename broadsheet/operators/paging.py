"""Ordering, paging and timelines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.operators.ranges import number_rows


def newest(date: str = "date", id: str = "id"):
    return [F.desc_nulls_last(date), F.desc(id)]


def newest_first(df: DataFrame) -> DataFrame:
    """O01. Newest date first, then highest id; undated rows last."""
    return df.orderBy(*newest())


def paginate(df: DataFrame, page: int, size: int, order=None) -> DataFrame:
    """O02. One page (1-based) with ``total`` and ``total_pages`` beside each row. Only the first
    page·size rows are ever sorted: a bounded top-k, then an offset."""
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    total = df.agg(F.count("*").alias("n")).scalar()
    rows = df.orderBy(*(order or newest())).limit(page * size).offset((page - 1) * size)
    return rows.withColumn("total", total).withColumn("total_pages", F.ceil(F.col("total") / size).cast("bigint"))


def write_newest_first(df: DataFrame, path: str, rows_per_file: int = 100_000, date: str = "date", id: str = "id") -> str:
    """A store whose files are ranges of O01's order, so that a page, or any range of dates, reads the files it lies in."""
    files = max(1, math.ceil(df.count() / rows_per_file))
    df.repartitionByRange(files, *newest(date, id)).sortWithinPartitions(*newest(date, id)).write.mode("overwrite").parquet(path)
    return path


def page_index(df: DataFrame, size: int, date: str = "date", id: str = "id") -> DataFrame:
    """Where every page of O01's order starts: (page, date, id, total). Made from dates and ids alone, numbered by ranges, once for
    a store; one row a page, to be stored beside it. Ids are distinct."""
    if size < 1:
        raise ValueError("page and size start at 1")
    numbered = number_rows(df.select(F.col(date).alias("date"), F.col(id).alias("id")), newest(), "_n")
    starts = numbered.where((F.col("_n") - 1) % size == 0).select(((F.col("_n") - 1) / size + 1).cast("bigint").alias("page"), "date", "id")
    return starts.withColumn("total", df.agg(F.count("*").alias("n")).scalar())


def _from(row, date: str, id: str) -> Column:
    """Rows at or after a page's start in O01's order, as tests that reach the files' statistics."""
    if row["date"] is None:
        return F.col(date).isNull() & (F.col(id) <= row["id"])
    day = F.lit(row["date"])
    return F.col(date).isNull() | (F.col(date) < day) | ((F.col(date) == day) & (F.col(id) <= row["id"]))


def indexed_page(df: DataFrame, index: DataFrame, page: int, size: int, date: str = "date", id: str = "id") -> DataFrame:
    """O02 by seeking: one page between its start and the next one's, however deep it lies. Two rows of the index are
    looked up; no more than ``size`` rows are sorted."""
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    bounds = {r["page"]: r for r in index.where(F.col("page").isin(page, page + 1)).collect()}
    if page not in bounds:
        return df.where(F.lit(False)).withColumn("total", F.lit(0).cast("bigint")).withColumn("total_pages", F.lit(0).cast("bigint"))
    rows = df.where(_from(bounds[page], date, id))
    if page + 1 in bounds:
        after = bounds[page + 1]
        rows = rows.where(~F.coalesce(_from(after, date, id), F.lit(False)))
        if after["date"] is not None:  # said once more, so that the files' statistics can be used
            rows = rows.where(F.col(date) >= F.lit(after["date"]))
    total = bounds[page]["total"]
    return rows.orderBy(*newest(date, id)).limit(size).withColumn("total", F.lit(total).cast("bigint")).withColumn(
        "total_pages", F.lit(-(-total // size)).cast("bigint"))


def offset_limit(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """O03. A slice by descending id."""
    return df.orderBy(F.desc("id")).limit(offset + limit).offset(offset)


def offset_limit_stats(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """O03's numbers, which cover the slice only."""
    has = lambda c: F.count_if(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0)
    part = offset_limit(df, offset, limit)
    return part.agg(
        F.count("*").alias("count"), has("parties").alias("with_parties"), has("people").alias("with_people"),
        F.count_if(F.coalesce(F.size("people_affiliations"), F.lit(0)) > 0).alias("with_affiliations"),
    ).withColumn("total", df.agg(F.count("*").alias("n")).scalar())


def latest_n(df: DataFrame, n: int) -> DataFrame:
    """O04. The newest n rows."""
    return newest_first(df).limit(n)


def group_by_date(df: DataFrame) -> DataFrame:
    """O05. Timeline of a page of rows: date → list of (title, source, url) in newest-first order."""
    entry = F.struct((-F.col("id")).alias("o"), "title", "source", "url")
    ordered = F.sort_array(F.collect_list(entry))
    return df.where("date is not null").groupBy("date").agg(
        F.transform(ordered, lambda e: F.struct(e["title"].alias("title"), e["source"].alias("source"), e["url"].alias("url")))
        .alias("articles"))
