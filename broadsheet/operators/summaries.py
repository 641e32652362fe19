"""Stored entity and period summaries: one row per key, the last write wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.dates import check_bound
from broadsheet.operators.identity import latest_per_key

ENTITY_KEY = ["entity_type", "entity_name"]
PERIOD_KEY = ["entity_type", "entity_name", "start_date", "end_date"]

ENTITY_SUMMARY_SCHEMA = (
    "entity_type string, entity_name string, keywords array<string>, topics array<string>, summary string, "
    "articles_analyzed bigint, associated_party string, last_updated timestamp"
)
PERIOD_SUMMARY_SCHEMA = (
    "entity_type string, entity_name string, start_date date, end_date date, summary string, key_points array<string>, "
    "keywords array<string>, topics array<string>, "
    "statistics struct<total_articles:bigint,newly_summarized:bigint,already_summarized:bigint>, last_updated timestamp"
)


def upsert_summary(store: DataFrame, rows: DataFrame, keys: list[str] | None = None, updated: str = "last_updated") -> DataFrame:
    """E15. Store after the write. New rows win over stored ones with the same time."""
    keys = keys or (PERIOD_KEY if "start_date" in store.columns else ENTITY_KEY)
    both = store.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    ranked = both.withColumn("_order", F.struct(F.col(updated).alias("u"), F.col("_new").alias("n")))
    return latest_per_key(ranked, keys, "_order").drop("_new", "_order")


def lookup_summary(store: DataFrame, entity_type: str, name: str, start=None, end=None) -> DataFrame:
    """E16. The summary of a key, or no row."""
    out = store.where((F.col("entity_type") == entity_type) & (F.col("entity_name") == name))
    if start is not None:
        out = out.where(F.col("start_date") == F.lit(check_bound(start)))
    if end is not None:
        out = out.where(F.col("end_date") == F.lit(check_bound(end)))
    return out


def list_period_summaries(store: DataFrame, entity_type: str, name: str) -> DataFrame:
    """E16. All periods of an entity, the latest start first."""
    return lookup_summary(store, entity_type, name).orderBy(F.desc("start_date"), F.desc("end_date"))


def delete_summary(store: DataFrame, entity_type: str, name: str, start=None, end=None) -> DataFrame:
    """E16. The store without one key, or without all periods of an entity."""
    return store.join(lookup_summary(store, entity_type, name, start, end).select(
        *(PERIOD_KEY if "start_date" in store.columns else ENTITY_KEY)),
        PERIOD_KEY if "start_date" in store.columns else ENTITY_KEY, "left_anti")


def summary_age_days(rows: DataFrame, now, updated: str = "last_updated", out: str = "age_days") -> DataFrame:
    """E17. Age in days, NULL without a time."""
    n = now if isinstance(now, Column) else F.lit(now)
    age = F.unix_micros(n.cast("timestamp")) - F.unix_micros(F.col(updated).cast("timestamp"))
    return rows.withColumn(out, age / 86_400_000_000)
