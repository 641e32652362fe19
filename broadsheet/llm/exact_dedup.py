"""Exact duplicates by a content sort, with DataFrame operations only.

Spark samples splitters of the normalised texts' leading bytes and range-partitions all rows by them; each range is
sorted externally, so equal texts lie next to each other, and a window compares neighbouring texts in full and keeps
one row of each run of equals.

A text with very many copies would fill one range. The sort key therefore ends with a salt that is constant but for
such texts: a pre-aggregated count by hash finds every hash with more than 1/(4 * ranges) of the rows (at most
4 * ranges of them, so their list may be broadcast), and their copies are dealt over as many salts as there are ranges.
The runs of one such text, one for each salt, are then merged by the text's SHA-256 (again at most 4 * ranges texts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.llm.common import ascii_lower, narrow, parts, stage

#: Leading characters that take part in choosing ranges; texts that share them are parted by their hash.
RANGE_CHARS = 24


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise=ascii_lower) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id (the smallest id of the rows with an equal text; with
    ``keep='max'`` the largest), group_size, kept, text_sha256 (of the normalised text).

    Null texts count as empty. Null ids are larger than none: they are kept only if no row of the group has an id. If
    an id occurs twice in a group, both rows have keep_id = doc_id and both are kept. An empty table gives none.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    spark = docs.sparkSession
    n = parts(spark)
    rows = narrow(docs, id_col, text_col).select("doc_id", normalise(F.col("text")).alias("norm"))
    rows = rows.withColumn("hash", F.xxhash64("norm"))
    counts = stage(rows.groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    total = docs.count()
    hot = counts.where(F.col("copies") > total / (4 * n)).select("hash", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(n))).otherwise(F.lit(0)).cast("int")
    ranged = (rows.join(F.broadcast(hot), "hash", "left")
              .select("doc_id", "norm", "hash", salt.alias("salt"), F.substring("norm", 1, RANGE_CHARS).alias("head"))
              .repartitionByRange(n, "head", "hash", "salt"))
    run = W.partitionBy("head", "hash", "salt", "norm")  # the ranges already hold these together: no further exchange
    best: Column = F.min("doc_id").over(run) if keep == "min" else F.max("doc_id").over(run)
    sorted_ = ranged.select("doc_id", best.alias("keep_id"), F.count("*").over(run).alias("group_size"), "salt", "hash",
                            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    runs = stage(sorted_, "runs")
    merged = (runs.join(F.broadcast(hot.select("hash")), "hash", "left_semi").groupBy("text_sha256")
              .agg((F.min if keep == "min" else F.max)("keep_id").alias("all_keep"), F.count("*").alias("all_size")))
    whole = runs.join(F.broadcast(merged), "text_sha256", "left").select(
        "doc_id", F.when(F.col("all_size").isNotNull(), F.col("all_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"), "text_sha256")
    return whole.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise=ascii_lower) -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts: the one with the smallest (or largest) id.

    The rows themselves are sorted as in ``exact_groups``, so nothing is joined back by id: of rows that also share
    their id, one stays. The copies of very frequent texts are settled beforehand by a pre-aggregated group-by.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    n = parts(docs.sparkSession)
    norm = normalise(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    key = docs[id_col].cast("bigint")
    prepared = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key"), F.substring(norm, 1, RANGE_CHARS).alias("head"),
                           F.xxhash64(norm).alias("hash"))
    counts = stage(prepared.groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    hot = counts.where(F.col("copies") > docs.count() / (4 * n)).select("hash")
    of_row = normalise(F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")))
    best = F.min if keep == "min" else F.max
    settled = (prepared.join(F.broadcast(hot), "hash", "left_semi").groupBy("hash", F.sha2(of_row.cast("binary"), 256).alias("sha"))
               .agg(best("key").alias("all_keep")))  # hot hashes have few texts, so at most about 4 * n rows
    salted = (prepared.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "hash", "left")
              .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(F.lit(17), "key"), F.lit(n))).otherwise(F.lit(0)).cast("int"))
              .repartitionByRange(n, "head", "hash", "salt").withColumn("norm", of_row))
    order = F.asc_nulls_last("key") if keep == "min" else F.desc_nulls_last("key")
    first = salted.withColumn("place", F.row_number().over(W.partitionBy("head", "hash", "salt", "norm").orderBy(order))).where("place = 1")
    sha = F.when(F.col("hot"), F.sha2(F.col("norm").cast("binary"), 256))
    kept = first.withColumn("sha", sha).join(F.broadcast(settled), ["hash", "sha"], "left").where(F.col("hot").isNull() | F.col("key").eqNullSafe(F.col("all_keep")))
    return kept.select("row.*")
