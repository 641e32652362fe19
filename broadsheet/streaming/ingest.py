"""I02: the ingestion as a stream. Progress and the URLs seen so far are Spark's checkpoint and state, so a restart or a
repeated batch never inserts an article twice, and no batch reads what the stream has stored before."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from broadsheet.operators.identity import insert_new, non_empty
from broadsheet.plans.ingest import IngestConfig, tag_articles
from broadsheet.sources.html import extract_articles
from broadsheet.sources.store import exists, list_dir

BATCH = "ingest_batch"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fresh_articles(pages: DataFrame, config: IngestConfig, forget_after: str | None = None) -> DataFrame:
    """Articles of a stream of page files, one for each URL that the stream has ever seen (its state), rows without a URL
    always. A page without an article leaves no trace, so a later version of it can still come in. With
    ``forget_after`` (such as ``90 days``, by the files' times) older URLs leave the state, which then is bounded."""
    file, row, time = (F.col(f"_metadata.{c}") for c in ("file_path", "row_index", "file_modification_time"))
    # a row without a URL is known by its place in the input, which is the same on a replay
    place = F.concat_ws("\x00", F.lit(""), file, row.cast("string"))
    marked = pages.withColumn("_place", place).withColumn("_time", time)
    articles = extract_articles(marked, config.rules, source=config.source, start=config.start, end=config.end)
    keyed = articles.withColumn("_key", F.coalesce(non_empty("url"), F.col("_place"))).drop("_place")
    if forget_after is None:
        return keyed.drop("_time").dropDuplicates(["_key"]).drop("_key")
    return keyed.withWatermark("_time", forget_after).dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_time")


def write_batch(articles: DataFrame, batch_id: int, store_path: str, config: IngestConfig, stream: str = "batch") -> None:
    """Tag and store the fresh articles of one micro-batch in a directory of its own, named by the stream and the batch:
    an earlier attempt at the same batch is replaced, another stream's batch of the same number never is. Only what
    other streams have stored (a checkpoint before this one) is compared with, by URL."""
    spark = articles.sparkSession
    others = other_batches(spark, store_path, stream)
    if others:
        stored = spark.read.option("basePath", store_path).option("mergeSchema", "true").parquet(*others)
        articles = insert_new(stored.select("url"), articles.withColumn("_order", F.lit(0)), order="_order").drop("_order")
    tag_articles(articles, config).write.mode("overwrite").parquet(f"{store_path}/{BATCH}={stream}-{batch_id}")


def other_batches(spark: SparkSession, store_path: str, stream: str) -> list[str]:
    """Directories in a store that another stream has written."""
    if not exists(spark, store_path):
        return []
    found = [s.getPath() for s in list_dir(spark, store_path)]
    return sorted(p.toString() for p in found if p.getName().startswith(f"{BATCH}=") and not p.getName().startswith(f"{BATCH}={stream}-"))


def stream_name(checkpoint: str) -> str:
    """The same for every run from one checkpoint, another for a new one."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def ingest_stream(spark: SparkSession, pages_path: str, page_schema, store_path: str, checkpoint: str,
                  config: IngestConfig, files_per_batch: int = 100, forget_after: str | None = None) -> StreamingQuery:
    """Take in all page files that have arrived, then stop; call again (or schedule) for the next ones. The URLs seen are
    kept in RocksDB below the checkpoint, on disk rather than in executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    pages = spark.readStream.schema(page_schema).option("maxFilesPerTrigger", files_per_batch).parquet(pages_path)
    name = stream_name(checkpoint)
    return (
        fresh_articles(pages, config, forget_after).writeStream
        .foreachBatch(lambda df, batch_id: write_batch(df, batch_id, store_path, config, name))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
