"""Tables at rest: article stores, party partitions, vectors, summaries and exports, all Parquet or JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators.identity import STORE_KEY, store_key


def union_sources(*frames: DataFrame | None) -> DataFrame:
    """S11. All rows of all sources; a source that failed (None) contributes nothing."""
    present = [f for f in frames if f is not None]
    if not present:
        raise ValueError("no source produced rows")
    out = present[0]
    for frame in present[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def write_articles(articles: DataFrame, path: str, mode: str = "append", partition_by=()) -> str:
    """S13. Append articles to a store. Tasks write their own files; a failed task is retried alone."""
    writer = articles.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def read_articles(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """S13. A store as a table. Columns added by later batches are NULL in earlier ones."""
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    return spark.read.option("mergeSchema", "true").parquet(path)


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def list_dir(spark: SparkSession, path: str) -> list:
    """File statuses of a directory."""
    fs, p = _path(spark, path)
    return list(fs.listStatus(p))


def rewrite(df: DataFrame, path: str, partition_by=()) -> str:
    """Replace a store by a table derived from it: written beside the store first, then swapped in by two
    renames whose results are checked. When the second one fails, the old store is put back; it is deleted
    only after the new one is in place. Between the renames a reader may find no store, never half of one."""
    spark = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    write_articles(df, fresh, "overwrite", partition_by)
    fs, target = _path(spark, path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    had = fs.exists(target)
    if had and not fs.rename(target, path_of(old)):
        fs.delete(path_of(fresh), True)
        raise OSError(f"{path} could not be moved aside; it is unchanged")
    if not fs.rename(path_of(fresh), target):
        restored = not had or fs.rename(path_of(old), target)
        raise OSError(f"the new table could not be moved to {path}; " + (
            "the old one is back" if restored else f"the old one is at {old}") + f", the new one at {fresh}")
    if had:
        fs.delete(path_of(old), True)
    return path


def write_bucketed(articles: DataFrame, path: str, buckets: int | None = None, url: str = "url", id: str = "id") -> str:
    """S13, R03. Append articles to a store that is laid out by URL: every batch writes the same buckets, so a later batch
    meets the store bucket by bucket. The number of buckets is fixed when the store is made (default: the
    shuffle partitions) and kept in the store's ``_layout``."""
    spark = articles.sparkSession
    layout = f"{path}/_layout"
    if exists(spark, layout):
        buckets = spark.read.parquet(layout).first()["buckets"]
    else:
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.createDataFrame([(STORE_KEY, buckets)], "key string, buckets int").coalesce(1).write.mode("overwrite").parquet(layout)
    keyed = articles if STORE_KEY in articles.columns else articles.withColumn(STORE_KEY, store_key(url, id))
    stored = _stored_schema(spark, path)
    added = [f for f in keyed.schema if f.name not in {g.name for g in stored}]
    name = _register(spark, path, [*stored, *added], buckets)
    aligned = keyed.select(*[(F.col(f"`{f.name}`") if f.name in keyed.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in [*stored, *added]])
    aligned.repartition(buckets, STORE_KEY).write.mode("append").format("parquet").bucketBy(buckets, STORE_KEY).sortBy(STORE_KEY).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are external
    return path


def _stored_schema(spark: SparkSession, path: str) -> list:
    files = [s.getPath().getName() for s in list_dir(spark, path)] if exists(spark, path) else []
    return list(spark.read.option("mergeSchema", "true").parquet(path).schema) if any(not n.startswith(("_", ".")) for n in files) else []


def _register(spark: SparkSession, path: str, fields: list, buckets: int) -> str:
    """A fresh table name for the files of a bucketed store."""
    name = f"articles_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({STORE_KEY}) SORTED BY ({STORE_KEY}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A store made by :func:`write_bucketed`, with its layout known to the planner: joins and aggregates by its key
    need no exchange above it. Columns added by later batches are NULL in earlier ones."""
    buckets = spark.read.parquet(f"{path}/_layout").first()["buckets"]
    return spark.table(_register(spark, path, _stored_schema(spark, path), buckets))


def export_json(df: DataFrame, path: str) -> str:
    """S14. JSON lines, UTF-8, non-ASCII characters as they are."""
    df.write.mode("overwrite").json(path)
    return path


def export_envelope(articles: DataFrame, categorized: bool = True) -> DataFrame:
    """S14. One-row summary that accompanies an export."""
    tag = lambda name: F.count_if(F.size(F.col(name)) > 0).alias(f"with_{name}")
    return articles.agg(
        F.count("*").alias("total_articles"),
        *([tag("parties"), tag("people"), tag("themes")] if categorized else []),
        F.min("date").cast("string").alias("earliest"), F.max("date").cast("string").alias("latest"),
    )


def write_embeddings(vectors: DataFrame, path: str, model_name: str, embedding: str = "embedding",
                     mode: str = "overwrite") -> str:
    """S15. Vectors with the name and dimension of the model that made them."""
    vectors.withColumn("model_name", F.lit(model_name)).withColumn("dim", F.size(embedding)).write.mode(mode).parquet(path)
    return path


def read_embeddings(spark: SparkSession, path: str, model_name: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if model_name is None else df.where(F.col("model_name") == model_name)


def write_party_partitioned(assigned: DataFrame, path: str, mode: str = "append", party: str = "party_id") -> str:
    """S16. One directory per assigned party; articles of no party are left out. The rebalance hint sizes
    files by volume, so a party with a third of all articles is split over many tasks."""
    rows = assigned.where(F.col(party).isNotNull()).hint("rebalance", F.col(party))
    rows.write.mode(mode).partitionBy(party).parquet(path)
    return path


def party_counts(assigned: DataFrame, party: str = "party_id") -> DataFrame:
    """S16's report: articles per party."""
    return assigned.where(F.col(party).isNotNull()).groupBy(party).agg(F.count("*").alias("articles"))


def drop_party_partition(spark: SparkSession, path: str, party: str, column: str = "party_id") -> dict:
    """S17. Remove one party's directory; the others are not read or rewritten. Returns row counts."""
    before = spark.read.parquet(path).count()
    fs, p = _path(spark, f"{path}/{column}={escape_partition(party)}")
    removed = 0
    if fs.exists(p):
        removed = spark.read.parquet(p.toString()).count()
        if not fs.delete(p, True):
            raise OSError(f"{p} could not be deleted")
    return {"before": before, "after": before - removed}


def escape_partition(value: str) -> str:
    """A partition value as Spark writes it in a directory name: control characters and those with a meaning
    in paths or globs as ``%`` and two hex digits."""
    special = set('"#%\'*/:=?\\{[]^') | {chr(c) for c in range(1, 32)} | {"\x7f"}
    return "".join(f"%{ord(c):02X}" if c in special else c for c in value)


def reset_store(spark: SparkSession, path: str, confirm: str, token: str = "DELETE_ALL") -> dict:
    """S17. Empty a store. The caller must pass the confirmation token."""
    if confirm != token:
        raise ValueError("reset needs the confirmation token")
    before = spark.read.parquet(path)
    count = before.count()
    rewrite(before.where(F.lit(False)), path)
    return {"before": count, "after": 0}
