"""The corpus pipeline: quality, exact and near duplicates, benchmark leaks, then tokens.

Each stage works on all rows that the one before it kept; run() stores every stage as Parquet in the cluster's shared
folder and reads it again, so a lost executor repeats at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import decontamination, exact_dedup, jaccard_join, quality, sentencepiece
from broadsheet.llm.common import stage
from broadsheet.llm.queries import benchmark, documents, labels, tokenizer_path

#: A text goes when its probability of good quality is below this; low, so that clean texts stay.
LEAST_QUALITY = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, learned from the labelled ones of a bounded sample, does not reject."""
    return quality.drop_poor(docs, quality.fit(docs, labels(spark, sf_dir)), least=LEAST_QUALITY)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (but for the case of A-Z): the smallest id."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the smallest id."""
    return jaccard_join.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a copy of a benchmark item."""
    return decontamination.drop_leaking(docs, benchmark(spark, sf_dir))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and the digests of ids and decoded text."""
    coded = sentencepiece.encode_decode(docs, tokenizer_path())
    return coded.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("decontamination", drop_leaks), ("sentencepiece", encode)]

#: Learned weights, alignment and byte-pair encoding are beyond SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
