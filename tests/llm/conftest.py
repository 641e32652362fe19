import pytest
from pyspark.sql import functions as F

from broadsheet.llm import exchange

SF = "/root/testdata/sf0.001"
#: Rows that every operator must take: nulls, empty, blank, very long, ties, repeats, other scripts.
ROWS = [
    (1, "The quick brown fox\njumps over\nthe lazy dog today"), (2, None), (3, ""), (4, " \t\n\r\x0b\x0c "), (None, "an id is missing here"), (None, None),
    (5, "THE QUICK brown fox\njumps over\nthe lazy dog today"), (6, "a"), (6, "a"), (6, "b"), (7, "word " * 30_000), (8, "x" * 50_000), (9, " é漢字 🙂 ÉCOLE \x1c ▁ \x00"),
    (10, "same same same same same same same same"), (2**53 + 1, "cc by CC-BY general public license All rights reserved"), (11, "a\nb\nc\na\nb\nc\na\nb\nc"),
]


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    """Blocks small enough that the small tables fill several of them."""
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 40_000)


@pytest.fixture(scope="session")
def edge(spark):
    """The rows above beside columns whose names operators use inside."""
    rows = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    for name in ("hash", "block", "norm", "ord", "row_hash", "pos", "token", "score", "kept", "row", "key", "ids", "cls"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows.withColumn("lang", F.when(F.col("doc_id") == 1, "en").when(F.col("doc_id") == 9, "fr")).cache()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}
