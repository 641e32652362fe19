"""What joins with an index shuffle."""

import numpy as np
from pyspark.sql import functions as F

from broadsheet.operators import index as index_module
from broadsheet.operators import search
from broadsheet.plans import digest


def test_a_question_is_sent_once_for_a_shard(spark, monkeypatch):
    """Not once for each cell that it visits; shards hold parts of cells of about equal size."""
    monkeypatch.setattr(index_module, "SHARDS", 3)
    rng = np.random.default_rng(1)
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 8)))], "id bigint, embedding array<double>")
    index = search.build_index(c, sample_rows=200, part_rows=60, cells=20)
    assert len(index.centres) == 20 and len(set(index.shards)) == 3
    assert {r["n"] for r in index.table.groupBy("shard").agg(F.count("*").alias("n")).collect()} <= set(range(120, 280))
    q = c.where("id < 40").select(F.col("id").alias("query_id"), "embedding")
    joined = search.knn_join(q, index, 3)
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "shard" in plan and "cells" in plan
    exact = {(r["query_id"], r["rank"]): r["id"] for r in joined.collect()}
    m = np.array([r["embedding"] for r in c.orderBy("id").collect()])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, n + 1): int(j) for i in range(40) for n, j in enumerate(np.argsort(-(m @ m[i]), kind="stable")[:3])}
    assert exact == want


def test_only_missed_questions_are_asked_again(spark, monkeypatch):
    schema = "id bigint, embedding array<double>, parties array<string>, people array<string>, themes array<string>, date date, is_speech boolean, is_stance boolean"
    c = spark.createDataFrame([(i, [1.0, i / 10], ["A" if i < 4 else "B"], [], [], None, None, None) for i in range(8)], schema)
    q = spark.createDataFrame([(1, [1.0, 0.0], ["A"]), (2, [1.0, 0.0], ["NONE"])], "query_id bigint, embedding array<double>, entities array<string>")
    q = q.withColumn("topics", F.array().cast("array<string>")).withColumn("time_constraint", F.lit(None).cast("struct<days:int,start:date,end:date>"))
    asked = []
    plain = digest.filtered_knn_join
    monkeypatch.setattr(digest, "filtered_knn_join", lambda f, *a, **k: (asked.append(sorted(r["query_id"] for r in f.collect())), plain(f, *a, **k))[1])
    got = {}
    for r in digest.retrieve(q, c, 2, F.lit("2025-01-01").cast("date")).collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [0, 1], 2: [0, 1]} and asked == [[1, 2], [2]]
