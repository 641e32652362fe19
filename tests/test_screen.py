"""Inside a shard rows are screened, and only candidates are scored in full."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from broadsheet.functions.vectors import scores
from broadsheet.operators import index as index_module
from broadsheet.operators import search


def lists(m):
    return pa.array([[float(x) for x in v] for v in m], pa.list_(pa.float32()))


def shard(rows, ids, cells):
    rng = np.random.default_rng(3)
    return pa.table({"cid": pa.array(ids, pa.int64()), "cv": lists(rows), "cell": pa.array(cells, pa.int32()),
                     "parties": pa.array([["A", "B"][:n] for n in rng.integers(0, 3, len(rows))], pa.list_(pa.string())),
                     "people": pa.array([[]] * len(rows), pa.list_(pa.string())), "themes": pa.array([None] * len(rows), pa.list_(pa.string())),
                     "date": pa.array([None if n == 0 else n for n in rng.integers(0, 9, len(rows))], pa.int32()).cast(pa.date32())})


def asked(vectors, cells, parties):
    n, none = len(vectors), pa.array([None] * len(vectors), pa.list_(pa.string()))
    day = pa.array([3 if i % 4 == 0 else None for i in range(n)], pa.int32()).cast(pa.date32())
    return pa.table({"qid": pa.array(range(n), pa.int64()), "qv": lists(vectors), "filter_parties": pa.array(parties, pa.list_(pa.string())), "filter_people": none,
                     "filter_themes": none, "filter_from": day, "filter_to": pa.array([None] * n, pa.date32()), "cells": pa.array(cells, pa.list_(pa.int32()))})


def plain(questions, table, k, metric):
    """(question, id) of the k best, from all scores in double precision."""
    out, rows, wanted = [], table.to_pylist(), questions.to_pylist()
    sim = scores(np.array([r["cv"] for r in rows]), np.array([q["qv"] for q in wanted]), metric)
    for j, q in enumerate(wanted):
        fits = [i for i, r in enumerate(rows) if r["cell"] in q["cells"] and (not q["filter_parties"] or set(q["filter_parties"]) & set(r["parties"]))
                and (not q["filter_from"] or r["date"] and r["date"] >= q["filter_from"]) and not np.isnan(sim[i, j])]
        best = sorted(fits, key=lambda i: (-float(f"{sim[i, j]:.11g}"), rows[i]["cid"] is not None, rows[i]["cid"] or 0))[:k]
        out += [(q["qid"], rows[i]["cid"]) for i in best]
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_screened_bests_are_exact(metric, monkeypatch):
    monkeypatch.setattr(index_module, "TILE_ROWS", 1_100)
    monkeypatch.setattr(index_module, "TILE_QUESTIONS", 7)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(3_001, 16)) * rng.uniform(0.5, 40, (3_001, 1))
    m[500:900] = m[500]  # many rows of one vector
    m[1000:1100] = m[1000] * (1 + 1e-7 * rng.normal(size=(100, 16)))  # nearer than single precision tells
    cells = np.where((np.arange(3_001) >= 500) & (np.arange(3_001) < 900), 2, rng.integers(0, 4, 3_001))
    ids = [None if i == 7 else int(i) for i in rng.permutation(3_001)]
    q = rng.normal(size=(40, 16))
    q[3], q[4], q[5], q[6] = m[500], 0, m[1000] + np.roll(m[1000], 1), m[7]
    t = shard(m, ids, cells)
    questions = asked(q, [[0, 1, 2, 3] if i % 5 else [2] for i in range(40)], [["A"] if i % 3 == 1 else ["B", "none"] if i % 3 == 2 else None for i in range(40)])
    got = index_module.best_in_shard(questions, t, 6, metric, False)
    assert list(zip(got[0].to_pylist(), got[1].to_pylist())) == plain(questions, t, 6, metric)


def test_few_pairs_are_scored_in_full(monkeypatch):
    pairs, plain_take = [], index_module.Best._take
    monkeypatch.setattr(index_module.Best, "_take", lambda self, row, who: (pairs.append(len(row)), plain_take(self, row, who))[1])
    rng = np.random.default_rng(2)
    t, questions = shard(rng.normal(size=(20_000, 32)), range(20_000), np.zeros(20_000, int)), asked(rng.normal(size=(50, 32)), [[0]] * 50, [None] * 50)
    assert len(index_module.best_in_shard(questions, t, 10, "cosine")[0]) == 500
    assert 500 <= sum(pairs) < 0.02 * 50 * 20_000
    pairs.clear()  # one vector in all rows: no more than k of them are candidates
    same = shard(np.ones((20_000, 4)), range(20_000), np.zeros(20_000, int))
    got = index_module.best_in_shard(asked(np.ones((50, 4)), [[0]] * 50, [["A"]] * 50), same, 10, "cosine")
    first = [i for i, p in enumerate(same.column("parties").to_pylist()) if "A" in p]
    dates = same.column("date").to_pylist()
    late = [i for i in first if dates[i] and dates[i].day >= 4]
    assert got[1].to_pylist() == [i for q in range(50) for i in (late if q % 4 == 0 else first)[:10]] and sum(pairs) == 500


def test_blocks_of_questions_meet_fewer_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(2_000, 6)))], "id bigint, embedding array<double>")
    index = search.build_index(c, sample_rows=400, part_rows=50)
    q = c.where("id < 60").select(F.col("id").alias("query_id"), "embedding")
    whole = sorted(map(tuple, search.knn_join(q, index, 4).collect()))
    shards = []
    plain_met = index_module.merge
    monkeypatch.setattr(index_module, "merge", lambda partial, k: (shards.append(partial.groupBy("qid").count().agg(F.max("count")).first()[0]), plain_met(partial, k))[1])
    monkeypatch.setattr(index_module, "MEETINGS", 12)
    assert sorted(map(tuple, search.knn_join(q, index, 4, question_rows=10).collect())) == whole
    assert int(index.shards.max()) == 23 and shards[0] <= 4 * 2


def test_computed_vectors_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def encoder(texts):
        seen.add(len(texts))
        return np.array([[len(x), 1.0 + x.count("1")] for x in texts])

    docs = spark.range(300).select("id", F.lit("").alias("title"), F.col("id").cast("string").alias("content"))
    index = search.build_index(search.embed(docs, encoder), sample_rows=50)
    assert index.rows == 300 and index.table.count() == 300 and seen.value == 300
