import datetime as dt

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from broadsheet import dims
from broadsheet.catalog.base import GAZ
from broadsheet.functions.vectors import scores
from broadsheet.operators import enrich, ranking, search, summaries
from broadsheet.operators import index as index_module
from broadsheet.plans import digest

SF = "/root/testdata/sf0.01"


def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())


def brute(corpus, queries, k, metric):
    """(query, rank, id) of the k best of each query."""
    c, q = ([(r["id"] if "id" in r else r["query_id"], np.array(r["embedding"], float)) for r in d.collect()] for d in (corpus, queries))
    m = scores(np.array([v for _, v in c]), np.array([v for _, v in q]), metric)
    out = []
    for j, (qid, _) in enumerate(q):
        best = sorted((-m[i, j], c[i][0]) for i in range(len(c)) if not np.isnan(m[i, j]))[:k]
        out += [(qid, n, i) for n, (_, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_exact_join_visits_all_it_needs(spark, metric):
    rng = np.random.default_rng(4)
    near = rng.normal(size=(12, 6))[rng.integers(0, 12, 700)] * 4 + rng.normal(size=(700, 6))
    near[::90], near[100:400] = 0, near[100]  # zero vectors, and one vector that many rows share
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(near)], "id bigint, embedding array<double>")
    q = c.where("id % 9 = 4").select(F.col("id").alias("query_id"), F.transform("embedding", lambda x: x + 0.25).alias("embedding"))
    index = search.build_index(c, metric, sample_rows=200, part_rows=60, cells=20)
    assert len(index.centres) > 5 and index.parts.max() > 3 and index.sample.num_rows <= 200
    want = brute(c, q, 5, metric)
    assert rows(search.knn_join(q, index, 5)) == want
    assert rows(search.knn_join(q, index, 5, question_rows=10)) == want
    if metric != "dot":  # balls of clustered points shut most cells out
        visits = index_module._visits(index, pa.RecordBatch.from_pylist([{"qv": r["embedding"]} for r in q.collect()]), 5, None)
        assert visits.mean() < 0.6


def test_join_edges(spark):
    schema = "id bigint, embedding array<float>"
    none = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], schema)
    q = one.select(F.col("id").alias("query_id"), "embedding")
    assert rows(search.knn_join(q, none, 3)) == [] and rows(search.knn_join(q.where("false"), one, 3)) == []
    assert rows(search.knn_join(q, one, 3)) == [(1, 1, 1)]
    assert rows(search.approx_knn_join(q, one, 3)) == [(1, 1, 1)]
    assert len(rows(search.knn_join(q, one.unionAll(one), 3))) == 2


def test_questions_alone_are_shuffled(spark):
    index = search.build_index(vectors(spark))
    q = index.table.sparkSession.range(1).select(F.col("id").alias("qid"), F.lit([1.0] * 64).alias("qv"))
    plan = search.index_join(q, index, 3)._jdf.queryExecution().executedPlan().toString()
    scan = next(i for i, line in enumerate(plan.splitlines()) if "Scan parquet" in line and "cell" in line)
    above = plan.splitlines()[scan - 4:scan]
    assert "Bucketed: true" in plan and not any("Exchange" in line for line in above), plan


def test_knn_join_ties_by_id(spark):
    c = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 9, 1)], "id bigint, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    assert rows(search.knn_join(q, c.repartition(4), 2)) == [(0, 1, 1), (0, 2, 3)]


def test_filtered_join_passes_agree(spark):
    c = vectors(spark).withColumn("parties", F.array(F.concat(F.lit("P"), F.col("id") % 3))).withColumn("people", F.array().cast("array<string>")).withColumn(
        "themes", F.array(F.lit("T"))).withColumn("date", F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 30).cast("int")))
    q = c.where("id < 12").select(F.col("id").alias("query_id"), "embedding", F.array(F.lit("P1")).alias("filter_parties"),
                                  F.lit(None).cast("array<string>").alias("filter_people"), F.array().cast("array<string>").alias("filter_themes"),
                                  F.lit(dt.date(2024, 1, 10)).alias("filter_from"), F.lit(None).cast("date").alias("filter_to"))
    a = search.filtered_knn_join(q, c, 3)
    strict = a.where("strict").join(c, "id").collect()
    assert strict and all(r["parties"] == ["P1"] and r["date"] >= dt.date(2024, 1, 10) for r in strict)
    assert rows(a) == rows(search.filtered_knn_join(q, search.filter_index(c), 3, question_rows=5))
    loose = [(x, r, i) for x, r, i in brute(c.where("date >= '2024-01-10'"), q, 3, "cosine")]
    tight = brute(c.where("date >= '2024-01-10' and parties[0] = 'P1'"), q, 3, "cosine")
    assert rows(a.where("not strict")) == loose and rows(a.where("strict")) == tight


def test_approx_recall(spark):
    """Every row whose id is divisible by 50 against all rows: recall by the exact join."""
    c = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = c.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = search.build_index(c, sample_rows=500, cells=22)
    exact = {(a, i) for a, _, i in rows(search.knn_join(q, index, 10))}
    near = {(a, i) for a, _, i in rows(search.approx_knn_join(q, index, 10))}
    assert len(exact) == 10 * q.count() and len(exact & near) >= 0.9 * len(exact)
    assert search.probes_for(index, 10, 0.95) < len(index.centres)
    one = q.first()
    got = [r["id"] for r in search.approx_knn(one["embedding"], c, 10, index=index).collect()]
    assert got == [i for a, _, i in sorted(rows(search.approx_knn_join(q.where(q.query_id == one["query_id"]), index, 10)))]


def test_encoder_plugin(spark):
    df = spark.createDataFrame([(1, "a", "bb"), (2, "", "")], "id bigint, title string, content string")
    got = search.embed(df, lambda s: np.array([[len(t), 1.0] for t in s])).orderBy("id").collect()
    assert got[0]["embedding"] == pytest.approx([4 / 17**.5, 1 / 17**.5]) and got[0]["embedding_dimension"] == 2


def test_search_bounds(spark):
    with pytest.raises(ValueError):
        search.search("x", vectors(spark), 0)


def test_context_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, i, "t", None, "s", [], [], c) for i, c in ((1, "a"), (2, "b" * 500), (3, "c"))],
                               "query_id bigint, position int, title string, date date, source string, parties array<string>, people array<string>, content string")
    sizes = [r[0] for r in df.orderBy("position").select(F.length(ranking.context_block())).collect()]
    exact = ranking.pack_context(df, sizes[0] + sizes[1]).first()
    assert exact["blocks"] == 2
    assert ranking.pack_context(df, sizes[0] + sizes[1] - 1).first()["blocks"] == 1  # the third would fit, but comes later


def test_intent_filters(spark):
    df = spark.createDataFrame([(1, ["BNP", "Interim Government", "Tareq Rahman"], ["x"], None)],
                               "query_id bigint, entities array<string>, topics array<string>, time_constraint struct<start:date,end:date>")
    r = ranking.intent_filters(df).first()
    assert r["filter_parties"] == ["BNP", "Interim Government"] and r["filter_people"] == ["Tareq Rahman"]


SUMMARY = """Intro to skip
**Summary**: The plan
is clear.

## Key Points
- *First point here*
2. Second point here
- tiny

**Keywords**
reform, vote, ab
- judiciary
4. **Topics Covered**
* elections
**Stance Analysis**: In favour
of it"""


def test_sectioned_summary():
    assert enrich.read_summary(SUMMARY) == {
        "summary": "The plan is clear.", "key_points": ["First point here", "Second point here"],
        "keywords": ["reform", "vote", "judiciary"], "topics": ["elections"], "stance_analysis": "In favour of it"}
    assert enrich.read_summary("Only text.\n\nMore.")["summary"] == "Only text."
    assert enrich.read_summary("সারসংক্ষেপ: এটি\n২. মূল পয়েন্ট\n- গুরুত্বপূর্ণ কথা")["summary"] == "এটি"
    assert enrich.read_summary(None)["summary"] == ""


def test_keyword_lists():
    got = enrich.read_keywords("**Keywords**\n1. reform\n- vote\n**Key Phrases**\n- election law\nMain Topics:\nlaw", 1)
    assert got == {"keywords": ["reform"], "phrases": ["election law"], "topics": ["law"]}
    assert enrich.read_keywords("a, b\n- c", 5)["keywords"] == ["a", "b", "c"]
    many = enrich.read_keywords("**Key Phrases**\n" + "\n".join(f"- p{i}" for i in range(9)) + "\n**Main Topics**\n- a\n- b\n- c\n- d", 5, 7, 4)
    assert len(many["phrases"]) == 7 and many["topics"] == ["a", "b", "c", "d"]


def test_json_responses(spark):
    df = spark.createDataFrame([('{"type": "general"}',), ('x ```json\n{"type": "a"}\n``` y',), ('so {"type": "b"} ok',), ("{broken",), (None,)], "r string")
    got = [r[0] and r[0]["type"] for r in df.select(enrich.parse_json_response("r", enrich.INTENT_SCHEMA)).collect()]
    assert got == ["general", "a", "b", None, None]


def test_failed_completion_keeps_row(spark):
    def picky(prompts: pd.Series) -> pd.Series:
        if (prompts == "bad").any():
            raise RuntimeError("no")
        return prompts.str.upper()

    df = spark.createDataFrame([("a",), ("bad",), (None,)], "prompt string")
    got = {r["prompt"]: (r["response"], r["error"]) for r in enrich.complete(df, picky).collect()}
    assert got == {"a": ("A", None), "bad": (None, "no"), None: (None, None)}


def test_blank_question(spark):
    df = spark.createDataFrame([(1, " ", None, None)], "query_id bigint, query string, response string, error string")
    r = enrich.intents_from_responses(df, ["A"], dt.date(2025, 1, 1)).first()
    assert (r["classification_method"], r["complexity"], r["confidence"]) == ("empty", "simple", 0.0)


def test_combine_in_parts_covers_every_text(spark):
    seen = []

    def shorten(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: " ".join(sorted({w for w in p.split() if w.startswith("#")})))

    texts = spark.createDataFrame([(f"2024-0{1 + i % 3}-1{i % 9}", f"#w{i:02d} " + "filler " * 30) for i in range(60)], "order_key string, text string")
    whole = digest.combine_texts(texts, shorten, "", 1_000_000)
    parts = digest.combine_texts(texts, shorten, "", 2_000)
    assert whole[1] is None and parts[1] is None
    assert set(whole[0].split()) == set(parts[0].split()) == {f"#w{i:02d}" for i in range(60)} and not seen
    long = spark.createDataFrame([("2024-01-01", " ".join(f"#w{i:02d} filler" for i in range(60)) + " x" * 2_000)], "order_key string, text string")
    pieces = digest.combine_texts(long, shorten, "", 1_500)[0]
    assert len({w for w in pieces.split() if len(w) == 4}) >= 58  # a cut may part a word in two


def test_a_failing_group_loses_no_text(spark):
    def shorten(prompts: pd.Series) -> pd.Series:
        if prompts.str.contains("#w07").any() and prompts.str.len().max() > 1_000:
            raise RuntimeError("model is down")
        return prompts.map(lambda p: " ".join(sorted({w for w in p.split() if w.startswith("#")})))

    def never(prompts):
        raise RuntimeError("model is down")

    texts = spark.createDataFrame([(f"2024-0{1 + i % 3}-1{i % 9}", f"#w{i:02d} " + "filler " * 30) for i in range(60)], "order_key string, text string")
    response, error = digest.combine_texts(texts, shorten, "", 2_000)
    assert error or set(response.split()) == {f"#w{i:02d}" for i in range(60)}
    assert digest.combine_texts(texts, never, "", 2_000) == (None, "model is down")
    articles = spark.createDataFrame([(i, f"t{i}", "body", dt.date(2024, 1, 5), ["A"], [], []) for i in range(6)],
                                     "id bigint, title string, content string, date date, parties array<string>, people array<string>, themes array<string>")

    def some(prompts: pd.Series) -> pd.Series:
        if prompts.str.contains("Title: t3").any() or prompts.str.contains("t3").any():
            raise RuntimeError("model is down")
        return prompts.map(lambda p: "**Summary**: fine")

    cache = spark.createDataFrame([], summaries.PERIOD_SUMMARY_SCHEMA)
    row, merged = digest.period_summary(articles, cache, "party", "A", "2024-01-01", "2024-01-31", some, lambda p: p.map(lambda x: "SUMMARY: all"), now=dt.datetime(2024, 2, 1))
    got = row.first()
    assert (got["statistics"]["total_articles"], got["statistics"]["newly_summarized"], got["failed_articles"], got["error"]) == (6, 5, 1, "model is down")
    assert merged.where("id = 3").first()["content"] == "body" and merged.where("id = 4").first()["content"] == "fine"


def test_texts_of_one_date_are_grouped_by_ranges(spark, monkeypatch):
    """All texts under one key: no window holds more than a range of them."""
    def shorten(prompts: pd.Series) -> pd.Series:
        assert prompts.str.len().max() <= 2_010
        return prompts.map(lambda p: " ".join(sorted({w for w in p.split() if w.startswith("#")})))

    monkeypatch.setattr(digest, "TEXTS_IN_RANGE", 10)
    texts = spark.createDataFrame([("", f"#w{i:03d} " + "filler " * 30) for i in range(150)], "order_key string, text string")
    response, error = digest.combine_texts(texts, shorten, "", 2_000)
    assert error is None and set(response.split()) == {f"#w{i:03d}" for i in range(150)}


def test_encoder_leaves_other_columns_alone(spark):
    df = spark.createDataFrame([(None, "a", "x"), (2**53 + 1, "b", "y")], "id bigint, title string, content string")
    got = search.embed(df, lambda s: np.array([[len(t), 1.0] for t in s])).collect()
    assert {r["id"] for r in got} == {None, 2**53 + 1} and all(len(r["embedding"]) == 2 == r["embedding_dimension"] for r in got)


def test_period_cache_hit_asks_no_model(spark):
    def boom(prompts):
        raise AssertionError("model called")

    cache = spark.createDataFrame([("party", "A", dt.date(2024, 1, 1), dt.date(2024, 1, 31), "s", [], [], [], (1, 1, 0), None)], summaries.PERIOD_SUMMARY_SCHEMA)
    row, merged = digest.period_summary(spark.range(0), cache, "party", "A", "2024-01-01", "2024-01-31", boom, boom)
    assert row.first()["summary"] == "s" and row.first()["from_cache"] and merged is None


def test_upsert_last_write_wins(spark):
    schema = "entity_type string, entity_name string, summary string, last_updated timestamp"
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("party", "A", "old", t), ("party", "B", "keep", t)], schema)
    new = spark.createDataFrame([("party", "A", "new", t)], schema)
    got = {r["entity_name"]: r["summary"] for r in summaries.upsert_summary(old, new).collect()}
    assert got == {"A": "new", "B": "keep"}


def test_prompts_skip_missing_values(spark):
    df = spark.createDataFrame([(1, "T", "body", "English", [], ["A"], [])], "id bigint, title string, content string, language string, people array<string>, parties array<string>, themes array<string>")
    p = enrich.build_summary_prompts(df).first()["prompt"]
    assert "Political Party: A" in p and "Political Figure" not in p and "Key Issues" not in p


def test_dimension_limits(spark):
    assert dims.dim_rows(GAZ, 2) is None
    with pytest.raises(ValueError):
        dims.config_rows(GAZ.frame(spark), 2)
    with pytest.raises(ValueError):
        dims.gazetteer({"A": {"names": [" "]}})


def test_only_the_failed_call_is_repeated(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "id bigint, prompt string").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def model(prompts: pd.Series):
        calls.add(1)
        if len(prompts) > 1 and "p3" in set(prompts):
            raise RuntimeError("busy")
        if "p9" in set(prompts):
            return ["too", "many", "answers", "for", "one", "call"]
        return [p.upper() for p in prompts]

    got = {r["id"]: (r["response"], r["error"]) for r in enrich.complete(df, model, batch_size=5).collect()}
    assert got[3] == ("P3", None) and got[12] == ("P12", None) and got[9][0] is None and got[9][1]
    assert calls.value == 4 + 5 + 5
