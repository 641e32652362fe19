"""Terms of large dimensions are found in one pass over the texts, without a row for each position."""

import pytest
from pyspark.sql import functions as F

from broadsheet import dims
from broadsheet.operators import matching, themes


@pytest.mark.parametrize("mode", ["word", "substring", "name_part"])
def test_scan_and_grams_agree(spark, mode):
    texts = ["abab aba", "x.ab-Ab", "ab_ é ab́", "(BC d),ab", "", None, "aaaa ab্ ab", "ab²"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, "other bc d")], "id bigint, content string")
    terms = spark.createDataFrame([(w,) for w in ["ab", "AB", "aba", "bc d", "é", "aa", "", "longer than the anchor"]], "term string")
    scan = matching.match_by_join(df, "id", "content", terms, "term", mode)
    grams = matching.match_by_join(df, "id", "content", terms, "term", mode, scan_limit=0)
    plan = scan._jdf.queryExecution().executedPlan().toString()  # as planned, before it runs
    assert sorted(map(tuple, scan.collect())) == sorted(map(tuple, grams.collect())) != []
    assert "split(" not in plan and plan.count("Exchange hashpartitioning") == 1  # no row for each position of a text


def test_counts_by_scan_and_by_grams_agree(spark):
    df = spark.createDataFrame([(1, "aaaa abab"), (2, "none"), (None, "aa"), (1, "aa")], "id bigint, content string")
    terms = spark.createDataFrame([("aa",), ("ab",), ("b a",)], "term string")
    total = lambda d: sorted(map(tuple, d.groupBy("id", "term").agg(F.sum("n")).collect()))
    scan = matching.match_counts(df, "id", "content", terms, "term")
    assert total(scan) == total(matching.match_counts(df, "id", "content", terms, "term", scan_limit=0)) == [(1, "aa", 3), (1, "ab", 2)]


def test_theme_counts_travel_without_texts(spark):
    lexicon = dims.lexicon({f"T{i}": [f"w{i}a", f"w{i}b"] for i in range(300)})
    df = spark.createDataFrame([(1, "w1a w1b w1a w299b"), (2, "nothing")], "id bigint, content string")
    scored = themes.theme_scores(df, lexicon, F.col("content")).select("id", "theme_scores")
    assert {r["id"]: r["theme_scores"] for r in scored.collect()} == {1: {"T1": 3, "T299": 1}, 2: {}}
    assert "split(" not in scored._jdf.queryExecution().executedPlan().toString()
