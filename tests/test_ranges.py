"""Running totals and row numbers by ranges."""

from collections import Counter

from pyspark.sql import functions as F

from broadsheet import dims
from broadsheet.operators import stats
from broadsheet.operators.ranges import number_rows, running


def test_numbers_of_ranged_rows(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("score"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("key"))
    got = number_rows(rows, [F.desc("score"), F.asc("id")], "rank", ranges=9).collect()
    assert {r["id"]: r["rank"] for r in got} == {i: n for n, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 7), i)), 1)}
    sums = running(rows, [F.asc("id")], {"total": F.col("score")}, by=["key"], ranges=9).collect()
    want, so_far = {}, Counter()
    for i in range(1000):
        so_far[i % 3] += i % 7
        want[i] = so_far[i % 3]
    assert {r["id"]: r["total"] for r in sums} == want


def test_facets_take_one_scan(spark):
    rows = [(i, [f"c{i % 3}", None], [] if i % 2 else ["p"], None if i == 4 else [f"x{i}", "y"], ["k"] * 2, i % 2 == 0, None) for i in range(8)]
    schema = "id bigint, categories array<string>, parties array<string>, people array<string>, keywords array<string>, is_speech boolean, is_stance boolean"
    df = spark.createDataFrame(rows, schema)
    report = stats.categorization_summary(df)
    got = {(r["facet"], r["value"]): r["count"] for r in report.collect()}
    assert got["total_articles", None] == 8 and got["speech_articles", None] == 4 and got["stance_articles", None] == 0
    assert got["top_categories", "c0"] == 3 and got["top_keywords", "k"] == 16 and ("top_categories", None) not in got
    assert got["avg_people_per_article", None] == 2  # an article without a list has no size
    assert sum(f == "top_people" for f, _ in got) == 8
    many = spark.range(50).select("id", *[F.array(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 2, "0"))).alias(c) for c in ("categories", "parties", "people", "keywords")],
                                  F.lit(True).alias("is_speech"), F.lit(False).alias("is_stance"))
    cut = {f: sorted(r["value"] for r in rows) for f, rows in _by_facet(stats.categorization_summary(many).collect()).items() if f.startswith("top")}
    assert [len(v) for _, v in sorted(cut.items())] == [10, 20, 10, 10] and cut["top_parties"] == [f"v{i:02d}" for i in range(10)]
    path = "/root/testdata/sf0.001/documents.parquet"
    d = spark.read.parquet(path).select(F.col("doc_id").alias("id"), *[F.array("lang").alias(c) for c in ("categories", "parties", "people", "keywords", "topics", "ai_categories")],
                                        (F.col("doc_id") > 3).alias("is_speech"), F.lit(False).alias("is_stance"), F.col("lang").alias("primary_category"), "source",
                                        F.to_date(F.lit("2024-01-02")).alias("date"))
    taxonomy = dims.default_taxonomy()
    reports = [stats.categorization_summary(d), stats.category_detail(d, "en"), stats.profile_facets(d)]
    reports += [stats.category_stats(d, taxonomy)]
    for report in reports:
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1, plan
    for report, n in ((stats.categorization_summary(d.where("false")), 5), (stats.category_detail(d.where("false"), "en"), 3), (stats.profile_facets(d.where("false")), 3)):
        assert {r["value"] for r in report.collect()} == {None} and report.count() == n


def _by_facet(rows):
    out = {}
    for r in rows:
        out.setdefault(r["facet"], []).append(r)
    return out


def test_ranks_without_one_window_over_all(spark):
    counts = spark.range(10_000).select(F.concat(F.lit("n"), "id").alias("value"), (F.col("id") % 10).alias("count"))
    ranked = stats.share_and_rank(counts)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange SinglePartition" not in plan.split("Subquery")[0]
    got = {r["value"]: r["rank"] for r in ranked.collect()}
    order = sorted(range(10_000), key=lambda i: (-(i % 10), f"n{i}"))
    assert got == {f"n{i}": n for n, i in enumerate(order, 1)}
