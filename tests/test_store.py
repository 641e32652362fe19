import pytest
from pyspark.sql import functions as F

from broadsheet.catalog.base import GAZ, LEXICON, SPEECH, STANCE
from broadsheet.operators import filters, identity, paging
from broadsheet.plans.cards import flatten_article, unflatten_article
from broadsheet.plans.ingest import IngestConfig
from broadsheet.session import scratch_path
from broadsheet.sources import store
from broadsheet.sources.html import ENGLISH_RULES, PageRules, extract_articles
from broadsheet.streaming.ingest import ingest_stream


def urls(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id bigint, url string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_empty_urls_are_never_duplicates(spark):
    df = urls(spark, (1, "a"), (2, ""), (3, "a"), (4, ""), (5, None), (6, None), (7, "b"))
    assert ids(identity.dedup_by_url(df)) == [1, 2, 4, 5, 6, 7]


def test_insert_new_is_idempotent(spark):
    old, batch = urls(spark, (1, "a"), (2, "")), urls(spark, (3, "a"), (4, "b"), (5, "b"), (6, ""))
    fresh = identity.insert_new(old, batch)
    assert ids(fresh) == [4, 6]
    assert ids(identity.insert_new(old.union(fresh), batch)) == [6]
    stats = identity.ingest_stats(old, batch).first().asDict()
    assert stats == {"total": 4, "unique": 3, "duplicates": 2, "stored": 2, "collection_size": 4}


def test_replace_document_keeps_first_original(spark):
    df = spark.createDataFrame([(1, "long"), (2, "other")], "id bigint, content string")
    s = lambda x: spark.createDataFrame([(1, x)], "id bigint, summary string")
    twice = identity.replace_document(identity.replace_document(df, s("s1")), s("s2")).orderBy("id").collect()
    assert (twice[0]["content"], twice[0]["original_content"], twice[0]["is_summarized"]) == ("s2", "long", True)
    assert (twice[1]["content"], twice[1]["original_content"], twice[1]["is_summarized"]) == ("other", None, False)


def test_article_round_trip(spark):
    df = spark.createDataFrame(
        [(1, "T", "2024-08-05", ["A", "B"], ["x"], True, ("s" * 600, ["p"], "for"), (["k"], ["f"], ["t"]))],
        "id bigint, title string, date string, parties array<string>, keywords array<string>, is_speech boolean, "
        "llm_summary struct<summary:string,key_points:array<string>,stance_analysis:string>, "
        "llm_keywords struct<keywords:array<string>,phrases:array<string>,topics:array<string>>")
    flat = flatten_article(df, chars=500)
    assert flat.first()["parties"] == "A, B" and flat.first()["is_speech"] == "True" and flat.first()["date_ts"] == 1722816000
    back = unflatten_article(flat).first()
    assert back["parties"] == ["A", "B"] and back["is_speech"] is True and len(back["llm_summary"]["summary"]) == 500
    assert back["llm_keywords"]["keywords"] == ["k"] and back["keywords"] == ["x"]


def test_dates_filters(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, ""), (3, "2024-02-31"), (4, None)], "id bigint, date string")
    assert ids(filters.filter_date_strict(df)) == [1, 2, 3, 4]
    assert ids(filters.filter_date_strict(df, "2023-01-01")) == [1]
    assert ids(filters.filter_date_lexical(df, None, "2024-01-31")) == [1, 2, 4]
    assert ids(filters.filter_date_lexical(df, "2024-01-01")) == [1, 3]
    with pytest.raises(ValueError):
        filters.filter_date_strict(df, "soon")


def test_pages_partition_the_input(spark):
    df = spark.range(23).withColumn("date", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("id") % 5).cast("int")))
    seen = [r["id"] for p in (1, 2, 3, 4) for r in paging.paginate(df, p, 7).collect()]
    assert sorted(seen) == list(range(23)) and len(seen) == 23
    assert paging.paginate(df, 1, 7).first()["total_pages"] == 4 and paging.paginate(df, 9, 7).count() == 0
    first = [r["id"] for r in paging.newest_first(df).limit(3).collect()]
    assert first == [19, 14, 9]


PAGE = """<html><head><meta property="article:published_time" content="{d}"></head><body><nav><p>{long}</p></nav><h1> The <b>Title</b> </h1>
<div class="article-content x"><p>too short</p><p>{long}</p><script>var p = "<p>no</p>";</script><p>second: {long}</p></div>
<span class="author-name">Ann</span><a class="category" href="/c">News</a></body></html>"""
LONG = "A paragraph that is long enough to be kept by every rule that there is."


def test_extract_articles(spark):
    pages = spark.createDataFrame([
        (1, PAGE.format(d="2024-08-05T10:00:00+06:00", long=LONG)), (2, "<html><body><p>no title</p></body></html>"),
        (3, PAGE.format(d="2020-01-01", long=LONG)), (4, None), (5, "<h1>T</h1><p>short</p>")], "page_id bigint, html string")
    rows = extract_articles(pages, PageRules("site"), start="2024-01-01").collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["title"] == "TheTitle" and r["content"] == f"{LONG}\n\nsecond: {LONG}" and r["category"] == "News" and str(r["date"]) == "2024-08-05"
    english = extract_articles(pages, PageRules("site", **ENGLISH_RULES), start="2024-01-01").collect()
    assert len(english) == 1 and english[0]["author"] == "Ann" and english[0]["content"].startswith("too short " + LONG)


def test_reset_needs_token(spark):
    path = store.write_articles(urls(spark, (1, "a")), scratch_path(spark, "t"))
    with pytest.raises(ValueError):
        store.reset_store(spark, path, "yes")
    assert store.reset_store(spark, path, "DELETE_ALL") == {"before": 1, "after": 0}


def test_union_sources_skips_failures(spark):
    assert store.union_sources(urls(spark, (1, "a")), None, urls(spark, (1, "a"))).count() == 2
    with pytest.raises(ValueError):
        store.union_sources(None)


def test_stream_never_inserts_twice(spark):
    config = IngestConfig(PageRules("web", body=("article",)), GAZ, LEXICON, tuple(SPEECH), tuple(STANCE), dim=16)
    page = lambda i: (f"https://x/{i}", f"<h1>T{i}</h1><article><p>{LONG}</p><p>{LONG}</p></article>")
    pages, out, progress = (scratch_path(spark, n) for n in ("in", "out", "chk"))
    run = lambda: ingest_stream(spark, pages, "url string, html string", out, progress, config).awaitTermination()
    add = lambda *n: spark.createDataFrame([page(i) for i in n], "url string, html string").write.mode("append").parquet(pages)
    add(1, 2)
    run()
    add(2, 3, 3)
    run()
    run()
    assert sorted(r["url"][-1] for r in store.read_articles(spark, out).collect()) == ["1", "2", "3"]
    # a new checkpoint over the same store starts at batch 0 again: nothing stored is lost, nothing comes twice
    add(4)
    progress += "-new"
    run()
    assert sorted(r["url"][-1] for r in store.read_articles(spark, out).collect()) == ["1", "2", "3", "4"]


@pytest.mark.parametrize("forget_after", [None, "1 hour"])
def test_a_replayed_batch_gives_each_url_once_without_reading_the_store(spark, monkeypatch, forget_after):
    from broadsheet.streaming import ingest

    config = IngestConfig(PageRules("web", body=("article",)), GAZ, LEXICON, tuple(SPEECH), tuple(STANCE), dim=16)
    page = lambda i, u: (u, f"<h1>T{i}</h1><article><p>{LONG}</p><p>{LONG}</p></article>" if i != 7 else "<p>no article yet</p>")
    pages, out, progress = (scratch_path(spark, n) for n in ("in", "out", "chk"))
    add = lambda *rows: spark.createDataFrame([page(*r) for r in rows], "url string, html string").coalesce(1).write.mode("append").parquet(pages)
    plans, real = [], ingest.write_batch

    def watched(df, batch_id, *rest, fail=[True]):  # noqa: B006
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        if batch_id >= 1 and df.count() and fail and fail.pop():
            real(df, batch_id, *rest)
            raise RuntimeError("lost after writing")
        real(df, batch_id, *rest)

    monkeypatch.setattr(ingest, "write_batch", watched)
    run = lambda: ingest_stream(spark, pages, "url string, html string", out, progress, config, forget_after=forget_after)
    add((1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (7, "g"))
    run().awaitTermination()
    add((1, "a"), (6, "c"), (3, None), (8, "g"))
    with pytest.raises(Exception, match="lost after writing"):
        run().awaitTermination()
    run().awaitTermination()
    run().awaitTermination()
    stored = store.read_articles(spark, out)
    assert sorted(r["url"] or "" for r in stored.collect()) == ["", "", "", "a", "b", "c", "g"]
    assert len(plans) >= 3 and not any(out in p for p in plans)
    assert ingest.other_batches(spark, out, ingest.stream_name(progress)) == [] != ingest.other_batches(spark, out, "another")


def test_failed_rename_keeps_the_store(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store.write_articles(spark.range(5), path)

    class Stubborn:
        """A file system whose second rename fails."""

        def __init__(self, fs):
            self.fs, self.calls = fs, 0

        def rename(self, a, b):
            self.calls += 1
            return False if self.calls == 2 else self.fs.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    real = store._path
    monkeypatch.setattr(store, "_path", lambda s, p: (Stubborn(real(s, p)[0]), real(s, p)[1]))
    with pytest.raises(OSError, match="the old one is back"):
        store.rewrite(spark.range(2), path)
    monkeypatch.undo()
    assert spark.read.parquet(path).count() == 5
    store.rewrite(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2


def test_party_with_special_characters_can_be_dropped(spark, tmp_path):
    path = str(tmp_path / "parties")
    df = spark.createDataFrame([(1, "A/B: C"), (2, "A/B: C"), (3, "50% = x"), (4, "P")], "id bigint, party_id string")
    store.write_party_partitioned(df, path)
    assert store.drop_party_partition(spark, path, "A/B: C") == {"before": 4, "after": 2}
    assert store.drop_party_partition(spark, path, "50% = x") == {"before": 2, "after": 1}
    assert [r["party_id"] for r in spark.read.parquet(path).collect()] == ["P"]


def test_page_fields_leave_other_columns_alone(spark):
    from broadsheet.sources.html import PageRules, extract_pages

    page = "<h1>T</h1><article><p>" + "word " * 20 + "</p></article>"
    df = spark.createDataFrame([(None, page), (2**53 + 1, page), (3, None)], "page_id bigint, html string")
    got = extract_pages(df, PageRules(source="s")).collect()
    assert {r["page_id"] for r in got} == {None, 2**53 + 1, 3} and sum(r["title"] == "T" for r in got) == 2


def test_boilerplate_goes_before_the_length_test(spark):
    page = "<h1>T</h1><article><p>" + "MENU junk MENU " * 10 + "</p><p>END of page " + "more " * 40 + "</p></article>"
    df = spark.createDataFrame([(1, page)], "page_id bigint, html string")
    rules = PageRules("web", body=("article",))
    assert extract_articles(df, rules).count() == 1
    from dataclasses import replace

    assert extract_articles(df, replace(rules, boilerplate=("MENU junk MENU",), tail_marker="END of page")).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def below(plan, what):
    """Lines of a plan from the one that holds ``what`` up to the root: what lies above it."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if what in line)
    depth, above = lines[at].index(lines[at].lstrip(" :+-|")[0]), []
    for line in reversed(lines[:at]):
        d = len(line) - len(line.lstrip(" :+-|"))
        if d < depth:
            above.append(line)
            depth = d
    return above


def test_only_the_batch_is_shuffled_into_a_bucketed_store(spark, tmp_path):
    path = str(tmp_path / "articles")
    first = spark.createDataFrame([(i, "" if i % 3 == 0 else f"u{i}", "text " * 50) for i in range(300)], "id bigint, url string, content string")
    assert store.write_bucketed(first, path, buckets=6) == path
    store.write_bucketed(first.where("id < 2").selectExpr("id + 1000 as id", "concat('v', id) as url", "content", "7 as extra"), path, buckets=99)
    opened = store.open_bucketed(spark, path)
    assert opened.count() == 302 and opened.where("extra = 7").count() == 2
    batch = spark.createDataFrame([(i, f"u{i}" if i % 2 else None, "new") for i in range(290, 320)] + [(400, "u311", "again"), (401, "v1", "x")], "id bigint, url string, content string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fresh = identity.insert_new(opened, batch)
        above = below(plan_of(fresh), STORE_SCAN)
        assert "Bucketed: true" in plan_of(fresh) and above and not any("Exchange" in line for line in above), plan_of(fresh)
        stats = identity.ingest_stats(opened, batch)
        assert not any("Exchange hashpartitioning" in line for line in below(plan_of(stats), STORE_SCAN)), plan_of(stats)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    known = {f"u{i}" for i in range(300) if i % 3} | {"v0", "v1"}
    want = sorted(i for i in range(290, 320) if i % 2 == 0 or f"u{i}" not in known)
    assert ids(fresh) == want
    assert stats.first().asDict() == {"total": 32, "unique": 31, "duplicates": 32 - len(want), "stored": len(want), "collection_size": 302 + len(want)}
    # rows without a URL do not pile up in one bucket
    files = opened.where("url = ''").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 5


STORE_SCAN = f"[{identity.STORE_KEY}#"


def test_duplicates_are_found_without_their_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), F.col("source").alias("url"), "text")
    plan = plan_of(identity.dedup_by_url(df).select("id", "url"))
    assert "WindowGroupLimit" in plan and "ReadSchema: struct<doc_id:bigint,source:string>" in plan and "text" not in plan


def test_a_deep_page_reads_one_range(spark, tmp_path):
    rows = spark.range(3_000).select("id", F.when(F.col("id") % 50 != 7, F.date_add(F.to_date(F.lit("2020-01-01")), (F.col("id") % 400).cast("int"))).alias("date"),
                                     F.repeat(F.lit("text "), 20).alias("content"))
    stored = spark.read.parquet(paging.write_newest_first(rows, str(tmp_path / "newest"), rows_per_file=100))
    index = paging.page_index(stored, 70)
    assert index.count() == 43
    for page in (1, 2, 30, 42, 43):
        want = [r["id"] for r in paging.paginate(rows, page, 70).collect()]
        got = paging.indexed_page(stored, index, page, 70)
        assert [r["id"] for r in got.collect()] == want and {(r["total"], r["total_pages"]) for r in got.collect()} == {(3_000, 43)}
    deep = paging.indexed_page(stored, index, 30, 70)
    execution = deep._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    leaf = execution.executedPlan()
    while leaf.children().size():
        leaf = leaf.children().head()
    assert 70 <= leaf.metrics().apply("numOutputRows").value() <= 300
    assert paging.indexed_page(stored, index, 44, 70).count() == 0
    with pytest.raises(ValueError):
        paging.indexed_page(stored, index, 0, 70)


def test_profiles_find_duplicates_without_texts(spark, monkeypatch):
    from broadsheet.plans import digest, profiles

    rows = [(i, f"t{i}", f"u{i % 5}" if i % 4 else "", "long text " * 200, "2024-01-0%d" % (1 + i % 9), ["P1"], ["F1"], {"F1": "P1"}) for i in range(40)]
    a = spark.createDataFrame(rows, "id bigint, title string, url string, content string, date string, parties array<string>, people array<string>, people_affiliations map<string,string>")
    a = spark.read.parquet(store.write_articles(a.withColumn("source", F.lit("s")).withColumn("keywords", F.array()), scratch_path(spark, "profiled")))
    for profile in (profiles.party_profile(a, GAZ, "P1"), profiles.figure_profile(a, GAZ, "P1", "F1")):
        got = profile._jdf.queryExecution().optimizedPlan().toString()
        window = got.index("Window [row_number()")
        assert "content" in got and "content" not in got[window:].split("Project")[0]
        profile.collect()
    kept = {r["id"] for r in identity.dedup_by_url(a).collect()}
    assert {r["id"] for r in profiles.party_profile(a, GAZ, "P1", size=100).collect()} == kept
    texts = []
    monkeypatch.setattr(digest, "dedup_by_url", lambda df: texts.append(df.columns) or identity.dedup_by_url(df))
    row = digest.build_digest_input(a, "party", "P1", 7).first()
    assert row["articles_analyzed"] == 7 and "content" not in texts[0] and row["digest_text"].count("long text " * 200) == 7
