"""What a task's Python holds follows the size of a piece of a batch."""

import gc

import pyarrow as pa
from pyspark.sql import functions as F

from broadsheet.functions import batches
from broadsheet.functions.tokens import term_statistics, top_counts, top_words, word_count
from broadsheet.operators import enrich
from broadsheet.sources import html


def test_pieces_hold_a_bounded_size_of_text(monkeypatch):
    monkeypatch.setattr(batches, "PIECE_BYTES", 10)
    texts = pa.array(["abcd", None, "efgh", "x" * 30, "", "ij"])
    sizes = []

    def work(part):
        sizes.append(sum(len(t or "") for t in part.to_pylist() if len(t or "") <= 10))
        return part

    assert batches.by_pieces(work, texts).to_pylist() == texts.to_pylist() and len(sizes) > 1 and max(sizes) <= 10
    assert batches.by_pieces(work, texts.slice(0, 0)).to_pylist() == []


def test_counts_across_pieces(spark):
    """Rows of one batch that fall into several pieces are counted as if they were alone."""
    text = "apple pear apple " * 9_000
    df = spark.createDataFrame([(i, text + f"only{i} " * 20_000 if i % 3 else None if i == 3 else "") for i in range(12)], "id int, t string").coalesce(1)
    got = {r["id"]: r for r in df.select(
        "id", top_words(F.col("t"), 2, 3).alias("top"), word_count(F.col("t"), 3).alias("n"), top_counts(F.col("t"), 2, 3).alias("c")).collect()}
    assert got[1]["top"] == ["only1", "apple"] and got[1]["n"] == 47_000 and list(got[1]["c"]["counts"]) == [20_000, 18_000]
    assert got[0]["top"] == [] and got[0]["n"] == 0 and got[3]["top"] == []
    stats = {r["term"]: (r["tf"], r["df"]) for r in term_statistics(df, "t", 3, [], (1, 1)).collect()}
    assert stats["apple"] == (8 * 18_000, 8) and stats["only7"] == (20_000, 1)


def test_a_read_page_leaves_no_garbage():
    gc.collect()
    gc.disable()
    try:
        html._read_page("<html><body><h1>T</h1><p>" + "word " * 50 + "</p></body></html>", html.PageRules("s"))
        assert not any(isinstance(o, html._Node) for o in gc.get_objects())
    finally:
        gc.enable()


def test_keyword_lists_of_null_and_empty_responses(spark):
    df = spark.createDataFrame([(1, "**Keywords**\n- a\n- b\n**Main Topics**\nt"), (2, ""), (3, None)], "id int, r string")
    got = {r["id"]: r["p"] for r in df.select("id", enrich.parse_keyword_lists("r", 1).alias("p")).collect()}
    assert got[1]["keywords"] == ["a"] and got[1]["topics"] == ["t"] and got[2]["keywords"] == [] and got[3]["phrases"] == []
