"""Blocks and buckets follow the texts, and the packed messages give back what went in."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broadsheet.llm import exchange, language_model, substring_dedup


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1)), st.lists(st.integers(0, 2**40 - 1)), st.integers(0, 2**33))
def test_questions_round_trip(tokens, pairs, most):
    tokens, pairs = (np.array(sorted(x), np.uint64) for x in (tokens, pairs))
    counts, pair_counts = np.full(len(tokens), most, np.int64), np.arange(len(pairs))
    got = language_model.read_question(language_model.question(tokens, counts, pairs, pair_counts))
    for a, b in zip(got, (tokens, counts, pairs, pair_counts), strict=True):
        assert a.tolist() == b.tolist()


def test_blocks_do_not_follow_the_partitions(spark, docs, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("3", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            blocks, buckets = exchange.blocks_of(docs)
            found.append((blocks.select("block").distinct().count(), buckets))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and found[0][0] > 2
    assert exchange.blocks_of(docs.limit(0))[1] == 1


@pytest.mark.parametrize("size", [2_000, 10**9])
def test_results_are_those_of_any_block_size(spark, docs, monkeypatch, size):
    some = docs.where("doc_id < 40")  # a fixture of this test only
    train = F.col("doc_id") % 3 != 0
    want = [sorted(substring_dedup.remove_repeats(some).collect()), sorted(language_model.fit_score(some, train).drop("score", "base_score").collect())]
    base = dict(language_model.fit_score(some, train).select("doc_id", "base_score").collect())
    monkeypatch.setattr(exchange, "BLOCK_BYTES", size)
    got = [sorted(substring_dedup.remove_repeats(some).collect()), sorted(language_model.fit_score(some, train).drop("score", "base_score").collect())]
    assert got == want
    other = dict(language_model.fit_score(some, train).select("doc_id", "base_score").collect())
    assert other == pytest.approx(base)
