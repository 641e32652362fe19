"""Token counts, source divergence and importance resampling: edge rows, plain versions, exact round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import divergence, resampling, terms, token_counts
from broadsheet.llm.queries import QUERIES, tokenizer_path
from broadsheet.llm.sentencepiece import PieceTable, read_model
from broadsheet.llm.tokens import SYMBOL
from tests.llm.conftest import ROWS, SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- 11 token counts ------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def test_counts_of_all_prefixes_are_the_library_s(library):
    counter = token_counts.PrefixCounts(PieceTable(read_model(tokenizer_path())))
    rng = random.Random(3)
    parts = ["the", "quick", " ", "   ", "   " * 8, " " * 15, " " * 33, "漢字", "x" * 30, "\n", "int main", "ﬁ", "É", "▁", "<s>", "</s>", "<unk>", "<0x41>", "🙂", "\t\t", "\x00"]
    texts = ["".join(rng.choice("ab  ▁é漢🙂\n\tthe quick of ing") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts += [rng.choice([" ", ""]).join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    for t in texts:
        want = [len(x) for x in library.encode([t[:i] for i in range(len(t) + 1)])]
        assert token_counts.counts_of(counter.of(t)).tolist() == want, repr(t)


def test_budget_questions_from_stored_steps(spark, docs, library, tmp_path):
    path = str(tmp_path / "steps")
    token_counts.prefix_table(docs, tokenizer_path()).write.parquet(path)
    table = spark.read.parquet(path)
    rows = docs.select("doc_id", "text").join(table, "doc_id").select(
        "text", "n_tokens", "n_bytes", token_counts.fitting_chars(F.lit(50)).alias("chars"), token_counts.tokens_before(F.lit(30)).alias("before"),
        token_counts.truncated("text", F.lit(50)).alias("cut"), token_counts.fitting_chars(F.lit(-1)).alias("none")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r["text"] or ""
        assert (r["n_tokens"], r["n_bytes"], r["none"]) == (len(library.encode(text)), len(text.encode()), -1)
        assert r["before"] == len(library.encode(text[:30]))
        assert r["cut"] == text[:r["chars"]] and len(library.encode(r["cut"])) <= 50
        assert all(len(library.encode(text[:n])) > 50 for n in range(r["chars"] + 1, min(len(text), r["chars"] + 30) + 1))


def test_token_count_edges(edge, library):
    for t in ("spark", "empty"):
        rows = token_counts.within_budget(token_counts.prefix_table(edge if t == "spark" else edge.where("false"), tokenizer_path()), 4096).collect()
        assert len(rows) == (len(ROWS) if t == "spark" else 0)
        want = sorted(((i is None, i or 0), len((x or "").encode()), len(library.encode(x or ""))) for i, x in ROWS)
        assert not rows or sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_bytes"], r["n_tokens"]) for r in rows) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in rows)


def test_op11_is_the_library_s_count(spark, texts, library):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op11_token_counts"](spark, SF).collect()}
    assert got == {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts.items()}


# --- 12 divergence --------------------------------------------------------------------------------------

def plain_audit(rows, min_df=3, top=200):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = LETTERS.findall(lower_az(text))
        df[lang].update(set(found))
        n[lang, source].update(found)
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, c in df[lang].items() if c >= min_df]
        sources = sorted({r[2] for r in rows if r[1] == lang})
        whole = Counter({t: sum(n[lang, s][t] for s in sources) for t in kept})

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: share(n[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            words = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", words)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, i) for i, (v, o) in enumerate(items, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_against_a_plain_version(spark, seed, monkeypatch):
    rng = random.Random(seed)
    words = ["a", "b", "É", "漢", "Zz", "zz", "w1x", "thing", "of", "the", "rare"] + [f"q{'x' * i}" for i in range(20)]
    rows = [(" ".join(rng.choice(words[:rng.randint(1, len(words))]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", "s4", None]))
            for _ in range(150)] + [(None, "de", "s1"), ("", "de", "s2"), ("unique", "de", None), ("same same", "en", "s1")] + [("same same", "en", "s1")] * 30
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 7)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("g", F.lit("x"))
    got = divergence.audit(docs.repartition(5), top=7).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got) == plain_audit(rows, top=7)


def test_divergence_edges(spark, edge):
    rows = [(t, {1: "en", 9: "fr"}.get(i), None) for i, t in ROWS]
    got = divergence.audit(edge.withColumn("source", F.lit(None).cast("string")), min_df=1).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got) == plain_audit(rows, 1)
    none = edge.withColumn("source", F.lit("s")).where("false")
    assert divergence.audit(none).count() == 0


def test_totals_beyond_a_broadcast_meet_by_salted_keys(spark, monkeypatch):
    rows = [(f"a b c {'d ' * i}", "en", f"s{i % 5}") for i in range(40)]
    monkeypatch.setattr(divergence, "broadcast_if_small", lambda df: df)
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string")).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got) == plain_audit(rows)


# --- 13 resampling --------------------------------------------------------------------------------------

def test_crc32_of_spans_of_any_length():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 400_000, dtype=np.uint8)
    lengths = np.concatenate([np.arange(0, 300), rng.integers(0, 70, 500), [64, 65, 127, 128, 129, 4096, 100_000, 300_001]])
    start = np.array([rng.integers(0, len(data) - n) for n in lengths])
    got = resampling.crc32_spans(data, start, start + lengths, piece=1000)
    assert got.tolist() == [zlib.crc32(data[s:s + n].tobytes()) for s, n in zip(start, lengths, strict=True)]
    assert len(resampling.crc32_spans(data, np.empty(0, int), np.empty(0, int))) == 0


@pytest.mark.parametrize("size", [1, 2, 3])
def test_runs_of_words(size):
    import pyarrow as pa

    texts = ["One two  THREE four", "", "é漢 x", "a", " - "]
    s = terms.spans(pa.array(texts), SYMBOL)
    start, end, data, doc = terms.runs(s, size)
    got = [(d, data[a:b].tobytes().decode()) for d, a, b in zip(doc, start, end, strict=True)]
    words = [WORD.findall(lower_az(t)) for t in texts]
    assert got == [(d, " ".join(w[i:i + size])) for d, w in enumerate(words) for i in range(len(w) - size + 1)]
    assert s.n.tolist() == [len(w) for w in words] and s.strings().to_pylist() == [x for w in words for x in w]


def plain_sample(rows, target, longest=1, buckets=10_000, percent=10, least=20):
    def features(text):
        ws = WORD.findall(lower_az(text or ""))
        return len(ws), [zlib.crc32(" ".join(ws[i:i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]

    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    gain = lambda b: math.floor(1000 * math.log((float(t[b]) + 1) * S / ((float(s[b]) + 1) * T)))
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    rank = {}
    for place, r in enumerate(order[:percent * len(order) // 100], 1):
        rank.setdefault(r, []).append(place)
    return sorted(((r[0], r[2], r[3], r[4], rank[r].pop(0) if rank.get(r) else None) for r in out), key=repr)


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_against_a_plain_version(spark, docs, texts, longest):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = resampling.resample(docs, target, longest=longest, percent=30).collect()
    want = plain_sample(list(texts.items()), [r["text"] for r in target.collect()], longest, percent=30)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got), key=repr) == want


def test_resampling_edges(spark, edge):
    target = spark.createDataFrame([("the quick brown fox",), (None,), ("",), ("word word",)], "text string")
    got = resampling.resample(edge, target, percent=50, least_words=1).collect()
    want = plain_sample(ROWS, ["the quick brown fox", None, "", "word word"], percent=50, least=1)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got), key=repr) == want
    assert resampling.resample(edge.where("false"), target).count() == 0
    assert resampling.resample(edge, target.where("false")).count() == len(ROWS)
