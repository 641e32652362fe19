"""The training-data operators: edge rows, empty tables, and plain versions where SQL has none."""

import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import decontamination, exact_dedup, jaccard_join, language_id, language_model, license_rules, license_scan, line_dedup, quality, sentencepiece, substring_dedup
from broadsheet.llm.common import window_hashes
from broadsheet.llm.components import components
from broadsheet.llm.queries import QUERIES, SQL, tokenizer_path
from broadsheet.llm.tokens import SPACE, SYMBOL, words
from tests.compare import compare, duck
from tests.llm.conftest import ROWS, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
N = len(ROWS)
LABELS = [(1, 1), (5, 0), (6, 1), (10, 0), (None, 1), (2, None)]


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def ranked(rows, keys=("doc_id", "text")):
    return sorted(rows, key=lambda r: tuple((r[k] is None, r[k] or 0) if k == "doc_id" else r[k] or "" for k in keys))


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int")


@pytest.fixture(scope="session")
def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (None, "a b"), (3, None), (4, "")], "item_id bigint, text string")


def operators(labels, bench):
    def by_quality(d):
        return quality.score(d, quality.fit(d, labels))

    return {
        "lines": line_dedup.remove_repeated_lines, "licenses": license_scan.scan, "quality": by_quality, "substrings": substring_dedup.remove_repeats,
        "language": lambda d: language_id.predict(d, language_id.fit(d)), "model": lambda d: language_model.fit_score(d, F.col("doc_id") % 2 == 0),
        "exact": exact_dedup.exact_groups, "near": jaccard_join.near_groups, "pieces": lambda d: sentencepiece.encode_decode(d, tokenizer_path()),
    }


def test_edge_rows_keep_every_row_and_id(edge, labels, bench):
    want = sorted((r[0] for r in ROWS), key=lambda i: (i is None, i or 0))
    for name, run in operators(labels, bench).items():
        got = sorted((r["doc_id"] for r in run(edge).select("doc_id").collect()), key=lambda i: (i is None, i or 0))
        assert got == want, name
    assert decontamination.leaks(edge, bench).count() == 0
    assert decontamination.drop_leaking(edge, bench).count() == N


def test_empty_tables(edge, labels, bench):
    none = edge.where("false")
    for name, run in operators(labels, bench).items():
        assert run(none).count() == 0, name
    assert decontamination.leaks(none, bench).count() == 0
    assert decontamination.leaks(edge, bench.where("false")).count() == 0
    for drop in (exact_dedup.drop_copies, jaccard_join.drop_near_copies):
        assert drop(none).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    problem, _ = compare(spark, duck(SF), name, QUERIES[name], SQL[name], SF)
    assert problem is None


# --- 1 lines --------------------------------------------------------------------------------------------

def plain_line_runs(texts, min_lines, min_words):
    """Per text (lines, removed, kept): every run that counts is looked up among all that start earlier."""
    seen, want = set(), []
    for t in texts:
        lines, gone = t.split("\n"), set()
        for p in range(len(lines)):
            for n in range(1, min(min_lines, len(lines) - p) + 1):
                run = tuple(lines[p:p + n])
                if run in seen and (n == min_lines or len(re.findall(line_dedup.WORD, " ".join(run))) >= min_words):
                    gone |= set(range(p, p + n))
                seen.add(run)
        want.append((len(lines), len(gone), "\n".join(x for j, x in enumerate(lines) if j not in gone)))
    return want


@pytest.mark.parametrize("k, words", [(1, 20), (2, 2), (3, 20), (3, 3), (5, 4)])
def test_line_runs(spark, k, words):
    rng = np.random.default_rng(k)
    texts = ["\n".join(rng.choice(["a", "b", "c c", "", "d\u00a0d\x0bd"], rng.integers(1, 30))) for _ in range(60)] + ["x\ny\nz\nw"] * 40
    got = line_dedup.remove_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7), min_lines=k, min_words=words).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in got} == dict(enumerate(plain_line_runs(texts, k, words)))


def test_line_runs_of_every_length(spark):
    """Runs of 1 to 50 lines between lines of their own, short and long lines; and one long line that many texts share."""
    rng, long = random.Random(5), " ".join(f"w{i}" for i in range(60))
    runs = [[f"run {n} line {i}" + " more" * rng.randrange(12) for i in range(n)] for n in range(1, 51)]
    texts = [f"own {d}\n" + "\n".join(run) + f"\nend {d}" for d, run in enumerate(runs + runs)] + [f"only {i}\n{long}" for i in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept"]) for r in line_dedup.remove_repeated_lines(rows).collect()}
    assert got == dict(enumerate(plain_line_runs(texts, 3, 20)))
    assert all(got[100 + i][2] == f"only {i}" for i in range(1, 30)) and all(got[50 + n - 1][1] == n for n in range(3, 51))


# --- 2 licenses -----------------------------------------------------------------------------------------

def plain_scan(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text))
    base = [(i, label) for phrase, label in license_rules.BASE for i in range(len(ws)) if ws[i:i + len(phrase.split())] == phrase.split()]
    norm, spans = " " + " ".join(ws) + " ", []
    for place, r in enumerate(license_rules.build()):
        if r.keyword in ws:
            spans += [(m.start(), m.end(), r.level, place, r.label) for m in re.finditer(f" {r.pattern}(?= )", norm)]
    left = [s for s in spans if not any(o is not s and o[2] <= s[2] and o[0] <= s[0] and o[1] >= s[1] and ((o[0], o[1], o[2]) != s[:3] or o[3] < s[3]) for o in spans)]
    found = sorted({label for _, label in base})
    return (len(ws), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None), ",".join(found),
            ",".join(sorted({*found, *[s[4] for s in left]})), max((license_rules.WEIGHTS[s[2]] for s in left), default=0.0))


SAMPLES = [
    "Licensed under the Apache License, Version 2.0 (the License)", "SPDX-License-Identifier: MIT", "GNU Lesser General Public License v2.1 or later", "This is CC BY-SA 4.0, or cc-by.",
    "Copyright (c) 2020 X. All rights reserved. ALL RIGHTS\nRESERVED", "Creative Commons Attribution-NonCommercial-ShareAlike 3.0", "cc by cc by cc by", "general public license general public license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this", "gplv3 GPL 2 lgplv2.1 AGPL-3.0", "the BSD 3-Clause license; mit licence", "occ by", "cc byx", "", "é cc by É",
]


def test_license_rules_against_a_plain_scan(spark, texts):
    all_texts = SAMPLES + [t + " " + s for t, s in zip(list(texts.values())[:40], itertools.cycle(SAMPLES))]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(all_texts)), "doc_id bigint, text string")).collect()
    assert len(license_rules.build()) > 300
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == plain_scan(all_texts[r["doc_id"]]), all_texts[r["doc_id"]][-200:]
        norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(all_texts[r["doc_id"]]))) + " "
        assert all(0 <= d["start"] < d["end"] < len(norm) and norm[d["end"]] == " " for d in r["detections"])


def test_every_license_rule_has_its_keyword_in_reach():
    for r in license_rules.build():
        assert re.search(r"(?<![a-z0-9])" + r.keyword, r.pattern.replace("[sc]", "s")) or re.search(r.keyword, r.pattern.replace("[sc]", "c").replace("(?:", "")), r


def ways(pattern):
    """Every text that a rule's pattern matches."""
    def of(tokens):
        out = [""]
        for kind, value in tokens:
            kind = str(kind)
            if kind == "LITERAL":
                more = [chr(value)]
            elif kind == "IN":
                more = [chr(c) for k, v in value for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))][:2]
            elif kind == "BRANCH":
                more = [x for branch in value[1] for x in of(branch)]
            elif kind == "SUBPATTERN":
                more = of(value[3])
            else:
                assert kind == "MAX_REPEAT" and value[:2] == (0, 1), kind
                more = ["", *of(value[2])]
            out = [a + b for a in out for b in more]
        return out
    return of(re._parser.parse(pattern))


def test_every_way_to_match_a_license_rule_holds_its_keyword():
    for r in license_rules.build():
        for text in ways(r.pattern):
            assert re.fullmatch(r.pattern, text) and r.keyword in text.split(), (r, text)


def test_wordings_without_the_rule_s_first_keyword(spark):
    want = {"An end user licence agreement applies": "license,proprietary", "End user license agreement": "proprietary", "not without prior written permission": "proprietary",
            "a licence agreement": "license", "the licence terms": "license", "licenced under something": "license", "licensed under something": "license"}
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(want)), "doc_id bigint, text string")).collect()}
    for i, (text, labels) in enumerate(want.items()):
        assert set(got[i]["labels"].split(",")) & set(labels.split(",")) and got[i]["score"] > 0, (text, got[i])


# --- 3 benchmark ----------------------------------------------------------------------------------------

def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(1, 30)).astype(np.uint64) for _ in range(2))
        score, first, last = decontamination.align(a, b)
        assert score == plain_alignment(a, b)
        if score:
            assert plain_alignment(a, b[first:last + 1]) == score


def test_edited_copies_are_found_and_others_left(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    items = [" ".join(rng.choice(vocabulary, 40)) for _ in range(30)]
    rows, want = [], set()
    for i in range(300):
        body = list(rng.choice(vocabulary, 200))
        if i % 3 == 0:
            item, copy = i % 30, items[i % 30].split()
            for p in rng.choice(40, 6, replace=False):
                copy[p] = "edited"
            del copy[int(rng.integers(40))]
            at = int(rng.integers(200))
            body[at:at] = [w.upper() + "," for w in copy]
            want.add((i, item))
        rows.append((i, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = decontamination.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["score"] >= 0.5 for r in got)
    assert {r["doc_id"] for r in decontamination.drop_leaking(docs, bench).collect()} == {i for i in range(300) if i % 3}


def test_copies_in_many_rows_are_found_as_in_few(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    items = [" ".join(rng.choice(vocabulary, 40)) for _ in range(2)]
    edited, begun = items[0].split(), items[1].split()[:28]
    for p in (6, 19, 31):
        edited[p] = "edited"
    copies, rare = {0: " ".join(edited), 1: " ".join(begun)}, items[1].split()[28:40]
    rows = [(i, " ".join(rng.choice(vocabulary, 60)) + " " + copies[i % 2]) for i in range(120)]
    rows += [(200, " ".join(rare))]  # the rest of the second item occurs once, so its other seeds are common beside
    got = decontamination.leaks(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i % 2) for i in range(120)}


# --- 4, 6 learned models --------------------------------------------------------------------------------

def test_quality_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_words_of_a_language_hold_their_marks(spark):
    words = language_id._words
    assert words("বাংলাদেশ हिन्दी ภาษาไทย") == ["বাংলাদেশ", "हिन्दी", "ภาษาไทย"]
    assert words("²½ ³ Ⅷ 12 _ \u0301 😀 𐄇") == []
    assert words("Été x²y naïve_né e\u0301a 𐐀b😀c") == ["été", "x", "y", "naïve", "né", "e\u0301a", "𐐨b", "c"]
    plain = [unicodedata.category(chr(c))[0] == "L" for c in range(0x10000)]
    assert [words(chr(c)) != [] for c in range(0x10000) if chr(c).lower() == chr(c)] == [p for c, p in enumerate(plain) if chr(c).lower() == chr(c)]
    docs = spark.createDataFrame([(1, "বাংলাদেশ বাংলা", "bn"), (2, "হিন্দি বাংলাদেশের", "as"), (3, "²½ ³", None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert got == {1: "bn", 2: "as", 3: "und"}


def test_language_on_held_out_texts(spark, edge):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op6_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.98
    assert {r["lang_pred"] for r in language_id.predict(edge, language_id.fit(edge)).where("doc_id IN (2, 3, 4)").collect()} == {"und"}


def test_backoff_goes_from_words_to_shorter_grams():
    one = np.array([1.0, 5.0])
    score = language_id.Scorer(["aa", "bb"], [{"haus": one}, {"x": one[::-1]}, {" h": one}])
    assert score.word("haus") is one
    assert np.allclose(score.word("hx"), (one + 2 * language_id.PENALTY) / 3)  # " h", "hx", "x "
    assert np.allclose(score.word("xq"), (one[::-1] + 3 * language_id.PENALTY) / 4)
    assert np.allclose(score.word("qq"), language_id.PENALTY)


# --- 5 substrings ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("size", [4, 20])
def test_windows(spark, size):
    rng = np.random.default_rng(size)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(rng.choice(["a", "b"], rng.integers(0, 80))) for _ in range(60)]
    texts += [" ".join([*rng.choice(passage, 5), *passage[:rng.integers(15, 60)], *rng.choice(passage, 5)]) for _ in range(60)] + ["a " * n for n in (19, 20, 21, 70)] + [None, ""]
    got = substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5), size=size).collect()
    seen, want = set(), {}
    for i, t in enumerate(texts):
        ws, gone = WORD.findall(t or ""), set()
        for p in range(len(ws) - size + 1):
            run = tuple(ws[p:p + size])
            if run in seen:
                gone |= set(range(p, p + size))
            seen.add(run)
        want[i] = (len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == want


def test_inner_symbols_agree_wherever_a_window_occurs():
    rng = np.random.default_rng(5)
    core = " ".join(rng.choice(list("abcdef"), 20))
    keys = set()
    for _ in range(50):
        before, after = (" ".join(rng.choice(list("abcdef"), rng.integers(1, 30))) for _ in range(2))
        w = words(pa.array([f"{before} {core} {after}"]))
        v = substring_dedup.Windows(w)
        at = len(before.split())
        keys.add((int(v.key[at]), int(v.hash[at]), int(v.anchor[at]) - at))
    assert len(keys) == 1


# --- 7 language model -----------------------------------------------------------------------------------

def test_unigram_scores(spark, texts):
    got = QUERIES["op7_language_model"](spark, SF).collect()
    tokens = {i: [*WORD.findall(lower_az(t)), None] for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for i in train for w in tokens[i])
    total = sum(counts.values())
    for r in got:
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(w in counts for w in own), total, r["doc_id"] not in train)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in own), rel_tol=1e-9)
        assert r["score"] < 0
    # the pairs that it has learned make training texts likelier than unigrams do, on the whole
    assert sum(r["score"] for r in got if not r["held_out"]) > sum(r["base_score"] for r in got if not r["held_out"])


def test_filter_never_reads_a_count_too_low():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    counts = np.exp2(rng.integers(0, 12, 5000)).astype(np.int64) + rng.integers(0, 2, 5000)
    made = language_model.Filter(None, 1, 1 << 18)
    made.add(keys, counts)
    read = language_model.Filter(made.bits.tobytes(), 1, 1 << 18)
    want = np.floor(np.log2(counts)).astype(int)
    levels = read.levels(keys)
    assert (levels >= want).all() and (levels == want).mean() > 0.95
    assert (read.levels(rng.integers(0, 2**63, 5000).astype(np.uint64)) == 0).mean() > 0.95


def test_filter_grows_with_what_it_holds():
    rng = np.random.default_rng(4)
    for n in (0, 1, 1000, 200_000):
        keys, counts = np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), rng.integers(0, 40, n)
        made = language_model.Filter.of([counts[:n // 2], counts[n // 2:]])
        made.add(keys, counts)
        assert (made.levels(keys) >= np.floor(np.log2(np.maximum(counts, 1)))).all()
        assert (made.levels(rng.integers(0, 2**63, 5000).astype(np.uint64)) > 0).mean() < 0.02
    full = language_model.Filter.of([np.array([5])])
    full.add(np.array([7], np.uint64), np.array([5]))
    full.bits[:] = 255  # every probe succeeds: reading ends at the largest level entered
    assert (full.levels(keys[:9]) == 2).all()


def test_a_pair_seen_once_is_told_from_one_never_seen(spark):
    rows = [(0, "alpha beta gamma delta"), (2, "one two three four"), (1, "alpha beta"), (3, "beta alpha"), (5, "alpha unheard")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in language_model.fit_score(docs, F.col("doc_id") % 2 == 0).collect()}
    # the same tokens; only (1) has a pair that the training texts hold besides the first
    assert got[1]["base_score"] == pytest.approx(got[3]["base_score"]) and got[1]["score"] > got[3]["score"] + 0.5
    keys, counts = np.arange(1, 5, dtype=np.uint64), np.array([1, 0, 3, 4])
    made = language_model.Filter(None, 1, 1 << 18)
    made.add(keys, counts)
    assert language_model.expected(made.read(keys)).tolist() == [1.0, 0.0, 2.5, 5.5]


# --- 8 exact duplicates ---------------------------------------------------------------------------------

@pytest.mark.parametrize("keep", ["min", "max"])
def test_a_third_of_all_rows_equal(spark, keep):
    texts = ["Hot TEXT" if i % 3 == 0 else f"text {i % 50}" for i in range(600)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(lower_az(t or ""), []).append(i)
    pick = min if keep == "min" else max
    want = {i: (pick(g), len(g), i == pick(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = exact_dedup.exact_groups(rows, keep=keep).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == want
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(rows, keep=keep).collect()) == sorted(pick(g) for g in groups.values())


def test_copies_that_share_an_id_leave_one(spark):
    rows = spark.createDataFrame([(1, "A", "x"), (1, "a", "y"), (None, "a", "z"), (None, "b", "z"), (None, "B", "z")], "doc_id bigint, text string, hash string")
    assert sorted(str(r["doc_id"]) for r in exact_dedup.drop_copies(rows).collect()) == ["1", "None"]


# --- 9 near duplicates ----------------------------------------------------------------------------------

def plain_components(texts):
    sets = {}
    for i, t in texts.items():
        ws = WORD.findall(lower_az(t or ""))
        sets[i] = {tuple(ws[p:p + 5]) for p in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def near_texts():
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(400)]
    base, shared = list(rng.choice(vocabulary, 120)), list(rng.choice(vocabulary, 50))
    out = []
    for i in range(260):
        if i % 3 == 0:  # a large group of near copies, linked with one another in part only
            copy = list(base)
            for p in rng.choice(120, rng.integers(0, 5), replace=False):
                copy[p] = f"e{rng.integers(1000)}"
            out.append(copy)
        elif i % 3 == 1:  # texts that share a passage and nothing else
            out.append([*rng.choice(vocabulary, 20), *shared, *rng.choice(vocabulary, 20)])
        else:
            out.append(list(rng.choice(vocabulary, rng.integers(0, 9))))
    return {i: " ".join(w) for i, w in enumerate(out)}


def test_components_of_near_copies(spark, monkeypatch):
    texts = near_texts()
    want = plain_components(texts)
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(6)
    for block in (1000, 20):  # with large buckets cut into blocks, too
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        got = jaccard_join.near_groups(rows).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert sorted(r["doc_id"] for r in jaccard_join.drop_near_copies(rows).collect()) == sorted({c for _, c in want.values()})


def test_tree_finds_what_the_bound_leaves():
    rng = np.random.default_rng(4)
    point = (rng.random((300, jaccard_join.GROUPS)) < 0.3).astype(np.int32)
    point[100:160] = point[:60] + (rng.random((60, jaccard_join.GROUPS)) < 0.03)
    size = point.sum(axis=1)
    q, at = jaccard_join.Tree(point, size).partners(point, size)
    most = np.minimum(point[:, None], point[None]).sum(axis=2)
    assert set(zip(q.tolist(), at.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(jaccard_join.linked(most, size[:, None], size[None])))))


def test_connected_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (230, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


# --- 10 pieces ------------------------------------------------------------------------------------------

def test_pieces_against_the_library(spark, texts):
    import sentencepiece as library

    own = library.SentencePieceProcessor(model_file=tokenizer_path())
    rng = np.random.default_rng(6)
    odd = ["", " ", "   ", " a  b ", "▁", "▁▁a", "\t\x00é漢字🙂 x", "aaaa" * 50, " " * 37, "<s> </s> <0x41>", " a　b", "x" + " " * 9 + "y", "\n\n a"]
    odd += ["".join(rng.choice(list("abcdefghinorst eé.,\n▁THE漢"), rng.integers(1, 40))) for _ in range(400)]
    all_texts = odd + list(texts.values())
    got = sentencepiece.encode_decode(spark.createDataFrame(list(enumerate(all_texts)), "doc_id bigint, text string"), tokenizer_path()).collect()
    for r in got:
        ids = own.encode(all_texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["decoded"] == own.decode(ids)


def test_decoding_any_ids():
    import sentencepiece as library

    own, table = library.SentencePieceProcessor(model_file=tokenizer_path()), sentencepiece.PieceTable(sentencepiece.read_model(tokenizer_path()))
    rng = np.random.default_rng(7)
    for _ in range(300):
        ids = rng.integers(259, 32000, rng.integers(1, 12)).tolist()
        assert table.decode(np.array(ids, "<u4").tobytes()).decode() == own.decode(ids)


# --- words ----------------------------------------------------------------------------------------------

def test_words_of_bytes(texts):
    column = pa.array([*texts.values(), "", "x" * 3_000_000, "é " * 5, "a" * 1_048_575 + " b"])
    for parting, lower, pattern in ((SPACE, False, WORD), (SYMBOL, True, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))):
        w = words(column, parting, lower)
        want = [pattern.findall(lower_az(t) if lower else t) for t in column.to_pylist()]
        assert w.counts().tolist() == [len(x) for x in want]
        by_word = {}
        for word, h in zip(itertools.chain(*want), w.hash.tolist()):
            assert by_word.setdefault(word, h) == h
        assert len(set(by_word.values())) == len(by_word)
    assert len(window_hashes(w.hash[:3], 4)) == 0


# --- pipeline -------------------------------------------------------------------------------------------

def test_pipeline_against_a_plain_version(spark, texts):
    import sentencepiece as library

    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    table = quality.WordSums(quality.fit(docs, labels))
    left = {i: t for i, t in texts.items() if table.logit(t) >= 0}
    assert len(left) < len(texts)
    first = {}
    for i in sorted(left):
        first.setdefault(lower_az(left[i]), i)
    left = {i: left[i] for i in first.values()}
    left = {i: left[i] for i in {c for _, c in plain_components(left).values()}}
    items = [decontamination.words(pa.array([r["text"]]), SYMBOL, True).hash for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, t in list(left.items()):
        own = words(pa.array([t]), SYMBOL, True).hash
        for item in items:
            places = np.flatnonzero(np.isin(own, item))
            if len(places) > len(item) // 3 and decontamination.align(item, own)[0] >= 0.5 * len(item):
                left.pop(i, None)
    own = library.SentencePieceProcessor(model_file=tokenizer_path())
    want = {i: hashlib.sha256(np.array(own.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest() for i, t in left.items()}
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_pipeline_stages_keep_the_columns(spark, edge):
    import corpus_pipeline

    docs = edge
    for _, work in corpus_pipeline.STAGES[:-1]:
        docs = work(spark, docs, SF)
        assert docs.columns == edge.columns
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns)
