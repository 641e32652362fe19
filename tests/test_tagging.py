import random

import pytest
from pyspark.sql import functions as F

from broadsheet import dims
from broadsheet.operators import entities as ent
from broadsheet.operators import matching, names, themes
from broadsheet.operators.keywords import key_points, keywords_by_frequency, keywords_combined, keywords_tfidf
from broadsheet.operators.tagging import categorize

GAZ = dims.gazetteer({
    "A": {"names": ["Alpha Party", "বিএনপি", "B.N.P."], "figures": {"Ann Lee": ["Ann Lee", "এ্যান লী"], "Bo": ["Bo"]}},
    "Gov": {"names": ["government"], "figures": {"Dr Cy": ["Dr Cyrus Vane"]}, "requires_figure": True},
    "C": {"names": ["Cee"], "figures": {"Dee": ["Dee"]}},
})


def articles(spark, *texts):
    return spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "id bigint, title string, content string")


def tags(df):
    return {(r["id"], r["party"]): (r["party_mentioned"], r["figures"]) for r in ent.entity_rows(df).collect()}


TEXTS = ["বিএনপি বলেন", "(B.N.P.) met", "Alpha Partying", "Bob and Borneo", "Ann Lee met the government", "the government said",
         "government by Dr Cyrus Vane, Dee", "xbox", "Cee"]


def test_word_boundaries(spark):
    got = tags(ent.tag_entities_word(articles(spark, *TEXTS), GAZ))
    assert got[(0, "A")] == (True, []) and got[(1, "A")] == (True, [])
    assert (2, "A") not in got and (3, "A") not in got and (7, "A") not in got
    assert got[(4, "A")] == (False, ["Ann Lee"]) and (4, "Gov") not in got and (5, "Gov") not in got
    assert got[(6, "Gov")] == (True, ["Dr Cy"]) and got[(6, "C")] == (False, ["Dee"])


def test_substring_hits_inside_words(spark):
    got = tags(ent.tag_entities_substring(articles(spark, *TEXTS), GAZ))
    assert got[(2, "A")] == (True, []) and got[(3, "A")] == (False, ["Bo"]) and got[(7, "A")] == (False, ["Bo"])


@pytest.mark.parametrize("mode", ["word", "substring"])
def test_all_forms_agree(spark, mode, monkeypatch):
    df = articles(spark, *TEXTS, "", "Dee")
    plain = tags(ent.tag_entities(df, GAZ, mode))
    assert tags(ent.tag_entities(df, GAZ.frame(spark), mode, unroll_limit=1)) == plain
    monkeypatch.setattr(matching, "SCAN_FROM", 1)
    assert tags(ent.tag_entities(df, GAZ, mode)) == plain


@pytest.mark.parametrize("mode", ["word", "substring"])
def test_join_form_matches_brute_force(spark, mode):
    words = ["a", "ab", "bc d", "averylongterm", "é"]
    texts = ["ab", "xab bc d", "averylongterm!", "caféa", "é ab", "bc d_", ""]
    df = articles(spark, *texts)
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    got = {tuple(r) for r in matching.match_by_join(df, "id", "content", terms, "term", mode).collect()}
    inside = lambda t, w: w in t

    def whole(t, w):
        at = t.find(w)
        while at >= 0:
            around = t[at - 1:at] + t[at + len(w):at + len(w) + 1]
            if not any(c.isalnum() or c == "_" for c in around):
                return True
            at = t.find(w, at + 1)
        return False

    test = inside if mode == "substring" else whole
    assert got == {(i, w) for i, t in enumerate(texts) for w in words if test(t, w)}


def test_partial_people(spark):
    df = articles(spark, "said Cyrus, today", "Cyrusville", "the Vane", "ann", "Lee")
    got = [r[0] for r in ent.tag_people_partial(df, GAZ).orderBy("id").select("people_raw").collect()]
    assert got == [["Dr Cyrus Vane"], [], ["Dr Cyrus Vane"], [], []]


MANY = ["Ann met Lee at B.N.P., Bo-Dee and Cyrus", "vane Cyrus।Vane (Dr Cy)", "এ্যান লী Cyrusvane", "anncyrus bo", "", None, "Dr Cyrus Vane\nAnn Lee Dee Dee Cee Cee government",
        "bobobo alpha party B.N.P."]


def test_people_parties_and_topics_by_join(spark):
    """The joined forms give what the forms with one test per term give; a second pass runs on many partitions."""
    lexicon = dims.lexicon({"one": ["bo", "bob", "lee"], "two": ["obo", "Cyrus"], "three": ["zzz"], "four": ["e", "dee", "dee"]})
    extra = dims.gazetteer({"X": {"names": ["Cee"], "figures": {"Ann Lee": ["Lee Ann"], "Eve": ["Cyrus Evergreen", "met Lee"]}}})
    both = dims.Dim(GAZ.schema, GAZ.rows + tuple((r[0], 3, *r[2:]) for r in extra.rows))
    rows = articles(spark, *TEXTS, *MANY)
    for work, dim, columns in (
        (ent.tag_people_partial, both, ["people_raw"]), (ent.assign_party, both, ["party_id", "party_score", "mentioned_figures"]),
        (themes.topics, lexicon, ["topics"]), (themes.theme_scores, lexicon, ["theme_scores"]),
    ):
        want = {r["id"]: r for r in work(rows, dim).collect()}
        for table in (rows, rows.repartition(7)):
            joined = work(table, dim, unroll_limit=0)
            assert set(joined.columns) == set(work(rows, dim).columns)
            got = {r["id"]: r for r in joined.collect()}
            assert {i: [r[c] for c in columns] for i, r in got.items()} == {i: [r[c] for c in columns] for i, r in want.items()}, work.__name__
        assert work(rows.limit(0), dim, unroll_limit=0).count() == 0
        again = work(work(rows, dim, unroll_limit=0), dim, unroll_limit=0)  # columns of its own names are replaced
        assert again.columns == work(rows, dim, unroll_limit=0).columns


def test_themes_with_twelve_thousand_keywords(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcdef", k=rng.randint(3, 9))) for _ in range(14_000)})[:12_000]
    lexicon = dims.lexicon({f"t{i}": words[i::40] for i in range(40)})
    texts = [" ".join(rng.choices(words, k=20)) for _ in range(12)] + ["", "xyz"]
    got = {r["id"]: r["theme_scores"] for r in themes.theme_scores(articles(spark, *texts), lexicon).collect()}
    for i, t in enumerate(texts):
        want = {f"t{j}": sum(t.count(w) for w in words[j::40]) for j in range(40)}
        assert got[i] == {k: v for k, v in want.items() if v}


def test_assign_party_ties_and_flag(spark):
    df = articles(spark, "cee alpha party", "government", "dee", "nothing")
    got = [(r["party_id"], r["party_score"]) for r in ent.assign_party(df, GAZ).orderBy("id").collect()]
    assert got == [("A", 2), (None, None), ("C", 5), (None, None)]


def test_default_mentions(one):
    none, some = F.array().cast("array<string>"), F.array(F.lit("A"))
    assert tuple(one([ent.default_mentions(none), ent.default_mentions(some)])) == (["General Politics"], ["A"])


def test_nested_theme_keywords_both_count(spark):
    lex = dims.lexicon({"E": ["election", "election commission"], "Z": ["zebra"]})
    row = themes.theme_scores(articles(spark, "Election Commission held an election"), lex).first()
    assert row["theme_scores"] == {"E": 3}


def test_flag_needs_two_different_words(spark):
    df = articles(spark, "said said said", "said and stated")
    got = themes.is_keyword_article(df, ["said", "stated"], "f").orderBy("id").collect()
    assert [r["f"] for r in got] == [False, True]


def test_fuzzy_names(spark):
    al = dims.aliases([("তারেক রহমান", "Tareq Rahman"), ("Tarique Rahman", "Tareq Rahman"), ("Mirza Fakhrul Islam", "Mirza Fakhrul")])
    df = spark.createDataFrame([(n,) for n in (
        "তারেক রহমান", " Tareq  Rahman ", "TARIQUE RAHMAN", "Mirza Fakhrul Islam Alamgir", "Rahman", "Someone Else", "")], "n string")
    got = {r["n"]: r["canonical"] for r in names.canonicalize_fuzzy(df, "n", al).collect()}
    assert got == {"তারেক রহমান": "Tareq Rahman", " Tareq  Rahman ": "Tareq Rahman", "TARIQUE RAHMAN": "Tareq Rahman",
                   "Mirza Fakhrul Islam Alamgir": "Mirza Fakhrul", "Rahman": "Rahman", "Someone Else": "Someone Else", "": ""}


def test_distinct_names(spark):
    al = dims.aliases([("x1", "Ann"), ("x2", "Bob")])
    df = spark.createDataFrame([(1, ["x2", "ann", "X1", "Bob", "cy"]), (2, [])], "id int, n array<string>")
    got = {r["id"]: r["n"] for r in names.distinct_names(df, "id", "n", al).collect()}
    assert got == {1: ["Bob", "Ann", "cy"], 2: []}


def test_known_entities(one):
    arr = F.array(*[F.lit(x) for x in ("BNP", "tareq rahman", "Tareq", "nobody")])
    assert one([ent.match_known_entity(arr, ["BNP", "Tareq Rahman"])])[0] == ["BNP", "Tareq Rahman"]


def test_unknown_lookups_fail(spark):
    with pytest.raises(ValueError):
        ent.gazetteer_members(spark, GAZ, "Nope", must_exist=True)
    assert ent.gazetteer_members(spark, GAZ, "Nope").count() == 0
    with pytest.raises(ValueError):
        ent.taxonomy_lookup(spark, dims.default_taxonomy(), "Nope")
    assert ent.taxonomy_lookup(spark, dims.default_taxonomy()).count() == 9


def test_keywords(spark):
    df = articles(spark, "Reform reform vote vote vote that budget", "the a", "")
    got = [r["keywords"] for r in keywords_by_frequency(df, 2).orderBy("id").collect()]
    assert got == [["vote", "reform"], [], []]


def test_tfidf_prefers_rare_terms(spark):
    df = articles(spark, "common rare", "common other", "common third")
    top = keywords_tfidf(df, 1, ngrams=(1, 1)).orderBy("id").collect()
    assert [r["keywords_tfidf"] for r in top] == [["rare"], ["other"], ["third"]]
    only = keywords_tfidf(df, 1, ngrams=(1, 1), max_features=1).orderBy("id").collect()
    assert [r["keywords_tfidf"] for r in only] == [["common"]] * 3 and only[0]["keywords_tfidf_scores"] == [1.0]
    alone = keywords_tfidf(df, 3, corpus="self").orderBy("id").first()
    assert alone["keywords_tfidf"] == ["common", "common rare", "rare"]


def test_combined_keeps_short_texts(spark):
    df = articles(spark, "alpha beta beta", " ".join(["word%d" % (i % 6) for i in range(20)]))
    rows = keywords_combined(df, 3).orderBy("id").collect()
    assert rows[0]["keywords_combined"] == ["beta", "alpha"]
    assert len(rows[1]["keywords_combined"]) == 3


def test_key_points(spark):
    t = "He said that the whole plan was wrong. Short said. Nothing was reported in this long sentence. " + "She stated it clearly and loudly too. " * 6
    got = key_points(articles(spark, t)).first()["key_points"]
    assert got[0] == "He said that the whole plan was wrong." and len(got) == 5


def test_categorize(spark):
    lex = dims.lexicon({"Vote": ["election"]})
    df = articles(spark, "Ann Lee of the Alpha Party said and announced on 2024-08-05 that the election is near")
    r = categorize(df, GAZ, lex).first()
    assert r["parties"] == ["A"] and r["people"] == ["Ann Lee"] and r["people_affiliations"] == {"Ann Lee": "A"}
    assert r["dates"] == ["2024-08-05"] and r["is_speech"] and not r["is_stance"]
    assert r["categories"] == ["A", "Speech Analysis", "Vote"] and r["total_categories"] == 3


def test_categorize_with_partial_names(spark):
    gaz = dims.gazetteer({
        "A": {"names": ["Alpha"], "figures": {"Ann Lee": ["Ann Lee", "A. Lee Junior"], "ann lee": ["Annie"], "Bo Tan": ["Bo Tan Sr"]}},
        "B": {"names": ["Beta"], "figures": {"Cy": ["Cyrus Vane"]}},
    })
    other = dims.aliases([("Cyrus Vane", "Dr Cyrus"), ("Annie", "ANN LEE"), ("Bo Tan", "Bo T.")])
    rows = articles(spark, "Annie and Ann Lee", "Junior met Vane.", "Bo Tan Sr, Cyrus Vane", "nobody", "")
    got = {r["id"]: r["people"] for r in categorize(rows, gaz, dims.default_lexicon(), people="partial").collect()}
    assert got == {0: ["Ann Lee"], 1: ["Ann Lee", "Cy"], 2: ["Bo Tan", "Cy"], 3: [], 4: []}
    known = dims.dim_frame(spark, gaz).select("variant")
    raw = ent.tag_people_partial(rows, gaz, out="people")
    for table in (gaz, dims.dim_frame(spark, gaz)):
        mapped, joined = (names.distinct_known_names(raw, "id", "people", known, names.figure_aliases(table), limit) for limit in (100, 0))
        assert sorted(map(tuple, mapped.select("id", "people").collect())) == sorted(map(tuple, joined.select("id", "people").collect()))
    got = {r["id"]: r["people"] for r in categorize(rows, gaz, dims.default_lexicon(), people="partial", aliases=other).collect()}
    assert got[0] == ["ANN LEE"] and got[1][1] == "Dr Cyrus" and got[2] == ["Bo T.", "Dr Cyrus"]
    plan = categorize(rows, gaz, dims.default_lexicon(), people="partial")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    with pytest.raises(ValueError, match="people"):
        categorize(rows, gaz, dims.default_lexicon(), people="other")


def test_partitioning_does_not_change_results(spark):
    df = articles(spark, *TEXTS * 5)
    one, many = (sorted(map(str, keywords_tfidf(ent.tag_entities_word(df.repartition(n), GAZ), 3).collect())) for n in (1, 16))
    assert one == many
