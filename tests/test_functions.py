import datetime as dt

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import arrays, dates, text
from broadsheet.functions.vectors import check_metric, similarity


def test_document_text_strips(one):
    assert one([text.document_text("t", "c")], t=" A", c="b \n")[0] == "A\n\nb"
    assert one([text.document_text("t", "c", " ")], t="A", c="b")[0] == "A b"


def test_language_block(one):
    assert one([text.detect_language("t")], t="hello নির্বাচন")[0] == "Bangla"
    assert one([text.detect_language("t")], t="x" * 500 + "নির্বাচন")[0] == "Bangla"
    assert one([text.detect_language("t", head=500)], t="x" * 500 + "নির্বাচন")[0] == "English"


def test_clean_text(one):
    got = one([text.clean_text("t")], t="See http://a.b/c?d  mail me@x.org, now! নির্বাচন কমিশন")[0]
    assert got == "See mail now নির্বাচন কমিশন"


def test_preview_only_when_longer(one):
    assert one([text.preview("t", 3)], t="abc")[0] == "abc"
    assert one([text.preview("t", 3)], t="abcd")[0] == "abc..."
    assert one([text.preview("t", 3, always=True)], t="ab")[0] == "ab..."


@pytest.mark.parametrize("n,kept", [(99, None), (100, "s"), (101, "f")])
def test_prefer_full_content_boundary(one, n, kept):
    full, short = "f" * n, "s" * 100
    got = one([text.prefer_full_content("f", "s")], f=full, s=short if n != 99 else "s" * 99)[0]
    assert (got[0] if got else None) == kept


def test_strip_boilerplate(one):
    got = one([text.strip_boilerplate("t", ["AD.*?END"], "MARK", "TAIL")], t="xx MARK a AD b\nc END  d\n\n\ne TAIL f MARK")[0]
    assert got == "a d\ne"


def test_boilerplate_head_marker_after_200_chars_stays(one):
    t = "y" * 201 + "MARK z"
    assert one([text.strip_boilerplate("t", [], "MARK", None)], t=t)[0] == t


def test_resolve_url(one):
    c = [text.resolve_url("https://n.example/", h) for h in ("a", "b", "c", "d", "e")]
    got = one(c, a="/p", b="//q.r/s", c="https://x/y", d="http://x/y", e="rel")
    assert tuple(got) == ("https://n.example/p", "https://q.r/s", "https://x/y", None, None)


def test_url_domain(one):
    assert tuple(one([text.url_domain("u"), text.url_domain("v")], u="https://www.a.example:80/x", v="not a url")) == ("a.example", None)


def test_locate_excerpt(one):
    body = "The  quick brown\nfox jumps over the lazy dog and runs far away from it"
    c = [text.locate_excerpt("b", e) for e in ("e", "f", "g", "h")]
    got = one(c, b=body, e='"quick brown fox"', f="QUICK brown fox jumps", g="short", h="quick brown fox jumps over the lazy cat")
    assert got[0].asDict() == {"start": 5, "length": 15, "whole": True}
    assert got[1].asDict() == {"start": 5, "length": 21, "whole": False}
    assert got[2] is None
    assert got[3].asDict() == {"start": 5, "length": 39, "whole": False}  # found by its first 25 characters


def test_lists(one):
    got = one([arrays.split_list("a"), arrays.split_list("b"), arrays.join_list(arrays.split_list("a"), 2)], a=" x, ,y ,z", b=None)
    assert (got[0], got[1], got[2]) == (["x", "y", "z"], [], "x, y")


def test_parse_affiliations_bad_json(one):
    c = [arrays.parse_affiliations(x) for x in ("a", "b", "c")]
    assert tuple(one(c, a='{"x": "P"}', b='{"x": ', c=None)) == ({"x": "P"}, {}, {})


def test_distinct_ci(one):
    assert one([arrays.distinct_ci(F.array(*[F.lit(x) for x in ("Bb", "a", "bB", "A")]))])[0] == ["Bb", "a"]


def test_extract_dates(one):
    t = "On 2024-02-31, 5/8/2024, August 5, 2024, 6 august 2024; not 1899-01-01, 2024-13-01 or 12024-01-01. ১৫-০৮-২০২৪"
    assert one([dates.extract_dates("t")], t=t)[0] == ["2024-02-31", "2024-08-05", "2024-08-06", "2024-08-15"]


def test_multi_format_dates(one):
    c = [dates.parse_multi_format_date(F.lit(x)) for x in ("2024-12-31", "31-12-2024", "2024/12/31", "31/12/2024", "2024-02-31", "December 31, 2024")]
    assert list(one(c)) == [dt.date(2024, 12, 31)] * 4 + [None, None]


def test_month_chunks_clip(spark):
    rows = [tuple(r) for r in dates.month_chunks(spark, "2024-11-20", "2025-01-05").collect()]
    assert rows == [(dt.date(2024, 11, 20), dt.date(2024, 11, 30)), (dt.date(2024, 12, 1), dt.date(2024, 12, 31)),
                    (dt.date(2025, 1, 1), dt.date(2025, 1, 5))]
    assert dates.day_series(spark, "2024-02-28", "2024-03-01").count() == 3


def test_recency_steps(one):
    now = F.lit(dt.date(2025, 1, 31))
    ages = [7, 8, 30, 31, 90, 91, 180, 181]
    got = one([dates.recency_score(F.date_sub(now, a), now) for a in ages])
    assert list(got) == [1.0, .8, .8, .6, .6, .4, .4, .2]
    got = one([dates.recency_score(F.date_sub(now, a), now, 20) for a in (20, 40, 41)] + [dates.recency_score(F.lit(None).cast("date"), now)])
    assert list(got) == [1.0, .7, .6, .5]


def test_bad_bound_is_an_error():
    with pytest.raises(ValueError):
        dates.check_bound("31/12/2024")


def test_similarity_metrics(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(*[similarity("a", "b", m) for m in ("cosine", "dot", "euclidean")]).collect()
    assert got[0][0] == pytest.approx(24 / 25) and got[0][1] == pytest.approx(24) and got[0][2] == pytest.approx(1 / (1 + 2**.5))
    assert got[1][0] is None and got[2][0] is None
    with pytest.raises(ValueError):
        check_metric("manhattan")
