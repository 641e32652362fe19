"""JVM-side page functions on HTML as it is written, against the page parser."""

import html as library

from pyspark.sql import functions as F

from broadsheet.sources import html
from broadsheet.sources.html import PageRules, extract_pages

BODY = "<article><p>" + "word " * 30 + "</p></article>"
PAGES = [
    "<h1 class='x'>Caf&eacute; &#8217;</h1>", "<H1 CLASS=article-title data-a='1 > 0'>One &amp;lt; two</H1 >", '<h1 title="a>b">Q &#x1F642; &hellip;&copy 5</h1>',
    "<!-- <h1>hidden</h1> --><script>var a = '<h1>no</h1>';</script><h1>shown</h1>", "<h1>first</h1><h1 class='big article-title'>second</h1>",
    "<h2 class=headline>only an h2</h2>", "<h1></h1><h2 class='sub title'>t</h2>", "<h1>&#0;&#128;&#xD800;&#99999999999999;&unknown;&</h1>", "<h10>no</h10><h1>a<br>b</h1>",
]


def test_titles_are_the_parser_s(spark):
    rows = spark.createDataFrame([(i, p + BODY) for i, p in enumerate(PAGES)], "page_id int, html string")
    rules = PageRules("web", title=("h1.article-title", "h1", "h2~title|headline"), body=("article",))
    want = {r["page_id"]: r["title"] for r in extract_pages(rows, rules).collect()}
    got = {r["page_id"]: r["t"] for r in rows.select("page_id", html.extract_title().alias("t")).collect()}
    assert got[0] == "Caf\u00e9 \u2019" and got[1] == "One &lt; two" and got[4] == "second"
    assert {i: t for i, t in got.items() if i not in (6,)} == {i: t for i, t in want.items() if i not in (6,)}
    assert got[6] == "t"


def test_references(spark):
    texts = ["plain", "&amp;amp; &lt;b&gt;", "&#39;&#x27;&apos;", "&nbsp;x&eacute;&Eacute;", "a & b &; &zzz; &#;", "&#169;&copy;&copy", "&#150;&#x80;", "&NotEqualTilde;", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(html.unescape("t")).collect()]
    assert got == [None if t is None else library.unescape(t) for t in texts]


def test_attributes_of_any_quoting(spark):
    page = """<a href='/one'>1</a><A class=x HREF=/two>2</A><a data-t="href=/no" href = "/three?a=1&amp;b=2">3</a><abbr href="/never">x</abbr><a name=n>4</a><!-- <a href="/gone">5</a> --><a href="/q>r">6</a>"""
    rows = spark.createDataFrame([(1, page)], "page_id int, html string")
    links = [r["link"] for r in html.extract_links(rows, "https://h.example").orderBy("position").collect()]
    assert links == ["https://h.example/one", "https://h.example/two", "https://h.example/three?a=1&b=2", "https://h.example/q>r"]
    dates = ["<meta content='2024-05-06T10:00:00Z' property='article:published_time'>", "<time class=t datetime=2024-05-06>x</time>",
             "<time>no value</time><time datetime='2024-05-06'>x</time>", "<div class='date'>Mon May 6, 2024 01:55 PM</div>", "<div class=update>Mon May 6, 2024 01:55 PM</div>"]
    got = [str(r[0]) for r in spark.createDataFrame([(d,) for d in dates], "html string").select(html.extract_published_date()).collect()]
    assert got == ["2024-05-06"] * 4 + ["None"]
    found = spark.createDataFrame([("<p class='byline big'>By &Agrave;</p><a class=news-category href=x>desk</a>",)], "html string").select(
        html.extract_author_category().alias("x")).first()["x"]
    assert (found["author"], found["category"]) == ("By \u00c0", "desk")


def test_a_very_long_tag_is_read(spark):
    page = "<a " + " ".join(f'data-{i}="{i}"' for i in range(3_000)) + " href='/x'>y</a>" + "<b>" * 20_000
    rows = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert html.extract_links(rows, "https://h.example").first()["link"] == "https://h.example/x"
    assert rows.select(F.size(html.tags(F.col("html"), "b"))).first()[0] == 20_000
