"""References of RFC 3986 against urljoin, and anchors of untidy pages."""

from urllib.parse import urljoin

import duckdb

from tessera.functions import urls
from tessera.operators import links
from tessera.plans import web_sql

BASE = "http://a/b/c/d;p?q"
REFERENCES = (
    "g:h|g|./g|g/|/g|//g|?y|g?y|#s|g#s|g?y#s|;x|g;x|g;x?y#s||.|./|..|../|../g|../..|../../|../../g|../../../g|../../../../g|/./g|/../g"
    "|g.|.g|g..|..g|./../g|./g/.|g/./h|g/../h|g;x=1/./y|g;x=1/../y|g?y/./x|g?y/../x|g#s/./x|g#s/../x|http:g|mailto:x@y|https://q/../r"
)
CASES = [(BASE, r) for r in REFERENCES.split("|")] + [("http://a", r) for r in ("g", "?x", "../g", "")] + [("https://a.b/c/#top", "x")]
PAGE = """<A HREF=x>1</A><a class=b href='y&amp;z' >2</a><a title=" href='no'" href="a>b">3</a><!-- <a href="c"> -->
<script>"<a href='s'>"</script><abbr href="n"><a name=q><a
 href = "&#233;&#x1F600;&bad;&amp;lt;">4</a><a href>5</a><a/href="w"><a href="x">"""
FOUND = ["x", "y&z", "a>b", "é😀&bad;&lt;", "", "w"]


def test_references_as_urljoin(spark):
    rows = spark.createDataFrame([*CASES, (None, "x"), (BASE, None)], "b string, r string")
    got = [r[0] for r in rows.select(urls.resolve("b", "r")).collect()]
    assert got == [urljoin(*c) for c in CASES] + [None, None]


def test_references_in_sql():
    got = [duckdb.execute(f"SELECT {web_sql.resolve('b', 'r')} FROM (SELECT ? AS b, ? AS r)", c).fetchone()[0] for c in CASES]
    assert got == [urljoin(*c) for c in CASES]


def test_anchors_of_untidy_pages(spark):
    rows = spark.createDataFrame([(1, "http://h/p/q", PAGE), (2, "http://h", None), (3, None, "<a href=z>"), (4, "http://h", "")], "page_id long, url string, html string")
    got = links.page_links(rows).collect()
    assert [r["href"] for r in got if r["page_id"] == 1] == FOUND
    assert [r["link"] for r in got if r["page_id"] == 1] == [urljoin("http://h/p/q", h) for h in FOUND]
    assert [tuple(r) for r in got if r["page_id"] != 1] == [(3, None, "z", None)]


def test_hostile_pages_end(spark):
    open_quotes = "<a " + chr(34) * 1_000_001 + "<a href='ok'>"
    many = "<a " + " ".join(f"k{i}='v'" for i in range(100)) + " href=far>"
    dots = "/a" + "/.." * 5000 + "/b"
    rows = spark.createDataFrame([(1, "http://h", open_quotes), (2, "http://h", many), (3, "http://h", f"<a href='{dots}'>"), (4, "http://h", "<!--" * 300_000)], "page_id long, url string, html string")
    assert {(r["page_id"], r["link"]) for r in links.page_links(rows).collect()} == {(1, "http://h/ok"), (2, "http://h/far"), (3, "http://h/b")}


def test_entities(spark):
    texts = ["a&b", "&#65;&#x41;&#55296;&#1114112;&#0;", "&LT;&lt;&&amp;", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(urls.unescape("t")).collect()]
    assert got == ["a&b", "AA&#55296;&#1114112;&#0;", "&LT;<&&", "", None]
