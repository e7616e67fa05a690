"""Verdicts of addresses and their aliases: by hand, by a plain union-find, and by SQL."""

import duckdb
import pytest
from oracle import SF_DIR, same, sorted_rows, sql_rows

pytest.importorskip("tessera.llm")
from urllib.parse import urljoin  # noqa: E402

from tessera.llm import url_filters  # noqa: E402

SCHEMA = "page_id long, url string, html string"
CANON = "<html><head><link rel='canonical' href='{}'></head>"
PAGES = [
    (1, "http://a.net/x", None),  # blocked by net/
    (2, "http://b.org/x", CANON.format("http://a.net/x#part")),  # alias of a blocked page
    (3, "http://www.example.net/en/1", CANON.format("http://b.org/x")),  # allowed by a longer rule, though an alias is blocked
    (4, "https://example.net/de/", ""),
    (5, "HTTP://M.EXAMPLE.COM/de/?q#f", "<p>"),
    (6, "http://c.org/fr/2", CANON.format("http://gone.example.com/de/7")),  # explicit allow; its target is no page
    (7, "http://c.org/en/2", CANON.format("http://gone.example.com/de/7")),
    (8, "http://c.org/en/3", "<META HTTP-EQUIV=Refresh content='0; URL=2'>"),  # two steps from a blocked address
    (9, "http://c.org/en/4", "<!-- <link rel=canonical href='http://a.net/x'> -->"),
    (10, "http://a.net", CANON.format("http://lone.org/")),  # an empty path fits no rule
    (11, "http://notexample.com/de/", None),
    (12, "http://example.com.evil.org/de/", None),
    (13, "no address", CANON.format("http://a.net/x")),
    (14, None, CANON.format("http://a.net/x")),
    (None, "http://b.org/x#again", None),
    (2, "http://b.org/x", CANON.format("http://a.net/x#part")),
    (15, "://", None),
    (16, "http://u@net:80/", None),
    (17, "x/y://net/z://q", None),
]
VERDICTS = {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "block", 8: "block", 9: "allow", 10: "allow", 11: "allow", 12: "allow", 13: "allow", 14: "allow", None: "block", 15: "allow", 16: "allow", 17: "block"}
RULE = {1: "net/", 3: "example.net/en/", 4: "net/", 5: "example.com/de/", 6: "org/fr/", 17: "net/"}


def test_verdicts_by_hand(spark):
    rows = url_filters.judge_pages(spark.createDataFrame(PAGES, SCHEMA)).collect()
    assert len(rows) == len(PAGES)
    assert {(r["page_id"], r["verdict"]) for r in rows} == set(VERDICTS.items())
    assert {r["page_id"]: r["rule"] for r in rows if r["rule"]} == RULE
    of = {r["page_id"]: (r["host"], r["path"]) for r in rows}
    assert of[5] == ("m.example.com", "/de/") and of[13] == of[14] == of[15] == ("", "") and of[17] == ("net", "/z://q")
    assert {r["page_id"] for r in rows if r["alias_verdict"]} == {1, 2, 3, 6, 7, 8, None}


def test_verdicts_in_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    pages = [(99 if p is None else p, *rest) for p, *rest in PAGES]  # pandas would turn ids into floats
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    same(url_filters.judge_pages(spark.createDataFrame(pages, SCHEMA)).toPandas(), con.execute(url_filters.SQL).df())


def test_query_matches_sql(spark):
    same(url_filters.query(spark, SF_DIR).toPandas(), sql_rows(url_filters.SQL))


def test_redirect_logs_in_crowds(spark):
    """A third of all pages points at one address; chains and rings beside it. A union-find judges them too."""
    pages = [(i, f"http://s{i % 7}.org/{i}", None) for i in range(900)]
    logged = [(f"http://s{i % 7}.org/{i}", "http://hub.org/") for i in range(0, 900, 3)]
    logged += [(f"http://s{i % 7}.org/{i}", f"http://s{(i + 3) % 7}.org/{i + 3}") for i in range(1, 300, 3)]
    logged += [("http://s0.org/700", "//x.net/y"), ("http://s0.org/700", "http://s0.org/700"), (None, "http://a.net/"), ("http://s0.org/700", None)]
    logged = [(a, urljoin(a, b) if a and b else b) for a, b in logged] + [("http://s2.org/298", "http://evil.net/")]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in logged:
        if a and b:
            up[root(a)] = root(b)
    bad = {root(x) for x in list(up) if ".net/" in x}
    expect = {i: "block" if root(u) in bad else "allow" for i, u, _ in pages}
    got = url_filters.judge_pages(spark.createDataFrame(pages, SCHEMA), redirects=spark.createDataFrame(logged, "url string, target string"))
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == expect
    assert "block" in expect.values()


def test_hub_is_blocked_with_all_its_aliases(spark):
    pages = [(i, f"http://s.org/{i}", CANON.format("/hub")) for i in range(300)] + [(999, "http://s.org/hub", CANON.format("http://a.net/"))]
    got = url_filters.judge_pages(spark.createDataFrame(pages, SCHEMA))
    assert {r["verdict"] for r in got.collect()} == {"block"}


def test_equal_length_rules_and_own_rules(spark):
    rows = spark.createDataFrame([(1, "http://a.b/c", None), (2, "http://z.b/cd", None), (3, "http://b/", None)], SCHEMA)
    got = url_filters.judge_pages(rows, [("b/c", "block"), ("b/c", "allow"), ("z.b/cd", "block")]).collect()
    assert sorted((r["page_id"], r["verdict"], r["rule"]) for r in got if r["rule"]) == [(1, "allow", "b/c"), (2, "block", "z.b/cd")]


def test_empty_long_and_clashing(spark):
    assert url_filters.judge_pages(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "http://a.net/" + "p" * 300_000
    rows = spark.createDataFrame([(1, long, "<link " * 20_000, "x", "y", "z", "n")], SCHEMA + ", host string, verdict string, component string, node string")
    got = url_filters.judge_pages(rows).collect()
    assert [(r["verdict"], len(r["path"])) for r in got] == [("block", 300_001)]
    assert sorted_rows(url_filters.judge_pages(rows).toPandas())
