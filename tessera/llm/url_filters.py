"""Block and allow rules for pages, carried to aliases by redirect equivalence.

A rule judges the addresses that it fits; the longest wins. Redirects and canonical links tie addresses
together: connected components over these edges are aliases of one another, and an address without
a rule of its own is blocked with any alias that a rule blocks. A rule that allows an address
explicitly goes before what its aliases say.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.functions.scalars import col
from tessera.llm.components import components
from tessera.plans import web_sql
from tessera.session import settle

#: The rules of the query: what matches is blocked or allowed.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pages that hold a tie at all; others are not looked through.
MAY_TIE = r"(?i)canonical|http-equiv"
#: A refresh within a page's head: seconds, then the address.
REFRESH = r"""(?is)^\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?["']?([^"']*)"""


def _rest(url) -> Column:
    """What follows the first ://; empty without one."""
    u = F.coalesce(col(url), F.lit(""))
    at = F.locate("://", u)
    return F.when(at > 0, F.substr(u, at + 3)).otherwise("")


def host(url) -> Column:
    """Between the first :// and the next /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def address(url) -> Column:
    """An address without its fragment, which names a place on the same page; null without ://."""
    u = col(url)
    return F.when(F.contains(u, F.lit("://")), F.regexp_replace(u, r"(?s)#.*$", ""))


def fitting(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does. Of equally long ones, allow goes first.

    A rule is a host and a path: it fits its host and all subdomains where the path starts with the
    rule's. The rules are few and part of the plan.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[1] != "allow", r[0]))
    cases = []
    for rule, verdict in ordered:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        cases.append((fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), none)


def ties(pages: DataFrame) -> DataFrame:
    """(url, target): what a page's canonical link and its refresh name, resolved against its address.

    Null pages and addresses give none; every such tag counts, outside comments, scripts and styles.
    """
    tag = pages.where(F.col("html").rlike(MAY_TIE)).select("url", F.explode(urls.tags("html", "link", "meta")).alias("tag"))
    canonical = F.when(F.array_contains(F.split(F.lower(urls.attribute("tag", "rel")), r"\s+"), "canonical"), urls.attribute("tag", "href"))
    refresh = F.when(F.lower(F.btrim(urls.attribute("tag", "http-equiv"))) == "refresh", F.nullif(F.regexp_extract(urls.attribute("tag", "content"), REFRESH, 1), F.lit("")))
    named = tag.select("url", F.coalesce(canonical, refresh).alias("reference")).where("reference is not null")
    return named.select("url", urls.resolve("url", "reference").alias("target"))


def judge_pages(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_verdict for every page.

    ``redirects`` are further ties (url, target), as a crawler logs them. alias_verdict is block where
    an alias is blocked by a rule, whether that alias is a page of the table or not, and else null.
    Null addresses and those without :// have empty host and path, fit no rule, have no alias and
    are allowed. Repeated rows are judged alike, ids may be null, empty tables give no rows, columns
    other than page_id, url and html are ignored.
    """
    rules = list(rules)
    edges = ties(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "target"))
    edges = edges.select(address("url").alias("a"), address("target").alias("b")).where("a <> b")
    # an address is long, its digest is not, and no two are met that share one
    key = lambda c: F.unhex(F.sha2(F.col(c), 256))
    edges = settle(edges.select("a", "b", key("a").alias("a_key"), key("b").alias("b_key")).distinct())
    ends = edges.select(F.col("a").alias("url"), F.col("a_key").alias("node")).unionByName(edges.select(F.col("b").alias("url"), F.col("b_key").alias("node")))
    blocked = ends.where(fitting(host("url"), path("url"), rules)["verdict"] == "block").select("node").distinct()
    member = settle(components(edges.select("a_key", "b_key"), "a_key", "b_key", "binary"))
    struck = member.join(blocked, "node").select("component").distinct()
    caught = member.join(struck, "component", "left_semi").select("node", F.lit("block").alias("alias_verdict"))

    own = pages.select("page_id", "url", host("url").alias("host"), path("url").alias("path"))
    own = own.withColumn("fit", fitting(F.col("host"), F.col("path"), rules)).withColumn("node", F.unhex(F.sha2(address("url"), 256)))
    judged = own.join(caught, "node", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.col("alias_verdict"), F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "alias_verdict")


def _fitting_sql(url: str, rules: Iterable[tuple[str, str]], give: int) -> str:
    """The rule (0) or the verdict (1) of the longest rule that fits."""
    h, p = f"({_HOST.format(url)})", f"({_PATH.format(url)})"
    cases = [f"WHEN (('.' || {h}) LIKE '%.{n}' AND starts_with({p}, '/{rest}')) THEN '{(n + '/' + rest, v)[give]}'" for n, _, rest, v in ((*r.partition("/"), v) for r, v in sorted(rules, key=lambda r: (-len(r[0]), r[1] != "allow", r[0])))]
    return f"CASE {' '.join(cases)} END"


_REST = "CASE WHEN contains(coalesce({0}, ''), '://') THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
_HOST = f"translate(regexp_extract({_REST}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
_PATH = f"regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1)"
_ADDRESS = "CASE WHEN contains({0}, '://') THEN regexp_replace({0}, '#.*$', '', 's') END"
_NAMED = f"""CASE WHEN list_contains(string_split_regex(lower({web_sql.attribute("tag", "rel")}), '\\s+'), 'canonical') THEN {web_sql.attribute("tag", "href")}
 WHEN lower(trim({web_sql.attribute("tag", "http-equiv")})) = 'refresh' THEN nullif(regexp_extract({web_sql.attribute("tag", "content")}, '{REFRESH.replace("'", "''")}', 1), '') END"""
SQL = f"""WITH RECURSIVE tag AS (SELECT url, unnest({web_sql.tags("html", "link", "meta")}) AS tag FROM pages),
named AS (SELECT url, {_NAMED} AS reference FROM tag),
target AS (SELECT url, {web_sql.resolve("url", "reference")} AS target FROM named WHERE reference IS NOT NULL),
tie AS (SELECT DISTINCT {_ADDRESS.format("url")} AS a, {_ADDRESS.format("target")} AS b FROM target),
both_ways AS (SELECT a, b FROM tie WHERE a <> b UNION SELECT b, a FROM tie WHERE a <> b),
struck AS (SELECT a AS node FROM both_ways WHERE {_fitting_sql("a", RULES, 1)} = 'block' UNION SELECT b FROM struck JOIN both_ways ON a = node),
own AS (SELECT page_id, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path, {_fitting_sql("url", RULES, 0)} AS rule, {_fitting_sql("url", RULES, 1)} AS own_verdict, {_ADDRESS.format("url")} AS address FROM pages)
SELECT page_id, host, path, rule, coalesce(own_verdict, CASE WHEN node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN node IS NOT NULL THEN 'block' END AS alias_verdict
FROM own LEFT JOIN struck ON address = node"""


def query(spark, sf_dir: str) -> DataFrame:
    return judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
