"""Web pages: links, site filters, cached copies, and breadth-first traversal of link graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.functions.scalars import age_seconds, col
from tessera.session import discard, settle

def page_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """page_id, url, href and link: the distinct targets of a page's anchors, as written and resolved.

    Anchors in any case and any quotes count, those in comments, scripts and styles do not.
    """
    found = F.array_compact(F.array_distinct(F.transform(urls.tags(html, "a"), lambda tag: urls.attribute(tag, "href"))))
    rows = pages.select("page_id", url, F.explode(found).alias("href"))
    return rows.withColumn("link", urls.resolve(url, "href"))


def inbound(links: DataFrame) -> DataFrame:
    """link and pages: how many pages name each resolved address, each page once."""
    return links.where("link is not null").groupBy("link").agg(F.count_distinct("page_id").alias("pages"))


def same_site(url, base) -> Column:
    """Whether an address is http or https and has the base's host and port."""
    u = col(url)
    return F.coalesce(F.try_parse_url(u, F.lit("AUTHORITY")) == base, F.lit(False)) & F.coalesce(F.try_parse_url(u, F.lit("PROTOCOL")).isin("http", "https"), F.lit(False))


def cache_key(url) -> Column:
    return F.md5(col(url))


def fresh(cache: DataFrame, now: Column, hours: float, at: str = "fetched_at") -> DataFrame:
    """Cached rows not older than so many hours at ``now``."""
    return cache.where(age_seconds(at, now) <= hours * 3600)


def bfs(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """node and depth: the least number of links from a root, up to ``max_depth``.

    Each level is a table in the shared scratch folder, so the lineage stays short. ``edges`` has
    src and dst, ``roots`` has node. Cycles, loops and null ends are harmless.
    """
    frontier = settle(roots.where("node is not null").select("node").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in range(1, max_depth + 1):
        ahead = edges.where("dst is not null").join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = settle(ahead.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.take(1):
            discard(frontier)
            break
        seen = seen.unionByName(frontier)
    return seen
