"""A crawl over pages that are already there, and the choice of pages to fetch again.

The frontier is walked breadth first: each round takes the addresses to visit from a static
table, extracts their links, and queues those that are new, allowed and not blocked, until
enough pages are visited. All of a round's work is joins on addresses.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls
from ..plans.tables import keep

MOST_VISITED, MOST_KNOWN = 5000, 6000


def next_urls(visited: DataFrame, queued: DataFrame, links: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Links (url) that may be queued: cheap tests first, then visited and queued ones, then robots rules."""
    new = links.where(~urls.is_blocked(F.col("url"))).select("url").distinct()
    new = new.join(visited.select("url"), "url", "left_anti").join(queued.select("url"), "url", "left_anti")
    return urls.allowed(new, rules) if rules is not None else new


def crawl(pages: DataFrame, seeds: DataFrame, rules: DataFrame | None = None, most_visited: int = MOST_VISITED, most_known: int = MOST_KNOWN, rounds: int = 50, take: int | None = None, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(visited: url, round; frontier: url) from ``seeds`` (url) over ``pages`` (page_id, url, html).

    ``take`` bounds how many addresses leave the queue in a round; addresses are taken in order of
    the round that queued them, then by name. Addresses without a page are visited and have no links.
    To go on with an earlier crawl, give its frontier as seeds and its visited table as ``before``.
    """
    store = pages.select("page_id", urls.normalize(F.col("url")).alias("url"), "html").dropDuplicates(["url"])
    visited = pages.sparkSession.createDataFrame([], "url string, round int") if before is None else before.select("url", "round")
    start = seeds.select(urls.normalize(F.col("url")).alias("url")).distinct().join(visited.select("url"), "url", "left_anti")
    frontier = keep(start.withColumn("queued", F.lit(0)), "frontier")
    n_visited, first, n_queued = *visited.agg(F.count("*"), F.coalesce(F.max("round") + 1, F.lit(0))).first(), frontier.count()
    for number in range(first, first + rounds):
        room = min(most_visited - n_visited, take or n_queued, n_queued)
        if room <= 0:
            break
        now = keep(frontier.orderBy("queued", "url").limit(room), "visiting")
        visited = keep(visited.unionByName(now.select("url", F.lit(number).alias("round"))), "visited")
        rest = frontier.join(now.select("url"), "url", "left_anti")
        # links are made absolute by the page's own address
        found = html.links(html.parsed(store.join(now.select("url"), "url", "left_semi").select("page_id", "url", "html"), resolve=True)).where(F.col("url").startswith("http"))
        new = next_urls(visited, rest, found, rules).orderBy("url")
        n_visited += room
        new = new.limit(max(0, most_known - n_visited - (n_queued - room)))
        frontier = keep(rest.unionByName(new.withColumn("queued", F.lit(number + 1))), "frontier")
        n_queued = frontier.count()
    return visited, frontier.select("url")


def to_fetch_again(pages: DataFrame, now: datetime, after_hours: int = 1) -> DataFrame:
    """Pages (with last_modified, null if unknown) changed since they were fetched, or of unknown age and fetched long ago."""
    old = F.col("crawled_time") < F.lit(now) - F.expr(f"INTERVAL {after_hours} HOUR")
    return pages.where(F.when(F.col("last_modified").isNotNull(), F.col("last_modified") > F.col("crawled_time")).otherwise(old))


def refreshed(pages: DataFrame, fetched: DataFrame, key: str = "url") -> DataFrame:
    """Pages with the new html and crawled_time of those fetched again (key, html, crawled_time; each key once).

    Where pages share an address but differ, say by user, ``key`` is ``page_id``.
    """
    new = fetched.select(key, F.col("html").alias("_html"), F.col("crawled_time").alias("_time"))
    out = pages.join(new, key, "left")
    return out.withColumn("html", F.coalesce("_html", "html")).withColumn("crawled_time", F.coalesce("_time", "crawled_time")).select(*pages.columns)
