"""The link graph of crawled pages: nodes, edges, depth, loops, robots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import scalars as S
from siteloom.functions import urls as U

from .ranking import running
from .staging import staged

LOOP_URLS, LOOP_DEPTHS = 25, 4
#: The href of an anchor, quoted or not.
ANCHOR = r"(?i)<a\s[^>]*?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
#: What a reader never sees as markup: comments, scripts and styles, to their end or that of the page.
UNSEEN = r"(?is)<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)"
SCHEMES = r"(?i)^\s*(#|javascript:|mailto:|tel:|data:|sms:)"


def links(pages: DataFrame) -> DataFrame:
    """src, href of every link to a page of the same site, once for each page."""
    shown = F.regexp_replace("html", UNSEEN, " ")
    found = pages.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all(shown, F.lit(ANCHOR), F.lit(1))).alias("raw"))
    found = found.select("src", U.unescape_markup(F.regexp_replace("raw", "^[\"']|[\"']$", "")).alias("raw"))
    found = found.distinct()  # links that repeat on a page; also deals what few files hold over the tasks
    usable = found.where(~F.col("raw").rlike(SCHEMES) & (F.trim("raw") != ""))
    made = usable.select("src", U.join_href(F.col("raw"), F.col("src")).alias("href"))
    here = made.where(F.col("href").rlike("(?i)^https?://") & U.same_site(F.col("src"), F.col("href")) & U.is_crawlable("href"))
    return here.distinct()


def refusal(url: Column) -> Column:
    """Why an address is not admitted, null if it is."""
    return (
        F.when(~U.is_crawlable(url), "media").when(U.is_spider_trap(url), "trap").when(U.is_malformed(url), "malformed")
    )


def merge_sources(found: DataFrame) -> DataFrame:
    """One node per normal address from rows url, ord, source (sitemap, link, cms), depth and,
    if they are there, ``sitemap_source`` and ``cms_record``, of which the first is kept."""
    source = F.col("source")
    kept = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in ("sitemap_source", "cms_record") if c in found.columns]
    return found.groupBy(U.normalize_url("url").alias("key")).agg(
        F.min_by("url", "ord").alias("url"),
        F.bool_or(source == "sitemap").alias("in_sitemap"),
        F.bool_or(source == "link").alias("in_links"),
        F.bool_or(source == "cms").alias("in_cms"),
        F.min("depth").alias("depth"),
        F.min("ord").alias("ord"),
        *kept,
    )


def within_budget(nodes: DataFrame, most: int, reserve: float = 0.2) -> DataFrame:
    """The page budget (the feature), with ``slot``, listed or linked: sitemap and CMS pages
    leave ``reserve`` of it to pages that links found, listed ones that had no room among
    them.  Ranks are distributed, so no task orders all nodes, however large the budget."""
    order = [F.col("ord").asc(), F.col("key").asc()]
    listed = running(nodes.where("in_sitemap or in_cms"), [], order).where(F.col("rank") <= most - held_back(most, reserve))
    listed = staged(listed.drop("rank").withColumn("slot", F.lit("listed")))
    room = most - listed.count()
    rest = nodes.where("in_links").join(listed.select("key"), "key", "left_anti").select(*nodes.columns)
    linked = running(rest, [], order).where(F.col("rank") <= room).drop("rank").withColumn("slot", F.lit("linked"))
    return listed.union(linked)


def held_back(most: int, reserve: float) -> int:
    """Pages of the budget that only links may fill; one at least is for the others."""
    return min(int(most * max(0.0, min(reserve, 0.9))), most - 1)


def budget_report(nodes: DataFrame, kept: DataFrame, most: int, reserve: float = 0.2) -> DataFrame:
    """One row: nodes, admitted pages, how many were left out, whether any was, the pages
    held back for links, and how many of these links used."""
    held = held_back(most, reserve)
    used = kept.agg(F.count(F.lit(1)).alias("admitted"), F.count_if(F.col("slot") == "linked").alias("linked"))
    rows = nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(used)  # one row each
    return rows.select(
        "nodes",
        "admitted",
        (F.col("nodes") - F.col("admitted")).alias("left_out"),
        (F.col("nodes") > F.col("admitted")).alias("truncated"),
        F.lit(held).cast("long").alias("reserved"),
        F.least("linked", F.lit(held)).cast("long").alias("reserve_used"),
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Inbound links (distinct hrefs of each page) and outbound links."""
    inbound = edges.groupBy(U.normalize_url("href").alias("key")).agg(F.count("*").alias("inbound"))
    outbound = edges.groupBy(U.normalize_url("src").alias("key")).agg(F.count("*").alias("outbound"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.join(inbound, "key", "left").join(outbound, "key", "left").select(*nodes.columns, zero("inbound"), zero("outbound"))


def bfs(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """key, depth: levels from the roots over edges (src, dst), to the last that is
    reached or to ``most``.  Filtered listings (facets) are reached but not expanded.

    One join a level; what has been visited is staged, so plans stay short.
    """
    edges = edges.where(~U.is_faceted("src"))
    seen = staged(roots.select("key", F.lit(0).alias("depth")).distinct())
    frontier, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        step = edges.join(frontier.select(F.col("key").alias("src")), "src", "left_semi").select(F.col("dst").alias("key")).distinct()
        frontier = staged(step.join(seen, "key", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = staged(seen.union(frontier))
    return seen


def loops(urls: DataFrame, least: int = LOOP_URLS, depths: int = LOOP_DEPTHS) -> DataFrame:
    """Path tails that many addresses of several depths end in."""
    tails = urls.select("url", U.tail_of("url").alias("t")).where("t is not null").select("url", "t.*")
    return tails.groupBy("tail").agg(F.countDistinct("url").alias("urls"), F.countDistinct("depth").alias("depths")).where(
        (F.col("urls") >= least) & (F.col("depths") >= depths)
    )


def evidence(nodes: DataFrame, bodies: DataFrame, crumbs: DataFrame, degrees_: DataFrame) -> DataFrame:
    """What classification sees of each node (key, url and its sources): its body (key,
    html), its breadcrumb labels (url, labels), its links (key, inbound, outbound) and
    the size of the crawl."""
    size = nodes.agg(F.count("*").alias("total_pages"))
    none = F.array().cast("array<string>")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = nodes.join(bodies, "key", "left").join(degrees_.select("key", "inbound", "outbound"), "key", "left").join(crumbs, "url", "left")
    return joined.crossJoin(F.broadcast(size)).select(  # one row
        *nodes.columns, "html", F.coalesce("labels", none).alias("breadcrumb"), zero("inbound"), zero("outbound"), "total_pages"
    )


def site_profiles(probes: DataFrame) -> DataFrame:
    """site, family, client_side, has_catalogue, locales from stored probes (site, path,
    status, body): what answers with JSON, what the home page is made of, and the
    first folders of the sitemaps that robots.txt names."""
    ok = (F.col("status") == 200) & (F.trim("body") != "")
    json = ok & F.coalesce(F.json_array_length("body").isNotNull() | F.json_object_keys("body").isNotNull(), F.lit(False))
    at = lambda *paths: F.col("path").isin(*paths)
    maps = F.when(at("/robots.txt") & ok, F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1)))
    found = F.filter(F.transform(maps, lambda u: U.locale_of(u)), lambda x: x.isNotNull())
    by = probes.groupBy("site").agg(
        F.bool_or(at("/wp-json/wp/v2/types") & json).alias("wordpress"),
        F.bool_or(at("/products.json", "/collections.json") & json).alias("has_catalogue"),
        F.bool_or(at("/") & ok & S.is_client_rendered(F.col("body"))).alias("client_side"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(found)))).alias("locales"),
    )
    return by.select("site", S.cms_family(F.col("wordpress"), F.col("has_catalogue"), F.col("client_side")).alias("family"), "client_side", "has_catalogue", "locales")


def report(nodes: DataFrame) -> DataFrame:
    n = F.count_if
    return nodes.agg(
        F.count("*").alias("nodes"),
        n("in_sitemap").alias("from_sitemap"),
        n("in_links").alias("from_links"),
        n("in_cms").alias("from_cms"),
        n(F.expr("in_sitemap and not in_links and not in_cms")).alias("sitemap_only"),
        n(F.expr("in_links and not in_sitemap and not in_cms")).alias("links_only"),
        n(F.expr("inbound = 0")).alias("orphans"),
    )


def first_of_each(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("_nr", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_nr = 1").drop("_nr")
