"""Site-audit inputs derived from the driver's tables.

All are arithmetic on ``page_id`` and expressions on ``url`` and ``html``, so
the SQL in ``VIEWS`` says the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import urls as U

TYPES = ["PRODUCT_DETAIL_PAGE", "PRODUCT_CATEGORY_HUB", "SERVICE_DETAIL_PAGE", "BLOG_ARTICLE", "COMPANY_ABOUT", "CASE_STUDY", "UNKNOWN"]
LEVELS = ["L3_LEAF_PAGE", "L2_SUB_NAV_HUB", "L3_LEAF_PAGE", "L1_PRIMARY_NAV_HUB"]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs, three quarters of them spelled in another way."""
    p = pages(spark, sf_dir)
    bare = F.regexp_replace("url", "[?#].*$", "")
    host = F.regexp_replace(bare, "^(https?://)", "")
    url = (
        F.when(F.col("page_id") % 4 == 1, F.concat(F.lit("HTTP://www."), host, F.lit("?b=2&utm_source=x&a=1#f")))
        .when(F.col("page_id") % 4 == 2, F.concat(bare, F.lit("//Widgets/a-b_c.PDF?sort=up&gclid=1")))
        .when(F.col("page_id") % 4 == 3, F.concat(bare, F.lit("/list/page/2/list/?A=1&b=&c=3&d=4&e=5&f=6")))
        .otherwise(F.col("url"))
    )
    return p.select("page_id", url.alias("url"))


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified pages, every fifth also under a second spelling with a deeper
    trail, every seventh with another page's address as canonical."""
    i = F.col("page_id")
    base = pages(spark, sf_dir)
    host, path = U.host_of("url"), U.path_of("url")
    first = F.coalesce(F.get(U.segments_of(path), F.lit(0)), F.lit("home"))
    label = F.substring_index(host, ".", 1)
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    own = base.select(
        i.alias("page_id"),
        (i * 2).alias("ord"),
        "url",
        F.when(i % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(label, first)).alias("trail"),
    )
    again = base.where(i % 5 == 0).select(
        i.alias("page_id"),
        (i * 2 + 1).alias("ord"),
        F.concat(F.lit("http://www."), F.upper(host), path, F.lit("?utm_source=x")).alias("url"),
        F.array(label, first, F.lit("copies")).alias("trail"),
    )
    both = own.unionByName(again)
    return both.select(
        "page_id",
        "ord",
        "url",
        "trail",
        F.when(i % 7 == 0, F.concat(F.lit("https://canon.example.com/p/"), (i % 3).cast("string"))).otherwise(F.col("url")).alias("canonical_url"),
        F.when(i % 11 == 0, F.concat(F.lit("https://moved.example.com/"), i.cast("string"))).otherwise(F.col("url")).alias("final_url"),
        (i * 11 % 23).alias("inbound"),
        pick(TYPES, i).alias("page_type"),
        pick(LEVELS, i).alias("level"),
        ((i * 13 % 101) / F.lit(100.0)).alias("score"),
        (i % 3 == 0).alias("in_sitemap"),
        (i % 4 == 0).alias("in_links"),
        (i % 5 == 0).alias("in_cms"),
    )


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl that missed every other page holds: gaps are what resolution and
    reconciliation are about."""
    return crawl(spark, sf_dir).where("page_id % 2 = 0")


def gsc(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    clicks = i * 37 % 211
    return pages(spark, sf_dir).select(
        i.alias("ord"), "url", clicks.alias("clicks"), (clicks * 13 + i % 97).alias("impressions"), (1 + i % 40).cast("double").alias("position")
    )


def ga4(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    return pages(spark, sf_dir).where(i % 3 == 0).select(i.alias("ord"), U.path_of("url").alias("path"), (i * 17 % 301).alias("sessions"))


def frog(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    return (
        pages(spark, sf_dir)
        .where(i % 3 != 0)
        .select(
            i.alias("ord"),
            "url",
            F.when(i % 11 == 0, 301).when(i % 11 == 1, 404).when(i % 11 == 2, 0).otherwise(200).alias("status"),
            (i % 7 != 0).alias("indexable"),
            (i % 19).alias("inlinks"),
        )
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand labels of crawled pages and some that were not crawled."""
    i = F.col("page_id")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    return pages(spark, sf_dir).where(i % 3 == 0).select(
        i.alias("page_id"),
        F.concat(F.lit("archetype"), (i % 6).cast("string")).alias("archetype"),
        pick(TYPES[:5], i).alias("want_type"),
        pick(LEVELS, i + (i % 9 == 0).cast("int")).alias("want_level"),
    )


# --- the same in DuckDB ---------------------------------------------------
SEGS = "list_filter(string_split({0}, '/'), lambda s: s <> '')"


def sql_segs(path: str) -> str:
    return SEGS.format(path)


def sql_path(u: str) -> str:
    return rf"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def sql_netloc(u: str) -> str:
    return rf"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def sql_query(u: str) -> str:
    return rf"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


def sql_host(u: str) -> str:
    return rf"regexp_replace(split_part(lower({sql_netloc(u)}), ':', 1), '^www\.', '')"


def sql_norm_path(p: str) -> str:
    s = sql_segs(p)
    return f"CASE WHEN len({s}) = 0 THEN '/' ELSE '/' || lower(array_to_string({s}, '/')) || '/' END"


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def sql_pairs(q: str) -> str:
    prefixes = "|".join(U.TRACKING_PREFIXES)
    name = "lower(split_part(x, '=', 1))"
    return f"list_filter(string_split({q}, '&'), lambda x: x <> '' AND NOT ({name} IN {_in(U.TRACKING)} OR regexp_matches({name}, '^({prefixes})')))"


def sql_sorted_query(u: str) -> str:
    return f"array_to_string(list_sort(list_transform({sql_pairs(sql_query(u))}, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)), '&')"


def sql_norm_url(u: str) -> str:
    q = sql_sorted_query(u)
    host = rf"regexp_replace(lower({sql_netloc(u)}), '^www\.', '')"
    return f"('https://' || {host} || {sql_norm_path(sql_path(u))} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"


def sql_path_key(u: str) -> str:
    q = sql_sorted_query(u)
    return f"({sql_norm_path(sql_path(u))} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"


def sql_pick(names: list[str], n: str) -> str:
    return f"list_extract([{', '.join(repr(x) for x in names)}], CAST(({n}) % {len(names)} AS INTEGER) + 1)"


VIEWS = {
    "spelled": r"""SELECT page_id, CASE page_id % 4
  WHEN 1 THEN 'HTTP://www.' || regexp_replace(regexp_replace(url, '[?#].*$', ''), '^(https?://)', '') || '?b=2&utm_source=x&a=1#f'
  WHEN 2 THEN regexp_replace(url, '[?#].*$', '') || '//Widgets/a-b_c.PDF?sort=up&gclid=1'
  WHEN 3 THEN regexp_replace(url, '[?#].*$', '') || '/list/page/2/list/?A=1&b=&c=3&d=4&e=5&f=6'
  ELSE url END AS url FROM pages""",
    "crawl": f"""SELECT page_id, ord, url, trail,
  CASE WHEN page_id % 7 = 0 THEN 'https://canon.example.com/p/' || (page_id % 3) ELSE url END AS canonical_url,
  CASE WHEN page_id % 11 = 0 THEN 'https://moved.example.com/' || page_id ELSE url END AS final_url,
  page_id * 11 % 23 AS inbound, {sql_pick(TYPES, "page_id")} AS page_type, {sql_pick(LEVELS, "page_id")} AS level,
  (page_id * 13 % 101) / 100.0::DOUBLE AS score, page_id % 3 = 0 AS in_sitemap, page_id % 4 = 0 AS in_links, page_id % 5 = 0 AS in_cms
  FROM (
    SELECT page_id, page_id * 2 AS ord, url, CASE WHEN page_id % 10 = 0 THEN CAST([] AS VARCHAR[]) ELSE [label, first] END AS trail FROM src
    UNION ALL
    SELECT page_id, page_id * 2 + 1, 'http://www.' || upper(host) || path || '?utm_source=x', [label, first, 'copies'] FROM src WHERE page_id % 5 = 0
  )""",
    "src": f"""SELECT page_id, url, {sql_host("url")} AS host, {sql_path("url")} AS path,
  split_part({sql_host("url")}, '.', 1) AS label, coalesce(list_extract({sql_segs(sql_path("url"))}, 1), 'home') AS first
  FROM pages""",
    "crawled": "SELECT * FROM crawl WHERE page_id % 2 = 0",
    "gsc": """SELECT page_id AS ord, url, page_id * 37 % 211 AS clicks, (page_id * 37 % 211) * 13 + page_id % 97 AS impressions,
  CAST(1 + page_id % 40 AS DOUBLE) AS position FROM pages""",
    "ga4": f"SELECT page_id AS ord, {sql_path('url')} AS path, page_id * 17 % 301 AS sessions FROM pages WHERE page_id % 3 = 0",
    "frog": """SELECT page_id AS ord, url, CASE page_id % 11 WHEN 0 THEN 301 WHEN 1 THEN 404 WHEN 2 THEN 0 ELSE 200 END AS status,
  page_id % 7 <> 0 AS indexable, page_id % 19 AS inlinks FROM pages WHERE page_id % 3 <> 0""",
    "labelled": f"""SELECT page_id, 'archetype' || (page_id % 6) AS archetype, {sql_pick(TYPES[:5], "page_id")} AS want_type,
  {sql_pick(LEVELS, "page_id + CASE WHEN page_id % 9 = 0 THEN 1 ELSE 0 END")} AS want_level FROM pages WHERE page_id % 3 = 0""",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` after the views that it reads."""
    wanted = list(names)
    if "crawled" in wanted:
        wanted.insert(0, "crawl")
    if "crawl" in wanted:
        wanted.insert(0, "src")
    recursive = "RECURSIVE " if sql.startswith("--recursive\n") else ""
    body = sql.removeprefix("--recursive\n")
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    more = ",\n" if body.startswith("+") else "\n"
    return f"WITH {recursive}{ctes}{more}{body.removeprefix('+')}"
