"""Placement in menus, section trees and download listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.operators import place as L

from . import audit_queries
from . import inputs as I

c = F.col


def _menu(s, d):
    """The first or the first two folders of each page, as a menu; every third leads elsewhere."""
    p = I.pages(s, d)
    segs = U.path_segments("url")
    return p.select(
        F.concat(F.when(c("page_id") % 3 == 0, "https://m.test/other/").otherwise("https://m.test/"), F.array_join(F.slice(segs, 1, F.when(c("page_id") % 2 == 0, 1).otherwise(2)), "/")).alias("url"),
        F.transform(F.slice(segs, 1, F.when(c("page_id") % 2 == 0, 1).otherwise(2)), lambda x: F.upper(x)).alias("labels"),
        c("page_id").alias("ord"),
    )


def _pages(s, d):
    return I.crawl(s, d).where("ord % 2 = 0")


def _addresses(s, d):
    """The first page of each address."""
    return _pages(s, d).groupBy("url").agg(F.min_by(F.struct("page_type", "trail"), "ord").alias("p")).select("url", "p.*")


def _placed(s, d):
    return L.place(_addresses(s, d), _menu(s, d))


def _shown(s, d):
    return _placed(s, d).select("url", F.array_join("trail", " > ").alias("trail"), "how")


def _better(s, d):
    crumb = F.when(c("page_id") % 4 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array().cast("array<string>"))
    return L.better_trail(I.crawl(s, d).select("url", c("trail").alias("menu_trail"), crumb.alias("breadcrumb"), "page_type"))


def queries() -> dict:
    return {
        "pl1_flat_menu": lambda s, d: L.flat_menu(_menu(s, d)).select("key", F.array_join("labels", " > ").alias("labels"), "ord"),
        "pl2_longest_prefix": _shown,
        "pl3_better_trail": lambda s, d: _better(s, d).select("url", F.array_join("trail", " > ").alias("trail"), "source"),
        "pl6_coverage": lambda s, d: L.coverage(_placed(s, d)),
        "pl7_placement_changes": lambda s, d: L.placement_changes(_addresses(s, d), _placed(s, d)).select(
            "url", F.array_join("old", " > ").alias("old"), F.array_join("new", " > ").alias("new")
        ),
        "tr3_sibling_order": lambda s, d: L.sibling_order(
            _pages(s, d).select(F.array_join("trail", " > ").alias("parent"), c("url").alias("path"), "level")
        ),
        "tr6_section_counts": lambda s, d: L.section_counts(_pages(s, d)),
        "snk6_worksheet": lambda s, d: L.worksheet(_pages(s, d), audit_queries.Site(s, d).signals),
        "tr9_node_search": lambda s, d: _pages(s, d).where(F.lower("url").contains("thth")).select("url").orderBy("url").limit(40),
    }


_SEG = I.sql_segs(I.sql_path("url"))
_N = "CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END"
_M = f"""+menu AS (SELECT key, labels, ord FROM (SELECT CASE WHEN page_id % 3 = 0 THEN '/other' ELSE '' END || CASE WHEN len(g) = 0 THEN '/' ELSE '/' || lower(array_to_string(g, '/')) || '/' END AS key, list_transform(g, lambda x: upper(x)) AS labels, page_id AS ord
  FROM (SELECT page_id, {_SEG}[1:{_N}] AS g FROM pages)) WHERE key <> '/' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1),
pg AS (SELECT * FROM crawl WHERE ord % 2 = 0),
placed AS (SELECT p.url, p.trail AS old, m.labels, m.key AS mkey, {I.sql_norm_path(I.sql_path("p.url"))} AS pkey, p.page_type FROM pg p LEFT JOIN menu m ON starts_with({I.sql_norm_path(I.sql_path("p.url"))}, m.key)
  QUALIFY row_number() OVER (PARTITION BY p.url ORDER BY length(m.key) DESC NULLS LAST) = 1),
shown AS (SELECT url, old, coalesce(labels, ['OTHERS', page_type]) AS trail, CASE WHEN labels IS NULL THEN 'unmatched' WHEN mkey = pkey THEN 'exact' ELSE 'inherited' END AS how FROM placed) """
_LOC = f"list_extract({_SEG}, 1)"
_ISLOC = f"coalesce(regexp_matches(lower({_LOC}), '^[a-z]{{2}}[-_][a-z]{{2,4}}$') OR lower({_LOC}) IN {I._in(U.LANGUAGES)}, false)"


def oracle_sql() -> dict[str, str]:
    w = lambda tail: I.with_views(_M + tail, "crawl")
    return {
        "pl1_flat_menu": w("SELECT key, array_to_string(labels, ' > ') AS labels, ord FROM menu"),
        "pl2_longest_prefix": w("SELECT url, array_to_string(trail, ' > ') AS trail, how FROM shown"),
        "pl3_better_trail": w("SELECT url, CASE WHEN source = 'menu' THEN array_to_string(trail, ' > ') WHEN source = 'breadcrumb' THEN 'a > b > c' ELSE 'OTHERS > ' || page_type END AS trail, source FROM (SELECT *, CASE WHEN len(trail) > 0 AND len(trail) >= CASE WHEN page_id % 4 = 0 THEN 3 ELSE 0 END THEN 'menu' WHEN page_id % 4 = 0 THEN 'breadcrumb' ELSE 'none' END AS source FROM crawl)"),
        "pl6_coverage": w("SELECT count(*) AS pages, count(*) FILTER (how = 'exact') AS exact, count(*) FILTER (how = 'inherited') AS inherited, count(*) FILTER (how = 'unmatched') AS unmatched, count(*) FILTER (how <> 'unmatched') / count(*)::DOUBLE AS coverage FROM shown"),
        "pl7_placement_changes": w("SELECT url, array_to_string(old, ' > ') AS old, array_to_string(trail, ' > ') AS new FROM shown WHERE old IS DISTINCT FROM trail"),
        "tr3_sibling_order": w("SELECT array_to_string(trail, ' > ') AS parent, url AS path, level, CAST(row_number() OVER (PARTITION BY array_to_string(trail, ' > ') ORDER BY CASE level WHEN 'L0_HOMEPAGE' THEN 0 WHEN 'L1_PRIMARY_NAV_HUB' THEN 1 WHEN 'L2_SUB_NAV_HUB' THEN 2 WHEN 'L3_LEAF_PAGE' THEN 3 ELSE 4 END, url) AS INTEGER) AS nr FROM pg"),
        "tr6_section_counts": w(f"SELECT array_to_string(t[1:n], ' > ') AS node, count(*) AS pages FROM (SELECT t, unnest(range(0, len(t) + 1)) AS n FROM (SELECT CASE WHEN {_ISLOC} THEN [lower({_LOC})] ELSE [] END || CASE WHEN len(trail) > 0 THEN trail ELSE ['OTHERS'] END AS t FROM pg)) GROUP BY t[1:n]"),
        "snk6_worksheet": I.with_views(audit_queries._SIGNALS + "heard AS (SELECT url, array_to_string(list_sort(list_distinct(list(['CMS_API_ENDPOINT', 'ARIA_NAV_TREE', 'SITEMAP_INDEX', 'SCHEMA_JSONLD', 'LINK_IN_DEGREE'][source + 1]))), '|') AS signals FROM signals GROUP BY 1) SELECT url, level AS suggested_level, page_type AS suggested_page_type, round_even(score, 3) AS confidence, coalesce(signals, '') AS signals, '' AS reviewed, '' AS expected_level, '' AS expected_page_type, '' AS notes FROM one LEFT JOIN heard USING (url)", "crawl"),
        "tr9_node_search": w("SELECT url FROM pg WHERE contains(lower(url), 'thth') ORDER BY url LIMIT 40"),
    }
