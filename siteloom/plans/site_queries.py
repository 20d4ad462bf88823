"""Evidence, outside votes, placement, merges, trees and downloads over the derived inputs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.operators import audit as A
from siteloom.operators import classify as C
from siteloom.operators import downloads as D
from siteloom.operators import graph as G
from siteloom.operators import performance as P
from siteloom.operators import place as L
from siteloom.operators import trees as T
from siteloom.sources import html as H
from siteloom.sources import menu as M

from . import audit_queries as AQ
from . import inputs as I
from . import performance_queries as PQ
from . import place_queries as LQ

c = F.col
shown = lambda column: F.array_join(column, " > ")


def _own(s, d):
    return I.crawl(s, d).where("ord % 2 = 0")


def _vote(level: str, kind: str, confidence: float):
    return F.struct(F.lit(level).alias("level"), F.lit(kind).alias("page_type"), F.lit(confidence).alias("confidence"))


def _layers(s, d):
    p = AQ.twins(_own(s, d))
    local = C.local_votes(p, F.when(c("page_id") % 5 == 1, _vote("L2_SUB_NAV_HUB", "CASE_STUDY", 0.6)), AQ.PAIR)
    paid = C.local_votes(p, F.when(c("page_id") % 7 == 2, _vote("L3_LEAF_PAGE", "UTILITY_LEGAL", 0.9)), AQ.PAIR)
    return C.cascade(p, AQ.Site(s, d).voted, local, paid, AQ.PAIR).drop(*AQ.PAIR)


def _judge_page(url: pd.Series) -> pd.DataFrame:
    """A stand-in for a local model: it knows pages by the length of their address."""
    size = url.str.len()
    return pd.DataFrame({"level": "L3_LEAF_PAGE", "page_type": (size % 2 == 0).map({True: "BLOG_ARTICLE", False: "CASE_STUDY"}), "confidence": (size % 10) / 10})


def _judge_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in for a service that votes on some pages of a batch."""
    for frame in frames:
        some = frame[frame["url"].str.contains("/en/", regex=False)]
        yield pd.DataFrame({"url": some["url"], "level": "L2_SUB_NAV_HUB", "page_type": "BLOG_HUB", "confidence": 0.7})


def _local(s, d):
    judge = F.pandas_udf(_judge_page, "level string, page_type string, confidence double")
    return C.local_votes(I.pages(s, d), judge("url"))


def _external(s, d):
    votes = I.pages(s, d).where("page_id % 3 = 0").groupBy(U.normalize_url("url").alias("key")).agg(F.max("page_id").alias("n"))
    votes = votes.select("key", F.lit("L3_LEAF_PAGE").alias("level"), F.lit("BLOG_ARTICLE").alias("page_type"), ((c("n") % 10) / 10).alias("confidence"))
    return C.external_votes(I.spelled(s, d), votes)


def _hosts(s, d):
    return I.pages(s, d).groupBy(U.host_of("url").alias("site")).agg(F.min("page_id").alias("n"))


def _probes(s, d):
    n = c("n")
    row = lambda path, status, body: F.struct(F.lit(path).alias("path"), status.alias("status"), body.alias("body"))
    ok, lit = F.lit(200), F.lit
    return _hosts(s, d).select(
        "site",
        F.explode(
            F.array(
                row("/wp-json/wp/v2/types", ok, F.when(n % 3 == 0, '{"post": {}}').otherwise("<html>")),
                row("/products.json", F.when(n % 4 == 0, 200).otherwise(404), lit('{"products": []}')),
                row("/robots.txt", ok, F.when(n % 2 == 0, "User-agent: *\nSitemap: https://x.test/de/s.xml\nsitemap: https://x.test/s.xml").otherwise("Disallow:")),
                row("/", ok, F.when(n % 5 == 0, '<div id="root"></div>').otherwise("<p>plain</p>")),
            )
        ).alias("r"),
    ).select("site", "r.*")


def _evidence(s, d):
    site = AQ.Site(s, d)
    bodies = I.pages(s, d).groupBy(U.normalize_url("url").alias("key")).agg(F.min("html").alias("html"))
    # one body of each address, as above: two trails would be taken for one
    crumbs = H.section_labels(H.breadcrumbs(_trails(s, d).groupBy("url").agg(F.min("html").alias("html"))))
    found = G.evidence(site.nodes, bodies, crumbs, site.graph)
    return found.select("key", "in_sitemap", F.coalesce(F.length("html"), F.lit(0)).alias("chars"), shown("breadcrumb").alias("breadcrumb"), "inbound", "outbound", "total_pages")


def _trails(s, d):
    """Pages that show a trail after their first folder."""
    root = F.regexp_extract("url", "^([^:]*://[^/?#]*)", 1)
    trail = F.concat(F.lit('<ol class="Breadcrumbs"><li><a href="/">Home</a></li> / <li><a href="/x/">The  X</a></li><li>Page '), c("page_id").cast("string"), F.lit("</li></ol><p>end</p>"))
    return I.pages(s, d).select("url", F.concat(F.lit("<br>"), trail, F.coalesce("html", root)).alias("html"))


def _menus(s, d, html: str):
    return M.menu(I.pages(s, d).select("url", F.lit(html).alias("html"))).select("url", "ord", "target", shown("labels").alias("labels"))


NESTED = '<nav><ul><li><a href="/a">A</a><ul><li><a data-menu-level="0" href="/b">B</a><ul><li><a href="/d">D</a></li></ul></li><li><a href="/c">C</a></li><li><a href="mailto:x@y.test">M</a></li></ul></li></ul></nav>'
DECLARED = '<script type="application/ld+json">[{"@type": ["SiteNavigationElement"], "name": ["One", "Two"], "url": ["/1", "/2"]}, {"@type": "SiteNavigationElement", "name": "Else", "url": "https://elsewhere.test/"}]</script>'


def _mega_menu(s, d):
    """The links of a page's own list as a menu with panels, headings, a footer and a trail."""
    link = lambda k: F.concat(F.lit('<a href="'), F.get("l", F.lit(k)), F.lit('">'), F.lit(f"Entry {k}</a>"))
    parts = [
        "<header><nav><ul><li>", 0, "<nav><ul><li><h3>First</h3><ul><li>", 1, "</li><li>", 2, "</li></ul></li><li><h3>Second</h3><ul><li>", 3,
        '</li></ul></li></ul></nav></li><li><div>Alone</div></li></ul></nav></header><ol class="breadcrumb"><li>', 4, "</li></ol><footer><nav><ul><li>", 5,
        "</li></ul></nav></footer>",
    ]
    html = F.concat(*(F.coalesce(link(p), F.lit("")) if isinstance(p, int) else F.lit(p) for p in parts))
    own = F.regexp_extract_all(F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1), F.lit('<a href="([^"]*)"'), F.lit(1))
    return I.pages(s, d).select("url", own.alias("l")).where("size(l) > 5").select("url", html.alias("html"))


def _stored(s, d):
    """Pages as a stored result has them, with and without what they say of themselves."""
    n = c("page_id")
    return _own(s, d).select(
        "url",
        "page_type",
        "page_id",
        F.when(n % 4 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("own_breadcrumb"),
        F.when(n % 3 == 0, "breadcrumb").when(n % 3 == 1, "menu").otherwise("none").alias("trail_source"),
        "trail",
    )


def _first_sources(s, d):
    """Nodes with the sitemap and the record that named them first."""
    rows = AQ.Site(s, d).found
    n = c("ord")
    maps = F.when(c("source") == "sitemap", F.concat(F.lit("map-"), (n % 7).cast("string"), F.lit(".xml")))
    record = F.when(c("source") == "cms", F.struct(F.lit("post").alias("record_type"), n.alias("id")))
    nodes = G.merge_sources(rows.withColumns({"sitemap_source": maps, "cms_record": record}))
    return nodes.select("key", "sitemap_source", c("cms_record.record_type").alias("record_type"), c("cms_record.id").alias("record_id"))


def _placement_report(s, d):
    stored, by = _stored(s, d), ("page_id",)
    return L.placement_report(stored, L.place_pages(stored, LQ._menu(s, d), by), by)


def _merged(s, d):
    n = c("page_id")
    known = I.crawled(s, d).where("ord % 2 = 0").select(
        "url", "page_type", "level", c("score").alias("confidence"), F.lit("LAYER1").alias("method"), F.array().cast("array<string>").alias("own_breadcrumb"), F.lit("none").alias("trail_source"), "trail"
    )
    missed = I.pages(s, d).where("page_id % 2 = 1").select("url", (n % 19).alias("inlinks"))
    return L.merged(known, missed, LQ._menu(s, d))


def _tree(s, d):
    nodes = _own(s, d).select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("trail"), F.lit(1))), lambda k: F.slice("trail", 1, k))).alias("path")).where("size(path) > 0").distinct()
    return nodes.select("path", F.least(F.size("path"), F.lit(3)).alias("lane"), F.when(F.size("path") > 1, 0.8 + 0.1 * (F.length(F.element_at("path", -1)) % 2)).alias("score"))


def _shown(s, d):
    tree = _tree(s, d)
    opened = tree.where(F.length(F.element_at("path", -1)) % 2 == 0).select("path")
    return T.shown(tree, [1, 2], ["high"], opened).select(shown("path").alias("path"), "lane")


def _with_source(s, d):
    return _own(s, d).withColumn("source", F.when(c("page_id") % 2 == 0, "menu").otherwise("breadcrumb"))


def _opportunities(s, d):
    a = PQ.Audit(s, d, shared=True)
    skipped = s.createDataFrame([("UNDERPERFORMING_SIBLING", "no section is known")], "kind string, gap string")
    return D.opportunities(a.ranked, a.measured, skipped)


def _unmatched(s, d):
    a = PQ.Audit(s, d, shared=True)
    return D.unmatched(P.unmatched_groups(a.resolved), a.resolved.where("failure is not null"))


def _duplicates(s, d):
    sets = AQ.Site(s, d).sets
    trails = A.trail_disagreement(sets, I.spelled(s, d).select("url", F.array((c("page_id") % 3).cast("string")).alias("trail")))
    return D.duplicates(sets, A.survivors(sets), trails)


def queries() -> dict:
    return {
        "cl8_all_layers": _layers,
        "cl11_external_votes": _external,
        "cl13_weight_report": lambda s, d: C.weight_report(
            _hosts(s, d).select("site", F.when(c("n") % 3 == 0, "WORDPRESS").when(c("n") % 3 == 1, "HEADLESS").otherwise("UNKNOWN").alias("family"), (c("n") % 2 == 0).alias("client_side"))
        ),
        "ud1_local_votes": _local,
        "ud2_batch_votes": lambda s, d: C.batch_votes(I.pages(s, d).select("url"), _judge_batch),
        "gr11_evidence": _evidence,
        "gr13_site_profiles": lambda s, d: G.site_profiles(_probes(s, d)).withColumn("locales", F.array_join("locales", ",")),
        "htm3_mega_menu": lambda s, d: M.address_nodes(_mega_menu(s, d)).select("url", "target", shown("line").alias("labels"), "depth"),
        "htm4_declared_roots": lambda s, d: _menus(s, d, NESTED),
        "htm5_declared_menu": lambda s, d: _menus(s, d, DECLARED),
        "htm6_breadcrumbs": lambda s, d: H.breadcrumbs(_trails(s, d)),
        "pl4_own_breadcrumb": lambda s, d: L.own_breadcrumb(_stored(s, d)).select("url", shown("breadcrumb").alias("breadcrumb")),
        "pl5_placed_pages": lambda s, d: L.place_pages(_stored(s, d), LQ._menu(s, d)).select("url", shown("trail").alias("trail"), "trail_source"),
        "pl7_placement_report": _placement_report,
        "tr11_recounted_split": lambda s, d: L.placement_split(_stored(s, d).withColumn("trail_source", F.when(c("page_id") % 5 > 0, c("trail_source")))),
        "tr9_labels_and_total": lambda s, d: L.node_search(_own(s, d).select("url", F.element_at(F.concat(F.array(F.lit("Root")), "trail"), -1).alias("label")), " TH "),
        "gr2_first_sources": _first_sources,
        "rc6_merged": lambda s, d: _merged(s, d).select("url", "level", "page_type", "confidence", "method", shown("trail").alias("trail"), "trail_source", "added"),
        "rc7_resummarised": lambda s, d: C.resummarise(_merged(s, d), 7),
        "tr5_nav_tree": lambda s, d: T.nav_tree(_own(s, d).withColumn("nav_parent_url", F.when(c("page_id") % 3 == 0, c("url")))),
        "tr7_provenance": lambda s, d: T.lanes(_with_source(s, d)),
        "tr8_shown": _shown,
        "tr10_report_rows": lambda s, d: T.report_rows(_own(s, d)),
        "tr10_omitted": lambda s, d: T.omitted(_own(s, d), most=10),
        "snk2_opportunities": _opportunities,
        "snk3_matched": lambda s, d: P.matched_listing((a := PQ.Audit(s, d)).pages, a.found).orderBy(F.desc("clicks"), "url"),
        "snk4_unmatched": _unmatched,
        "snk5_reconciliation": lambda s, d: D.reconciliation(A.reconcile(I.crawled(s, d).select("url", "ord"), I.frog(s, d))),
        "snk7_duplicates": _duplicates,
    }


def _cases(column: str, meanings: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in meanings.items()) + " ELSE '' END"


_ROOT = "regexp_extract(url, '^([^:]*://[^/?#]*)', 1)"
_LOCAL = f"CASE WHEN {LQ._ISLOC} THEN [lower({LQ._LOC})] ELSE CAST([] AS VARCHAR[]) END"
_OWN = "CASE WHEN len(trail) > 0 THEN trail ELSE ['OTHERS'] END"
_PLACED = "CASE WHEN t.trail[1] = 'OTHERS' THEN 0 ELSE len(t.trail) END"
_MERGED = LQ._M + f""", known AS (SELECT url, page_type, level, score AS confidence, 'LAYER1' AS method, false AS added FROM crawled WHERE ord % 2 = 0),
missed AS (SELECT url, 'UNKNOWN' AS page_type, 'L3_LEAF_PAGE' AS level, page_id % 19 AS inlinks FROM pages WHERE page_id % 2 = 1),
voted AS (SELECT *, CASE WHEN inlinks = 1 AND (SELECT count(*) FROM known) + (SELECT count(*) FROM missed) > 50 THEN 0.35 ELSE 0 END::DOUBLE AS confidence FROM missed),
both_ AS (SELECT * FROM known UNION ALL SELECT url, page_type, level, confidence, CASE WHEN confidence > 0 THEN 'WEIGHTED_CONSENSUS' ELSE 'UNRESOLVED' END, true FROM voted),
put AS (SELECT b.*, m.labels FROM both_ b LEFT JOIN menu m ON starts_with({I.sql_norm_path(I.sql_path("b.url"))}, m.key) QUALIFY row_number() OVER (PARTITION BY b.url ORDER BY length(m.key) DESC NULLS LAST) = 1),
merged AS (SELECT url, level, page_type, confidence, method, array_to_string(coalesce(labels, ['OTHERS', page_type]), ' > ') AS trail, CASE WHEN labels IS NULL THEN 'none' ELSE 'menu' END AS trail_source, added FROM put) """
_SECTIONS = f"nodes AS (SELECT own[1:n] AS node, source FROM (SELECT {_OWN} AS own, CASE WHEN page_id % 2 = 0 THEN 'menu' ELSE 'breadcrumb' END AS source, unnest(range(1, len({_OWN}) + 1)) AS n FROM crawl WHERE ord % 2 = 0))"


def oracle_sql() -> dict[str, str]:
    w = I.with_views
    perf = lambda tail: w(PQ._CTES + tail, "crawled", "gsc", "ga4")
    two = f"SELECT url, ord, {_ROOT} || target AS target, labels FROM pages, (VALUES %s) v(ord, target, labels)"
    return {
        "cl8_all_layers": w(AQ._CLASS + """, a AS (SELECT c.url, page_id, c.level, c.page_type, c.confidence, c.method FROM classified c JOIN one USING (url)),
  b AS (SELECT url, page_id, u, CASE WHEN u THEN 'L2_SUB_NAV_HUB' ELSE level END AS level, CASE WHEN u THEN 'CASE_STUDY' ELSE page_type END AS page_type, CASE WHEN u THEN 0.6 ELSE confidence END AS confidence, CASE WHEN u THEN 'LAYER2_LOCAL' ELSE method END AS method FROM (SELECT *, confidence < 0.85 AND page_id % 5 = 1 AS u FROM a)),
  d AS (SELECT *, confidence < 0.85 AND page_id % 7 = 2 AS v FROM b)
  SELECT url, CASE WHEN v THEN 'UTILITY_PAGE' ELSE level END AS level, CASE WHEN v THEN 'UTILITY_LEGAL' ELSE page_type END AS page_type, CASE WHEN v THEN 0.9 ELSE confidence END::DOUBLE AS confidence, CASE WHEN v THEN 'LAYER3_PAID' ELSE method END AS method FROM d""", "crawl"),
        "cl11_external_votes": w(f"+v AS (SELECT {I.sql_norm_url('url')} AS key, max(page_id) AS n FROM pages WHERE page_id % 3 = 0 GROUP BY 1) SELECT url, 'L3_LEAF_PAGE' AS level, 'BLOG_ARTICLE' AS page_type, (n % 10) / 10.0::DOUBLE AS confidence FROM (SELECT url, {I.sql_norm_url('url')} AS key FROM spelled) JOIN v USING (key)", "spelled"),
        "cl13_weight_report": f"SELECT site, 'default' AS applied, false AS adaptive, CASE WHEN n % 3 = 0 THEN 'wordpress' WHEN n % 3 = 1 OR n % 2 = 0 THEN 'headless' ELSE 'default' END AS detected FROM (SELECT {I.sql_host('url')} AS site, min(page_id) AS n FROM pages GROUP BY 1)",
        "ud1_local_votes": "SELECT url, 'L3_LEAF_PAGE' AS level, CASE WHEN length(url) % 2 = 0 THEN 'BLOG_ARTICLE' ELSE 'CASE_STUDY' END AS page_type, (length(url) % 10) / 10.0::DOUBLE AS confidence FROM pages",
        "ud2_batch_votes": "SELECT url, 'L2_SUB_NAV_HUB' AS level, 'BLOG_HUB' AS page_type, 0.7::DOUBLE AS confidence FROM pages WHERE contains(url, '/en/')",
        "gr11_evidence": w(AQ._GRAPH + f", bodies AS (SELECT {I.sql_norm_url('url')} AS key, min(html) AS html FROM pages GROUP BY 1) SELECT key, in_sitemap, coalesce(length(html), 0) AS chars, CASE WHEN url IN (SELECT url FROM pages) THEN 'The X' ELSE '' END AS breadcrumb, inbound, outbound, (SELECT count(*) FROM nodes) AS total_pages FROM graph LEFT JOIN bodies USING (key)", "spelled"),
        "gr13_site_profiles": f"SELECT site, CASE WHEN n % 3 = 0 THEN 'WORDPRESS' WHEN n % 4 = 0 THEN 'SHOPIFY' WHEN n % 5 = 0 THEN 'HEADLESS' ELSE 'UNKNOWN' END AS family, n % 5 = 0 AS client_side, n % 4 = 0 AS has_catalogue, CASE WHEN n % 2 = 0 THEN 'de' ELSE '' END AS locales FROM (SELECT {I.sql_host('url')} AS site, min(page_id) AS n FROM pages GROUP BY 1)",
        "htm3_mega_menu": f"""WITH p AS (SELECT url, {_ROOT} AS root, l FROM (SELECT url, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) AS l FROM pages) WHERE len(l) > 5),
  e AS (SELECT url, k, root || l[k + 1] AS target FROM p, (VALUES (0), (1), (2), (3)) v(k) QUALIFY row_number() OVER (PARTITION BY url, l[k + 1] ORDER BY k) = 1),
  n AS (SELECT url, target, CASE k WHEN 0 THEN 'Entry 0' WHEN 3 THEN 'Entry 0 > Second > Entry 3' ELSE 'Entry 0 > First > Entry ' || k END AS labels, CASE k WHEN 0 THEN 0 ELSE 2 END AS depth FROM e)
  SELECT * FROM n UNION ALL SELECT DISTINCT url, NULL, CASE k WHEN 3 THEN 'Entry 0 > Second' ELSE 'Entry 0 > First' END, 1 FROM e WHERE k > 0""",
        "htm4_declared_roots": two % "(1, '/a', 'A'), (2, '/b', 'B'), (3, '/d', 'B > D'), (4, '/c', 'A > C')",
        "htm5_declared_menu": two % "(1, '/1', 'One'), (2, '/2', 'Two')",
        "htm6_breadcrumbs": f"SELECT url, nr, CASE WHEN nr = 2 THEN 'Page ' || page_id ELSE label END AS label, CASE WHEN nr < 2 THEN {_ROOT} || target END AS target FROM pages, (VALUES (0, 'Home', '/'), (1, 'The X', '/x/'), (2, '', '')) v(nr, label, target)",
        "pl4_own_breadcrumb": w("SELECT url, CASE WHEN page_id % 4 = 0 THEN 'a > b > c' WHEN page_id % 3 = 0 THEN array_to_string(trail, ' > ') ELSE '' END AS breadcrumb FROM crawl WHERE ord % 2 = 0", "crawl"),
        "pl5_placed_pages": w(LQ._M + f", s AS (SELECT url, page_type, CASE WHEN page_id % 4 = 0 THEN ['a', 'b', 'c'] WHEN page_id % 3 = 0 THEN trail ELSE CAST([] AS VARCHAR[]) END AS own FROM pg), t AS (SELECT s.*, shown.trail FROM s JOIN shown USING (url)) SELECT url, CASE src WHEN 'menu' THEN array_to_string(trail, ' > ') WHEN 'breadcrumb' THEN array_to_string(own, ' > ') ELSE 'OTHERS > ' || page_type END AS trail, src AS trail_source FROM (SELECT *, CASE WHEN {_PLACED} > 0 AND {_PLACED} >= len(own) THEN 'menu' WHEN len(own) > 0 THEN 'breadcrumb' ELSE 'none' END AS src FROM t)", "crawl"),
        "pl7_placement_report": w(LQ._M + f", s AS (SELECT url, page_id, page_type, trail AS old, CASE page_id % 3 WHEN 0 THEN 'breadcrumb' WHEN 1 THEN 'menu' ELSE 'none' END AS was, CASE WHEN page_id % 4 = 0 THEN ['a', 'b', 'c'] WHEN page_id % 3 = 0 THEN trail ELSE CAST([] AS VARCHAR[]) END AS own FROM pg), t AS (SELECT s.*, shown.trail FROM s JOIN shown USING (url)), n AS (SELECT *, CASE src WHEN 'menu' THEN trail WHEN 'breadcrumb' THEN own ELSE ['OTHERS', page_type] END AS new FROM (SELECT *, CASE WHEN {_PLACED} > 0 AND {_PLACED} >= len(own) THEN 'menu' WHEN len(own) > 0 THEN 'breadcrumb' ELSE 'none' END AS src FROM t)), b AS (SELECT was AS name, 1 AS x, 0 AS y FROM n UNION ALL SELECT src, 0, 1 FROM n), r AS (SELECT coalesce(old[1], 'none') AS name, 1 AS x, 0 AS y FROM n UNION ALL SELECT coalesce(new[1], 'none'), 0, 1 FROM n) SELECT 'source' AS row, name, CAST(sum(x) AS BIGINT) AS before, CAST(sum(y) AS BIGINT) AS after FROM b GROUP BY name UNION ALL SELECT 'moved', '', 0, count_if(old IS DISTINCT FROM new) FROM n UNION ALL SELECT CASE WHEN sum(x) = 0 THEN 'root gained' ELSE 'root lost' END, name, CAST(sum(x) AS BIGINT), CAST(sum(y) AS BIGINT) FROM r GROUP BY name HAVING (sum(x) = 0) <> (sum(y) = 0)", "crawl"),
        "tr11_recounted_split": w("SELECT source, count(*) AS pages, count(*) / (SELECT count(*) FROM crawl WHERE ord % 2 = 0)::DOUBLE AS share FROM (SELECT CASE WHEN page_id % 5 = 0 THEN CASE WHEN len(trail) > 0 AND trail[1] <> 'OTHERS' THEN 'menu' ELSE 'unplaced' END WHEN page_id % 3 = 0 THEN 'breadcrumb' WHEN page_id % 3 = 1 THEN 'menu' ELSE 'unplaced' END AS source FROM crawl WHERE ord % 2 = 0) GROUP BY 1", "crawl"),
        "tr9_labels_and_total": w("+n AS (SELECT url, coalesce(trail[-1], 'Root') AS label FROM crawl WHERE ord % 2 = 0), h AS (SELECT * FROM n WHERE contains(lower(label), 'th') OR contains(lower(url), 'th')) SELECT url, label, (SELECT count(*) FROM h) AS total FROM h ORDER BY label, url LIMIT 40", "crawl"),
        "gr2_first_sources": w(AQ._FOUND.rstrip(", ") + f" SELECT {I.sql_norm_url('url')} AS key, 'map-' || (min(ord) FILTER (source = 'sitemap') % 7) || '.xml' AS sitemap_source, CASE WHEN count_if(source = 'cms') > 0 THEN 'post' END AS record_type, min(ord) FILTER (source = 'cms') AS record_id FROM found GROUP BY 1", "spelled"),
        "rc6_merged": w(_MERGED + "SELECT * FROM merged", "crawled"),
        "rc7_resummarised": w(_MERGED + "SELECT count(*) AS pages, 0 AS escalated, 0::DOUBLE AS escalation_rate, count_if(page_type = 'UNKNOWN') AS unknown, count_if(NOT (confidence >= 0.85 AND page_type <> 'UNKNOWN')) AS low_confidence, 7 AS orphans FROM merged", "crawled"),
        "tr5_nav_tree": w(f"+r AS (SELECT url, page_id % 3 = 0 AS sp, {_LOCAL} || {_OWN} AS own FROM crawl WHERE ord % 2 = 0), o AS (SELECT own, min(url) AS page FROM r WHERE sp GROUP BY 1), n AS (SELECT own[1:k] AS node, count(*) AS pages FROM (SELECT own, unnest(range(1, len(own) + 1)) AS k FROM r) GROUP BY 1) SELECT '/' || array_to_string(node, '/') AS path, CAST(len(node) AS INTEGER) AS depth, page AS url, pages FROM n LEFT JOIN o ON o.own = n.node UNION ALL SELECT '/' || array_to_string(own, '/') || '#' || url, CAST(len(own) + 1 AS INTEGER), url, 1 FROM r LEFT JOIN o USING (own) WHERE NOT sp OR url <> page", "crawl"),
        "tr7_provenance": w(f"+{_SECTIONS} SELECT array_to_string(node, ' > ') AS path, CASE WHEN node[1] = 'OTHERS' THEN 0 ELSE least(len(node), 3) END::INTEGER AS lane, count(*) AS pages, CASE WHEN min(source) = max(source) THEN min(source) ELSE 'mixed' END AS provenance FROM nodes GROUP BY node", "crawl"),
        "tr8_shown": w("+t AS (SELECT DISTINCT trail[1:n] AS path FROM (SELECT trail, unnest(range(1, len(trail) + 1)) AS n FROM crawl WHERE ord % 2 = 0)), p AS (SELECT *, least(len(path), 3) AS lane FROM t WHERE len(path) = 1 OR (len(path) = 2 AND length(path[2]) % 2 = 1)) SELECT array_to_string(path, ' > ') AS path, CAST(lane AS INTEGER) AS lane FROM p WHERE len(path) = 1 OR (length(path[1]) % 2 = 0 AND path[1:1] IN (SELECT path FROM p))", "crawl"),
        "tr10_report_rows": w(f"+{_SECTIONS} SELECT array_to_string(node, ' > ') AS path, CAST(len(node) AS INTEGER) AS depth, count(*) AS pages FROM nodes WHERE len(node) <= 3 GROUP BY node ORDER BY 1 LIMIT 3000", "crawl"),
        "tr10_omitted": w(f"+{_SECTIONS} SELECT count(*) AS sections, greatest(count(*) - 10, 0) AS omitted FROM (SELECT DISTINCT node FROM nodes WHERE len(node) <= 3)", "crawl"),
        "snk2_opportunities": perf("SELECT r.severity, r.kind, r.score, r.url, coalesce(array_to_string(m.own, ' > '), '') AS section, m.clicks, m.impressions, m.position, lower(replace(r.kind, '_', ' ')) AS reason FROM ranked r LEFT JOIN measured m ON m.url = r.url UNION ALL SELECT NULL, 'UNDERPERFORMING_SIBLING', NULL, NULL, NULL, NULL, NULL, NULL, 'not evaluated: no section is known'"),
        "snk3_matched": perf(PQ._TAIL["pf9_matched_listing"]),
        "snk4_unmatched": perf(f"SELECT *, {_cases('reason', D.UNMATCHED)} AS meaning FROM (SELECT 'group' AS row, host, reason, '' AS url, urls, clicks, impressions FROM groups UNION ALL SELECT 'address', host, failure, url, 1, clicks, impressions FROM lost)"),
        "snk5_reconciliation": w(AQ._REC + f"SELECT *, {_cases('reason', D.RECONCILED)} AS meaning FROM (SELECT '' AS url, side AS found_by, coalesce(reason, '') AS reason, count(*) AS n FROM rec GROUP BY ALL UNION ALL SELECT key, side, coalesce(reason, ''), 1 FROM rec)", "crawled", "frog"),
    }
