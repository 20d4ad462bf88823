"""Worklists, listings and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import scalars as S
from siteloom.functions import urls as U
from siteloom.operators import audit as A
from siteloom.operators import reports as P

from . import audit_queries, inputs as I

c = F.col


def _pages(s, d):
    return I.crawl(s, d).where("ord % 2 = 0")


def _sheet(s, d):
    n = c("page_id")
    marks = F.element_at(F.array(*map(F.lit, ["yes", " OK", "no", ""])), (n % 4 + 1).cast("int"))
    return _pages(s, d).select(marks.alias("reviewed"), F.when(n % 5 == 0, "L9").otherwise(c("level")).alias("expected_level"))


def _export(s, d):
    n = c("page_id")
    return I.pages(s, d).select(
        F.when(n % 9 == 0, " ").otherwise(F.concat(F.lit(" "), c("url"))).alias("Address"),
        F.when(n % 5 == 0, "n/a").otherwise((n % 500).cast("string")).alias("Status Code"),
        (n % 30).cast("string").alias("Unique Inlinks"),
        F.when(n % 4 == 0, "").otherwise((n % 7).cast("string")).alias("Crawl Depth"),
    )


def _findings(s, d):
    p = _pages(s, d)
    placed = p.withColumn("trail", F.when(c("page_id") % 4 == 0, c("trail")).otherwise(F.slice("trail", 1, 1)))
    kinds = [
        ("orphans", "high", A.orphan_list(p)),
        ("sitemap-redirects", "high", A.sitemap_redirects(p)),
        ("pagination", "medium", I.spelled(s, d).where(U.is_paginated(c("url")))),
        ("silo-mismatch", "medium", A.folder_mismatch(placed)),
        ("unclassified", "low", p.where("score = 0")),
    ]
    return reduce(DataFrame.union, [rows.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), "url") for kind, severity, rows in kinds])


def queries() -> dict:
    return {
        "cl10_affordable": lambda s, d: P.affordable(_pages(s, d).withColumn("cost", (c("page_id") % 4 + 1) / 10), 20.0).select("url", "spent"),
        "cl14_levels": lambda s, d: P.level_counts(_pages(s, d)),
        "tr4_types_present": lambda s, d: _pages(s, d).select("page_type").distinct().orderBy("page_type"),
        "tr12_subtree": lambda s, d: P.subtree(_pages(s, d), ["blog"]).select("url"),
        "tr12_ancestors": lambda s, d: P.ancestors(_pages(s, d), _pages(s, d).where("page_type = 'UNKNOWN'")).select(F.array_join("node", " > ").alias("node")),
        "tr13_child_paging": lambda s, d: P.child_page(_pages(s, d), 2, 1),
        "ev3_weakest": lambda s, d: P.weakest(A.accuracy(I.labels(s, d), _pages(s, d).select("page_id", "level", "page_type", "score"))),
        "ev6_corpus_coverage": lambda s, d: P.corpus_coverage(I.labels(s, d), s.range(8).select(F.concat(F.lit("archetype"), c("id").cast("string")).alias("archetype"))),
        "ev7_review_progress": lambda s, d: P.review_progress(_sheet(s, d), S.LEVELS),
        "gr9_resume_set": lambda s, d: P.resume_set(audit_queries.Site(s, d).nodes, I.pages(s, d).where("page_id % 2 = 0")),
        "src10_crawler_export": lambda s, d: P.crawler_export(_export(s, d)),
        "src15_checkpoint_view": lambda s, d: I.spelled(s, d).select("url", F.lit("L3_LEAF_PAGE").alias("level"), F.lit("UNKNOWN").alias("page_type"), F.lit(0.0).alias("score")),
        "au9_finding_list": lambda s, d: P.finding_list(_findings(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    w = lambda sql, *more: I.with_views(sql, "crawl", *more)
    p = "(SELECT * FROM crawl WHERE ord % 2 = 0)"
    aq = audit_queries
    own = "array_to_string(CASE WHEN len(trail) > 0 THEN trail ELSE ['OTHERS'] END, ' > ')"
    return {
        "cl10_affordable": w(f"SELECT * FROM (SELECT url, round(sum((page_id % 4 + 1) / 10.0::DOUBLE) OVER (ORDER BY score, url ROWS UNBOUNDED PRECEDING), 9) AS spent FROM {p}) WHERE spent <= 20"),
        "cl14_levels": w(f"SELECT level, count(*) AS pages, count(*) FILTER (page_type = 'UNKNOWN') AS unknown FROM {p} GROUP BY 1"),
        "tr4_types_present": w(f"SELECT DISTINCT page_type FROM {p}"),
        "tr12_subtree": w(f"SELECT url FROM {p} WHERE trail[1] = 'blog'"),
        "tr12_ancestors": w(f"SELECT DISTINCT array_to_string(trail[1:n], ' > ') AS node FROM (SELECT trail, unnest(range(0, len(trail) + 1)) AS n FROM {p} WHERE page_type = 'UNKNOWN')"),
        "tr13_child_paging": w(f"SELECT section, url, CAST(nr AS INTEGER) AS nr, greatest(n - 4, 0) AS left FROM (SELECT {own} AS section, url, row_number() OVER (PARTITION BY {own} ORDER BY url) AS nr, count(*) OVER (PARTITION BY {own}) AS n FROM {p}) WHERE nr BETWEEN 3 AND 4"),
        "ev3_weakest": w(aq._J + "SELECT arg_min(archetype, (r, archetype)) AS weakest, bool_and(e >= 50) AS trustworthy FROM (SELECT archetype, count(*) FILTER (page_type IS NOT NULL) AS e, count(*) FILTER (level = want_level AND page_type = want_type) / nullif(count(*) FILTER (page_type IS NOT NULL), 0) AS r FROM j GROUP BY 1) WHERE e > 0", "labelled"),
        "ev6_corpus_coverage": w("SELECT 'archetype' || i AS archetype, (SELECT count(*) FROM labelled WHERE archetype = 'archetype' || i) AS entries, greatest(50 - (SELECT count(*) FROM labelled WHERE archetype = 'archetype' || i), 0) AS shortfall FROM range(8) t(i)", "labelled"),
        "ev7_review_progress": w(f"SELECT count(*) AS total, count(*) FILTER (page_id % 4 < 2) AS reviewed, count(*) FILTER (page_id % 4 < 2 AND page_id % 5 <> 0) AS admitted, count(*) FILTER (page_id % 4 < 2 AND page_id % 5 = 0) AS unusable FROM {p}"),
        "gr9_resume_set": I.with_views(aq._GRAPH + f"SELECT key, CASE WHEN key IN (SELECT {I.sql_norm_url('url')} FROM pages WHERE page_id % 2 = 0) THEN 'exclude' ELSE 'seed' END AS role FROM nodes", "spelled"),
        "src10_crawler_export": "SELECT url, CASE WHEN page_id % 5 = 0 THEN 0 ELSE page_id % 500 END AS status, page_id % 30 AS inlinks, CASE WHEN page_id % 4 <> 0 THEN CAST(page_id % 7 AS INTEGER) END AS depth FROM pages WHERE page_id % 9 <> 0",
        "src15_checkpoint_view": I.with_views("SELECT url, 'L3_LEAF_PAGE' AS level, 'UNKNOWN' AS page_type, 0.0::DOUBLE AS score FROM spelled", "spelled"),
        "au9_finding_list": w("+p AS (SELECT * FROM crawl WHERE ord % 2 = 0), q AS (SELECT url, len({S}) AS n, regexp_replace(lower({S}[1]), '[^a-z0-9]', '', 'g') AS folder, CASE WHEN page_id % 4 = 0 THEN trail ELSE trail[1:1] END AS t FROM p), f AS (SELECT 'orphans' AS kind, 'high' AS severity, url FROM p WHERE inbound = 0 UNION ALL SELECT 'sitemap-redirects', 'high', url FROM p WHERE in_sitemap AND page_id % 11 = 0 UNION ALL SELECT 'pagination', 'medium', url FROM spelled WHERE regexp_matches(url, '(?i)[?&]page=\\d+') OR regexp_matches({P}, '(?i)/page/\\d+/?$') UNION ALL SELECT 'unclassified', 'low', url FROM p WHERE score = 0 UNION ALL SELECT 'silo-mismatch', 'medium', url FROM q WHERE n >= 2 AND len(t) > 0 AND NOT list_bool_or(list_transform(t, lambda x: contains(regexp_replace(lower(x), '[^a-z0-9]', '', 'g'), folder) OR contains(folder, regexp_replace(lower(x), '[^a-z0-9]', '', 'g'))))) SELECT kind, severity, count(*) AS n, array_to_string((list(url ORDER BY url))[1:5], ' ') AS examples FROM f GROUP BY 1, 2".replace("{S}", aq._SEG).replace("{P}", aq._P), "spelled"),
    }
