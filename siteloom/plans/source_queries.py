"""Sources and streams over bodies that are made of the driver's tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from siteloom.functions import scalars as S
from siteloom.functions import urls as U
from siteloom.operators.staging import staged
from siteloom.sources import bodies as B
from siteloom.sources import html as H
from siteloom.sources import listings as P
from siteloom.sources import menu as M
from siteloom.streaming import crawl_stream as T

from . import inputs as I

c = F.col


def _sitemaps(s, d):
    """Sitemaps of a thousand pages each, with references and CDATA, below an index."""
    n = c("page_id")
    text = F.when(n % 3 == 0, F.concat(F.lit("<![CDATA["), F.col("url"), F.lit("]]>"))).otherwise(F.concat(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" ")))
    loc = F.concat(F.lit("<url><loc> "), text, F.lit("</loc></url>"))
    parts = I.pages(s, d).groupBy(F.floor(n / 1000).alias("n")).agg(
        F.concat(F.lit("<?xml?><urlset>"), F.array_join(F.array_sort(F.collect_list(loc)), ""), F.lit("</urlset>")).alias("body")
    ).select(F.concat(F.lit("https://s.test/sitemap-"), c("n").cast("string"), F.lit(".xml")).alias("name"), "body")
    listed = F.concat(F.lit("<sitemap><loc>"), c("name"), F.lit("</loc></sitemap>"))
    index = parts.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(listed), ""), F.lit("<sitemap><loc>https://s.test/index.xml</loc></sitemap></sitemapindex>")).alias("body"))
    return parts.union(index.select(F.lit("https://s.test/index.xml").alias("name"), "body"))


def _expanded(s, d):
    return B.expanded_sitemaps(_sitemaps(s, d), s.range(1).select(F.lit("https://s.test/index.xml").alias("name")))


def _listings(s, d):
    n = c("page_id")
    rows = F.struct(n.alias("id"), F.col("url").alias("link"), (F.when(n % 10 == 0, 0).otherwise(n - n % 10)).alias("parent"))
    return I.pages(s, d).groupBy(F.concat(F.lit("list"), F.floor(n / 500).cast("string")).alias("endpoint")).agg(F.to_json(F.collect_list(rows)).alias("body"))


def _shop(s, d):
    n = c("page_id")
    rows = F.struct(F.concat(F.lit("item-"), n.cast("string")).alias("handle"))
    return I.pages(s, d).groupBy(F.concat(F.lit("https://shop"), F.floor(n / 500).cast("string"), F.lit(".test/")).alias("root")).agg(
        F.to_json(F.struct(F.collect_list(rows).alias("products"))).alias("body")
    )


def _export(s, d):
    """Two tables of an export with quoted cells, and one that lists something else."""
    n = c("page_id")
    german = F.concat_ws(";", F.concat(F.lit('"'), c("url"), F.lit('"')), F.concat((n % 7).cast("string"), F.lit(".123")), n.cast("string"), F.lit("1%"), F.concat((n % 40).cast("string"), F.lit(",5")))
    english = F.concat_ws(",", c("url"), F.concat((n % 40).cast("string"), F.lit(".5")), F.lit('"1,234"'), n.cast("string"))
    words = F.concat_ws(",", F.concat(F.lit("word "), n.cast("string")), F.lit("5,6,1%,2"))
    head = s.createDataFrame(
        [("de", -1, "Häufigste Seiten;Klicks;Impressionen;CTR;Position"), ("en", -1, "Top pages,Position,Clicks,Impressions"), ("words", -1, "Queries,Clicks,Impressions,CTR,Position")],
        "file string, nr long, line string",
    )
    rows = I.pages(s, d).select(F.explode(F.array(F.struct(F.lit("de").alias("file"), n.alias("nr"), german.alias("line")), *[F.struct(F.lit(f).alias("file"), n.alias("nr"), x.alias("line")) for f, x in (("en", english), ("words", words))])).alias("r"))
    return head.union(rows.select("r.*"))


def _odd_export(s, d):
    """A table with a byte order mark, a cell that goes over two lines, and its figures beyond forty others."""
    n = c("page_id")
    fill = "," * 40
    head = s.createDataFrame([("wide", -1, "\ufeffTop pages,Note" + fill + "Clicks,Impressions,Position")], "file string, nr long, line string")
    first = F.concat(c("url"), F.lit(',"says ""'), n.cast("string"))
    second = F.concat(F.lit('"", and more"' + fill), F.concat_ws(",", (n % 9).cast("string"), n.cast("string"), F.concat((n % 40).cast("string"), F.lit(".5"))))
    row = lambda k, line: F.struct(F.lit("wide").alias("file"), (2 * n + k).alias("nr"), line.alias("line"))
    return head.union(I.pages(s, d).select(F.explode(F.array(row(0, first), row(1, second))).alias("r")).select("r.*"))


def _responses(s, d):
    """Listings of fifty stored pages: by cursor, by a declared number, until one repeats, and without an end."""
    n = c("page_id")
    group, j = F.floor(n / 50).cast("long"), n % 50
    endpoint = F.concat(F.lit("https://cms.test/e"), group.cast("string"), F.lit("?per_page=9"))
    cursor = lambda k: F.concat(endpoint, F.lit("&after="), k.cast("string"))
    kind = group % 4
    url = F.when(j == 0, endpoint).when(kind == 0, cursor(j)).otherwise(F.concat(endpoint, F.lit("&page="), (j + 1).cast("string")))
    link = F.when((kind == 0) & (j < 7), F.concat(F.lit('<https://cms.test/>; rel="prev", <'), cursor(j + 1), F.lit('>; title=x; REL="Next"')))
    body = F.concat(F.lit("page "), F.when(kind == 2, F.least(j, F.lit(2))).otherwise(j).cast("string"))
    headers = F.create_map(F.lit("Link"), F.coalesce(link, F.lit("")), F.lit("X-WP-TotalPages"), F.when(kind == 1, "5").otherwise("none"))
    return I.pages(s, d).select(endpoint.alias("endpoint"), url.alias("url"), F.lit(200).alias("status"), body.alias("body"), headers.alias("headers"))


def _corpus(s, d):
    """Label files: sites by host, some again in a later file."""
    n = c("page_id")
    site = lambda add: F.struct(
        U.host_of("url").alias("name"), F.lit("blog").alias("archetype"),
        F.array(F.struct(c("url"), F.element_at(F.array(*map(F.lit, I.LEVELS)), ((n + add) % 4 + 1).cast("int")).alias("expected_level"), F.lit("UNKNOWN").alias("expected_page_type"))).alias("entries"),
    )
    return I.pages(s, d).select(
        F.concat((n % 2).cast("string"), F.lit("-"), n.cast("string"), F.lit(".json")).alias("file"),
        F.when(n % 2 == 0, F.to_json(site(0))).otherwise(F.to_json(F.array(site(1)))).alias("body"),
    )


def _worksheet(s, d):
    n = c("page_id")
    marks = F.element_at(F.array(*map(F.lit, ["yes", " OK", "no", ""])), (n % 4 + 1).cast("int"))
    level = F.when(n % 5 == 0, "L9").otherwise(F.lower(F.lit("L3_LEAF_PAGE")))
    return I.pages(s, d).select("url", marks.alias("reviewed"), level.alias("expected_level"), F.lit("UNKNOWN").alias("expected_page_type"))


def _robots(s, d):
    n = c("page_id")
    body = F.concat(F.lit("User-agent: *\nUser-agent: Bot\nDisallow: /x"), n.cast("string"), F.lit("\nAllow: /y # z\nDisallow:\nUser-agent: other\nDisallow: /\n"))
    return I.pages(s, d).select(F.concat(F.lit("h"), n.cast("string")).alias("host"), body.alias("body"))


def _samples(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    us = F.unix_micros(c("ts").cast("timestamp_ltz")).cast("double")
    return e.select(c("user_id").alias("job"), (us / 1e6).alias("ts"), c("event_id").alias("completed"), (c("event_id") + 500).alias("discovered"))


def _folder(s) -> str:
    """A place for stream checkpoints in the shared folder of the session."""
    staged(s.range(1))
    top = s.sparkContext.getCheckpointDir()
    return f"{top}/stream-{os.urandom(8).hex()}"


def _stream_counts(s, d):
    """The event log as a stream of files; equal to the batch count."""
    schema = s.read.parquet(f"{d}/events.parquet").schema
    log = s.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    counts = log.groupBy("event_type").agg(F.count("*").alias("n"))
    return T.run_once(counts, "complete", _folder(s), f"counts_{os.urandom(4).hex()}")


def _verdicts(s, d):
    log = s.readStream.schema("page_id long, url string, html string").parquet(f"{d}/pages*.parquet")
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.repeat(F.lit("/q"), (c("page_id") % 5).cast("int")), F.lit("/a/b/c/"))
    return T.run_once(T.loop_verdicts(log.select(url.alias("url"))), "append", _folder(s), f"loops_{os.urandom(4).hex()}")


def _stream_loops(s, d):
    """Tails confirmed as loops, address by address."""
    return _verdicts(s, d).where("verdict = 'confirming'").select("tail")


def queries() -> dict:
    return {
        "st1_confirmed_loops": _stream_loops,
        "st1_loop_members": lambda s, d: T.loop_members(_verdicts(s, d)).select("url", "tail"),
        "htm2_nav_links": lambda s, d: H.nav_links(I.pages(s, d)).select("url", "nr", "href", "depth"),
        "htm3_menu": lambda s, d: M.address_menu(I.pages(s, d)).select("url", "ord", "target", F.array_join("labels", " > ").alias("labels")),
        "src2_sitemap_entries": lambda s, d: B.sitemap_entries(_sitemaps(s, d)).select("name", "kind", "loc"),
        "src4_wordpress_records": lambda s, d: B.wordpress_records(_listings(s, d)),
        "src5_shopify_records": lambda s, d: B.shopify_records(_shop(s, d)),
        "src6_listing_pages": lambda s, d: P.listing_bodies(_responses(s, d)),
        "src3_expanded_sitemaps": _expanded,
        "src7_search_export": lambda s, d: B.search_export(_export(s, d)),
        "src7_picked_export": lambda s, d: B.archive_export(_export(s, d)),
        "src7_odd_export": lambda s, d: B.search_export(_odd_export(s, d)),
        "src7_rejected_rows": lambda s, d: B.rejected_rows(_export(s, d)),
        "src8_picked_table": lambda s, d: B.pick_table(B.export_cells(_export(s, d))),
        "src9_named_columns": lambda s, d: B.named_columns(B.export_cells(_export(s, d))),
        "src11_label_corpus": lambda s, d: B.label_corpus(_corpus(s, d)),
        "src12_reviewed_rows": lambda s, d: B.reviewed_rows(_worksheet(s, d), S.LEVELS, I.TYPES).select("url", "usable"),
        "src13_robots_rules": lambda s, d: B.robots_rules(_robots(s, d)),
        "st2_progress_rate": lambda s, d: T.progress_rate(_samples(s, d)),
        "st2_progress": lambda s, d: T.progress(_samples(s, d), 9000),
        "st2_recent_items": lambda s, d: T.recent_items(s.read.parquet(f"{d}/events.parquet").select(c("user_id").alias("job"), "ts", c("event_id").alias("item"))),
        "st3_stream_counts": _stream_counts,
        "st_hourly_fetches": lambda s, d: T.hourly_fetches(s.read.parquet(f"{d}/events.parquet")),
    }


#: Samples of each job folded in order of time: z the last, s the last that counted with its rate.
_FOLD = """WITH l AS (SELECT user_id AS job, list({'t': epoch_us(ts) / 1e6, 'n': event_id, 'r': NULL::DOUBLE} ORDER BY ts, event_id) AS xs FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL GROUP BY 1),
f AS (SELECT job, xs[-1] AS z, xs[1].t AS began, list_reduce(xs, lambda a, b: CASE WHEN b.t - a.t >= 0.05 THEN {'t': b.t, 'n': b.n, 'r': CASE WHEN coalesce(a.r, 0) = 0 THEN greatest(0, b.n - a.n) / (b.t - a.t) ELSE 0.3::DOUBLE * (greatest(0, b.n - a.n) / (b.t - a.t)) + 0.7::DOUBLE * a.r END} ELSE a END) AS s FROM l)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "htm2_nav_links": """SELECT url, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS nr, unnest(l) AS href, 0 AS depth
  FROM (SELECT url, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) AS l FROM pages)""",
        "htm3_menu": """SELECT url, CAST(row_number() OVER (PARTITION BY url ORDER BY nr) AS INTEGER) AS ord, target, label AS labels
  FROM (SELECT url, nr, root || href AS target, label FROM (SELECT url, regexp_extract(url, '^([^:]*://[^/?#]*)', 1) AS root, generate_subscripts(l, 1) AS nr,
    unnest(list_transform(l, lambda x: regexp_extract(x, '"([^"]*)"', 1))) AS href, unnest(list_transform(l, lambda x: regexp_extract(x, '>([^<]*)<', 1))) AS label
    FROM (SELECT url, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="[^"]*">[^<]*</a>') AS l FROM pages))
  QUALIFY row_number() OVER (PARTITION BY url, root || href ORDER BY nr) = 1)""",
        "src2_sitemap_entries": "SELECT DISTINCT 'https://s.test/sitemap-' || (page_id // 1000) || '.xml' AS name, 'URLSET' AS kind, url AS loc FROM pages UNION ALL SELECT 'https://s.test/index.xml', 'INDEX', x FROM (SELECT DISTINCT 'https://s.test/sitemap-' || (page_id // 1000) || '.xml' AS x FROM pages UNION ALL SELECT 'https://s.test/index.xml')",
        "src6_listing_pages": """WITH p AS (SELECT 'https://cms.test/e' || (page_id // 50) || '?per_page=9' AS endpoint, page_id // 50 % 4 AS kind, page_id % 50 AS j FROM pages)
  SELECT endpoint, CAST(j + 1 AS INTEGER) AS nr, endpoint || CASE WHEN j = 0 THEN '' WHEN kind = 0 THEN '&after=' || j ELSE '&page=' || (j + 1) END AS url, 'page ' || j AS body
  FROM p WHERE j < CASE kind WHEN 0 THEN 8 WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 40 END""",
        "src3_expanded_sitemaps": "SELECT DISTINCT url, 'sitemap-' || (page_id // 1000) || '.xml' AS sitemap_source FROM pages",
        "src7_picked_export": "SELECT 'en' AS file, url, 1234::BIGINT AS clicks, page_id AS impressions, (page_id % 40) + 0.5::DOUBLE AS position FROM pages",
        "src7_odd_export": "SELECT 'wide' AS file, url, page_id % 9 AS clicks, page_id AS impressions, (page_id % 40) + 0.5::DOUBLE AS position FROM pages",
        "src7_rejected_rows": "SELECT * FROM (VALUES ('de', 0::BIGINT), ('en', 0::BIGINT)) v(file, rejected) UNION ALL SELECT 'words' AS file, count(*) AS rejected FROM pages",
        "src8_picked_table": "SELECT 'en' AS file, count(*) + 1 AS rows, count(*) / (count(*) + 1)::DOUBLE AS share FROM pages",
        "src9_named_columns": "SELECT * FROM (VALUES ('de', true, 1, 2, 4), ('en', true, 2, 3, 1), ('words', true, 1, 2, 4)) v(file, header, clicks, impressions, position)",
        "src11_label_corpus": f"SELECT {I.sql_host('url')} AS name, 'blog' AS archetype, url, {I.sql_pick(I.LEVELS, 'page_id + page_id % 2')} AS expected_level, 'UNKNOWN' AS expected_page_type FROM pages QUALIFY row_number() OVER (PARTITION BY {I.sql_host('url')} ORDER BY (page_id % 2) || '-' || page_id || '.json' DESC) = 1",
        "src12_reviewed_rows": "SELECT url, page_id % 5 <> 0 AS usable FROM pages WHERE page_id % 4 < 2",
        "src4_wordpress_records": "WITH r AS (SELECT 'list' || (page_id // 500) AS endpoint, page_id AS id, url AS link, nullif(CASE WHEN page_id % 10 = 0 THEN 0 ELSE page_id - page_id % 10 END, 0) AS parent FROM pages) SELECT r.*, p.link AS parent_url, EXISTS (SELECT 1 FROM r x WHERE x.endpoint = r.endpoint AND x.parent = r.id) AS has_children FROM r LEFT JOIN r p ON p.endpoint = r.endpoint AND p.id = r.parent",
        "src5_shopify_records": "SELECT 'https://shop' || (page_id // 500) || '.test/products/item-' || page_id AS url, 'products' AS record_type, false AS has_children FROM pages",
        "src7_search_export": "SELECT 'de' AS file, url, CAST((page_id % 7) * 1000 + 123 AS BIGINT) AS clicks, page_id AS impressions, (page_id % 40) + 0.5::DOUBLE AS position FROM pages UNION ALL SELECT 'en', url, 1234, page_id, (page_id % 40) + 0.5::DOUBLE FROM pages",
        "src13_robots_rules": "SELECT 'h' || page_id AS host, agent, pattern, allow FROM pages, (VALUES ('*', 'x', false), ('bot', 'x', false), ('*', '/y', true), ('bot', '/y', true), ('other', '/', false)) v(agent, p0, allow), LATERAL (SELECT CASE WHEN p0 = 'x' THEN '/x' || page_id ELSE p0 END AS pattern)",
        "st1_confirmed_loops": f"SELECT tail FROM (SELECT url, array_to_string(g[-3:], '/') AS tail, len(g) AS depth FROM (SELECT url, {I.sql_segs(I.sql_path('url'))} AS g FROM (SELECT regexp_replace(url, '[?#].*$', '') || repeat('/q', CAST(page_id % 5 AS INTEGER)) || '/a/b/c/' AS url FROM pages))) GROUP BY 1 HAVING count(DISTINCT url) >= 25 AND count(DISTINCT depth) >= 4",
        "st3_stream_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
        "st1_loop_members": f"WITH t AS (SELECT DISTINCT url, array_to_string(g[-3:], '/') AS tail, len(g) AS depth FROM (SELECT url, {I.sql_segs(I.sql_path('url'))} AS g FROM (SELECT regexp_replace(url, '[?#].*$', '') || repeat('/q', CAST(page_id % 5 AS INTEGER)) || '/a/b/c/' AS url FROM pages))) SELECT url, tail FROM t WHERE tail IN (SELECT tail FROM t GROUP BY 1 HAVING count(*) >= 25 AND count(DISTINCT depth) >= 4)",
        "st2_progress_rate": _FOLD + "SELECT job, z.n AS completed, s.r AS rate FROM f",
        "st2_progress": _FOLD + "SELECT job, completed, total, least(1.0, CASE WHEN total > 0 THEN completed / total ELSE 0 END)::DOUBLE AS share, round(coalesce(r, 0), 3) AS rate, round(CASE WHEN elapsed >= 3 AND r > 0 AND total > 0 THEN greatest(total - completed, 0) / r END, 1) AS eta_seconds FROM (SELECT job, z.n AS completed, least(z.n + 500, 9000) AS total, s.r AS r, z.t - began AS elapsed FROM f)",
        "st2_recent_items": "SELECT user_id AS job, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS nr, event_id AS item FROM events QUALIFY nr <= 20",
        "st_hourly_fetches": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    }
