"""Stateful streams, the ledger of a crawl, and stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.sources.store import Store, csv_lines
from siteloom.streaming import crawl_stream as T
from siteloom.streaming import ledger as L
from siteloom.streaming import live

from . import audit_queries as AQ
from . import inputs as I
from . import source_queries as SQ

c = F.col


def _events(s, d):
    return s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events*.parquet")


def _pages(s, d):
    return s.readStream.schema("page_id long, url string, html string").parquet(f"{d}/pages*.parquet")


def _once(s, made, mode):
    folder = SQ._folder(s)
    return T.run_once(made, mode, folder, folder.rpartition("/")[2].replace("-", "_"))


def _progress(s, d):
    live.use_rocksdb(s)
    us = F.unix_micros(c("ts").cast("timestamp_ltz")).cast("double")
    samples = _events(s, d).select(
        c("user_id").cast("string").alias("job"), (us / 1e6).alias("ts"), c("event_id").alias("completed"), (c("event_id") + 500).alias("discovered"), c("event_type").alias("item")
    )
    rows = live.latest(_once(s, live.live_progress(samples, 9000, idle=None), "update"))
    return rows.select("job", "samples", "completed", "total", "share", "rate", "eta_seconds", F.array_join("recent", ",").alias("recent"))


def _loops(s, d):
    """What a crawl keeps out: by tail, whether it was confirmed and how many addresses it had."""
    live.use_rocksdb(s)
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.repeat(F.lit("/q"), (c("page_id") % 5).cast("int")), F.lit("/a/b/c/"))
    rows = _once(s, live.discovered_loops(_pages(s, d).select(url.alias("url")), keep=None), "append")
    out = rows.where("verdict in ('evicted', 'refused', 'confirming')").groupBy("tail").agg(F.countDistinct("url").alias("urls"))
    early = rows.where("verdict in ('admitted')").select("tail", "url").distinct()
    gone = rows.where("verdict = 'evicted'").select("tail", "url").distinct()
    left = early.join(gone, ["tail", "url"], "left_anti").groupBy("tail").agg(F.count(F.lit(1)).alias("kept"))
    return out.join(left, "tail", "left").select("tail", "urls", F.coalesce("kept", F.lit(0)).alias("kept"))


def _ledger(s, d, html="html"):
    folder = SQ._folder(s)
    made = L.Ledger(s, f"{folder}-ledger")
    L.follow(_pages(s, d).selectExpr("url", f"{html} AS html"), made, folder)
    return made


def _checkpoint(s, d):
    left = _ledger(s, d).unclassified(I.crawl(s, d).where("ord % 2 = 0"))
    return left.select("key", "inbound", "page_type", "level", "confidence")


def _stored(s, d, partial=False):
    """A job's classified pages, written twice under one name."""
    store = Store(s, f"{SQ._folder(s)}-results")
    own = I.crawl(s, d).where("ord % 2 = 0").select("url", "page_type", "level", "score")
    store.write(own.where("score > 0.5"), "job", partial=True)
    store.write(own, "job", partial)
    return store


def _csv(s, d):
    n = c("page_id")
    text = F.concat(F.lit('say "'), n.cast("string"), F.lit('",\nit is'))
    rows = I.pages(s, d).select("url", F.when(n % 3 == 0, text).when(n % 3 == 1, "").alias("note"), (n % 5).alias("n")).orderBy("url")
    return csv_lines(rows)


def queries() -> dict:
    return {
        "st2_live_progress": _progress,
        "st1_evictions": _loops,
        "st3_link_degrees": lambda s, d: _ledger(s, d).nodes().where("refused is null").select("key", "inbound", "outbound"),
        "st3_refusals": lambda s, d: _ledger(s, d, """concat(html, '<a href="/again/a/again/', page_id % 7, '">x</a>')""").refusals(),
        "src15_checkpoint": _checkpoint,
        "snk1_stored_result": lambda s, d: _stored(s, d).read("job"),
        "src14_restored_result": lambda s, d: _stored(s, d, True).restored("job"),
        "snk8_csv_lines": _csv,
    }


_TAILS = f"""WITH t AS (SELECT DISTINCT url, array_to_string(g[-3:], '/') AS tail, len(g) AS depth FROM (SELECT url, {I.sql_segs(I.sql_path('url'))} AS g FROM
  (SELECT regexp_replace(url, '[?#].*$', '') || repeat('/q', CAST(page_id % 5 AS INTEGER)) || '/a/b/c/' AS url FROM pages))) """
_MET = f""", met AS (SELECT href AS url, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges UNION ALL SELECT url, 0, 0 FROM pages),
  ledger AS (SELECT {I.sql_norm_url('url')} AS key, CAST(sum(i) AS BIGINT) AS inbound, CAST(sum(o) AS BIGINT) AS outbound, min(url) AS url FROM met GROUP BY 1),
  judged AS (SELECT *, CASE WHEN {AQ._MEDIA} THEN 'media' WHEN {AQ._TRAP} THEN 'trap' END AS refused FROM ledger)"""


def oracle_sql() -> dict[str, str]:
    w = I.with_views
    own = "SELECT url, page_type, level, score{} FROM crawl WHERE ord % 2 = 0"
    return {
        "st2_live_progress": SQ._FOLD
        + """SELECT CAST(job AS VARCHAR) AS job, n AS samples, completed, total, least(1.0, CASE WHEN total > 0 THEN completed / total ELSE 0 END)::DOUBLE AS share, round(coalesce(r, 0), 3) AS rate,
  round(CASE WHEN elapsed >= 3 AND r > 0 AND total > 0 THEN greatest(total - completed, 0) / r END, 1) AS eta_seconds, recent
  FROM (SELECT job, z.n AS completed, least(z.n + 500, 9000) AS total, s.r AS r, z.t - began AS elapsed FROM f)
  JOIN (SELECT user_id AS job, count(*) AS n, array_to_string(list(event_type ORDER BY ts, event_id)[-20:], ',') AS recent FROM events GROUP BY 1) USING (job)""",
        "st1_evictions": _TAILS + "SELECT tail, count(*) AS urls, 0::BIGINT AS kept FROM t GROUP BY 1 HAVING count(*) >= 25 AND count(DISTINCT depth) >= 4",
        "st3_link_degrees": w(AQ._GRAPH + _MET + "SELECT key, inbound, outbound FROM judged WHERE refused IS NULL", "spelled"),
        "st3_refusals": w(AQ._GRAPH + _MET.replace("UNION ALL SELECT url, 0, 0 FROM pages", "UNION ALL SELECT url, 0, 0 FROM pages UNION ALL SELECT regexp_extract(url, '^([^:]*://[^/?#]*)', 1) || '/again/a/again/' || (page_id % 7), 1, 0 FROM pages") + "SELECT refused, count(*) AS n FROM judged WHERE refused IS NOT NULL GROUP BY 1", "spelled"),
        "src15_checkpoint": w(AQ._GRAPH + _MET + f"SELECT key, inbound, 'UNKNOWN' AS page_type, 'L3_LEAF_PAGE' AS level, 0::DOUBLE AS confidence FROM judged WHERE refused IS NULL AND key NOT IN (SELECT {I.sql_norm_url('url')} FROM crawl WHERE ord % 2 = 0)", "spelled", "crawl"),
        "snk1_stored_result": w(own.format(""), "crawl"),
        "src14_restored_result": w(own.format(", true AS partial"), "crawl"),
        "snk8_csv_lines": """SELECT 0::BIGINT AS nr, chr(65279) || 'url,note,n' AS line UNION ALL
  SELECT row_number() OVER (ORDER BY url), CASE WHEN contains(url, ',') THEN '"' || url || '"' ELSE url END || ',' || CASE WHEN page_id % 3 = 0 THEN '"say ""' || page_id || '"",' || chr(10) || 'it is"' ELSE '' END || ',' || (page_id % 5) FROM pages""",
    }
