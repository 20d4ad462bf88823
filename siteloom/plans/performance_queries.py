"""Address resolution, roll-up and opportunities over the derived export."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from siteloom.functions import scalars as S
from siteloom.functions import urls as U
from siteloom.operators import opportunities as O
from siteloom.operators import performance as P
from siteloom.operators import resolve as R
from siteloom.operators.staging import staged

from . import inputs as I


class Audit:
    """The steps of one audit.  Deduped pages, which every step reads, are staged;
    resolved rows where several steps of a query read them (``shared``)."""

    def __init__(self, spark, d, shared=False):
        self.spark, self.d, self.shared = spark, d, shared

    def _kept(self, df):
        return staged(df) if self.shared else df

    @cached_property
    def pages(self):
        return staged(R.dedupe(I.crawled(self.spark, self.d)))

    @cached_property
    def exported(self):
        """The export, some rows in other spellings that no page has."""
        nr = F.col("ord")
        url = (
            F.when(nr % 13 == 1, F.regexp_replace("url", r"^(https?://)", "$1staging."))
            .when(nr % 13 == 3, F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/abcd/abcd/")))
            .when(nr % 17 == 2, "not an address")
            .when(nr % 17 == 5, F.concat(F.lit("https://elsewhere.test/"), nr.cast("string")))
            .otherwise(F.col("url"))
        )
        return I.gsc(self.spark, self.d).withColumn("url", url)

    @cached_property
    def resolved(self):
        return self._kept(R.resolve(self.exported, self.pages))

    @cached_property
    def both(self):
        """Rows of the export and of the analytics, resolved together."""
        none = F.lit(None).cast("long")
        own = self.exported.withColumn("sessions", none)
        other = I.ga4(self.spark, self.d).select(
            "ord", F.col("path").alias("url"), none.alias("clicks"), none.alias("impressions"), F.lit(None).cast("double").alias("position"), "sessions"
        )
        return R.resolve(own.unionByName(other), self.pages)

    @cached_property
    def metrics(self):
        return P.page_metrics(self.both)

    @cached_property
    def found(self):
        """Search figures alone, by page."""
        return P.page_metrics(self.resolved.withColumn("sessions", F.lit(None).cast("long"))).drop("sessions")

    @cached_property
    def rollup(self):
        return P.rollup(self.pages, self.metrics).withColumn("section", F.array_join("section", " > "))

    @cached_property
    def measured(self):
        joined = self.pages.join(self.found, self.pages["url"] == self.found["page_url"])
        return self._kept(joined.withColumn("position", F.coalesce(S.weighted_position(F.col("weight"), F.col("impressions")), F.lit(0.0))))

    @cached_property
    def share(self):
        return O.orphan_share(self.pages)

    @cached_property
    def orphans(self):
        return O.orphans(self.measured, self.share)

    @cached_property
    def buried(self):
        return O.buried(self.measured, self.orphans)

    @cached_property
    def traps(self):
        return O.traps(self.resolved.where("failure is not null"))

    @cached_property
    def subdomains(self):
        totals = self.resolved.agg(F.sum("clicks").alias("all_clicks"), F.count("*").alias("all_rows"))
        return O.subdomains(P.unmatched_groups(self.resolved), totals)

    @cached_property
    def siblings(self):
        reported = self.orphans.select("url").union(self.buried.select("url"))
        return O.siblings(self.measured, self.pages, reported, self.share)

    @cached_property
    def ranked(self):
        found = self._kept(self.orphans.union(self.buried).union(self.traps).union(self.subdomains).union(self.siblings))
        return O.ranked(found)


def queries() -> dict:
    return {
        "pf1_dedupe_profiles": lambda s, d: Audit(s, d).pages.select("key", "url", "ord"),
        "pf2_tier_index": lambda s, d: R.tier_index(Audit(s, d).pages),
        "pf3_merge_tiers": lambda s, d: R.merge_tiers(R.tier_index(Audit(s, d).pages)),
        "pf4_resolve": lambda s, d: Audit(s, d).resolved.select("ord", "page_url", "via", "failure"),
        "pf5_resolution_report": lambda s, d: R.report(Audit(s, d).resolved),
        "pf6_page_metrics": lambda s, d: Audit(s, d).metrics,
        "pf6_unattributed": lambda s, d: P.unattributed(Audit(s, d).both),
        "pf7_section_rollup": lambda s, d: Audit(s, d).rollup,
        "pf8_unmatched_groups": lambda s, d: P.unmatched_groups(Audit(s, d).resolved),
        "pf9_matched_listing": lambda s, d: P.matched_listing((a := Audit(s, d)).pages, a.found),
        "pf10_top_sections": lambda s, d: Audit(s, d).rollup.where("depth = 1").select("section", "clicks", "pages").orderBy(F.desc("clicks"), "section"),
        "op_1_orphan_share": lambda s, d: Audit(s, d).share,
        "op_2_orphan_with_traffic": lambda s, d: Audit(s, d).orphans,
        "op_3_buried_with_traffic": lambda s, d: Audit(s, d).buried,
        "op_4_indexed_trap": lambda s, d: Audit(s, d).traps,
        "op_5_indexed_subdomain": lambda s, d: Audit(s, d).subdomains,
        "op_6_weak_sibling": lambda s, d: Audit(s, d, shared=True).siblings,
        "op_7_ranked": lambda s, d: Audit(s, d, shared=True).ranked,
        "op_8_report_order": lambda s, d: O.report_order(Audit(s, d, shared=True).ranked).select("kind", "severity", "url", "score"),
    }


_norm, _pkey = I.sql_norm_url("url"), I.sql_path_key("url")
_bare = lambda u: I.sql_norm_path(I.sql_path(u))
_dom = lambda h: f"CASE WHEN len(string_split({h}, '.')) < 3 THEN {h} WHEN string_split({h}, '.')[-2] IN {I._in(U.SECOND_LEVEL)} THEN array_to_string(string_split({h}, '.')[-3:], '.') ELSE array_to_string(string_split({h}, '.')[-2:], '.') END"

_CTES = f"""+pages_ AS (
  SELECT * FROM (SELECT *, {_norm} AS key FROM crawled)
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY len(trail) DESC, ord) = 1
), claims AS (
  SELECT * FROM (
    SELECT 0 AS tier, url AS alias_url, url AS owner, ord FROM pages_ UNION ALL
    SELECT 1, final_url, url, ord FROM pages_ UNION ALL SELECT 2, canonical_url, url, ord FROM pages_)
), spaces AS (
  SELECT 'absolute' AS space, {I.sql_norm_url("alias_url")} AS alias, tier, owner, ord FROM claims UNION ALL
  SELECT 'path', {I.sql_path_key("alias_url")}, tier, owner, ord FROM claims UNION ALL
  SELECT 'bare', {_bare("alias_url")}, tier, owner, ord FROM claims
), tiers AS (
  SELECT space, alias, tier, arg_min(owner, ord) AS owner, count(*) > 1 AS clash FROM spaces GROUP BY ALL
), idx AS (
  SELECT * FROM tiers QUALIFY row_number() OVER (PARTITION BY space, alias ORDER BY tier) = 1
), exported AS (
  SELECT ord, clicks, impressions, position, CASE
    WHEN ord % 13 = 1 THEN regexp_replace(url, '^(https?://)', '\\1staging.')
    WHEN ord % 13 = 3 THEN regexp_replace(url, '[?#].*$', '') || '/abcd/abcd/'
    WHEN ord % 17 = 2 THEN 'not an address'
    WHEN ord % 17 = 5 THEN 'https://elsewhere.test/' || ord ELSE url END AS url FROM gsc
), hosts AS (
  SELECT DISTINCT {I.sql_host("url")} AS host FROM pages_
), looked AS (
  SELECT 'gsc' AS src, ord, url, clicks, impressions, position, 0 AS sessions FROM exported UNION ALL
  SELECT 'ga4', ord, path, 0, 0, 0, sessions FROM ga4
), keyed AS (
  SELECT *, {I.sql_host("url")} AS host, {_norm} AS ak, {_pkey} AS pk, {_bare("url")} AS bk FROM looked
), outcome AS (
  SELECT k.*, CASE
    WHEN k.host = '' AND NOT starts_with(k.url, '/') THEN 'unparseable'
    WHEN k.host <> '' AND a.clash THEN 'ambiguous' WHEN k.host <> '' AND a.owner IS NOT NULL THEN NULL
    WHEN k.host <> '' AND h.host IS NULL AND {_dom("k.host")} IN (SELECT {_dom("host")} FROM hosts) THEN 'other_subdomain'
    WHEN k.host <> '' AND h.host IS NULL THEN 'off_site'
    WHEN p.clash THEN 'ambiguous' WHEN p.owner IS NOT NULL THEN NULL
    WHEN b.clash THEN 'ambiguous' WHEN b.owner IS NOT NULL THEN NULL ELSE 'not_crawled' END AS failure,
    CASE WHEN k.host <> '' AND a.owner IS NOT NULL THEN a.owner WHEN p.owner IS NOT NULL THEN p.owner ELSE b.owner END AS page0,
    CASE WHEN k.host <> '' AND a.owner IS NOT NULL THEN ['crawled_url', 'redirect_target', 'canonical_tag'][a.tier + 1]
         WHEN p.owner IS NOT NULL THEN ['crawled_url', 'redirect_target', 'canonical_tag'][p.tier + 1] ELSE 'bare_path' END AS via0
  FROM keyed k LEFT JOIN idx a ON a.space = 'absolute' AND a.alias = k.ak LEFT JOIN idx p ON p.space = 'path' AND p.alias = k.pk
  LEFT JOIN idx b ON b.space = 'bare' AND b.alias = k.bk LEFT JOIN hosts h ON h.host = k.host
), resolved AS (
  SELECT *, CASE WHEN failure IS NULL THEN page0 END AS page_url, CASE WHEN failure IS NULL THEN via0 END AS via FROM outcome
), g AS (
  SELECT page_url, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, sum(position * impressions) AS weight
  FROM resolved WHERE src = 'gsc' AND failure IS NULL GROUP BY 1
), a4 AS (
  SELECT page_url, CAST(sum(sessions) AS BIGINT) AS sessions FROM resolved WHERE src = 'ga4' AND failure IS NULL GROUP BY 1
), metrics AS (
  SELECT coalesce(g.page_url, a4.page_url) AS page_url, clicks, impressions, weight, sessions FROM g FULL JOIN a4 ON g.page_url = a4.page_url
), trails AS (
  SELECT p.*, m.clicks, m.impressions, m.weight, m.sessions, CASE WHEN len(trail) > 0 THEN trail ELSE ['OTHERS'] END AS own
  FROM pages_ p LEFT JOIN metrics m ON m.page_url = p.url
), spread AS (
  SELECT *, own[1:n] AS section FROM (SELECT *, unnest(range(0, len(own) + 1)) AS n FROM trails)
), sections AS (
  SELECT section AS path, array_to_string(section, ' > ') AS section, len(section)::INTEGER AS depth, count(*) AS pages,
    count_if(clicks IS NOT NULL OR sessions IS NOT NULL) AS pages_with_data, count_if(own = section) AS direct_pages,
    CAST(coalesce(sum(CASE WHEN own = section THEN clicks END), 0) AS BIGINT) AS direct_clicks, CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks,
    CAST(coalesce(sum(impressions), 0) AS BIGINT) AS impressions, CAST(coalesce(sum(sessions), 0) AS BIGINT) AS sessions, coalesce(sum(weight), 0) AS weight
  FROM spread GROUP BY section
), lost AS (
  SELECT * FROM resolved WHERE src = 'gsc' AND failure IS NOT NULL
), groups AS (
  SELECT host, failure AS reason, count(*) AS urls, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions,
    array_to_string((list(url ORDER BY clicks DESC, url))[1:3], ' ') AS examples FROM lost GROUP BY 1, 2
), measured AS (
  SELECT *, coalesce(weight / nullif(impressions, 0), 0) AS position, coalesce(clicks / nullif(impressions, 0), 0) AS ctr FROM trails WHERE clicks IS NOT NULL
), shr AS (
  SELECT count_if(inbound = 0) / count(*)::DOUBLE AS orphan_share FROM pages_
), orphans AS (
  SELECT 'ORPHAN_WITH_TRAFFIC' AS kind, url, clicks::DOUBLE AS value, 'routine' AS severity FROM measured, shr WHERE orphan_share <= 0.5 AND inbound = 0 AND clicks >= 1
), buried AS (
  SELECT 'BURIED_WITH_TRAFFIC' AS kind, url, clicks::DOUBLE AS value, 'routine' AS severity FROM measured
  WHERE len(own) >= 3 AND clicks >= 1 AND url NOT IN (SELECT url FROM orphans)
), traps AS (
  SELECT 'INDEXED_CRAWL_TRAP' AS kind, url, arg_min(impressions, ord)::DOUBLE AS value, 'routine' AS severity FROM lost
  WHERE ord % 13 = 3 GROUP BY url
), subs AS (
  SELECT 'INDEXED_SUBDOMAIN' AS kind, host AS url, clicks::DOUBLE AS value, CASE WHEN greatest(clicks / (SELECT sum(clicks) FROM exported), urls / (SELECT count(*) FROM exported)) >= 0.01 THEN 'critical' ELSE 'routine' END AS severity
  FROM groups WHERE reason = 'other_subdomain' AND host <> ''
), hub AS (
  SELECT own, url AS hub_url, inbound AS hub_inbound FROM measured WHERE inbound <= 0.2 * (SELECT count(*) FROM pages_)
  QUALIFY row_number() OVER (PARTITION BY own ORDER BY inbound DESC, ord) = 1
), sect AS (
  SELECT own, count(*) AS members, sum(clicks) / nullif(sum(impressions), 0) AS sctr FROM measured GROUP BY own
), sibs AS (
  SELECT 'UNDERPERFORMING_SIBLING' AS kind, url, impressions::DOUBLE AS value, 'routine' AS severity
  FROM measured JOIN hub USING (own) JOIN sect USING (own), shr
  WHERE orphan_share <= 0.5 AND members >= 2 AND hub_inbound > 0 AND url <> hub_url AND impressions >= 100 AND position BETWEEN 5 AND 20 AND ctr < coalesce(sctr, 0)
    AND url NOT IN (SELECT url FROM orphans UNION SELECT url FROM buried)
), findings AS (
  SELECT * FROM orphans UNION ALL SELECT * FROM buried UNION ALL SELECT * FROM traps UNION ALL SELECT * FROM subs UNION ALL SELECT * FROM sibs
), ranked AS (
  SELECT kind, severity, url, CASE WHEN most > 0 THEN 100.0::DOUBLE * value / most ELSE 0 END AS score, found, found > 1000 AS truncated, nr FROM (
    SELECT *, max(value) OVER (PARTITION BY kind) AS most, count(*) OVER (PARTITION BY kind) AS found, CAST(row_number() OVER (PARTITION BY kind ORDER BY value DESC, url) AS INTEGER) AS nr FROM findings)
  WHERE nr <= 1000
)
"""

_TAIL = {
    "pf1_dedupe_profiles": "SELECT key, url, ord FROM pages_",
    "pf2_tier_index": "SELECT * FROM tiers",
    "pf3_merge_tiers": "SELECT space, alias, tier, owner, clash FROM idx",
    "pf4_resolve": "SELECT ord, page_url, via, failure FROM resolved WHERE src = 'gsc'",
    "pf5_resolution_report": "SELECT count(*) AS total, count_if(failure IS NULL) AS matched, 100.0::DOUBLE * count_if(failure IS NULL) / count(*) AS match_rate, 100.0 * count_if(failure IS NULL) / count(*) >= 90 AS reliable, "
    + ", ".join(f"count_if(via = '{t}') AS via_{t}" for t in ["crawled_url", "redirect_target", "canonical_tag", "bare_path"])
    + ", "
    + ", ".join(f"count_if(failure = '{f}') AS failed_{f}" for f in R.FAILURES)
    + " FROM resolved WHERE src = 'gsc'",
    "pf6_page_metrics": "SELECT * FROM metrics",
    "pf6_unattributed": "SELECT count(*) AS rows, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(sessions) AS BIGINT) AS sessions FROM resolved WHERE failure IS NOT NULL",
    "pf7_section_rollup": "SELECT section, depth, pages, pages_with_data, direct_pages, direct_clicks, clicks, impressions, sessions, CASE WHEN impressions > 0 THEN clicks / impressions ELSE 0 END::DOUBLE AS ctr, weight / nullif(impressions, 0) AS position, pages_with_data / pages::DOUBLE AS data_coverage FROM sections",
    "pf8_unmatched_groups": "SELECT * FROM groups",
    "pf9_matched_listing": "SELECT url, array_to_string(own, ' > ') AS section, page_type, level, inbound, clicks, impressions, round_even(CASE WHEN impressions > 0 THEN clicks / impressions ELSE 0 END, 6) AS ctr, weight / nullif(impressions, 0) AS position FROM trails WHERE clicks IS NOT NULL",
    "pf10_top_sections": "SELECT section, clicks, pages FROM sections WHERE depth = 1",
    "op_1_orphan_share": "SELECT orphan_share FROM shr",
    "op_2_orphan_with_traffic": "SELECT * FROM orphans",
    "op_3_buried_with_traffic": "SELECT * FROM buried",
    "op_4_indexed_trap": "SELECT * FROM traps",
    "op_5_indexed_subdomain": "SELECT * FROM subs",
    "op_6_weak_sibling": "SELECT * FROM sibs",
    "op_7_ranked": "SELECT * FROM ranked",
    "op_8_report_order": "SELECT kind, severity, url, score FROM ranked",
}


def oracle_sql() -> dict[str, str]:
    return {n: I.with_views(_CTES + tail, "crawled", "gsc", "ga4") for n, tail in _TAIL.items()}
