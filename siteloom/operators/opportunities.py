"""Pages worth a look: five kinds, ranked within each.

``measured`` are pages with search figures: url, trail, inbound, clicks,
impressions, position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import scalars as S
from siteloom.functions import urls as U

KINDS = ["ORPHAN_WITH_TRAFFIC", "BURIED_WITH_TRAFFIC", "INDEXED_CRAWL_TRAP", "INDEXED_SUBDOMAIN", "UNDERPERFORMING_SIBLING"]
BURIED_DEPTH, ORPHAN_GATE, SITEWIDE, BAND, MIN_IMPRESSIONS, CRITICAL_SHARE, CAP = 3, 0.5, 0.2, (5.0, 20.0), 100, 0.01, 1000


def _finding(kind: str, url: Column, value: Column, severity: Column | None = None) -> list[Column]:
    return [
        F.lit(kind).alias("kind"),
        url.alias("url"),
        value.cast("double").alias("value"),
        (F.lit("routine") if severity is None else severity).alias("severity"),
    ]


def orphan_share(pages: DataFrame) -> DataFrame:
    """One row: the share of pages that nothing links to."""
    return pages.agg(S.share(F.count_if(F.col("inbound") == 0).cast("double"), F.count("*"), 0.0).alias("orphan_share"))


def orphans(measured: DataFrame, share: DataFrame) -> DataFrame:
    ok = measured.crossJoin(F.broadcast(share)).where(F.col("orphan_share") <= ORPHAN_GATE)  # one row
    return ok.where("inbound = 0 and clicks >= 1").select(*_finding(KINDS[0], F.col("url"), F.col("clicks")))


def buried(measured: DataFrame, orphans_: DataFrame) -> DataFrame:
    deep = measured.where((F.size(S.section_trail(F.col("trail"))) >= BURIED_DEPTH) & (F.col("clicks") >= 1))
    return deep.join(orphans_.select("url"), "url", "left_anti").select(*_finding(KINDS[1], F.col("url"), F.col("clicks")))


def traps(unmatched: DataFrame) -> DataFrame:
    bad = unmatched.where(U.is_spider_trap("url") | U.is_malformed("url"))
    first = bad.groupBy("url").agg(F.min_by("impressions", "ord").alias("impressions"))
    return first.select(*_finding(KINDS[2], F.col("url"), F.col("impressions")))


def subdomains(groups: DataFrame, totals: DataFrame) -> DataFrame:
    """``totals``: one row with exported clicks and rows."""
    g = groups.where("reason = 'other_subdomain' and host <> ''").crossJoin(F.broadcast(totals))
    worst = F.greatest(S.share(F.col("clicks").cast("double"), F.col("all_clicks"), 0.0), S.share(F.col("urls").cast("double"), F.col("all_rows"), 0.0))
    severity = F.when(worst >= CRITICAL_SHARE, "critical").otherwise("routine")
    return g.select(*_finding(KINDS[3], F.col("host"), F.col("clicks"), severity))


def siblings(measured: DataFrame, pages: DataFrame, reported: DataFrame, share: DataFrame) -> DataFrame:
    """Aggregates by section and a join, so that one huge section is no single window."""
    m = measured.withColumn("section", S.section_trail(F.col("trail")))
    site = pages.agg(F.count("*").alias("site_pages"))
    m = m.crossJoin(F.broadcast(site)).crossJoin(F.broadcast(share)).where(F.col("orphan_share") <= ORPHAN_GATE)
    topical = F.col("inbound") <= F.col("site_pages") * SITEWIDE
    best = F.when(topical, F.struct("inbound", (-F.col("ord")).alias("o")))
    by = m.groupBy("section").agg(
        F.count("*").alias("members"),
        F.sum("clicks").alias("c"),
        F.sum("impressions").alias("i"),
        F.max_by(F.struct("url", "inbound"), best).alias("hub"),
    )
    joined = m.join(by, "section").where("members >= 2 and hub.inbound > 0")
    low, high = BAND
    weak = joined.where(
        (F.col("url") != F.col("hub.url"))
        & (F.col("impressions") >= MIN_IMPRESSIONS)
        & F.col("position").between(low, high)
        & (S.ctr(F.col("clicks"), F.col("impressions")) < S.ctr(F.col("c"), F.col("i")))
    )
    return weak.join(reported.select("url"), "url", "left_anti").select(*_finding(KINDS[4], F.col("url"), F.col("impressions")))


def ranked(findings: DataFrame, cap: int = CAP) -> DataFrame:
    """Scores out of 100 of the kind's largest, at most ``cap`` of a kind (the feature)."""
    most = findings.groupBy("kind").agg(F.max("value").alias("most"), F.count("*").alias("found"))
    scored = findings.join(F.broadcast(most), "kind")  # five rows at most
    order = Window.partitionBy("kind").orderBy(F.desc("value"), "url")
    return (
        scored.withColumn("nr", F.row_number().over(order))
        .where(F.col("nr") <= cap)
        .withColumn("score", F.when(F.col("most") > 0, 100.0 * F.col("value") / F.col("most")).otherwise(0.0))
        .select("kind", "severity", "url", "score", "found", (F.col("found") > cap).alias("truncated"), "nr")
    )


def report_order(found: DataFrame) -> DataFrame:
    """Critical first, then by kind, then by score."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return found.orderBy(F.col("severity") != "critical", rank, F.desc("score"), "url")
