"""The listings that people download, as rows in their column order; ``sources.store.write_csv`` writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import scalars as S

#: What the reasons of unmatched and unreconciled addresses mean.
UNMATCHED = {
    "unparseable": "the cell holds no address",
    "ambiguous": "several pages go by this address",
    "off_site": "the address is on another site",
    "other_subdomain": "a subdomain that the crawl did not enter",
    "not_crawled": "no crawled page goes by this address",
}
RECONCILED = {
    "MISSED_PAGE": "a page that this crawl did not find",
    "REDIRECT": "the address redirects",
    "CLIENT_ERROR": "the address answers with an error",
    "MEDIA": "a file, not a page",
    "TRAP": "part of an endless address space",
    "NON_INDEXABLE": "search engines are told to leave it out",
    "OFF_SITE": "the address is on another site",
    "MALFORMED": "markup or blanks in the address",
    "REPEATED_SUFFIX": "one of many addresses with the same end",
    "QUERY_VARIANT": "a variant by its parameters",
    "SITEMAP_ORPHAN": "listed, but linked from nowhere",
}


def _meaning(reason: str, meanings: dict[str, str]):
    return F.coalesce(F.create_map(*[F.lit(x) for pair in meanings.items() for x in pair])[F.col(reason)], F.lit(""))


def opportunities(ranked: DataFrame, measured: DataFrame, skipped: DataFrame) -> DataFrame:
    """severity, kind, score, url, section, clicks, impressions, position, reason: the
    findings with the figures of their pages, and a row for each kind that was not
    evaluated (``skipped``: kind, gap)."""
    pages = measured.select(
        "url", F.array_join(S.section_trail(F.col("trail")), " > ").alias("section"), "clicks", "impressions", "position"
    )
    rows = ranked.join(pages, "url", "left").select(
        "severity", "kind", "score", "url", F.coalesce("section", F.lit("")).alias("section"), "clicks", "impressions", "position", F.lower(F.replace("kind", F.lit("_"), F.lit(" "))).alias("reason")
    )
    return rows.unionByName(skipped.select("kind", F.concat(F.lit("not evaluated: "), "gap").alias("reason")), allowMissingColumns=True)


def unmatched(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """row, host, reason, meaning, url, urls, clicks, impressions: totals of each group, then each row."""
    totals = groups.select(F.lit("group").alias("row"), "host", "reason", F.lit("").alias("url"), "urls", "clicks", "impressions")
    each = rows.select(F.lit("address").alias("row"), "host", F.col("failure").alias("reason"), "url", F.lit(1).cast("long").alias("urls"), "clicks", "impressions")
    return totals.unionByName(each).withColumn("meaning", _meaning("reason", UNMATCHED))


def reconciliation(rows: DataFrame) -> DataFrame:
    """url, found_by, reason, meaning, n: a summary of each side and reason, then each address (key, side, reason)."""
    blank = rows.withColumn("reason", F.coalesce("reason", F.lit("")))
    summary = blank.groupBy("side", "reason").agg(F.count("*").alias("n")).select(F.lit("").alias("url"), F.col("side").alias("found_by"), "reason", "n")
    each = blank.select(F.col("key").alias("url"), F.col("side").alias("found_by"), "reason", F.lit(1).cast("long").alias("n"))
    return summary.unionByName(each).withColumn("meaning", _meaning("reason", RECONCILED))


def duplicates(sets: DataFrame, kept: DataFrame, trails: DataFrame) -> DataFrame:
    """leaf, url, action (keep, redirect), trails: the members of each set of duplicates,
    and in how many places the site shows them."""
    return (
        sets.join(kept, "leaf").join(trails, "leaf", "left")
        .select("leaf", "url", F.when(F.col("url") == F.col("keep"), "keep").otherwise("redirect").alias("action"), F.coalesce("trails", F.lit(1)).alias("trails"))
    )
