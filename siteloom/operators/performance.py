"""Search and analytics figures by page, rolled up over sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import scalars as S


def page_metrics(resolved: DataFrame) -> DataFrame:
    """One row per page that either source names; a source that doesn't leaves nulls.

    ``resolved`` has the rows of both sources, each with nulls in the columns of
    the other.  Positions stay weights until they are shown.
    """
    return resolved.where("failure is null").groupBy("page_url").agg(
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.sum(F.col("position") * F.col("impressions")).alias("weight"),
        F.sum("sessions").alias("sessions"),
    )


def unattributed(resolved: DataFrame) -> DataFrame:
    """One row: what reached no page."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return resolved.where("failure is not null").agg(F.count("*").alias("rows"), zero("clicks"), zero("impressions"), zero("sessions"))


def rollup(pages: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every page added to itself and all its ancestors; the site is the empty path.

    Rates are made from sums, last.  OTHERS may hold most pages; partial sums keep that cheap.
    """
    trail = S.section_trail(F.col("trail"))
    joined = pages.join(metrics, pages["url"] == metrics["page_url"], "left").select(
        trail.alias("own"), "clicks", "impressions", "weight", "sessions", F.explode(S.prefixes(trail)).alias("section")
    )
    own = F.col("own") == F.col("section")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = joined.groupBy("section").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("clicks").isNotNull() | F.col("sessions").isNotNull()).alias("pages_with_data"),
        F.count_if(own).alias("direct_pages"),
        F.coalesce(F.sum(F.when(own, F.col("clicks"))), F.lit(0)).alias("direct_clicks"),
        zero("clicks").alias("clicks"),
        zero("impressions").alias("impressions"),
        zero("sessions").alias("sessions"),
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"),
    )
    return sums.select(
        "section",
        F.size("section").alias("depth"),
        "pages",
        "pages_with_data",
        "direct_pages",
        "direct_clicks",
        "clicks",
        "impressions",
        "sessions",
        S.ctr(F.col("clicks"), F.col("impressions")).alias("ctr"),
        S.weighted_position(F.col("weight"), F.col("impressions")).alias("position"),
        S.share(F.col("pages_with_data").cast("double"), F.col("pages"), 0.0).alias("data_coverage"),
    )


def unmatched_groups(resolved: DataFrame, examples: int = 3) -> DataFrame:
    """Unmatched rows by host and reason, with the first addresses by clicks.

    A bounded list for each group: only rows that may be among the first meet.
    """
    from pyspark.sql import Window

    lost = resolved.where("failure is not null")
    ranked = lost.withColumn("nr", F.row_number().over(Window.partitionBy("host", "failure").orderBy(F.desc("clicks"), "url"))).where(F.col("nr") <= examples)
    named = ranked.groupBy("host", "failure").agg(F.array_sort(F.collect_list(F.struct("nr", "url"))).alias("e"))
    sums = lost.groupBy("host", "failure").agg(F.count("*").alias("urls"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    return sums.join(named, ["host", "failure"]).select(
        "host", F.col("failure").alias("reason"), "urls", "clicks", "impressions", F.array_join("e.url", " ").alias("examples")
    )


def matched_listing(pages: DataFrame, metrics: DataFrame) -> DataFrame:
    """Matched pages with their section, as the download shows them."""
    return pages.join(metrics.where("clicks is not null"), pages["url"] == metrics["page_url"]).select(
        "url",
        F.array_join(S.section_trail(F.col("trail")), " > ").alias("section"),
        "page_type",
        "level",
        "inbound",
        "clicks",
        "impressions",
        F.bround(S.ctr(F.col("clicks"), F.col("impressions")), 6).alias("ctr"),
        S.weighted_position(F.col("weight"), F.col("impressions")).alias("position"),
    )
