"""Worklists, download listings and counts over classified pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import scalars as S
from siteloom.functions import urls as U

from .ranking import running


def affordable(pages: DataFrame, budget: float) -> DataFrame:
    """The least certain pages (score, url, cost) whose running cost stays within a
    budget (the feature), with what is ``spent`` up to each."""
    running_ = running(pages, [], [F.col("score").asc(), F.col("url").asc()], sums={"spent": "cost"})
    return running_.withColumn("spent", F.round("spent", 9)).where(F.col("spent") <= budget)


def level_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("level").agg(F.count("*").alias("pages"), F.count_if(F.col("page_type") == "UNKNOWN").alias("unknown"))


def subtree(pages: DataFrame, trail: list[str]) -> DataFrame:
    """Pages at or below a node of the section tree."""
    return pages.where(F.slice("trail", 1, len(trail)) == F.array(*map(F.lit, trail)))


def ancestors(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """node: the chosen nodes (trail) and all above them that have pages."""
    nodes = pages.select(F.explode(S.prefixes(F.col("trail"))).alias("node")).distinct()
    above = chosen.select(F.explode(S.prefixes(F.col("trail"))).alias("node")).distinct()
    return nodes.join(above, "node", "left_semi")


def child_page(pages: DataFrame, size: int, page: int) -> DataFrame:
    """One page of every section's children, with how many remain."""
    rows = pages.select("url", F.array_join(S.section_trail(F.col("trail")), " > ").alias("section"))
    ranked = running(rows, ["section"], [F.col("url").asc()], rank="nr").withColumn("nr", F.col("nr").cast("int"))
    numbered = ranked.where(F.col("nr").between(size * page + 1, size * (page + 1)))
    totals = rows.groupBy("section").agg(F.count("*").alias("n"))
    return numbered.join(totals, "section").select("section", "url", "nr", F.greatest(F.col("n") - size * (page + 1), F.lit(0)).alias("left"))


def corpus_coverage(labels: DataFrame, archetypes: DataFrame, wanted: int = 50) -> DataFrame:
    """Labels of each archetype, zeros kept, and how many are missing."""
    counts = labels.groupBy("archetype").agg(F.count("*").alias("entries"))
    return archetypes.join(counts, "archetype", "left").select(
        "archetype", F.coalesce("entries", F.lit(0)).alias("entries"), F.greatest(F.lit(wanted) - F.coalesce("entries", F.lit(0)), F.lit(0)).alias("shortfall")
    )


def weakest(accuracy: DataFrame) -> DataFrame:
    """One row: the archetype that is hit least, and whether all are sampled enough."""
    by = accuracy.where("archetype is not null and evaluated > 0")
    return by.agg(F.min_by("archetype", F.struct("exact_rate", "archetype")).alias("weakest"), F.bool_and("sufficient").alias("trustworthy"))


def review_progress(sheet: DataFrame, levels: list[str]) -> DataFrame:
    """total, reviewed, admitted, unusable of a reviewed worksheet."""
    done = F.lower(F.trim("reviewed")).isin("y", "yes", "true", "1", "ok", "done")
    good = F.col("expected_level").isin(*levels)
    return sheet.agg(
        F.count("*").alias("total"), F.count_if(done).alias("reviewed"), F.count_if(done & good).alias("admitted"), F.count_if(done & ~good).alias("unusable")
    )


def resume_set(nodes: DataFrame, fetched: DataFrame) -> DataFrame:
    """key, role: what is still to be fetched (seed), and what isn't to be fetched again."""
    have = fetched.select(U.normalize_url("url").alias("key")).distinct().withColumn("have", F.lit(True))
    return nodes.select("key").join(have, "key", "left").select("key", F.when(F.col("have"), "exclude").otherwise("seed").alias("role"))


def crawler_export(rows: DataFrame) -> DataFrame:
    """Another crawler's export (all text): blanks dropped, tolerant numbers, depth null if blank."""
    number = lambda c: F.coalesce(F.trim(F.col(c)).try_cast("bigint"), F.lit(0))
    return rows.where(F.trim("Address") != "").select(
        F.trim("Address").alias("url"), number("Status Code").alias("status"), number("Unique Inlinks").alias("inlinks"), F.trim("Crawl Depth").try_cast("int").alias("depth")
    )


#: Gravest first (fixed values).
SEVERITIES = ["high", "medium", "low"]


def finding_list(findings: DataFrame, examples: int = 5) -> DataFrame:
    """kind, severity, count and a few examples of rows (kind, severity, url), the
    gravest first and of these the most frequent."""
    some = running(findings.select("kind", "url"), ["kind"], [F.col("url").asc()], rank="nr").where(F.col("nr") <= examples)
    named = some.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("url")), " ").alias("examples"))
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return findings.groupBy("kind", "severity").agg(F.count("*").alias("n")).join(named, "kind").orderBy(rank, F.desc("n"), "kind")
