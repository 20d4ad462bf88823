"""The section tree as people browse it: nodes, lanes, filters and the printed report.

A node is a path of labels; a page that is its section's own page sits on the
node, any other is a leaf below it.  All are aggregates over exploded prefixes,
so no tree is built in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import scalars as S
from siteloom.functions import urls as U

REPORT_DEPTH, REPORT_ROWS = 2, 3000


def local_trail(url: str = "url") -> Column:
    """The trail (or OTHERS), below the address's locale if it has one."""
    locale = U.locale_of(url)
    return F.concat(F.when(locale.isNotNull(), F.array(locale)).otherwise(F.array().cast("array<string>")), S.section_trail(F.col("trail")))


def nav_tree(pages: DataFrame) -> DataFrame:
    """path, depth, url, pages: section nodes with their own page (null without one)
    and, for all other pages, leaves; ``pages`` (url, trail, nav_parent_url) are how
    many lie at or below a node."""
    rows = pages.select("url", local_trail().alias("own"), F.coalesce(F.col("nav_parent_url") == F.col("url"), F.lit(False)).alias("section_page"))
    # of several pages that say they are a section's own, the first stays
    own = rows.where("section_page").groupBy("own").agg(F.min("url").alias("page"))
    nodes = rows.select("own", F.explode(S.prefixes(F.col("own"))).alias("node")).where("size(node) > 0")
    counts = nodes.groupBy("node").agg(F.count("*").alias("pages"))
    sections = counts.join(own.withColumnRenamed("own", "node"), "node", "left").select(
        F.concat(F.lit("/"), F.array_join("node", "/")).alias("path"), F.size("node").alias("depth"), F.col("page").alias("url"), "pages"
    )
    leaves = rows.join(own, "own", "left").where("not section_page or url <> page")
    return sections.union(
        leaves.select(F.concat(F.lit("/"), F.array_join("own", "/"), F.lit("#"), "url"), F.size("own") + 1, "url", F.lit(1).cast("long"))
    )


def lanes(pages: DataFrame) -> DataFrame:
    """path, lane, nodes, provenance of section nodes of pages (trail, source): the
    lane is the depth up to 3, and 0 for OTHERS; provenance is that of all pages
    below (menu, breadcrumb, none), mixed if they differ."""
    trail = S.section_trail(F.col("trail"))
    spread = pages.select("source", trail.alias("own"), F.explode(S.prefixes(trail)).alias("node")).where("size(node) > 0")
    found = spread.groupBy("node").agg(F.count("*").alias("pages"), F.min("source").alias("low"), F.max("source").alias("high"))
    lane = F.when(F.col("node")[0] == S.OTHERS, 0).otherwise(F.least(F.size("node"), F.lit(3)))
    return found.select(
        F.array_join("node", " > ").alias("path"), lane.alias("lane"), "pages", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("mixed").alias("provenance")
    )


def shown(tree: DataFrame, lanes_: list[int], bands: list[str], opened: DataFrame) -> DataFrame:
    """Nodes (path, lane, score) of the chosen lanes and bands all of whose ancestors
    are among the ``opened`` (path) and pass too; a node without a score has no band."""
    passing = tree.where(F.col("lane").isin(lanes_) & (F.col("score").isNull() | S.band(F.col("score")).isin(bands)))
    above = lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda n: F.slice(p, 1, n))
    ready = passing.select("path").join(opened.select("path").distinct(), "path", "left_semi").withColumn("ok", F.lit(1))
    spread = passing.where(F.size("path") > 1).select("path", F.explode(above(F.col("path"))).alias("up"))
    held = spread.join(ready.withColumnRenamed("path", "up"), "up", "left").groupBy("path").agg(F.min(F.coalesce("ok", F.lit(0))).alias("ok"))
    return passing.join(held, "path", "left").where("size(path) = 1 or ok = 1").select("path", "lane", "score")


def report_rows(pages: DataFrame, depth: int = REPORT_DEPTH, most: int = REPORT_ROWS) -> DataFrame:
    """path, depth, pages: the sections of the printed report in order of their paths,
    none deeper than ``depth``, at most ``most`` (the feature); sections below the
    first level have something below them."""
    trail = S.section_trail(F.col("trail"))
    spread = pages.select(trail.alias("own"), F.explode(S.prefixes(trail)).alias("node")).where(F.size("node").between(1, depth + 1))
    nodes = spread.groupBy("node").agg(F.count("*").alias("pages"))
    printed = nodes.select(F.array_join("node", " > ").alias("path"), F.size("node").alias("depth"), "pages")
    return printed.orderBy("path").limit(most)


def omitted(pages: DataFrame, depth: int = REPORT_DEPTH, most: int = REPORT_ROWS) -> DataFrame:
    """One row: sections that the report would print without its limit, and how many it leaves out."""
    trail = S.section_trail(F.col("trail"))
    nodes = pages.select(F.explode(S.prefixes(trail)).alias("node")).where(F.size("node").between(1, depth + 1)).distinct()
    return nodes.agg(F.count("*").alias("sections")).withColumn("omitted", F.greatest(F.col("sections") - most, F.lit(0)))
