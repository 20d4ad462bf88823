"""Page classes by votes of structural signals, weighed and summed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import scalars as S
from siteloom.functions import urls as U

# Weights of the five signals, by profile; the order breaks ties.
SOURCES = ["CMS", "ARIA", "SITEMAP", "JSONLD", "IN_DEGREE"]
#: Their names in listings.
SOURCE_NAMES = ["CMS_API_ENDPOINT", "ARIA_NAV_TREE", "SITEMAP_INDEX", "SCHEMA_JSONLD", "LINK_IN_DEGREE"]
WEIGHTS = {
    "default": [0.30, 0.25, 0.20, 0.15, 0.10],
    "wordpress": [0.38, 0.20, 0.24, 0.12, 0.06],
    "shopify": [0.42, 0.15, 0.18, 0.20, 0.05],
    "headless": [0.0, 0.40, 0.26, 0.22, 0.12],
}
SITEMAP_HINTS = [
    ("product", "L3_LEAF_PAGE", "PRODUCT_DETAIL_PAGE"),
    ("collection", "L2_SUB_NAV_HUB", "PRODUCT_CATEGORY_HUB"),
    ("categor", "L2_SUB_NAV_HUB", "PRODUCT_CATEGORY_HUB"),
    ("case-stud", "L3_LEAF_PAGE", "CASE_STUDY"),
    ("case_stud", "L3_LEAF_PAGE", "CASE_STUDY"),
    ("blog", "L3_LEAF_PAGE", "BLOG_ARTICLE"),
    ("post", "L3_LEAF_PAGE", "BLOG_ARTICLE"),
    ("news", "L3_LEAF_PAGE", "BLOG_ARTICLE"),
    ("resource", "L3_LEAF_PAGE", "BLOG_ARTICLE"),
    ("service", "L3_LEAF_PAGE", "SERVICE_DETAIL_PAGE"),
    ("software", "L3_LEAF_PAGE", "SERVICE_DETAIL_PAGE"),
    ("global-page", "L1_PRIMARY_NAV_HUB", "COMPANY_ABOUT"),
    ("page", "L1_PRIMARY_NAV_HUB", "SERVICE_CATEGORY_HUB"),
]
ACCEPT, FAST = 0.85, 0.97


def vote(source: str, level: Column | str, kind: Column | str, confidence: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(SOURCES.index(source)).alias("source"), lit(level).alias("level"), lit(kind).alias("page_type"), lit(confidence).cast("double").alias("confidence")
    )


def cms_vote(kind: Column, parent: Column, parent_url: Column, children: Column) -> Column:
    root = F.coalesce(parent, F.lit(0)) == 0
    hub = F.when(root, "L1_PRIMARY_NAV_HUB").otherwise("L2_SUB_NAV_HUB")
    low = F.lower(kind)
    sure = F.when(parent_url.isNotNull() | root, 0.95).otherwise(0.88)
    return (
        F.when(low.isin("product", "products"), vote("CMS", "L3_LEAF_PAGE", "PRODUCT_DETAIL_PAGE", sure))
        .when(low.isin("collection", "collections", "product_category", "category"), vote("CMS", hub, "PRODUCT_CATEGORY_HUB", sure))
        .when(low.isin("post", "posts"), vote("CMS", "L3_LEAF_PAGE", "BLOG_ARTICLE", sure))
        .when(low.isNotNull() & children, vote("CMS", hub, "SERVICE_CATEGORY_HUB", sure))
        .when(low.isNotNull(), vote("CMS", "L3_LEAF_PAGE", "SERVICE_DETAIL_PAGE", sure))
    )


def nav_vote(depth: Column) -> Column:
    return (
        F.when(depth <= 0, vote("ARIA", "L1_PRIMARY_NAV_HUB", "SERVICE_CATEGORY_HUB", 0.90))
        .when(depth == 1, vote("ARIA", "L2_SUB_NAV_HUB", "SERVICE_CATEGORY_HUB", 0.82))
        .when(depth >= 2, vote("ARIA", "L3_LEAF_PAGE", "SERVICE_DETAIL_PAGE", 0.70))
    )


def sitemap_vote(name: Column) -> Column:
    made, low = F.lit(None), F.lower(name)
    for part, level, kind in reversed(SITEMAP_HINTS):
        made = F.when(low.contains(part), vote("SITEMAP", level, kind, 0.75)).otherwise(made)
    return made


def degree_vote(inbound: Column, total: Column) -> Column:
    enough = F.when(total > 0, F.least(F.lit(1000), F.greatest(F.lit(10), F.floor(total / 2)))).otherwise(1000)
    return (
        F.when(inbound <= 0, F.lit(None))
        .when(inbound >= enough, vote("IN_DEGREE", "L1_PRIMARY_NAV_HUB", "SERVICE_CATEGORY_HUB", 0.72))
        .when((inbound <= 1) & (total > 50), vote("IN_DEGREE", "L3_LEAF_PAGE", "UNKNOWN", 0.35))
    )


def collect(pages: DataFrame, *votes: Column) -> DataFrame:
    """Long table url, source, level, page_type, confidence."""
    return pages.select("url", F.explode(F.filter(F.array(*votes), lambda v: v.isNotNull())).alias("v")).select("url", "v.*")


def consensus(signals: DataFrame, profile: str = "default", by: tuple[str, ...] = ("url",)) -> DataFrame:
    """The (level, type) with the most weighted confidence; ties to the earlier signal.

    A source of weight 0 has no part in it.  Where several pages share an address, their
    votes count together; of two with equal sums from the same source the level, then the
    type, that sorts first wins, however the rows are dealt.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS[profile])), F.col("source") + 1)
    return _weighed(signals.withColumn("w", weight), by)


def consensus_by_profile(signals: DataFrame) -> DataFrame:
    """The consensus under each profile's weights, with ``profile``; signals are read once."""
    each = [F.struct(F.lit(name).alias("profile"), F.array(*map(F.lit, weights)).alias("weights")) for name, weights in WEIGHTS.items()]
    rows = signals.withColumn("p", F.explode(F.array(*each)))
    return _weighed(rows.select("*", "p.profile", F.element_at("p.weights", F.col("source") + 1).alias("w")), ("profile", "url"))


def _weighed(signals: DataFrame, by: tuple[str, ...]) -> DataFrame:
    sums = signals.where("w > 0").groupBy(*by, "level", "page_type").agg(
        F.round(F.sum(F.col("w") * F.col("confidence")), 12).alias("s"), F.sum("w").alias("own"), F.min("source").alias("first"), F.count("*").alias("n")
    )
    best = F.struct((-F.col("s")).alias("s"), "first", "level", "page_type")
    return sums.groupBy(*by).agg(
        F.min_by(F.struct("level", "page_type", "s", "n"), best).alias("b"), F.sum("own").alias("all"), F.sum("n").alias("votes")
    ).select(*by, "b.level", "b.page_type", F.least(F.lit(1.0), F.col("b.s") / F.col("all")).alias("confidence"), F.col("b.n").alias("supporters"), "votes")


def cascade(pages: DataFrame, voted: DataFrame, local: DataFrame | None = None, paid: DataFrame | None = None, by: tuple[str, ...] = ("url",)) -> DataFrame:
    """URL rule, then consensus, then the vote of a local and of a paid classifier
    where what stands is not sure enough, else unresolved; the pair made valid.

    ``local`` and ``paid`` are votes (url, level, page_type, confidence) from
    outside; see ``local_votes`` and ``batch_votes``.  Where pages share an address,
    ``by`` names the columns that tell them apart; votes and result have these too.
    """
    own = list(dict.fromkeys(["url", *by]))
    vote_of = lambda method: F.when(
        F.col("level").isNotNull(), F.struct("level", "page_type", "confidence", F.lit(method).alias("method"))
    )
    rule = U.fast_path("url")
    first = F.when(rule.isNotNull(), F.struct(rule["level"].alias("level"), rule["page_type"].alias("page_type"), F.lit(FAST).alias("confidence"), F.lit("URL_RULE").alias("method")))
    found = pages.select(*own, first.alias("first")).join(voted.select("url", vote_of("x").alias("v")), "url", "left")
    consensus_ = F.when(
        F.col("v").isNotNull(), F.col("v").withField("method", F.when(F.col("v.confidence") >= ACCEPT, "LAYER1").otherwise("WEIGHTED_CONSENSUS"))
    )
    found = found.select(*own, F.coalesce("first", consensus_).alias("o"))
    for votes, method in ((local, "LAYER2_LOCAL"), (paid, "LAYER3_PAID")):
        if votes is not None:
            more = votes.select(*by, vote_of(method).alias("more"))
            unsure = F.coalesce(F.col("o.confidence") < ACCEPT, F.lit(True))
            found = found.join(more, list(by), "left").select(*own, F.when(unsure & F.col("more").isNotNull(), F.col("more")).otherwise(F.col("o")).alias("o"))
    level, kind = F.coalesce("o.level", F.lit("L3_LEAF_PAGE")), F.coalesce("o.page_type", F.lit("UNKNOWN"))
    repaired = S.repaired_pair(F.col("level"), F.col("page_type"))
    plain = found.select(*own, level.alias("level"), kind.alias("page_type"), F.coalesce("o.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("o.method", F.lit("UNRESOLVED")).alias("method"))
    return plain.select(*own, repaired["level"].alias("level"), repaired["page_type"].alias("page_type"), "confidence", "method")


def local_votes(pages: DataFrame, classify: Column, by: tuple[str, ...] = ("url",)) -> DataFrame:
    """Votes of a classifier that judges a page at a time: ``classify`` is a column
    (of a pandas UDF, or of an expression) that gives level, page_type and
    confidence, or null where it abstains.  ``by`` as in ``cascade``."""
    own = list(dict.fromkeys(["url", *by]))
    return pages.select(*own, classify.alias("v")).where("v is not null").select(*own, "v.level", "v.page_type", "v.confidence")


def batch_votes(pages: DataFrame, classify: Callable) -> DataFrame:
    """Votes of a classifier that takes pages by the batch: ``classify`` maps an
    iterator of pandas frames (url and what ``pages`` has) to frames of votes."""
    return pages.mapInPandas(classify, "url string, level string, page_type string, confidence double")


def external_votes(pages: DataFrame, votes: DataFrame) -> DataFrame:
    """Votes from outside, keyed by normal address (key, level, page_type, confidence), by page."""
    return pages.select("url", U.normalize_url("url").alias("key")).join(votes, "key").select("url", "level", "page_type", "confidence")


def weight_report(sites: DataFrame, adaptive: bool = False) -> DataFrame:
    """site, applied, adaptive, detected: the weight profile in use, and the one that
    the site's family (family, client_side) would have."""
    return sites.select(
        "site",
        S.weight_profile(F.col("family"), F.col("client_side"), adaptive).alias("applied"),
        F.lit(adaptive).alias("adaptive"),
        S.weight_profile(F.col("family"), F.col("client_side"), True).alias("detected"),
    )


def escalated(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("confidence") < ACCEPT)


def summary(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("page_type") == "UNKNOWN").alias("unknown"),
        F.count_if(F.col("confidence") < ACCEPT).alias("low_confidence"),
    )


def resummarise(pages: DataFrame, orphans: int) -> DataFrame:
    """The head figures of a changed set of pages (method, confidence, page_type);
    ``orphans`` come from discovery, which a merge doesn't change."""
    n, paid = F.count("*"), F.count_if(F.col("method") == "LAYER3_PAID")
    return pages.agg(
        n.alias("pages"),
        paid.alias("escalated"),
        S.share(paid.cast("double"), n, 0.0).alias("escalation_rate"),
        F.count_if(F.col("page_type") == "UNKNOWN").alias("unknown"),
        F.count_if(~S.confident(F.col("confidence"), F.col("page_type"))).alias("low_confidence"),
        F.lit(orphans).cast("long").alias("orphans"),
    )
