"""Which crawled page an exported address means: a tiered join that refuses to guess.

``pages`` needs url, final_url, canonical_url, trail, ord (arrival order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import scalars as S
from siteloom.functions import urls as U

#: Evidence, strongest first (fixed values).
TIERS = [("url", "crawled_url"), ("final_url", "redirect_target"), ("canonical_url", "canonical_tag")]
BARE = "bare_path"
FAILURES = ["unparseable", "ambiguous", "off_site", "other_subdomain", "not_crawled"]


def dedupe(pages: DataFrame) -> DataFrame:
    """One row per normalised address: the deepest placement, then the first.

    An aggregate, not a window: copies of a hot address meet as partial maxima.
    """
    best = F.struct(S.trail_depth(F.col("trail")).alias("d"), (-F.col("ord")).alias("o"))
    whole = F.struct(*[F.col(c) for c in pages.columns])
    return pages.groupBy(U.normalize_url("url").alias("key")).agg(F.max_by(whole, best).alias("p")).select("key", "p.*")


def tier_index(pages: DataFrame) -> DataFrame:
    """space, alias, tier, owner, clash: who claims an alias in one tier; ``pages`` are deduped."""
    claims = [
        F.struct(
            F.lit(space).alias("space"), make(F.col(source)).alias("alias"), F.lit(n).alias("tier"), F.col("url").alias("owner"), F.col("ord").alias("ord")
        )
        for n, (source, _) in enumerate(TIERS)
        for space, make in (("absolute", U.normalize_url), ("path", U.path_key), ("bare", U.match_key))
    ]
    rows = pages.select(F.explode(F.array(*claims)).alias("c")).select("c.*").where("alias is not null and alias <> ''")
    return rows.groupBy("space", "alias", "tier").agg(F.min_by("owner", "ord").alias("owner"), (F.count("*") > 1).alias("clash"))


def merge_tiers(index: DataFrame) -> DataFrame:
    """The strongest tier decides an alias; if it clashes there, the alias is ambiguous."""
    top = F.struct("tier", "owner", "clash")
    return index.groupBy("space", "alias").agg(F.min_by(top, "tier").alias("t")).select("space", "alias", "t.*")


#: How an address is looked up: by its whole key, by path and parameters, by path alone.
SPACES = {"absolute": U.normalize_url, "path": U.path_key, "bare": U.match_key}


def claims(pages: DataFrame) -> DataFrame:
    """tier, owner, ord and the keys of each address that a page goes by."""
    each = [F.struct(F.lit(n).alias("tier"), F.col(source).alias("address"), F.col("ord"), F.col("url").alias("owner")) for n, (source, _) in enumerate(TIERS)]
    rows = pages.select(F.explode(F.array(*each)).alias("c")).select("c.*")
    return rows.select("tier", "ord", "owner", *[make("address").alias(space) for space, make in SPACES.items()])


def space_index(claimed: DataFrame, space: str) -> DataFrame:
    """As ``merge_tiers`` of ``tier_index``, for one space and in one aggregate:
    key, owner, clash and tier of each alias, named after the space."""
    rows = claimed.select("tier", "ord", "owner", F.col(space).alias("alias")).where("alias is not null and alias <> ''")
    of = lambda n: F.col("tier") == n
    firsts = [F.min(F.when(of(n), F.struct("ord", "owner")))["owner"] for n in range(len(TIERS))]
    counts = [F.count_if(of(n)) for n in range(len(TIERS))]
    found = rows.groupBy("alias").agg(F.min("tier").alias("tier"), F.array(*firsts).alias("owners"), F.array(*counts).alias("claims"))
    return found.select(
        F.col("alias").alias(f"{space}_key"),
        F.get("owners", F.col("tier")).alias(f"{space}_owner"),
        (F.get("claims", F.col("tier")) > 1).alias(f"{space}_clash"),
        F.col("tier").alias(f"{space}_tier"),
    )


def resolve(addresses: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """``addresses`` with page_url and via, or failure.  ``pages`` are deduped."""
    claimed = claims(pages)
    parts = U.split_url(url)
    host = U.site_host(parts["netloc"])
    hosts = pages.select(U.host_of("url").alias("host")).distinct().where("host <> ''")
    domains = hosts.select(U.registrable_domain("host").alias("domain")).distinct()
    keyed = addresses.withColumns(
        {
            "absolute_key": U.normalize_url(url),
            "path_key": U.path_key(url),
            "bare_key": U.match_key(url),
            "host": host,
            "domain": U.registrable_domain(host),
            "usable": parts.isNotNull() & ((parts["netloc"] != "") | parts["path"].startswith("/")),
        }
    )
    joined = (
        keyed.join(space_index(claimed, "absolute"), "absolute_key", "left")
        .join(space_index(claimed, "path"), "path_key", "left")
        .join(space_index(claimed, "bare"), "bare_key", "left")
        .join(hosts.withColumn("crawled_host", F.lit(True)), "host", "left")
        .join(domains.withColumn("crawled_domain", F.lit(True)), "domain", "left")
    )
    c = F.col
    has = c("host") != ""
    tiers = F.array(*[F.lit(name) for _, name in TIERS])
    via = lambda tier: F.get(tiers, c(tier))

    def outcome(page: Column, how: Column, failure: str | None) -> Column:
        return F.struct(page.alias("page_url"), how.alias("via"), F.lit(failure).cast("string").alias("failure"))

    none = F.lit(None).cast("string")
    fail = lambda why: outcome(none, none, why)
    result = (
        F.when(~F.coalesce("usable", F.lit(False)), fail("unparseable"))
        .when(has & c("absolute_clash"), fail("ambiguous"))
        .when(has & c("absolute_owner").isNotNull(), outcome(c("absolute_owner"), via("absolute_tier"), None))
        .when(has & c("crawled_host").isNull() & c("crawled_domain").isNotNull(), fail("other_subdomain"))
        .when(has & c("crawled_host").isNull(), fail("off_site"))
        .when(c("path_clash"), fail("ambiguous"))
        .when(c("path_owner").isNotNull(), outcome(c("path_owner"), via("path_tier"), None))
        .when(c("bare_clash"), fail("ambiguous"))
        .when(c("bare_owner").isNotNull(), outcome(c("bare_owner"), F.lit(BARE), None))
        .otherwise(fail("not_crawled"))
    )
    return joined.withColumn("r", result).select(*addresses.columns, "host", "r.*")


def report(resolved: DataFrame, reliable: float = 90.0) -> DataFrame:
    """One row: totals, match rate in per cent, counts by tier and failure (zeros kept)."""
    n, hit = F.count("*"), F.count_if(F.col("failure").isNull())
    rate = S.share(100.0 * hit, n, 0.0)
    tiers = [F.count_if(F.col("via") == t).alias(f"via_{t}") for t in [*(t for _, t in TIERS), BARE]]
    failures = [F.count_if(F.col("failure") == f).alias(f"failed_{f}") for f in FAILURES]
    return resolved.agg(n.alias("total"), hit.alias("matched"), rate.alias("match_rate"), (rate >= reliable).alias("reliable"), *tiers, *failures)
