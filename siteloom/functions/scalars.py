"""Numbers, labels and enumerations of pages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import once

OTHERS = "OTHERS"
HIGH, LLM_THRESHOLD = 0.85, 0.85
LEVELS = ["L0_HOMEPAGE", "L1_PRIMARY_NAV_HUB", "L2_SUB_NAV_HUB", "L3_LEAF_PAGE", "UTILITY_PAGE"]


def is_address(value: Column) -> Column:
    return value.rlike(r"^\s*(/|(?i)https?://[^/\s]+)")


def tolerant_int(value: Column) -> Column:
    """Signs of thousands, spaces and per cent are dropped; anything else is 0."""
    bare = F.regexp_replace(value, r"[%\s\u00a0\u202f'’.,]", "")
    return F.greatest(F.coalesce(bare.try_cast("bigint"), F.lit(0)), F.lit(0))


def tolerant_decimal(value: Column) -> Column:
    """The last point or comma is the decimal one."""
    bare = F.regexp_replace(value, r"[%\s\u00a0\u202f'’]", "")
    one = F.replace(F.regexp_replace(bare, r"[.,](?=.*[.,])", ""), F.lit(","), F.lit("."))
    return F.greatest(F.coalesce(one.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def confidence(value: Column) -> Column:
    return F.least(F.greatest(F.coalesce(value.try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def ctr(clicks: Column, impressions: Column) -> Column:
    return F.when(impressions > 0, clicks / impressions).otherwise(0.0)


def weighted_position(weight: Column, impressions: Column) -> Column:
    """Sum of position times impressions over impressions, null without any."""
    return F.try_divide(weight, F.when(impressions > 0, impressions))


def share(part: Column, whole: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(empty))


def search_intent(level: Column, kind: Column) -> Column:
    return (
        F.when(kind.isin("PRODUCT_DETAIL_PAGE", "COMMERCIAL_LEAD_GEN"), "TRANSACTIONAL")
        .when(
            kind.isin("PRODUCT_CATEGORY_HUB", "SERVICE_CATEGORY_HUB", "SERVICE_DETAIL_PAGE", "CASE_STUDY", "TOOL_APPLICATION"),
            "COMMERCIAL_INVESTIGATION",
        )
        .when(kind.isin("HOMEPAGE", "COMPANY_ABOUT") | (level == "UTILITY_PAGE"), "NAVIGATIONAL")
        .otherwise("INFORMATIONAL")
    )


def conversion_role(kind: Column) -> Column:
    return (
        F.when(kind == "PRODUCT_DETAIL_PAGE", "DIRECT_SALE")
        .when(kind.isin("COMMERCIAL_LEAD_GEN", "SERVICE_DETAIL_PAGE", "TOOL_APPLICATION"), "LEAD_GENERATION")
        .when(kind.isin("CASE_STUDY", "COMPANY_ABOUT"), "BRAND_AWARENESS")
        .when(kind.isin("BLOG_ARTICLE", "BLOG_HUB"), "INFORMATIONAL_SUPPORT")
        .otherwise("NONE")
    )


def valid_pair(level: Column, kind: Column) -> Column:
    return ((kind == "HOMEPAGE") == (level == "L0_HOMEPAGE")) & (
        ~kind.isin("FACETED_FILTER", "UTILITY_LEGAL") | (level == "UTILITY_PAGE")
    )


def repaired_pair(level: Column, kind: Column) -> Column:
    fixed = lambda a, b: F.struct(a.alias("level"), b.alias("page_type"))
    return (
        F.when(level == "L0_HOMEPAGE", fixed(level, F.lit("HOMEPAGE")))
        .when(kind == "HOMEPAGE", fixed(F.lit("L0_HOMEPAGE"), kind))
        .when(kind.isin("FACETED_FILTER", "UTILITY_LEGAL"), fixed(F.lit("UTILITY_PAGE"), kind))
        .otherwise(fixed(level, kind))
    )


def confident(score: Column, kind: Column) -> Column:
    return (score >= HIGH) & (kind != "UNKNOWN")


@once
def is_client_rendered(html: Column) -> Column:
    """A hydration root, and hardly any text once code and tags are out."""
    root = html.rlike(r"(?is)<div[^>]+id\s*=\s*[\"'](root|__next|app|__nuxt|svelte)[\"'][^>]*>.*?</div>")
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " "), r"(?s)<[^>]+>", " ")
    return F.coalesce(root & (F.length(F.trim(F.regexp_replace(bare, r"\s+", " "))) < 200), F.lit(False))


def cms_family(wordpress: Column, catalogue: Column, client_side: Column) -> Column:
    return F.when(wordpress, "WORDPRESS").when(catalogue, "SHOPIFY").when(client_side, "HEADLESS").otherwise("UNKNOWN")


def weight_profile(family: Column, client_side: Column, adaptive: bool = False) -> Column:
    if not adaptive:
        return F.when(family.isNotNull() | family.isNull(), "default")
    return (
        F.when(family == "WORDPRESS", "wordpress").when(family == "SHOPIFY", "shopify").when((family == "HEADLESS") | client_side, "headless").otherwise("default")
    )


def tokens(text: Column) -> Column:
    """Estimate of a text's tokens; an empty one has none."""
    return F.when(F.length(text) == 0, F.lit(0).cast("long")).otherwise(F.floor(F.length(text) / F.lit(3.5)).cast("long") + 1)


def model_cost(read: Column, written: Column, rates: tuple[float, float], batch: float = 1.0) -> Column:
    """Cost of a call from tokens read and (at most) written, rates a million, and the discount of a batch."""
    return (read * rates[0] + written * rates[1]) / 1e6 * batch


def is_refusal(status: Column) -> Column:
    return status.isin(401, 403, 407, 429) | (status >= 500)


@once
def section_trail(trail: Column) -> Column:
    return F.when(F.size(trail) > 0, trail).otherwise(F.array(F.lit(OTHERS)))


@once
def trail_depth(trail: Column) -> Column:
    """Depth of a real placement, 0 for OTHERS and none."""
    return F.when((F.size(trail) <= 0) | (F.get(trail, F.lit(0)) == OTHERS), 0).otherwise(F.size(trail))


@once
def prefixes(trail: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(trail)), lambda n: F.slice(trail, 1, n))


@once
def robots_regex(pattern: Column) -> Column:
    """A robots pattern (``*``, last ``$``) as a regular expression."""
    plain = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(plain, F.lit("*"), F.lit(".*")), F.when(pattern.endswith("$"), "$").otherwise(""))


def discovery_count(*flags: Column) -> Column:
    total = F.lit(0)
    for f in flags:
        total = total + f.cast("int")
    return total


def orphan_kind(sitemap: Column, cms: Column) -> Column:
    return F.when(sitemap, "sitemap").when(cms, "cms").otherwise("unlinked")


def band(score: Column) -> Column:
    return F.when(score >= HIGH, "high").otherwise("review")


def level_rank(level: Column) -> Column:
    rank = F.lit(9)
    for i, name in enumerate(LEVELS):
        rank = F.when(level == name, i).otherwise(rank)
    return rank


@once
def clock(seconds: Column) -> Column:
    whole = F.floor(F.greatest(seconds, F.lit(0)))
    minutes = F.floor(whole / 60).cast("string")
    # lpad cuts what is longer, and a long run has more than 99 minutes
    return F.concat(F.lpad(minutes, F.greatest(F.lit(2), F.length(minutes)), F.lit("0")), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def percent(done: Column, total: Column) -> Column:
    return F.least(F.coalesce(F.floor(F.try_divide(done * 100, total)), F.lit(0)), F.lit(100)).cast("int")
