"""URL functions as Column expressions, so predicates stay in the scan's plan.

Every function takes and returns Columns; a null URL gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let, named, once

# Fixed values ------------------------------------------------------------
NON_PAGE_SUFFIXES = (
    "jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "bmp", "eps", "ai", "psd", "css", "js", "json", "xml", "rss",
    "atom", "zip", "gz", "tar", "rar", "7z", "mp4", "mp3", "avi", "mov", "wmv", "wav", "webm", "woff", "woff2", "ttf",
    "eot", "exe", "dmg", "pkg", "md", "markdown",
)
TRACKING = (
    "gclid", "fbclid", "msclkid", "dclid", "gclsrc", "mc_cid", "mc_eid", "igshid", "ref", "referrer", "source", "qid",
    "sr", "th", "psc", "_ga", "_gl", "yclid", "twclid", "ttclid", "si", "trk", "sessionid", "session_id", "phpsessid",
    "jsessionid",
)
TRACKING_PREFIXES = ("utm_", "pf_rd_", "pd_rd_", "_encoding", "spm_", "hsa_", "vero_")
LANGUAGES = (
    "ar", "bg", "bn", "cs", "da", "de", "el", "en", "es", "et", "fa", "fi", "fr", "he", "hi", "hu", "id", "is", "ja",
    "ko", "lt", "lv", "ms", "nl", "no", "pl", "pt", "ro", "ru", "sk", "sl", "sr", "sv", "th", "tr", "uk", "ur", "vi",
    "zh",
)
LEGAL_SLUGS = (
    "privacy-policy", "privacy", "terms", "terms-of-service", "terms-and-conditions", "terms-of-use", "cookie-policy",
    "cookies", "legal", "disclaimer", "accessibility", "gdpr", "imprint", "impressum", "sitemap", "404", "search",
)
FILTER_PARAMS = (
    "color", "colour", "size", "price", "brand", "sort", "sort_by", "orderby", "filter", "facet",
)
SECOND_LEVEL = (
    "co", "com", "org", "net", "ac", "gov", "edu", "gob", "or", "ne",
)
MARKUP = ("<", ">", "href=", "“", "”")
SLUG_FILLERS = (
    "a", "an", "and", "for", "in", "of", "on", "the", "to", "with",
)
MAX_DEPTH, MAX_PARAMS, TRAP_LENGTH = 15, 5, 3
# -------------------------------------------------------------------------

SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


@once
def split_url(url: Column) -> Column:
    """scheme, netloc, path, query, fragment; null where brackets don't balance."""
    u = F.regexp_replace(url, r"^\s+|\s+$", "")
    part = lambda i: F.coalesce(F.regexp_extract(u, SPLIT, i), F.lit(""))
    whole = F.struct(
        F.lower(part(1)).alias("scheme"), part(2).alias("netloc"), part(3).alias("path"), part(4).alias("query"), part(5).alias("fragment")
    )
    return F.when(part(2).contains("[") == part(2).contains("]"), whole)


@named
def path_of(url: Column) -> Column:
    return split_url(url)["path"]


def segments_of(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_tracking_param(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(*TRACKING) | low.rlike("^(" + "|".join(TRACKING_PREFIXES) + ")")


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


@once
def query_pairs(query: Column) -> Column:
    """Array of (k, v), decoded, blank values kept, tracking parameters dropped."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("k"),
            F.when(p.contains("="), _decoded(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p)))).otherwise("").alias("v"),
        ),
    )
    return F.filter(pairs, lambda p: ~is_tracking_param(p["k"]))


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def sorted_query(query: Column) -> Column:
    pairs = F.transform(F.array_sort(query_pairs(query)), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"])))
    return F.array_join(pairs, "&")


#: Runs of escapes, but for those of / ? # % and backslash, which keep their meaning.
ESCAPES = r"(?:%(?!2[fF]|3[fF]|23|25|5[cC])[0-9A-Fa-f]{2})+"
ANY_ESCAPES = r"(?:%[0-9A-Fa-f]{2})+"


def _decoded_runs(path: Column, pattern: str, strict: bool) -> Column:
    """Each run of escapes as the text that its bytes are; a run that isn't UTF-8 stays if ``strict``."""

    def text(run: Column) -> Column:
        made = F.unhex(F.replace(run, F.lit("%"), F.lit(""))).cast("string")
        return F.when(F.is_valid_utf8(made), made).otherwise(run) if strict else made

    parts = F.zip_with(
        F.split(path, pattern), F.regexp_extract_all(path, F.lit(f"({pattern})"), F.lit(1)), lambda p, r: F.concat(p, F.coalesce(text(r), F.lit("")))
    )
    return F.when(~path.contains("%"), path).otherwise(F.array_join(parts, ""))


@once
def decode_path(path: Column) -> Column:
    """Percent escapes decoded run by run, but for those of / ? # % and backslash;
    a run whose bytes aren't UTF-8 stays as it is."""
    return _decoded_runs(path, ESCAPES, strict=True)


@once
def normalize_path(path: Column) -> Column:
    kept = F.filter(F.transform(F.split(decode_path(path), "/"), lambda s: F.trim(s)), lambda s: s != "")
    named = lambda k: F.when(F.size(k) == 0, "/").otherwise(F.concat(F.lit("/"), F.lower(F.array_join(k, "/")), F.lit("/")))
    return let(kept, named)


@once
def _asked(query: Column) -> Column:
    return F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")


def _bare_netloc(netloc: Column) -> Column:
    return F.regexp_replace(F.lower(netloc), r"^www\.", "")


@once
def normalize_url(url: Column, strip_locale: bool = False) -> Column:
    """The key under which pages are one: https, no ``www.``, normal path,
    sorted parameters without tracking, no fragment."""
    return let(split_url(url), lambda parts: _normal(url, parts, strip_locale))


def _normal(url: Column, parts: Column, strip_locale: bool) -> Column:
    path = F.when(parts["path"] == "", "/").otherwise(parts["path"])
    if strip_locale:
        path = strip_locale_prefix(path)["path"]
    scheme = F.when(parts["scheme"].isin("http", "https"), "https").otherwise(parts["scheme"])
    made = F.concat(
        F.when(parts["scheme"] != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        let(_bare_netloc(parts["netloc"]), lambda host: F.when(host != "", F.concat(F.lit("//"), host)).otherwise("")),
        normalize_path(path),
        _asked(sorted_query(parts["query"])),
    )
    return F.when(parts.isNull(), F.trim(url)).otherwise(made)


@once
def path_key(url: Column) -> Column:
    """Host-free identity: normal path and sorted parameters."""
    return let(split_url(url), lambda parts: F.concat(normalize_path(parts["path"]), _asked(sorted_query(parts["query"]))))


@named
def match_key(url: Column) -> Column:
    """Where a page lies among sections: its normal path alone."""
    return normalize_path(path_of(url))


@once
def compare_key(url: Column) -> Column:
    """Another crawler's spelling: https, no ``www.``, no last slash, case kept."""
    return F.concat(F.lit("https://"), address(url))


@once
def link_path_key(href: Column) -> Column:
    return normalize_path(strip_locale_prefix(F.when(path_of(href) == "", "/").otherwise(path_of(href)))["path"])


@once
def site_host(netloc: Column) -> Column:
    host = F.substring_index(F.lower(netloc), "@", -1)
    plain = F.when(host.startswith("["), F.regexp_extract(host, r"^(\[[^\]]*\])", 1)).otherwise(F.substring_index(host, ":", 1))
    return F.regexp_replace(plain, r"^www\.", "")


@named
def host_of(url: Column) -> Column:
    return site_host(split_url(url)["netloc"])


@once
def registrable_domain(host: Column) -> Column:
    low = F.trim(F.lower(host), F.lit("."))
    labels = F.split(low, r"\.")
    deep = F.element_at(labels, -2).isin(*SECOND_LEVEL)
    return (
        F.when(low.startswith("[") | (F.size(labels) < 3) | low.rlike(r"^[0-9.]+$"), low)
        .when(deep, F.substring_index(low, ".", -3))
        .otherwise(F.substring_index(low, ".", -2))
    )


def same_site(a: Column, b: Column) -> Column:
    return F.coalesce(host_of(a) == host_of(b), F.lit(False))


@once
def is_locale_segment(segment: Column, known: list[str] | None = None) -> Column:
    low = F.lower(segment)
    if known is not None:
        return low.isin(*[k.lower() for k in known])
    return low.rlike("^[a-z]{2}[-_][a-z]{2,4}$") | low.isin(*LANGUAGES)


@once
def strip_locale_prefix(path: Column, known: list[str] | None = None) -> Column:
    """(path, locale): the path without its first segment if that is a locale."""
    return let(segments_of(path), lambda segs: _stripped(path, segs, known))


def _stripped(path: Column, segs: Column, known: list[str] | None) -> Column:
    first = F.get(segs, F.lit(0))
    has = F.coalesce(is_locale_segment(first, known), F.lit(False))
    rest = F.array_join(F.slice(segs, 2, F.size(segs)), "/")
    cut = F.when(F.size(segs) <= 1, "/").otherwise(F.concat(F.lit("/"), rest, F.when(path.endswith("/"), "/").otherwise("")))
    return F.struct(
        F.when(has, cut).when(path == "", "/").otherwise(path).alias("path"), F.when(has, F.lower(first)).alias("locale")
    )


@named
def depth_of(path: Column) -> Column:
    return F.least(F.size(segments_of(strip_locale_prefix(path)["path"])), F.lit(MAX_DEPTH))


@named
def is_crawlable(url: Column) -> Column:
    return F.coalesce(~F.lower(path_of(url)).rlike(r"\.(" + "|".join(NON_PAGE_SUFFIXES) + ")$"), F.lit(True))


@once
def is_malformed(url: Column) -> Column:
    path = path_of(url)
    return let(_decoded_runs(path, ANY_ESCAPES, strict=False), lambda decoded: _marked(path, decoded))


def _marked(path: Column, decoded: Column) -> Column:
    marked = F.lit(False)
    for m in MARKUP:
        marked = marked | decoded.contains(m)
    return F.coalesce(path.rlike(r"(?i)^/(%20|%09|%0[ad]|\s)") | marked, F.lit(False))


@once
def is_spider_trap(url: Column) -> Column:
    segs = F.transform(segments_of(path_of(url)), lambda s: F.lower(s))
    long = lambda a: F.filter(a, lambda s: F.length(s) > TRAP_LENGTH)
    trap = lambda a: (F.size(a) > MAX_DEPTH) | let(long(a), lambda x: F.size(x) != F.size(F.array_distinct(x)))
    return F.coalesce(let(segs, trap), F.lit(False))


@once
def is_faceted(url: Column) -> Column:
    keys = F.transform(query_pairs(split_url(url)["query"]), lambda p: F.lower(p["k"]))
    filters = F.array(*map(F.lit, FILTER_PARAMS))
    return F.coalesce((F.size(keys) > MAX_PARAMS) | F.arrays_overlap(keys, filters), F.lit(False))


@once
def fast_path(url: Column) -> Column:
    """(level, page_type) where the URL alone decides, else null."""
    path = path_of(url)
    segs = F.transform(segments_of(strip_locale_prefix(F.when(path == "", "/").otherwise(path))["path"]), lambda s: F.lower(s))
    return let(segs, lambda s: _decided(url, s))


def _decided(url: Column, segs: Column) -> Column:
    pair = lambda level, kind: F.struct(F.lit(level).alias("level"), F.lit(kind).alias("page_type"))
    root = F.size(segs) == 0
    plain = F.size(query_pairs(split_url(url)["query"])) == 0
    legal = F.arrays_overlap(segs, F.array(*map(F.lit, LEGAL_SLUGS)))
    return (
        F.when(root & plain, pair("L0_HOMEPAGE", "HOMEPAGE"))
        .when(root | is_faceted(url), pair("UTILITY_PAGE", "FACETED_FILTER"))
        .when(legal, pair("UTILITY_PAGE", "UTILITY_LEGAL"))
        .when(F.size(segs) > MAX_DEPTH, pair("UTILITY_PAGE", "FACETED_FILTER"))
    )


@named
def path_segments(url: Column) -> Column:
    return segments_of(path_of(url))


@once
def tail_of(url: Column, size: int = 3) -> Column:
    """(tail, depth): the last segments joined, null with fewer."""
    segs = path_segments(url)
    return F.when(
        F.size(segs) >= size,
        F.struct(F.array_join(F.slice(segs, -size, size), "/").alias("tail"), F.size(segs).alias("depth")),
    )


@once
def label_from_url(url: Column) -> Column:
    segs = path_segments(url)
    return F.when(F.size(segs) == 0, "Home").otherwise(F.initcap(F.regexp_replace(F.element_at(segs, -1), "[-_]", " ")))


@once
def locale_of(url: Column) -> Column:
    first = F.get(path_segments(url), F.lit(0))
    return F.when(is_locale_segment(first), F.lower(first))


def normalize_segment(segment: Column) -> Column:
    return F.array_join(F.filter(F.split(F.lower(segment), "[-_]+"), lambda s: ~s.isin(*SLUG_FILLERS) & (s != "")), "-")


def flatten(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def is_paginated(url: Column) -> Column:
    return url.rlike(r"(?i)[?&]page=\d+") | path_of(url).rlike(r"(?i)/page/\d+/?$")


@once
def address(url: Column) -> Column:
    return let(
        split_url(url), lambda p: F.concat(_bare_netloc(p["netloc"]), F.regexp_replace(p["path"], "/+$", ""), _asked(p["query"]))
    )


def same_address(a: Column, b: Column) -> Column:
    return F.coalesce(address(a) == address(b), F.lit(False))


def resolve_dots(path: Column) -> Column:
    """``.`` and ``..`` segments taken out of an absolute path, however many."""
    segs = F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")), F.lit(1)))
    folded = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s)),
    )
    last = F.element_at(segs, -1)
    end = F.when(last.isin(".", "..") & (F.size(folded) > 0), "/").otherwise("")  # a dot at the end names a folder
    return F.when(~path.contains("/."), path).otherwise(F.concat(F.lit("/"), F.array_join(folded, "/"), end))


def join_href(href: Column, base: Column) -> Column:
    """An href made absolute against its page, fragment cut; only the path is reduced."""
    return let(split_url(base), lambda b: let(F.regexp_replace(F.trim(href), r"(?s)#.*$", ""), lambda bare: _joined(bare, b, base)))


def _joined(bare: Column, b: Column, base: Column) -> Column:
    root = F.concat(b["scheme"], F.lit("://"), b["netloc"])
    path = F.regexp_extract(bare, r"(?s)^([^?]*)", 1)
    asked = F.regexp_extract(bare, r"(?s)(\?.*)$", 1)
    here = F.regexp_replace(F.when(b["path"] == "", "/").otherwise(b["path"]), r"[^/]*$", "")
    return (
        F.when(bare == "", base)
        .when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), bare)
        .when(bare.startswith("//"), F.concat(b["scheme"], F.lit(":"), bare))
        .when(bare.startswith("/"), F.concat(root, resolve_dots(path), asked))
        .when(bare.startswith("?"), F.concat(root, b["path"], bare))
        .otherwise(F.concat(root, resolve_dots(F.concat(here, path)), asked))
    )


def unescape_markup(text: Column) -> Column:
    """The named and numeric character references that addresses hold."""
    named = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&#38;": "&", "&#x26;": "&", "&#47;": "/", "&#x2F;": "/", "&#x2f;": "/", "&amp;": "&"}
    made = text
    for name, char in named.items():
        made = F.replace(made, F.lit(name), F.lit(char))
    return F.when(~text.contains("&"), text).otherwise(made)
