"""One query for each scalar function, over all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteloom.functions import scalars as S
from siteloom.functions import urls as U

from . import inputs as I

def u():
    return F.col("url")


_P, _N, _Q = I.sql_path("url"), I.sql_netloc("url"), I.sql_query("url")
_SEGS = I.sql_segs(_P)
_LOC = lambda s: f"(regexp_matches(lower({s}), '^[a-z]{{2}}[-_][a-z]{{2,4}}$') OR lower({s}) IN {I._in(U.LANGUAGES)})"
_FIRST = f"list_extract({_SEGS}, 1)"
_CUT = f"CASE WHEN len({_SEGS}) <= 1 THEN '/' ELSE '/' || array_to_string({_SEGS}[2:], '/') || CASE WHEN ends_with({_P}, '/') THEN '/' ELSE '' END END"
_STRIPPED = f"CASE WHEN coalesce({_LOC(_FIRST)}, false) THEN {_CUT} WHEN {_P} = '' THEN '/' ELSE {_P} END"
_PAIRS = I.sql_pairs(_Q)
_KEYS = f"list_transform({_PAIRS}, lambda x: lower(split_part(x, '=', 1)))"
_FACET = f"(len({_PAIRS}) > 5 OR list_has_any({_KEYS}, {list(U.FILTER_PARAMS)!r}))"
_LSEGS = f"list_transform({I.sql_segs(_STRIPPED)}, lambda s: lower(s))"
_LONG = f"list_filter(list_transform({_SEGS}, lambda s: lower(s)), lambda s: length(s) > 3)"
_HOST = I.sql_host("url")
_ADDR = lambda x: rf"regexp_replace(lower({I.sql_netloc(x)}), '^www\.', '') || regexp_replace({I.sql_path(x)}, '/+$', '') || CASE WHEN {I.sql_query(x)} <> '' THEN '?' || {I.sql_query(x)} ELSE '' END"
_HOME = "'https://blog.tionsh.example.net/'"

def _tail(texts):
    return F.element_at(F.array(*map(F.lit, texts)), (F.col("page_id") % len(texts) + 1).cast("int"))


def _sql_tail(values):
    return f"{values!r}[CAST(page_id % {len(values)} AS INTEGER) + 1]"


#: id -> (column, SQL), over the view ``spelled``
URLS = {
    "url1_safe_split": (
        lambda: F.concat_ws("|", *(U.split_url("url")[k] for k in ("scheme", "netloc", "path", "query", "fragment"))),
        rf"concat_ws('|', lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), {_N}, {_P}, {_Q}, regexp_extract(url, '#(.*)$', 1))",
    ),
    "url2_tracking_params": (
        lambda: F.array_join(
            F.filter(F.transform(F.split(U.split_url("url")["query"], "&"), lambda p: F.substring_index(p, "=", 1)), lambda k: U.is_tracking_param(k)), ","
        ),
        f"array_to_string(list_filter(list_transform(string_split({_Q}, '&'), lambda x: split_part(x, '=', 1)), lambda k: lower(k) IN {I._in(U.TRACKING)} OR regexp_matches(lower(k), '^({'|'.join(U.TRACKING_PREFIXES)})')), ',')",
    ),
    "url3_decode_path": (
        lambda: U.decode_path(F.concat(U.path_of("url"), _tail(["%41%C3%A9%2Fx%", "%FF/%6D", "/100%/%6D%2f%6d", "%C3%28%20b"]))),
        _P + " || " + _sql_tail(["Aé%2Fx%", "%FF/m", "/100%/m%2fm", "%C3%28%20b"]),
    ),
    "url4_normalize_path": (lambda: U.normalize_path(U.path_of("url")), I.sql_norm_path(_P)),
    "url5_normalize_url": (lambda: U.normalize_url("url"), I.sql_norm_url("url")),
    "url6_path_key": (lambda: U.path_key("url"), I.sql_path_key("url")),
    "url7_match_key": (lambda: U.match_key("url"), I.sql_norm_path(_P)),
    "url8_compare_key": (
        lambda: U.compare_key("url"),
        rf"'https://' || regexp_replace(lower({_N}), '^www\.', '') || regexp_replace({_P}, '/+$', '') || CASE WHEN {_Q} <> '' THEN '?' || {_Q} ELSE '' END",
    ),
    "url9_link_path_key": (lambda: U.link_path_key("url"), I.sql_norm_path(f"({_STRIPPED})")),
    "url10_site_host": (lambda: U.host_of("url"), _HOST),
    "url11_registrable_domain": (
        lambda: U.registrable_domain(U.host_of("url")),
        f"CASE WHEN len(string_split({_HOST}, '.')) < 3 THEN {_HOST} WHEN string_split({_HOST}, '.')[-2] IN {I._in(U.SECOND_LEVEL)} THEN array_to_string(string_split({_HOST}, '.')[-3:], '.') ELSE array_to_string(string_split({_HOST}, '.')[-2:], '.') END",
    ),
    "url12_same_site": (lambda: U.same_site(u(), F.lit(_HOME.strip("'"))), f"{_HOST} = {I.sql_host(_HOME)}"),
    "url13_locale_segments": (
        lambda: F.array_join(F.filter(U.path_segments("url"), lambda s: U.is_locale_segment(s)), ","),
        f"array_to_string(list_filter({_SEGS}, lambda s: {_LOC('s')}), ',')",
    ),
    "url14_strip_locale": (lambda: U.strip_locale_prefix(U.path_of("url"))["path"], _STRIPPED),
    "url15_depth": (lambda: U.depth_of(U.path_of("url")), f"CAST(least(len({I.sql_segs(_STRIPPED)}), 15) AS INTEGER)"),
    "url16_crawlable": (lambda: U.is_crawlable("url"), rf"NOT regexp_matches(lower({_P}), '\.({'|'.join(U.NON_PAGE_SUFFIXES)})$')"),
    "url17_malformed": (
        lambda: U.is_malformed(F.concat(F.regexp_replace(u(), "[?#].*$", ""), _tail(["/%3Ca/100%", "", "/a%E2%80%9Cb", "/%FF"]))),
        _sql_tail([True, False, True, False]),
    ),
    "url18_spider_trap": (lambda: U.is_spider_trap("url"), f"len({_SEGS}) > 15 OR len({_LONG}) <> len(list_distinct({_LONG}))"),
    "url19_faceted": (lambda: U.is_faceted("url"), _FACET),
    "url20_fast_path": (
        lambda: F.concat_ws("/", U.fast_path("url")["level"], U.fast_path("url")["page_type"]),
        f"CASE WHEN len({_LSEGS}) = 0 AND len({_PAIRS}) = 0 THEN 'L0_HOMEPAGE/HOMEPAGE' WHEN len({_LSEGS}) = 0 OR {_FACET} THEN 'UTILITY_PAGE/FACETED_FILTER' WHEN list_has_any({_LSEGS}, {list(U.LEGAL_SLUGS)!r}) THEN 'UTILITY_PAGE/UTILITY_LEGAL' WHEN len({_LSEGS}) > 15 THEN 'UTILITY_PAGE/FACETED_FILTER' ELSE '' END",
    ),
    "url21_segments": (lambda: F.array_join(U.path_segments("url"), "|"), f"array_to_string({_SEGS}, '|')"),
    "url22_tail": (
        lambda: U.tail_of("url")["tail"],
        f"CASE WHEN len({_SEGS}) >= 3 THEN array_to_string({_SEGS}[-3:], '/') END",
    ),
    "url23_label": (
        lambda: U.label_from_url("url"),
        f"CASE WHEN len({_SEGS}) = 0 THEN 'Home' ELSE array_to_string(list_transform(string_split(regexp_replace({_SEGS}[-1], '[-_]', ' ', 'g'), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END",
    ),
    "url25_locale": (lambda: U.locale_of("url"), f"CASE WHEN {_LOC(_FIRST)} THEN lower({_FIRST}) END"),
    "url26_normal_segment": (
        lambda: U.normalize_segment(F.concat(F.lit("The-best_of-"), F.coalesce(F.element_at(U.path_segments("url"), -1), F.lit("")))),
        f"array_to_string(list_filter(regexp_split_to_array(lower('The-best_of-' || coalesce({_SEGS}[-1], '')), '[-_]+'), lambda s: s <> '' AND s NOT IN {I._in(U.SLUG_FILLERS)}), '-')",
    ),
    "url27_flatten": (lambda: U.flatten(u()), "regexp_replace(lower(url), '[^a-z0-9]', '', 'g')"),
    "url28_paginated": (lambda: U.is_paginated(u()), rf"regexp_matches(url, '(?i)[?&]page=\d+') OR regexp_matches({_P}, '(?i)/page/\d+/?$')"),
    "url29_same_address": (
        lambda: U.same_address(u(), F.regexp_replace(u(), "^https?://", "http://www.")),
        f"({_ADDR('url')}) = ({_ADDR(chr(40) + 'regexp_replace(url, ' + chr(39) + '^https?://' + chr(39) + ', ' + chr(39) + 'http://www.' + chr(39) + ')' + chr(41))})",
    ),
}

_RAW = "(page_id % 9)::VARCHAR || ['.', ',', ' ', '''', '%'][CAST(page_id % 5 AS INTEGER) + 1] || (100 + page_id % 900)::VARCHAR"


def raw():
    """Numbers as exports write them."""
    signs = F.array(*map(F.lit, [".", ",", " ", "'", "%"]))
    sign = F.element_at(signs, (F.col("page_id") % 5 + 1).cast("int"))
    return F.concat((F.col("page_id") % 9).cast("string"), sign, (100 + F.col("page_id") % 900).cast("string"))


c = F.col
#: id -> (column, SQL), over the view ``crawl``
PAGES = {
    "fn1_is_address": (lambda: S.is_address(F.when(c("page_id") % 4 == 0, "Top pages").otherwise(c("url"))), "page_id % 4 <> 0"),
    "fn2_tolerant_int": (lambda: S.tolerant_int(raw()), f"CAST(regexp_replace({_RAW}, '[^0-9]', '', 'g') AS BIGINT)"),
    "fn3_tolerant_decimal": (
        lambda: S.tolerant_decimal(F.concat(F.when(c("page_id") % 7 == 0, "-").otherwise(""), raw())),
        f"CASE WHEN page_id % 7 = 0 THEN 0 ELSE CAST(replace(regexp_replace({_RAW}, '[% '']', '', 'g'), ',', '.') AS DOUBLE) END::DOUBLE",
    ),
    "fn4_confidence": (lambda: S.confidence((c("score") * 2 - 0.5).cast("string")), "least(greatest(score * 2 - 0.5::DOUBLE, 0), 1)::DOUBLE"),
    "fn5_ctr": (lambda: S.ctr(c("inbound"), c("page_id") % 23), "CASE WHEN page_id % 23 > 0 THEN inbound / (page_id % 23)::DOUBLE ELSE 0 END::DOUBLE"),
    "fn6_weighted_position": (
        lambda: S.weighted_position(c("score") * c("inbound"), c("inbound")), "CASE WHEN inbound > 0 THEN score * inbound / inbound END",
    ),
    "fn7_share": (lambda: S.share(c("inbound").cast("double"), (c("page_id") % 3).cast("double"), 1.0), "CASE WHEN page_id % 3 = 0 THEN 1.0::DOUBLE ELSE inbound::DOUBLE / (page_id % 3) END"),
    "fn8_search_intent": (
        lambda: S.search_intent(c("level"), c("page_type")),
        "CASE WHEN page_type IN ('PRODUCT_DETAIL_PAGE', 'COMMERCIAL_LEAD_GEN') THEN 'TRANSACTIONAL' WHEN page_type IN ('PRODUCT_CATEGORY_HUB', 'SERVICE_CATEGORY_HUB', 'SERVICE_DETAIL_PAGE', 'CASE_STUDY', 'TOOL_APPLICATION') THEN 'COMMERCIAL_INVESTIGATION' WHEN page_type IN ('HOMEPAGE', 'COMPANY_ABOUT') OR level = 'UTILITY_PAGE' THEN 'NAVIGATIONAL' ELSE 'INFORMATIONAL' END",
    ),
    "fn9_conversion_role": (
        lambda: S.conversion_role(c("page_type")),
        "CASE WHEN page_type = 'PRODUCT_DETAIL_PAGE' THEN 'DIRECT_SALE' WHEN page_type IN ('COMMERCIAL_LEAD_GEN', 'SERVICE_DETAIL_PAGE', 'TOOL_APPLICATION') THEN 'LEAD_GENERATION' WHEN page_type IN ('CASE_STUDY', 'COMPANY_ABOUT') THEN 'BRAND_AWARENESS' WHEN page_type IN ('BLOG_ARTICLE', 'BLOG_HUB') THEN 'INFORMATIONAL_SUPPORT' ELSE 'NONE' END",
    ),
    "fn10_valid_pair": (
        lambda: S.valid_pair(F.when(c("page_id") % 6 == 0, "L0_HOMEPAGE").otherwise(c("level")), F.when(c("page_id") % 12 == 0, "HOMEPAGE").when(c("page_id") % 8 == 2, "UTILITY_LEGAL").otherwise(c("page_type"))),
        "CASE WHEN page_id % 12 = 0 THEN true WHEN page_id % 6 = 0 THEN false WHEN page_id % 8 = 2 THEN false ELSE true END",
    ),
    "fn11_repaired_pair": (
        lambda: F.concat_ws("/", S.repaired_pair(F.when(c("page_id") % 6 == 0, "L0_HOMEPAGE").otherwise(c("level")), c("page_type"))["level"], S.repaired_pair(F.when(c("page_id") % 6 == 0, "L0_HOMEPAGE").otherwise(c("level")), c("page_type"))["page_type"]),
        "CASE WHEN page_id % 6 = 0 THEN 'L0_HOMEPAGE/HOMEPAGE' ELSE level || '/' || page_type END",
    ),
    "fn12_confident": (lambda: S.confident(c("score"), c("page_type")), "score >= 0.85 AND page_type <> 'UNKNOWN'"),
    "fn14_cms_family": (lambda: S.cms_family(c("in_cms"), c("in_links"), c("in_sitemap")), "CASE WHEN in_cms THEN 'WORDPRESS' WHEN in_links THEN 'SHOPIFY' WHEN in_sitemap THEN 'HEADLESS' ELSE 'UNKNOWN' END"),
    "fn15_weight_profile": (
        lambda: S.weight_profile(S.cms_family(c("in_cms"), c("in_links"), F.lit(False)), c("in_sitemap"), adaptive=True),
        "CASE WHEN in_cms THEN 'wordpress' WHEN in_links THEN 'shopify' WHEN in_sitemap THEN 'headless' ELSE 'default' END",
    ),
    "fn18_tokens": (
        lambda: S.tokens(F.when(c("page_id") % 5 == 0, "").otherwise(c("url"))), "CASE WHEN page_id % 5 = 0 THEN 0 ELSE CAST(floor(length(url) / 3.5::DOUBLE) AS BIGINT) + 1 END",
    ),
    "fn18_model_cost": (
        lambda: S.model_cost(S.tokens(c("url")), F.lit(400), (0.5, 2.0), 0.5), "((CAST(floor(length(url) / 3.5::DOUBLE) AS BIGINT) + 1) * 0.5::DOUBLE + 400 * 2.0::DOUBLE) / 1000000.0::DOUBLE * 0.5::DOUBLE",
    ),
    "fn19_refusal": (lambda: S.is_refusal((c("page_id") % 150 + 390).cast("int")), "(page_id % 150 + 390) IN (401, 403, 407, 429) OR page_id % 150 + 390 >= 500"),
    "fn20_section_trail": (lambda: F.array_join(S.section_trail(c("trail")), " > "), "CASE WHEN len(trail) > 0 THEN array_to_string(trail, ' > ') ELSE 'OTHERS' END"),
    "fn21_prefixes": (
        lambda: F.array_join(F.transform(S.prefixes(c("trail")), lambda p: F.array_join(p, "/")), "|"),
        "array_to_string(list_transform(range(0, len(trail) + 1), lambda n: array_to_string(trail[1:n], '/')), '|')",
    ),
    "fn22_robots_match": (
        lambda: F.regexp(U.path_of("url"), S.robots_regex(F.when(c("page_id") % 4 == 0, "/en/*5$").otherwise("/*/4"))),
        f"CASE WHEN page_id % 4 = 0 THEN regexp_matches({_P}, '^/en/.*5$') ELSE regexp_matches({_P}, '^/.*/4') END",
    ),
    "fn23_orphan_kind": (lambda: S.orphan_kind(c("in_sitemap"), c("in_cms")), "CASE WHEN in_sitemap THEN 'sitemap' WHEN in_cms THEN 'cms' ELSE 'unlinked' END"),
    "fn24_band": (lambda: S.band(c("score")), "CASE WHEN score >= 0.85 THEN 'high' ELSE 'review' END"),
    "fn25_level_rank": (lambda: S.level_rank(c("level")), "CASE level WHEN 'L0_HOMEPAGE' THEN 0 WHEN 'L1_PRIMARY_NAV_HUB' THEN 1 WHEN 'L2_SUB_NAV_HUB' THEN 2 WHEN 'L3_LEAF_PAGE' THEN 3 WHEN 'UTILITY_PAGE' THEN 4 ELSE 9 END"),
    "fn26_clock": (lambda: S.clock(c("page_id") * 7), "lpad((page_id * 7 // 60)::VARCHAR, greatest(2, length((page_id * 7 // 60)::VARCHAR))::INTEGER, '0') || ':' || lpad((page_id * 7 % 60)::VARCHAR, 2, '0')"),
    "fn27_discovery_count": (lambda: S.discovery_count(c("in_sitemap"), c("in_links"), c("in_cms")), "in_sitemap::INTEGER + in_links::INTEGER + in_cms::INTEGER"),
}


def queries() -> dict:
    def over(view, value):
        return lambda spark, sf_dir: view(spark, sf_dir).select("page_id", "url", value().alias("value"))

    found = {name: over(I.spelled, value) for name, (value, _) in URLS.items()}
    found |= {name: over(I.crawl, value) for name, (value, _) in PAGES.items()}
    found["url24_locales"] = lambda spark, sf_dir: (
        I.pages(spark, sf_dir).select(U.locale_of("url").alias("locale")).where("locale is not null").distinct()
    )
    found["fn13_client_rendered"] = lambda spark, sf_dir: I.pages(spark, sf_dir).select(
        "page_id", S.is_client_rendered(F.when(c("page_id") % 3 == 0, F.concat(F.lit('<div id="root"></div>'), c("html"))).otherwise(c("html"))).alias("value")
    )
    return found


def oracle_sql() -> dict[str, str]:
    found = {n: I.with_views(f"SELECT page_id, url, {sql} AS value FROM spelled", "spelled") for n, (_, sql) in URLS.items() if sql}
    found |= {n: I.with_views(f"SELECT page_id, url, {sql} AS value FROM crawl", "crawl") for n, (_, sql) in PAGES.items() if sql}
    root = "CASE WHEN page_id % 3 = 0 THEN '<div id=\"root\"></div>' ELSE '' END || html"
    bare = "regexp_replace(regexp_replace(" + root + ", '(?is)<(script|style)\\b.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'gs')"
    found["fn13_client_rendered"] = f"SELECT page_id, page_id % 3 = 0 AND length(trim(regexp_replace({bare}, '\\s+', ' ', 'g'))) < 200 AS value FROM pages"
    found["url24_locales"] = f"SELECT DISTINCT lower({_FIRST}) AS locale FROM pages WHERE {_LOC(_FIRST)}"
    return found
