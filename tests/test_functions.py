"""URL and scalar functions on worked-out pairs."""

from pyspark.sql import functions as F

from siteloom.functions import scalars as S
from siteloom.functions import urls as U


def values(spark, inputs, make):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i long, x string")
    return [r["v"] for r in rows.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


def test_normalize_url(spark):
    pairs = {
        "http://WWW.Ex.com/A//b?utm_source=x&b=2&a=1#f": "https://ex.com/a/b/?a=1&b=2",
        "https://ex.com": "https://ex.com/",
        "https://ex.com/a%6Db%2Fc": "https://ex.com/amb%2fc/",
        " https://ex.com/x y/ ": "https://ex.com/x y/",
    }
    assert values(spark, list(pairs), U.normalize_url) == list(pairs.values())


def test_hosts_and_domains(spark):
    assert values(spark, ["user@www.Ex.com:8080", "[::1]:80"], U.site_host) == ["ex.com", "[::1]"]
    assert values(spark, ["shop.ex.co.uk", "a.b.ex.com", "10.0.0.1", "ex.com"], U.registrable_domain) == ["ex.co.uk", "ex.com", "10.0.0.1", "ex.com"]


def test_compare_key_keeps_case(spark):
    assert values(spark, ["http://www.ex.com/A/?q=1#f"], U.compare_key) == ["https://ex.com/A?q=1"]


def test_locales(spark):
    got = values(spark, ["/en-gb/pricing/", "/de", "/hr/x", ""], U.strip_locale_prefix)
    assert [(r["path"], r["locale"]) for r in got] == [("/pricing/", "en-gb"), ("/", "de"), ("/hr/x", None), ("/", None)]


def test_traps_and_facets(spark):
    assert values(spark, ["/news/a/news/", "/en/a/en/", "/" + "/".join("abcdefghijklmnop") + "/"], U.is_spider_trap) == [True, False, True]
    six = "/?" + "&".join(f"p{i}=1" for i in range(6))
    assert values(spark, ["/?color=red", "/?gclid=1", six], U.is_faceted) == [True, False, True]


def test_fast_path(spark):
    got = values(spark, ["https://e.com/", "https://e.com/?x=1", "https://e.com/privacy/", "https://e.com/shop?sort=a", "https://e.com/shop"], U.fast_path)
    assert [r and r["page_type"] for r in got] == ["HOMEPAGE", "FACETED_FILTER", "UTILITY_LEGAL", "FACETED_FILTER", None]


def test_malformed(spark):
    assert values(spark, ["https://e.com/%20x", "https://e.com/%3Ca", "https://e.com/a b"], U.is_malformed) == [True, True, False]


def test_decode_by_runs(spark):
    pairs = {"/a%20b/%FF": "/a b/%FF", "/100%/%6D": "/100%/m", "/%2F%41%2f": "/%2FA%2f", "/%C3%A9%E2%80%91": "/é‑", "/plain+x": "/plain+x", "/%zz": "/%zz"}
    assert values(spark, list(pairs), U.decode_path) == list(pairs.values())
    assert values(spark, ["https://e.com/%3Ca/100%", "https://e.com/%FF"], U.is_malformed) == [True, False]


def test_dot_segments(spark):
    base = F.lit("https://e.com/a/b/c/d/e/f?x=1")
    hrefs = ["/a/../b", "../../../../../x", "../../../../../../../x", "q?u=/a/../b", "./g/.", "/a/./b/../c?y"]
    want = ["/b", "/x", "/x", "/a/b/c/d/e/q?u=/a/../b", "/a/b/c/d/e/g/", "/a/c?y"]
    assert values(spark, hrefs, lambda h: U.join_href(h, base)) == [f"https://e.com{w}" for w in want]


def test_kept_columns_are_the_same(spark):
    rows = spark.createDataFrame([("http://WWW.Ex.com/A//b?b=2&a=1#f",)], "url string")
    for f in (U.normalize_url, U.path_key, U.match_key, U.host_of, U.tail_of, U.locale_of):
        a, b = rows.select(f("url").alias("a"), f(F.col("url")).alias("b")).first()
        assert a == b and f("url") is f("url")


def test_numbers(spark):
    assert values(spark, ["1,234", "1.234", "-", None], S.tolerant_int) == [1234, 1234, 0, 0]
    assert values(spark, ["1.234,5", "12,34", "x", "-5,0"], S.tolerant_decimal) == [1234.5, 12.34, 0.0, 0.0]
    assert values(spark, ["", "abc", None], S.tokens) == [0, 1, None]


def test_join_href(spark):
    base = F.lit("https://e.com/a/b?x=1")
    got = values(spark, ["/c", "d", "../e", "//f.com/g", "?y", "#z", "https://h.com/"], lambda h: U.join_href(h, base))
    assert got == ["https://e.com/c", "https://e.com/a/d", "https://e.com/e", "https://f.com/g", "https://e.com/a/b?y", "https://e.com/a/b?x=1", "https://h.com/"]


def test_whole_paths_and_pages(spark, tmp_path):
    """Queries over long texts see their ends."""
    from siteloom.plans import scalar_queries as Q

    body = "<br>" * 150 + "<p>" + "plain words of a page " * 200 + "</p>"
    spark.createDataFrame([(12, "https://e.com/" + "a" * 600, body)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    (path,) = Q.queries()["url3_decode_path"](spark, str(tmp_path)).collect()
    assert path["value"] == "/" + "a" * 600 + "Aé%2Fx%"
    (page,) = Q.queries()["fn13_client_rendered"](spark, str(tmp_path)).collect()
    assert page["value"] is False
