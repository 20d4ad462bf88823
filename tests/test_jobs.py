"""Sources, streams and reports on small inputs, empty ones included."""

import pytest

from siteloom.operators import audit as A
from siteloom.operators import classify as C
from siteloom.operators import graph as G
from siteloom.operators import place as L
from siteloom.operators import reports as R
from siteloom.operators import robots as RB
from siteloom.sources import bodies as B
from siteloom.sources.store import Store
from siteloom.streaming import crawl_stream as T


def test_progress_rate(spark):
    rows = [("a", 0.0, 0), ("a", 1.0, 10), ("a", 1.01, 99), ("a", 3.0, 20), ("b", 5.0, 7)]
    got = {r["job"]: r for r in T.progress_rate(spark.createDataFrame(rows, "job string, ts double, completed long")).collect()}
    assert got["a"]["rate"] == pytest.approx(0.3 * 5 + 0.7 * 10) and got["a"]["completed"] == 20
    assert got["b"]["rate"] is None


def test_streams_gather_nothing(spark, tmp_path):
    """Stream results are files, not rows of the driver; samples of a job aren't one row."""
    samples = spark.createDataFrame([("a", float(t), 2 * t) for t in range(5000)] + [(None, 1.0, 1)], "job string, ts double, completed long")
    rate = T.progress_rate(samples)
    assert {r["job"]: (r["completed"], r["rate"]) for r in rate.collect()} == {"a": (9998, pytest.approx(2.0)), None: (1, None)}
    assert "collect_list" not in rate._jdf.queryExecution().toString()
    for part in range(2):
        spark.range(10).selectExpr("id % 2 AS k").write.parquet(f"{tmp_path}/in/p{part}.parquet")
    stream = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/p*.parquet")
    counts = T.run_once(stream.groupBy("k").count(), "complete", f"{tmp_path}/counts", "counts")
    assert sorted(map(tuple, counts.collect())) == [(0, 10), (1, 10)] and counts.inputFiles()
    rows = T.run_once(stream, "append", f"{tmp_path}/rows", "rows")
    assert rows.count() == 20 and rows.inputFiles()


def test_sitemap_bodies(spark):
    rows = [("i", "junk <?xml?><sitemapindex><sitemap><loc> a </loc></sitemap><s:loc>b</s:loc><loc>a</loc></sitemapindex>"), ("u", "<p>"), ("n", None)]
    got = B.sitemap_entries(spark.createDataFrame(rows, "name string, body string")).orderBy("nr").collect()
    assert [(r["name"], r["kind"], r["loc"]) for r in got] == [("i", "INDEX", "a"), ("i", "INDEX", "b")]


def test_search_export(spark):
    """Quoted cells, localised headers, a delimiter for each file, and rows that are no addresses."""
    lines = [
        ("en", 0, "Top pages,Clicks,Impressions,CTR,Position"), ("en", 1, '"https://e.com/a,b","1,234",10,50%,1.5'), ("en", 2, "https://e.com/,5,10,50%,-1.5"), ("en", 3, "total,1,2,3,4"),
        ("de", 0, "Häufigste Seiten;Impressionen;Klicks;CTR;Position"), ("de", 1, "/a;1.234;2;1%;12,5"), ("de", 2, ""), ("none", 0, "/b,1,2,3%,4"), ("none", 1, None),
        ("words", 0, "Queries,Clicks"), ("words", 1, "shoes,5"),
    ]
    made = spark.createDataFrame(lines, "file string, nr long, line string")
    got = {tuple(r) for r in B.search_export(made).collect()}
    assert got == {("en", "https://e.com/a,b", 1234, 10, 1.5), ("en", "https://e.com/", 5, 10, 0.0), ("de", "/a", 2, 1234, 12.5), ("none", "/b", 1, 2, 4.0)}
    assert {tuple(r) for r in B.rejected_rows(made).collect()} == {("en", 1), ("de", 0), ("none", 0), ("words", 1)}
    assert B.pick_table(B.export_cells(made)).first()["file"] == "none"
    assert B.pick_table(B.export_cells(made.where("file = 'words'"))).count() == 0
    assert B.search_export(made.limit(0)).count() == 0


def test_sitemap_text(spark):
    body = "<urlset><url><loc>https://e.com/?a=1&amp;b=2</loc></url><url><loc><![CDATA[https://e.com/c?x&y]]></loc></url></urlset>"
    got = B.sitemap_entries(spark.createDataFrame([("u", body)], "name string, body string")).collect()
    assert [r["loc"] for r in got] == ["https://e.com/?a=1&b=2", "https://e.com/c?x&y"]


def test_links(spark):
    html = '<a href="/q?a=1&amp;b=2">x</a><a class=c href=/plain>y</a><A HREF=\'/s\'>z</a><a href="/a/../b">d</a><a href="mailto:x@y">m</a>'
    got = G.links(spark.createDataFrame([("https://e.com/d/", html)], "url string, html string")).collect()
    assert {r["href"] for r in got} == {"https://e.com/q?a=1&b=2", "https://e.com/plain", "https://e.com/s", "https://e.com/b"}


def test_placement_is_idempotent(spark):
    menu = spark.createDataFrame([("https://e.com/a", ["A"], 1)], "url string, labels array<string>, ord long")
    rows = [("https://e.com/a/x", "T", None, "none", []), ("https://e.com/b", "T", ["p", "q"], "none", []), ("https://e.com/c", "T", None, "none", [])]
    pages = spark.createDataFrame(rows, "url string, page_type string, own_breadcrumb array<string>, trail_source string, trail array<string>")
    once = L.place_pages(pages, menu)
    assert {tuple(map(str, r)) for r in once.collect()} == {("https://e.com/a/x", "['A']", "menu"), ("https://e.com/b", "['p', 'q']", "breadcrumb"), ("https://e.com/c", "['OTHERS', 'T']", "none")}
    again = L.place_pages(pages.select("url", "page_type", "own_breadcrumb").join(once, "url"), menu)
    assert {tuple(map(str, r)) for r in again.collect()} == {tuple(map(str, r)) for r in once.collect()}


def test_robots_longest_rule(spark):
    rules = spark.createDataFrame([("/a", False), ("/a/b", True), ("/*.pdf$", False)], "pattern string, allow boolean")
    urls = spark.createDataFrame([("https://e.com/a/x",), ("https://e.com/a/b/c",), ("https://e.com/q.pdf",), ("https://e.com/",)], "url string")
    got = {r["url"].removeprefix("https://e.com"): r["allowed"] for r in RB.allowed(urls, rules).collect()}
    assert got == {"/a/x": False, "/a/b/c": True, "/q.pdf": False, "/": True}


def test_bfs_stops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = G.bfs(edges, spark.createDataFrame([("a",)], "key string")).collect()
    assert {(r["key"], r["depth"]) for r in got} == {("a", 0), ("b", 1), ("c", 2)}


def test_result_round_trip(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/jobs")
    store.write(spark.range(3), "one")
    store.write(spark.range(5), "two")
    store.write(spark.range(3), "one")  # run again
    assert store.read("one").count() == 3 and store.read("two").count() == 5


def test_progress_estimate(spark):
    rows = [("a", 0.0, 0, 100), ("a", 1.0, 10, 100), ("a", 4.0, 40, 100), ("b", 0.0, 0, 50), ("b", 1.0, 5, 50), ("c", 0.0, 3, None), ("c", None, 9, 9), ("d", 0.0, 9, 5), ("d", 4.0, 2, 5)]
    got = {r["job"]: r for r in T.progress(spark.createDataFrame(rows, "job string, ts double, completed long, discovered long"), 60).collect()}
    assert (got["a"]["total"], got["a"]["rate"], got["a"]["eta_seconds"]) == (60, 10.0, 2.0)
    assert got["a"]["share"] == pytest.approx(40 / 60)
    assert got["b"]["rate"] == 5.0 and got["b"]["eta_seconds"] is None  # still warming up
    assert (got["c"]["completed"], got["c"]["total"], got["c"]["share"], got["c"]["eta_seconds"]) == (3, 0, 0.0, None)
    assert got["d"]["rate"] == 0.0 and got["d"]["eta_seconds"] is None  # a count that falls is no progress
    items = T.recent_items(spark.createDataFrame([("a", t, f"u{t}") for t in range(30)], "job string, ts long, item string"), 3)
    assert [(r["nr"], r["item"]) for r in items.orderBy("nr").collect()] == [(1, "u29"), (2, "u28"), (3, "u27")]


def test_loop_verdicts(spark, tmp_path):
    """Every address of a confirmed tail is refused or evicted, repeats count once, others stay."""
    loop = [f"https://e.com/p{n}" + "/q" * (n % 5) + "/a/b/c/" for n in range(60)]
    rows = [(u,) for u in loop + loop] + [(f"https://e.com/x{n}/d/e/f/",) for n in range(40)] + [("https://e.com/",)]
    spark.createDataFrame(rows, "url string").repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    verdicts = T.run_once(T.loop_verdicts(stream), "append", f"{tmp_path}/state", "verdicts")
    out = T.loop_members(verdicts).collect()
    assert sorted(r["url"] for r in out) == sorted(loop)
    assert {r["role"] for r in out} == {"refused", "evicted"}
    confirming = verdicts.where("verdict = 'confirming'").collect()
    assert [(r["tail"], r["depths"] >= 4) for r in confirming] == [("a/b/c", True)] and confirming[0]["urls"] >= 25
    assert verdicts.where("tail = 'd/e/f' and verdict = 'admitted'").count() == 40


def test_findings_and_worksheet(spark):
    rows = [("low", "low", f"l{n}") for n in range(9)] + [("many", "high", f"m{n}") for n in range(3)] + [("few", "high", "f")]
    got = R.finding_list(spark.createDataFrame(rows, "kind string, severity string, url string")).collect()
    assert [(r["kind"], r["n"]) for r in got] == [("many", 3), ("few", 1), ("low", 9)] and got[2]["examples"] == "l0 l1 l2 l3 l4"
    pages = spark.createDataFrame([("u", "L1", "T", 0.12345), ("v", "L2", "T", 0.1)], "url string, level string, page_type string, score double")
    sheet = L.worksheet(pages, spark.createDataFrame([("u", 4), ("u", 0), ("u", 0)], "url string, source int"))
    assert [(r["url"], r["confidence"], r["signals"], r["notes"]) for r in sheet.collect()] == [("v", 0.1, "", ""), ("u", 0.123, "CMS_API_ENDPOINT|LINK_IN_DEGREE", "")]


def test_profile_accuracy(spark):
    labels = spark.createDataFrame([(1, "L3_LEAF_PAGE", "X"), (2, "L3_LEAF_PAGE", "UNKNOWN"), (9, "a", "b")], "page_id long, want_level string, want_type string")
    pages = spark.createDataFrame([(1, "u"), (2, "v")], "page_id long, url string")
    signals = spark.createDataFrame([("u", 0, "L3_LEAF_PAGE", "X", 0.9)], "url string, source int, level string, page_type string, confidence double")
    got = A.profile_accuracy(labels, pages, C.consensus_by_profile(signals), list(C.WEIGHTS)).collect()
    # the profile that gives the only signal no weight is the last
    assert {r["profile"]: r["exact_hits"] for r in got} == {"default": 2, "wordpress": 2, "shopify": 2, "headless": 1} and got[-1]["profile"] == "headless"
