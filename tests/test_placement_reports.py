"""Placement reports, recounts, search, and the first sources of nodes."""

from siteloom.operators import graph as G
from siteloom.operators import place as L
from siteloom.sources import html as H

PLACED = "url string, trail array<string>, trail_source string"


def test_report_of_two_placements(spark):
    before = spark.createDataFrame([("a", ["X"], "menu"), ("b", ["X", "Y"], "menu"), ("c", ["Old"], None), ("gone", [], "none")], PLACED)
    after = spark.createDataFrame([("a", ["X"], "menu"), ("b", ["New"], "breadcrumb"), ("c", None, "none")], PLACED)
    rows = {(r["row"], r["name"]): (r["before"], r["after"]) for r in L.placement_report(before, after).collect()}
    assert rows == {
        ("source", "menu"): (2, 1), ("source", "breadcrumb"): (0, 1), ("source", "none"): (2, 1), ("moved", ""): (0, 2),
        ("root lost", "Old"): (1, 0), ("root gained", "New"): (0, 1),
    }


def test_split_is_recounted_without_a_source(spark):
    rows = [("a", ["X"], "menu"), ("b", [], "breadcrumb"), ("c", ["X"], None), ("d", ["OTHERS"], None), ("e", None, None), ("f", ["X"], "none")]
    found = {r["source"]: (r["pages"], round(r["share"], 3)) for r in L.placement_split(spark.createDataFrame(rows, PLACED)).collect()}
    assert found == {"menu": (2, 0.333), "breadcrumb": (1, 0.167), "unplaced": (3, 0.5)}
    assert L.placement_split(spark.createDataFrame([], PLACED)).count() == 0


def test_search(spark):
    nodes = spark.createDataFrame([("https://e.com/Shoes", "Red"), ("https://e.com/x", "shoe shop"), (None, "Shoes"), ("https://e.com/hat", None)], "url string, label string")
    assert [(r["label"], r["total"]) for r in L.node_search(nodes, " SHOE ", 2).collect()] == [("Red", 3), ("Shoes", 3)]
    assert L.node_search(nodes, " ").count() == 0 and L.node_search(nodes, "nothing").count() == 0


def test_first_sources_of_a_node(spark):
    rows = [("https://e.com/a", 3, "sitemap", 1, "late.xml", None), ("https://e.com/a/", 2, "sitemap", 2, "early.xml", None), ("https://e.com/a", 1, "link", 0, None, None), ("https://e.com/a", 4, "cms", 0, None, "post")]
    node = G.merge_sources(spark.createDataFrame(rows, "url string, ord long, source string, depth int, sitemap_source string, cms_record string")).first()
    assert (node["sitemap_source"], node["cms_record"], node["url"], node["depth"], node["ord"]) == ("early.xml", "post", "https://e.com/a", 0, 1)


def test_canonical_links_without_quotes(spark):
    from pyspark.sql import functions as F

    pages = [("<link rel=canonical href=/c/1>", "https://e.com/c/1"), ('<LINK href=" /c/2 " rel="x canonical">', "https://e.com/c/2"), ("<link rel=icon href=/i>", ""), ("<link rel=canonical>", "")]
    rows = spark.createDataFrame([("https://e.com/p", h, w) for h, w in pages], "url string, html string, want string")
    assert [r["got"] for r in rows.select(H.canonical_url(F.col("html"), F.col("url")).alias("got"), "want").collect()] == [w for _, w in pages]
