"""Exports with odd cells, and the choice of the table."""

from siteloom.sources import bodies as B


def cells(spark, lines, file="f"):
    rows = [(file, k, line) for k, line in enumerate(lines)]
    made = B.export_cells(spark.createDataFrame(rows, "file string, nr long, line string").repartition(3)).orderBy("nr").collect()
    return [list(r["cells"]) for r in made]


def test_cells(spark):
    assert cells(spark, ['﻿a,"b ""q"" c",,d', "", "x"]) == [["a", 'b "q" c', None, "d"], ["x"]]
    assert cells(spark, ["a;b,c;d", 'e;"f;g";']) == [["a", "b,c", "d"], ["e", "f;g", None]]
    assert cells(spark, [",".join(map(str, range(50)))]) == [[str(k) for k in range(50)]]
    assert cells(spark, ['""', '"",x']) == [[""], ["", "x"]]


def test_records_over_several_lines(spark):
    assert cells(spark, ["k,v", 'a,"one', "", 'two ""x"""', "c,d"]) == [["k", "v"], ["a", 'one\n\ntwo "x"'], ["c", "d"]]


def test_one_table_of_an_archive(spark):
    pages = ["Top pages,Clicks,Impressions"] + [f"https://e.com/{k},{k},9" for k in range(5)]
    again = ["Pages,Clicks,Impressions"] + [f"https://e.com/{k},{k},9" for k in range(3)]
    words = ["Queries,Clicks,Impressions"] + [f"word {k},1,2" for k in range(9)]
    rows = [(f, k, x) for f, t in (("pages.csv", pages), ("more.csv", again), ("words.csv", words)) for k, x in enumerate(t)]
    df = spark.createDataFrame(rows, "file string, nr long, line string")
    found = B.archive_export(df).collect()
    assert {r["file"] for r in found} == {"pages.csv"} and sorted(r["clicks"] for r in found) == [0, 1, 2, 3, 4]
    assert B.archive_export(df.where("file = 'words.csv'")).count() == 0


def test_sitemaps_of_any_depth(spark):
    index = lambda k: (f"https://e.com/s{k}.xml", f"<sitemapindex><sitemap><loc>https://e.com/s{k + 1}.xml</loc></sitemap><sitemap><loc>https://e.com/s0.xml</loc></sitemap></sitemapindex>")
    rows = [index(k) for k in range(14)] + [("https://e.com/s14.xml", "<urlset><url><loc>https://e.com/deep</loc></url></urlset>")]
    found = B.expanded_sitemaps(spark.createDataFrame(rows, "name string, body string"), spark.createDataFrame([("https://e.com/s0.xml",)], "name string"))
    assert [tuple(r) for r in found.collect()] == [("https://e.com/deep", "s14.xml")]
