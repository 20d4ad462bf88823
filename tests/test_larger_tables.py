"""Queries against their SQL on what only larger tables have: high page numbers and
addresses that several pages share."""

from collections import Counter

import duckdb
import pytest

from siteloom.operators import audit as A
from siteloom.operators import classify as C
from siteloom.operators import place as L
from siteloom.plans import registry
from siteloom.sources import menu as M
from test_audit import plain

#: New pages and the page whose address each has; no new page has a vote that ties with its twin's.
SHARED = {52: 1, 60: 2, 68: 3, 76: 5, 84: 6, 92: 7, 100: 9, 108: 16, 116: 21, 124: 16}


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    folder = tmp_path_factory.mktemp("larger")
    pairs = ", ".join(f"({new}, {old}, {new % 37})" for new, old in SHARED.items())
    duckdb.connect().execute(f"""COPY (
        WITH p AS (SELECT page_id::BIGINT AS page_id, url, html FROM '/root/testdata/sf0.001/pages.parquet'), v(new, old, other) AS (VALUES {pairs})
        SELECT * FROM p UNION ALL SELECT new::BIGINT, a.url, b.html FROM v JOIN p a ON a.page_id = old JOIN p b ON b.page_id = other
        UNION ALL SELECT 70000 + page_id, url || 'z', html FROM p WHERE page_id < 3
    ) TO '{folder}/pages.parquet' (FORMAT parquet)""")
    return str(folder)


def both(spark, name, folder, mend=str):
    """Rows of the query and of its SQL, by column name; ``mend`` completes an order in the SQL."""
    df = registry.queries()[name](spark, folder)
    names = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    made = con.execute(mend(registry.oracle_sql()[name]))
    at = [[d[0] for d in made.description].index(c) for c in names]
    return Counter(tuple(plain(r[c]) for c in names) for r in df.collect()), Counter(tuple(plain(r[i]) for i in at) for r in made.fetchall())


@pytest.mark.parametrize("name", ["fn26_clock", "htm8_schema_votes", "cl6_five_signals", "htm4_declared_roots", "htm5_declared_menu", "htm3_mega_menu", "gr11_evidence", "cl8_all_layers", "rc5_verified_missed"])
def test_same_rows_as_sql(spark, larger, name):
    got, want = both(spark, name, larger)
    assert got == want


def test_menu_of_an_address(spark, larger):
    """Entries at the same place of two pages are in any order in the SQL, in that of their targets here."""
    got, want = both(spark, "htm3_menu", larger)
    at = {"labels": 0, "ord": 1, "target": 2, "url": 3}
    unplaced = lambda rows: Counter({(r[at["url"]], r[at["target"]], r[at["labels"]]): n for r, n in rows.items()})
    assert unplaced(got) == unplaced(want)
    orders = lambda rows: sorted((r[at["url"]], r[at["ord"]]) for r in rows)
    assert orders(got) == orders(want) and got == both(spark, "htm3_menu", larger)[0]


def test_layers_on_demand(spark, larger):
    """An address that is paid for has the answer on all its rows in the SQL, once for each
    call; here each row that was open has it.  All other addresses are the same."""
    got, want = both(spark, "cl8_layers_on_demand", larger)
    paid = lambda rows: {r[4] for r in rows if r[2] == "LAYER3_PAID"}
    rest = lambda rows: Counter({r: n for r, n in rows.items() if r[4] not in paid(want)})
    assert paid(got) == paid(want) and rest(got) == rest(want)


@pytest.mark.parametrize("turn", [1, -1])
def test_votes_that_tie(spark, turn):
    """Two pages of an address, each with a vote of the same source: the rows' order tells nothing."""
    kinds = [("L3_LEAF_PAGE", "BLOG_ARTICLE"), ("L2_SUB_NAV_HUB", "SERVICE_CATEGORY_HUB"), ("L2_SUB_NAV_HUB", "PRODUCT_CATEGORY_HUB")]
    rows = [("u", 0, level, kind, 0.88) for level, kind in kinds][::turn]
    signals = spark.createDataFrame(rows, "url string, source int, level string, page_type string, confidence double").coalesce(1)
    for found in (C.consensus(signals), C.consensus_by_profile(signals).where("profile = 'default'")):
        assert [(r["level"], r["page_type"], r["votes"]) for r in found.collect()] == [("L2_SUB_NAV_HUB", "PRODUCT_CATEGORY_HUB", 3)]


def first_page(sql):
    """The SQL of placement with the first page of an address in its place, where any may be."""
    assert sql.count("NULLS LAST)") == 1
    return sql.replace("NULLS LAST)", "NULLS LAST, p.ord)")


@pytest.mark.parametrize("name", ["pl2_longest_prefix", "pl5_placed_pages", "pl6_coverage", "pl7_placement_changes", "pl7_placement_report"])
def test_placed_addresses(spark, larger, name):
    got, want = both(spark, name, larger, first_page)
    assert got == want


def test_pages_of_an_address_are_placed_once(spark):
    pages = spark.createDataFrame([("https://e.com/x/1", "B"), ("https://e.com/x/1", "A"), ("https://e.com/", "B"), ("https://e.com/", "A")], "url string, page_type string")
    menu = spark.createDataFrame([("https://e.com/x", ["X"], 1)], "url string, labels array<string>, ord long")
    rows = sorted((r["url"], r["trail"], r["how"]) for r in L.place(pages, menu).collect())
    assert rows == [("https://e.com/", ["OTHERS", "A"], "unmatched"), ("https://e.com/x/1", ["X"], "inherited")]


def test_pages_of_an_address_are_compared_with_themselves(spark):
    before = spark.createDataFrame([(1, "u", ["X"], "menu"), (2, "u", ["Y"], "menu")], "page_id long, url string, trail array<string>, trail_source string")
    after = before.selectExpr("page_id", "url", "array('Y') AS trail", "trail_source")
    moved = L.placement_changes(before, after, ("page_id",)).collect()
    assert [(r["page_id"], r["old"], r["new"]) for r in moved] == [(1, ["X"], ["Y"])]
    report = L.placement_report(before, after, ("page_id",)).where("row = 'moved'").first()
    assert report["after"] == 1


def test_pages_of_an_address_are_probed_apart(spark):
    missed = spark.createDataFrame([(1, "u"), (2, "u"), (3, "u")], "page_id long, url string")
    probes = spark.createDataFrame([(1, 200, None), (2, 301, "https://e.com/a")], "page_id long, status int, location string")
    ours = spark.createDataFrame([("https://e.com/a",)], "url string")
    rows = sorted((r["page_id"], r["url"], r["state"], r["held"]) for r in A.verify_missed(missed, probes, ours, ("page_id",)).collect())
    assert rows == [(1, "u", "LIVE", False), (2, "u", "REDIRECTED", True), (3, "u", "UNREACHABLE", False)]


def test_repeated_links_count_in_the_place_of_later_ones(spark):
    link = lambda names: "<nav><ul>" + "".join(f'<li><a href="/{n}">{n}</a></li>' for n in names) + "</ul></nav>"
    pages = spark.createDataFrame([("https://e.com/", link("abbc")), ("https://e.com/", link("defg"))], "url string, html string")
    rows = sorted((r["ord"], r["labels"][0]) for r in M.address_menu(pages).collect())
    assert [label for _, label in rows] == list("adbefcg")  # c is the fourth of its page, f the third
