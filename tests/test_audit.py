"""Queries against their SQL on the smallest tables, and invariants."""

import os
from collections import Counter

import duckdb
import pytest

from siteloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CHOSEN = [
    "url5_normalize_url", "url20_fast_path", "fn11_repaired_pair", "pf4_resolve", "pf7_section_rollup", "pf8_unmatched_groups", "op_7_ranked",
    "gr2_merged_nodes", "gr4_degrees", "gr10_loops", "cl7_consensus", "cl8_all_layers", "rc1_reconcile", "ev1_accuracy", "tr1_path_tree",
    "url3_decode_path", "src7_search_export", "src3_expanded_sitemaps", "pl5_placed_pages", "rc6_merged", "tr5_nav_tree", "gr11_evidence", "htm4_declared_roots", "snk4_unmatched", "ud2_batch_votes",
]


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows_as_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    made = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in made.description].index(c) for c in names]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in made.fetchall())


def test_sections_add_up(spark):
    rows = {r["section"]: r for r in registry.queries()["pf7_section_rollup"](spark, SF).collect()}
    top = [r for r in rows.values() if r["depth"] == 1]
    for what in ("pages", "clicks", "impressions", "sessions"):
        assert sum(r[what] for r in top) == rows[""][what]


def test_nothing_exported_is_lost(spark):
    q = registry.queries()
    matched = sum(r["clicks"] or 0 for r in q["pf6_page_metrics"](spark, SF).collect())
    lost = q["pf6_unattributed"](spark, SF).first()["clicks"]
    con = duckdb.connect()
    assert matched + lost == con.execute(f"SELECT sum(page_id * 37 % 211) FROM '{SF}/pages.parquet'").fetchone()[0]


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
