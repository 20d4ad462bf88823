"""Distributed ranks and running totals, and what is built on them."""

import random

import pytest
from pyspark.sql import functions as F

from siteloom.operators import escalation as E
from siteloom.operators import graph as G
from siteloom.operators import reports as R
from siteloom.operators.ranking import running


@pytest.mark.parametrize("seed", [1, 2])
def test_running_by_brute_force(spark, seed):
    """Most rows in one group, nulls, ties, and a group that starts within another's task."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randint(0, 20), rng.choice([None, 1, 2, 5]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, o int, n int, id long").repartition(7)
    made = running(df, ["g"], [F.col("o").desc()], sums={"total": "n"}, xors={"mixed": "id"}, drop=["o"]).collect()
    assert len(made) == 600 and made[0].asDict().keys() == {"g", "n", "id", "rank", "total", "mixed"}
    of = {r[3]: r for r in rows}
    for g in ("hot", "b", None):
        own = sorted((r for r in made if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert [of[r["id"]][1] for r in own] == sorted((r[1] for r in rows if r[0] == g), reverse=True)
        total = mixed = 0
        for r in own:
            total, mixed = total + (r["n"] or 0), mixed ^ r["id"]
            assert (r["total"], r["mixed"]) == (total, mixed)


def test_running_over_all_rows_and_none(spark):
    df = spark.range(1000).repartition(5)
    made = running(df, [], [F.col("id").asc()], sums={"s": "id"})
    assert made.where("rank <> id + 1 or s <> id * (id + 1) / 2").count() == 0
    assert running(df.limit(0), [], [F.col("id").asc()]).count() == 0
    same = running(spark.createDataFrame([(1,)] * 500, "x int"), ["x"], [F.col("x").asc()])
    assert sorted(r["rank"] for r in same.collect()) == list(range(1, 501))


def test_a_hot_group_lies_in_several_tasks(spark):
    df = spark.range(20_000).select(F.lit("one").alias("g"), "id")
    made = running(df, ["g"], [F.col("id").asc()])
    assert made.where("rank <> id + 1").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows are else brought together
    try:
        parts = df.repartitionByRange("g", "id").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 15_000


def test_budget_of_pages(spark):
    rows = [(f"k{i}", i, i % 2 == 0, i % 3 == 0, False) for i in range(30)]
    nodes = spark.createDataFrame(rows, "key string, ord long, in_sitemap boolean, in_links boolean, in_cms boolean")
    kept = G.within_budget(nodes, 10, 0.4)
    assert sorted((r["key"], r["slot"]) for r in kept.collect()) == sorted([(f"k{i}", "listed") for i in range(0, 12, 2)] + [(f"k{i}", "linked") for i in (3, 9, 12, 15)])
    assert tuple(G.budget_report(nodes, kept, 10, 0.4).first()) == (30, 10, 20, True, 4, 4)
    every = G.within_budget(nodes.where("in_sitemap"), 40)
    assert tuple(G.budget_report(nodes.where("in_sitemap"), every, 40).first()) == (15, 15, 0, False, 8, 0)
    assert G.held_back(1, 0.5) == 0 and G.held_back(10, 5.0) == 9 and G.held_back(10, -1) == 0


def test_costs_run_up_to_the_budget(spark):
    rows = [(f"u{i:02}", i % 3 / 10, 0.5) for i in range(12)]
    made = R.affordable(spark.createDataFrame(rows, "url string, score double, cost double"), 2.5).orderBy("spent").collect()
    assert [(r["url"], r["spent"]) for r in made] == [("u00", 0.5), ("u03", 1.0), ("u06", 1.5), ("u09", 2.0), ("u01", 2.5)]


VOTES = "url string, level string, page_type string, confidence double"


def test_settled_pages_are_never_asked(spark, tmp_path):
    """A rule, a sure consensus, a sure local vote: each ends it; the paid one sees what is left and can be afforded."""
    pages = spark.createDataFrame([(f"https://e.com/p/{k}", 1.0 + (k == 5)) for k in range(8)] + [("https://e.com/", 1.0)], "url string, cost double")
    sure = {0: 0.95, 1: 0.6, 2: 0.4, 3: 0.3, 4: 0.2, 5: 0.1}
    voted = spark.createDataFrame([(f"https://e.com/p/{k}", "L3_LEAF_PAGE", "BLOG_ARTICLE", c) for k, c in sure.items()], VOTES)
    asked = {"local": [], "paid": []}

    def judge(name, confidence):
        def run(frames):
            for frame in frames:
                with open(f"{tmp_path}/{name}", "a") as log:
                    log.writelines(f"{u}\n" for u in frame["url"])
                frame = frame[["url"]].copy()
                frame["level"], frame["page_type"], frame["confidence"] = "L3_LEAF_PAGE", "CASE_STUDY", [confidence(u) for u in frame["url"]]
                yield frame

        return lambda df: df.select("url").mapInPandas(run, VOTES)

    made = E.layered(pages, voted, judge("local", lambda u: 0.9 if u.endswith("/1") else 0.5), judge("paid", lambda u: 0.99), budget=3.0)
    found = {r["url"].rpartition("/")[2]: r["method"] for r in made.collect()}
    made.collect()  # reading again asks nobody again
    for name in asked:
        asked[name] = sorted(line.strip().rpartition("/")[2] for line in open(f"{tmp_path}/{name}"))
    assert asked["local"] == ["1", "2", "3", "4", "5", "6", "7"]  # all but the rule's and the sure one
    # least certain first: all are at 0.5 now, so by address, until the budget of three is spent
    assert asked["paid"] == ["2", "3", "4"]
    assert found["0"] == "LAYER1" and found["1"] == "LAYER2_LOCAL" and found[""] == "URL_RULE" and found["2"] == "LAYER3_PAID" and found["5"] == "LAYER2_LOCAL"


def test_nothing_is_paid_without_a_budget(spark):
    pages = spark.createDataFrame([("https://e.com/p/1", 1.0)], "url string, cost double")
    voted = spark.createDataFrame([], VOTES)

    def never(df):
        raise AssertionError("asked")

    assert E.layered(pages, voted, None, never, 0.0).first()["method"] == "UNRESOLVED"
    assert E.layered(pages, voted, None, lambda df: df.selectExpr("url", "'L3_LEAF_PAGE' AS level", "'CASE_STUDY' AS page_type", "0.9D AS confidence"), 0.5).first()["method"] == "UNRESOLVED"
