"""Robots files, hidden links, facets and duplicate sets on small rows."""

import pytest

from siteloom.operators import audit as A
from siteloom.operators import graph as G
from siteloom.operators import robots as RB


def verdicts(spark, body, paths, agent="LoomBot/2.0"):
    files = spark.createDataFrame([("e.com", body)], "host string, body string")
    urls = spark.createDataFrame([(f"https://e.com{p}",) for p in paths], "url string")
    found = {r["url"].removeprefix("https://e.com"): r["allowed"] for r in RB.allowed(urls, RB.rules_for(files, agent)).collect()}
    return [found[p] for p in paths]


@pytest.mark.parametrize(
    "rules, path, allowed",
    [
        ("Disallow: /a", "/a/b", False),
        ("Disallow: /a", "/b", True),
        ("Disallow: /a\nAllow: /a/b", "/a/b/c", True),
        ("Allow: /a/b\nDisallow: /a", "/a/b/c", True),
        ("Disallow: /p\nAllow: /p", "/p", True),  # equal length
        ("Disallow: /*?sort=", "/a?sort=up", False),  # the query counts
        ("Disallow: /*?sort=", "/a?x=1", True),
        ("Disallow: /*.pdf$", "/a/b.pdf", False),
        ("Disallow: /*.pdf$", "/a/b.pdf?x", True),
        ("Disallow: /a$", "/a", False),
        ("Disallow: /a$", "/a/", True),
        ("Disallow: *", "/", False),
        ("Disallow: /a*b*c", "/a-b-b-c-d", False),
        ("Disallow: /a.b", "/axb", True),  # no pattern but * and a last $
        ("Disallow: /x$y", "/x$y/z", False),
        ("Disallow:", "/a", True),
        ("Disallow: a", "/a", True),
        ("Disallow: /\nAllow: /$", "", True),  # no path is the root
    ],
)
def test_rules(spark, rules, path, allowed):
    assert verdicts(spark, f"User-agent: *\n{rules}", [path]) == [allowed]


def test_groups_of_agents(spark):
    body = "﻿Disallow: /\r\nUSER-AGENT: *\r\nDisallow: /all # for all\r\n\r\nuser-agent: loom\r\nDisallow: /loom\r\nUser-agent: LoomB\r\nSitemap: https://e.com/s.xml\r\nUser-agent: other\r\nDisallow: /b\r\nUser-agent: loomb\r\nDisallow: /second"
    paths = ["/all", "/loom", "/b", "/second", "/x"]
    assert verdicts(spark, body, paths) == [True, True, False, True, True]  # the longest token, its first group
    assert verdicts(spark, body, paths, "Loomer") == [True, False, True, True, True]
    assert verdicts(spark, body, paths, "none") == [False, True, True, True, True]
    assert verdicts(spark, body, paths, "OTHER") == [True, True, False, True, True]
    assert verdicts(spark, "User-agent: nobody\nDisallow: /", ["/a"]) == [True]
    # a named group without rules allows everything; a line of another field ends the agents
    assert verdicts(spark, "User-agent: *\nDisallow: /\nUser-agent: loombot\nDisallow:", ["/a"]) == [True]
    assert verdicts(spark, "User-agent: loombot\nCrawl-delay: 2\nUser-agent: b\nDisallow: /", ["/a"]) == [True]


def test_delays_and_limits(spark):
    body = "User-agent: loombot\nCrawl-delay: 2\nCrawl-delay: x\nCrawl-delay: -1\nCrawl-delay: 4.5\nAllow: /" + "x" * 2001 + "\nDisallow: /" + "y" * 1999
    said = RB.lines(spark.createDataFrame([("e.com", body), ("f.com", None)], "host string, body string"))
    assert [tuple(r) for r in RB.group_for(said, "loombot").select("host", "crawl_delay").collect()] == [("e.com", 4.5)]
    assert [len(r["pattern"]) for r in RB.rules(said).collect()] == [2000]


def test_rules_by_brute_force(spark):
    """Against a matcher of one character at a time, over many rules and addresses."""
    import random

    rng = random.Random(4)

    def fits(pattern, text):
        if not pattern:
            return True
        if pattern == "$":
            return not text
        if pattern[0] == "*":
            return any(fits(pattern[1:], text[k:]) for k in range(len(text) + 1))
        return bool(text) and text[0] == pattern[0] and fits(pattern[1:], text[1:])

    rules = [("/" + "".join(rng.choices("ab*/?", k=rng.randint(0, 5))) + rng.choice(["", "$"]), rng.random() < 0.5) for _ in range(60)]
    urls = ["https://e.com/" + "".join(rng.choices("ab/", k=rng.randint(0, 5))) + rng.choice(["", "?a", "?b/a"]) for _ in range(200)]
    made = RB.allowed(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(rules, "pattern string, allow boolean"))
    found = {r["url"]: r["allowed"] for r in made.collect()}
    for u in urls:
        hit = [(len(p), a) for p, a in rules if fits(p, u.removeprefix("https://e.com"))]
        assert found[u] == (max(hit)[1] if hit else True), u


def test_no_nested_loop(spark):
    files = spark.createDataFrame([("e.com", "User-agent: *\nDisallow: /a")], "host string, body string")
    urls = spark.createDataFrame([("https://e.com/a",)], "url string")
    plan = RB.allowed(urls, RB.rules_for(files, "x"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hidden_anchors_are_no_links(spark):
    html = """<!-- <a href="/c">c</a> --><script>var a = '<a href="/s">'; // <!--</script><a href="/1">1</a>
    <style><a href="/y"></style><script src="x"></script><a href='/2'>2</a><SCRIPT type=x><a href="/t"></script ><a href=/3>3</a><!-- open <a href="/o">"""
    rows = G.links(spark.createDataFrame([("https://e.com/", html), ("https://e.com/n", None)], "url string, html string")).collect()
    assert sorted(r["href"] for r in rows) == [f"https://e.com/{k}" for k in (1, 2, 3)]


def test_facets_are_reached_but_not_expanded(spark):
    edges = [("r", "a"), ("a", "https://e.com/p?sort=up"), ("https://e.com/p?sort=up", "x"), ("a", "b"), *((f"n{k}", f"n{k + 1}") for k in range(25)), ("b", "n0")]
    found = G.bfs(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("r",)], "key string")).collect()
    depth = {r["key"]: r["depth"] for r in found}
    assert depth["https://e.com/p?sort=up"] == 2 and "x" not in depth and depth["n25"] == 28  # as deep as the links lead
    short = G.bfs(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("r",)], "key string"), 2)
    assert short.agg({"depth": "max"}).first()[0] == 2


def test_duplicate_sets_at_the_root(spark):
    rows = [("https://e.com/job?role=a", 1), ("https://e.com/job?role=b", 2), ("https://e.com/x/job", 3), ("https://e.com/", 4), ("https://e.com/?a=1", 5)]
    found = A.duplicate_sets(spark.createDataFrame(rows, "url string, inbound long")).collect()
    assert sorted((r["leaf"], r["url"].removeprefix("https://e.com")) for r in found) == [("", "/"), ("", "/?a=1"), ("job", "/job?role=a"), ("job", "/job?role=b")]


def test_the_first_page_heads_a_set(spark):
    rows = [("https://e.com/z/p/leaf", 1), ("https://e.com/a/leaf", 2), ("https://e.com/z/leaf", 3), ("https://e.com/z-and-the/q/leaf", 4)]
    made = spark.createDataFrame(rows, "url string, n long").selectExpr("url", "n AS inbound")
    assert sorted(r["inbound"] for r in A.duplicate_sets(made, "inbound").collect()) == [1, 3]
    assert sorted(r["inbound"] for r in A.duplicate_sets(made).collect()) == []  # by URL /a/leaf is the first
