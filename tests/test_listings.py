"""Walks over stored listing pages."""

import pytest

from siteloom.sources import listings as P

E = "https://e.com/wp?per_page=2"


def read(spark, responses, most=P.MOST_PAGES):
    rows = [(E, url, status, body, headers) for url, status, body, headers in responses]
    made = P.listing_bodies(spark.createDataFrame(rows, "endpoint string, url string, status int, body string, headers map<string,string>"), most)
    return [r["body"] for r in made.orderBy("nr").collect()]


def page(k):
    return E if k == 1 else f"{E}&page={k}"


def test_numbered_pages_until_one_is_missing_empty_or_refused(spark):
    assert read(spark, [(page(k), 200, f"b{k}", {}) for k in (1, 2, 3, 5)]) == ["b1", "b2", "b3"]
    assert read(spark, [(page(1), 200, "b1", None), (page(2), 200, " \n", {}), (page(3), 200, "b3", {})]) == ["b1"]
    assert read(spark, [(page(1), 200, "b1", {}), (page(2), 403, "no", {}), (page(3), 200, "b3", {})]) == ["b1"]
    assert read(spark, [(page(2), 200, "b2", {})]) == []
    assert read(spark, [(page(1), 200, None, {})]) == []


def test_a_repeated_body_ends_the_walk(spark):
    assert read(spark, [(page(k), 200, "same" if k in (2, 4) else f"b{k}", {}) for k in range(1, 7)]) == ["b1", "same", "b3"]


def test_the_declared_number_ends_it(spark):
    said = {"X-WP-TotalPages": " 2 "}
    assert read(spark, [(page(k), 200, f"b{k}", said if k == 1 else {}) for k in range(1, 5)]) == ["b1", "b2"]
    assert len(read(spark, [(page(k), 200, f"b{k}", {"x-wp-totalpages": "0"}) for k in range(1, 5)])) == 4


def test_links_lead_before_numbers(spark):
    a, b = "https://e.com/c?after=1", "https://e.com/c?after=2"
    rows = [(E, 200, "b1", {"LINK": f'<{page(9)}>; rel=prev, <{a}>; rel="next"'}), (a, 200, "b2", {"link": f"<{b}>;x=1; rel='NEXT'"}), (b, 200, "b3", {"link": ""}), (page(4), 200, "b4", {})]
    assert read(spark, rows) == ["b1", "b2", "b3", "b4"]  # without a link the next number follows
    assert read(spark, [(E, 200, "b1", {"link": f'<{E}>; rel="next"'})]) == ["b1"]  # a circle


def test_at_most_so_many(spark):
    assert len(read(spark, [(page(k), 200, f"b{k}", {}) for k in range(1, 60)])) == 40
    assert read(spark, [(page(k), 200, f"b{k}", {}) for k in range(1, 9)], 3) == ["b1", "b2", "b3"]


@pytest.mark.parametrize(
    "url, expected",
    [(E, f"{E}&page=3"), ("https://e.com/x", "https://e.com/x?page=3"), ("https://e.com/x?page=1&a=2#f", "https://e.com/x?a=2&page=3#f"), ("https://e.com/x?a=1&page=1", "https://e.com/x?a=1&page=3")],
)
def test_page_address(spark, url, expected):
    from pyspark.sql import functions as F

    assert spark.range(1).select(P.page_address(F.lit(url), F.lit(3)).alias("u")).first()["u"] == expected
