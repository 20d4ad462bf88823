"""The pages of a listing, in the order in which they lead to each other.

Responses are stored by the endpoint that they were fetched for.  The next page
is what a ``Link`` header names, else the endpoint with the next page number;
the walk ends where the declared number of pages is reached, at a response that
is missing, refused or empty, and at a body that came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages of one endpoint that are read at most, as the reader of such listings has it.
MOST_PAGES = 40


def next_link(value: Column) -> Column:
    """The address that a Link header gives as ``rel=next``, the last of several; null if none."""
    parts = F.transform(F.split(value, ","), lambda p: F.split(p, ";"))
    named = F.filter(parts, lambda p: F.trim(p[0]).rlike("^<.+>$") & F.exists(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), _says_next))
    return F.trim(F.regexp_replace(F.trim(F.try_element_at(named, F.lit(-1))[0]), "^<|>$", ""))


def _says_next(attribute: Column) -> Column:
    name, raw = F.lower(F.trim(F.substring_index(attribute, "=", 1))), F.regexp_replace(attribute, "^[^=]*=", "")
    return attribute.contains("=") & (name == "rel") & (F.lower(F.regexp_replace(F.trim(raw), "^[\"']+|[\"']+$", "")) == "next")


def total_pages(value: Column) -> Column:
    """The number of pages that a header states, null if it is none above 0."""
    n = F.trim(value).try_cast("int")
    return F.when(n > 0, n)


def page_address(endpoint: Column, page: Column) -> Column:
    """The endpoint with its parameter ``page`` set, in place of one that it has."""
    bare = F.regexp_extract(endpoint, r"^[^?#]*", 0)
    query = F.regexp_replace(F.regexp_extract(endpoint, r"^[^?#]*\?([^#]*)", 1), r"(^|&)page=[^&]*", "")
    query = F.regexp_replace(query, "^&+", "")
    mark = F.regexp_extract(endpoint, r"(#.*)$", 1)
    return F.concat(bare, F.lit("?"), query, F.when(query != "", "&").otherwise(""), F.lit("page="), page.cast("string"), mark)


def walk(responses: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """endpoint, nr, url of the pages that are read, from endpoint, url, status, body, headers.

    Of an endpoint only addresses, digests and what headers say are brought
    together, of as many responses as were stored for it; bodies stay where they are.
    """
    headers = F.transform_keys("headers", lambda k, _: F.lower(k))
    fit = F.col("status").between(200, 299) & (F.trim(F.regexp_replace("body", r"\s+", " ")) != "")
    said = responses.where(fit).select(
        "endpoint", "url", F.sha2("body", 256).alias("digest"), next_link(F.try_element_at(headers, F.lit("link"))).alias("next"), total_pages(F.try_element_at(headers, F.lit("x-wp-totalpages"))).alias("total")
    )
    said = said.groupBy("endpoint", "url").agg(F.min(F.struct("digest", "next", "total")).alias("r"))  # an address that was stored again
    stored = said.groupBy("endpoint").agg(F.map_from_entries(F.collect_list(F.struct("url", "r"))).alias("at"))
    start = F.struct(
        F.col("endpoint").alias("url"),
        F.lit(None).cast("int").alias("total"),
        F.array().cast("array<string>").alias("seen"),
        F.array().cast("array<string>").alias("read"),
    )

    def step(state: Column, k: Column) -> Column:
        here = F.try_element_at(F.col("at"), state["url"])
        goes = F.coalesce(here.isNotNull() & ~F.array_contains(state["seen"], here["digest"]), F.lit(False))
        total = F.coalesce(state["total"], here["total"])
        onward = F.when(total.isNotNull() & (k >= total), F.lit(None)).otherwise(F.coalesce(here["next"], page_address(F.col("endpoint"), k + 1)))
        return F.struct(
            F.when(goes, onward).alias("url"),
            F.when(goes, total).otherwise(state["total"]).alias("total"),
            F.when(goes, F.concat(state["seen"], F.array(here["digest"]))).otherwise(state["seen"]).alias("seen"),
            F.when(goes, F.concat(state["read"], F.array(state["url"]))).otherwise(state["read"]).alias("read"),
        )

    read = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["read"])
    return stored.select("endpoint", F.posexplode(read).alias("nr", "url")).select("endpoint", (F.col("nr") + 1).alias("nr"), "url")


def listing_bodies(responses: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """endpoint, nr, url, body of the pages that are read."""
    bodies = responses.groupBy("endpoint", "url").agg(F.min_by("body", F.sha2("body", 256)).alias("body"))
    return walk(responses, most).join(bodies, ["endpoint", "url"]).select("endpoint", "nr", "url", "body")
