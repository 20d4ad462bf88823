"""Layers of classification, each asked only about what those before it left open.

A paid classifier is behind a gate: the least certain pages come first, each at
the cost of its call at worst, and calls are made as long as their sum stays
within the budget.  The sum is a distributed running total.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import scalars as S

from . import classify as C
from .ranking import running
from .staging import staged

Judge = Callable[[DataFrame], DataFrame]


def worst_cost(prompt: Column, most_written: int, rates: tuple[float, float], batch: float = 1.0) -> Column:
    """Cost of a call whose answer is as long as it may be."""
    return S.model_cost(S.tokens(prompt), F.lit(most_written), rates, batch)


def open_pages(pages: DataFrame, found: DataFrame, by: tuple[str, ...] = ("url",)) -> DataFrame:
    """``pages`` that a cascade (url, method, confidence) hasn't settled, with its confidence so far."""
    left = found.where((F.col("method") != "URL_RULE") & (F.col("confidence") < C.ACCEPT)).select(*by, F.col("confidence").alias("so_far"))
    return pages.join(left, list(by))


def gate(pages: DataFrame, budget: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Of pages with ``so_far`` and ``cost`` those that the budget covers, least certain
    first; ``spent`` is the sum up to each.  A page is never partly paid for.  ``by`` orders
    pages of one address."""
    ranked = running(pages, [], [F.col(c).asc() for c in dict.fromkeys(["so_far", "url", *by])], sums={"spent": "cost"}, rank="_rank")
    return ranked.drop("_rank").withColumn("spent", F.round("spent", 9)).where(F.col("spent") <= budget)


def layered(pages: DataFrame, voted: DataFrame, local: Judge | None = None, paid: Judge | None = None, budget: float = 0.0, by: tuple[str, ...] = ("url",)) -> DataFrame:
    """``classify.cascade`` whose later layers see only what is open.

    ``local`` and ``paid`` map pages to votes (url, level, page_type, confidence);
    ``pages`` has a ``cost`` if ``paid`` is given.  Without a budget nothing is paid.
    ``by`` as in ``classify.cascade``.
    """
    votes: list[DataFrame | None] = [None, None]
    if local is not None:
        votes[0] = staged(local(open_pages(pages, C.cascade(pages, voted, by=by), by)))
    if paid is not None and budget > 0:
        left = staged(gate(open_pages(pages, C.cascade(pages, voted, votes[0], by=by), by), budget, by))
        votes[1] = staged(paid(left))  # asked once, whatever reads the result
    return C.cascade(pages, voted, *votes, by=by)
