"""Arguments that are worked out once, and Columns that are made once.

A Column that is used several times is copied as often into the plan, and
copies of copies grow without bound; a lambda's variable is one reference.
Making a long Column takes many calls to the JVM, so functions of a column that
is given by its name are kept: the same Column serves in any DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), lambda v: make(v)), F.lit(0))


def named(function: Callable) -> Callable:
    """The function's first argument may be a column's name; then its result is kept."""
    kept: dict[tuple, Column] = {}

    @wraps(function)
    def made(value: Column | str, *args, **options) -> Column:
        if not isinstance(value, str):
            return function(value, *args, **options)
        if args or options:
            return function(F.col(value), *args, **options)
        key = (id(SparkContext._gateway), value)
        if key not in kept:
            kept[key] = function(F.col(value))
        return kept[key]

    return made


def once(function: Callable) -> Callable:
    """The function's first argument is bound before its body, and may be a name."""

    @wraps(function)
    def bound(value: Column, *args, **options) -> Column:
        return let(value, lambda v: function(v, *args, **options))

    return named(bound)
