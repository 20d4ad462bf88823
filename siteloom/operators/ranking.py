"""Ranks and running totals within groups of any size.

A window over a group needs the group's rows in one task.  Here rows are dealt by
ranges of group and order instead, so a group may lie in many tasks; each task
numbers its own part, and every part is moved up by what the parts before it
hold.  Only parts that begin within a group have such an offset, one at most
for each range, so the offsets are a table that may be broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import written

#: Bits in which ``monotonically_increasing_id`` counts within a task.
_PART = 33


def running(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    sums: dict[str, str] | None = None,
    xors: dict[str, str] | None = None,
    drop: list[str] | None = None,
    rank: str = "rank",
) -> DataFrame:
    """``df`` with ``rank`` (from 1, in ``order``) in each group and running totals, the row itself included.

    ``sums`` and ``xors`` name a new column for each column to be summed or
    xor-ed; a null counts as nothing.  Rows that are equal in ``order`` get ranks
    of their own in no set order.  ``drop`` names columns that only the order
    needs.  Without ``group`` all rows are one group.  The names ``_part``,
    ``_at`` and ``_before…`` belong to this function.
    """
    sums, xors = sums or {}, xors or {}
    names = [c for c in df.columns if c not in (drop or [])]
    keys = [*(F.col(g).asc_nulls_first() for g in group), *order]
    # rows that are equal in all keys may still be dealt to several tasks
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("_tie"))
    placed = ranged.sortWithinPartitions(*keys, "_tie").withColumn("_at", F.monotonically_increasing_id())
    kept = written(placed.select(*names, "_at")).withColumn("_part", F.shiftright("_at", _PART))

    own = Window.partitionBy("_part", *group).orderBy("_at")
    numbered = kept.withColumn("_rank", F.row_number().over(own).cast("long"))
    before = [F.count(F.lit(1)).alias("_before")]
    for new, of in sums.items():
        numbered = numbered.withColumn(f"_own_{new}", F.coalesce(F.sum(of).over(own), F.lit(0)))
        before.append(F.coalesce(F.sum(of), F.lit(0)).alias(f"_before_{new}"))
    for new, of in xors.items():
        numbered = numbered.withColumn(f"_own_{new}", F.coalesce(F.expr(f"bit_xor(`{of}`)").over(own), F.lit(0)))
        before.append(F.coalesce(F.expr(f"bit_xor(`{of}`)"), F.lit(0)).alias(f"_before_{new}"))

    parts = kept.groupBy("_part", *group).agg(*before)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    if not group:  # one row a task
        earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        F.col("_part").alias("_in"),
        *(F.col(g).alias(f"_of_{k}") for k, g in enumerate(group)),
        F.sum("_before").over(earlier).alias("_before"),
        *(F.sum(f"_before_{n}").over(earlier).alias(f"_before_{n}") for n in sums),
        *(F.expr(f"bit_xor(`_before_{n}`)").over(earlier).alias(f"_before_{n}") for n in xors),
    ).where("_before IS NOT NULL")
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_of_{k}")) for k, g in enumerate(group)), F.col("_part") == F.col("_in"))
    offset = lambda name: F.coalesce(F.col(name), F.lit(0))
    return numbered.join(F.broadcast(offsets), same, "left").select(
        *names,
        (F.col("_rank") + offset("_before")).alias(rank),
        *((F.col(f"_own_{n}") + offset(f"_before_{n}")).alias(n) for n in sums),
        *(F.col(f"_own_{n}").bitwiseXOR(offset(f"_before_{n}")).alias(n) for n in xors),
    )
