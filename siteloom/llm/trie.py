"""Prefix trie of conversations by digests of blocks of turns.

Every conversation is cut into blocks of ``BLOCK`` turns.  A block's place in
the trie is named by a digest of all turns up to its end: the exclusive or of
the digests of the blocks so far, each made with its number, so it comes as a
running total and no conversation is gathered.  Conversations are first grouped
by these block digests.  Only below a block that several different blocks
follow are the boundaries of turns looked at: the turns of these siblings (one
of each, with its number of conversations) are grouped by their digests turn by
turn.  Where one block alone follows, its turns have the block's members.

Sums over subtrees: within a block a node passes its share to the at most
``BLOCK`` nodes above it; from block to block they go up by pointer doubling, so
the number of rounds is the logarithm of the number of blocks in the longest
conversation.

No conversation, turn or node is gathered in a task, however frequent: counts
are combined before they are dealt.  The digest of the ids that end at a node
is a chain by definition; its ids are sorted by ranges, written out in long
pieces by many tasks, and the task of the node only streams these pieces.

Defined results: null roles and texts are empty ones; turns are in the order of
``turn`` (null first), role, text; rows that repeat are turns of their own;
rows without a conversation id belong to no conversation and are left out; an
empty table has no nodes; texts and conversations of any length are taken
whole; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.operators.ranking import running
from siteloom.operators.staging import written

#: Turns of a block, and ids in one piece of a node's list.
BLOCK, PIECE = 4, 50_000
ROOT = b"root"
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` from 1, digest (``said``) and code points (``size``) of each turn."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("said"),
        F.length(text).cast("long").alias("size"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    return running(rows, ["conv_id"], order, drop=["turn", "role", "text"], rank="place")


def whole(turns: DataFrame) -> DataFrame:
    """Conversations as they are, in the form that ``nodes`` takes: a row of place 0
    for each conversation, and its turns."""
    own = written(numbered(turns))
    return own.union(_tops(own.groupBy("conv_id").count()))


def _tops(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", F.lit(None).cast("binary").alias("said"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("place"))


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """As ``whole``, after each conversation's first turns have been replaced by
    those of the conversation that its id, rounded down to ``every``, names.

    The number of these turns is the id's CRC-32 modulo ``most``.  A named
    conversation serves fewer than ``2 * every`` others.
    """
    own = written(numbered(turns))
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumns(
        {
            "h": F.crc32(F.col("conv_id").cast("string")) % most,
            "source": F.col("conv_id") - F.col("conv_id") % every,
        }
    )
    named = F.col("conv_id") % every == 0
    lengths = convs.where(named).select(F.col("conv_id").alias("source"), F.col("n").alias("there"))
    convs = written(convs.join(lengths, "source", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))))
    heads = own.where(named & (F.col("place") < most)).withColumnRenamed("conv_id", "source")
    first = convs.join(heads, "source").where(F.col("place") <= F.col("h")).select("conv_id", "said", "size", "place")
    rest = own.join(convs.select("conv_id", "h", "taken"), "conv_id").where(F.col("place") > F.col("h"))
    rest = rest.select("conv_id", "said", "size", (F.col("place") - F.col("h") + F.col("taken")).alias("place"))
    return first.union(rest).union(_tops(convs))


def _id(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _number(n: Column) -> Column:
    return n.cast("string").cast("binary")


def blocks(turns: DataFrame, block: int) -> DataFrame:
    """Blocks of each conversation: number ``k``, its ``turns`` (at most ``block``), and
    the ids of the nodes before it (``above``) and of its full end (``end``)."""
    cut = (
        turns.where("place > 0")
        .groupBy("conv_id", F.floor((F.col("place") - 1) / block).alias("k"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "said", "size"))).alias("turns"))
        .withColumn("x", F.xxhash64("k", "turns"))
        .withColumn("y", F.xxhash64(F.lit(1), "k", "turns"))
    )
    named = running(cut, ["conv_id"], [F.col("k").asc()], xors={"to_x": "x", "to_y": "y"}, rank="nth")
    upto = lambda k, x, y: _id(*(F.concat(_number(c), F.lit(b" ")) for c in (k, x, y)))
    k, x, y = F.col("k"), F.col("to_x"), F.col("to_y")
    above = F.when(k == 0, F.lit(ROOT)).otherwise(upto(k - 1, x.bitwiseXOR(F.col("x")), y.bitwiseXOR(F.col("y"))))
    return named.select("conv_id", "k", "turns", "x", "y", above.alias("above"), upto(k, x, y).alias("end"))


def _path(block: int) -> Column:
    """Ids of the nodes at the turns of a block; that of a full block's end is ``end``."""
    said = lambda j: F.expr(f"array_join(transform(slice(turns, 1, {j}), t -> hex(t.said)), ' ')").cast("binary")
    ids = [F.when(F.size("turns") >= j, _id("above", F.lit(b" "), said(j)) if j < block else F.col("end")) for j in range(1, block + 1)]
    return F.array_compact(F.array(*ids))


def _turn_rows(families: DataFrame) -> DataFrame:
    """One row for each turn of a block, with the ids of the block's nodes up to it."""
    return families.select("above", "n_convs", "conv_id", "path", "turns", F.posexplode("path").alias("j", "id")).select(
        "id",
        "above",
        F.slice("path", 1, F.col("j") + 1).alias("line"),
        F.when(F.col("j") == 0, F.col("above")).otherwise(F.expr("path[j - 1]")).alias("parent"),
        F.expr("turns[j].place").alias("depth"),
        F.expr("turns[j].size").alias("size"),
        "n_convs",
        "conv_id",
    )


def turn_nodes(cut: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(blocks that differ, nodes below the root), by blocks first and turns where siblings diverge."""
    families = written(
        cut.groupBy("k", "above", "end", "x", "y")
        .agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns"))
        .withColumn("path", _path(block))
    )
    followed = families.where("k > 0").groupBy("above").agg((F.count(F.lit(1)) > 1).alias("diverge"))
    below = families.where("k > 0").join(followed, "above")
    alone = _turn_rows(below.where(~F.col("diverge")))
    siblings = families.where("k = 0").unionByName(below.where("diverge").drop("diverge"))
    # a node's line, parent and depth are the same in all rows that name it
    same = [F.first(c).alias(c) for c in ("above", "line", "parent", "depth", "size")]
    refined = _turn_rows(siblings).groupBy("id").agg(*same, F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    return families, written(refined.unionByName(alone))


def _below(families: DataFrame, shares: DataFrame) -> DataFrame:
    """``id`` of each full block that others follow, and the root: sums of all nodes below it."""
    up = families.select(F.col("end").alias("id"), F.col("above").alias("up"))
    acc = shares.groupBy(F.col("above").alias("id")).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    acc = acc.join(up, "id", "left")
    levels = families.agg(F.max("k")).first()[0] or 0
    for _ in range(int(levels).bit_length()):
        acc = written(acc)
        gained = acc.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
        higher = acc.select(F.col("id").alias("up"), F.col("up").alias("next"))
        acc = (
            acc.join(gained, "id", "left")
            .join(higher, "up", "left")
            .select(
                "id",
                (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
                F.col("next").alias("up"),
            )
        )
    return acc.select("id", F.col("leaves").alias("below_leaves"), F.col("saved").alias("below_saved"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (node, id) as rows (node, first id, ids joined by commas)."""
    node, ids = None, []
    for batch in batches:
        out = []
        for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (own != node or len(ids) >= PIECE):
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = own
            ids.append(conv)
        yield _named(out, [("id", pa.binary()), ("first", pa.int64()), ("said", pa.string())])
    if ids:
        yield _named([(node, ids[0], ",".join(map(str, ids)))], [("id", pa.binary()), ("first", pa.int64()), ("said", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (node, first id, ids joined) as one row (node, digest)."""
    node, digest = None, None
    for batch in batches:
        out = []
        for own, said in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if own == node:
                digest.update(b"," + said.encode())
                continue
            if digest:
                out.append((node, digest.hexdigest()))
            node, digest = own, hashlib.sha256(said.encode())
        yield _named(out, [("id", pa.binary()), ("ends_sha256", pa.string())])
    if digest:
        yield _named([(node, digest.hexdigest())], [("id", pa.binary()), ("ends_sha256", pa.string())])


def _named(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's sorted, comma-joined ids: rows (``id``, ``conv_id``) to (``id``, ``ends_sha256``)."""
    pieces = ends.select("id", "conv_id").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    pieces = pieces.mapInArrow(_pieces, "id binary, first long, said string")
    return pieces.repartition("id").sortWithinPartitions("id", "first").mapInArrow(_digests, "id binary, ends_sha256 string")


def nodes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of conversations (see ``whole``): its least member
    ``conv_id``, ``depth``, ``parent_conv_id``, members, children, leaves below,
    ``saved_tokens`` (code points that members share, over the subtree) and the
    digest of the conversations that end there."""
    turns = written(turns)
    cut = written(blocks(turns, block))
    families, below = turn_nodes(cut, block)

    convs = turns.where("place = 0")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    children = below.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    shares = written(
        below.join(children, "id", "left").select(
            "*",
            F.col("n_children").isNull().cast("long").alias("leaf"),
            ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
        )
    )
    lower = written(_below(families, shares))
    # a node's own share and what full blocks have below them go to the nodes above within the block
    passed = shares.join(lower, "id", "left").select(
        F.explode("line").alias("id"),
        (F.col("leaf") + F.coalesce("below_leaves", F.lit(0))).alias("leaf"),
        (F.col("saved") + F.coalesce("below_saved", F.lit(0))).alias("saved"),
    )
    sums = passed.groupBy("id").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    last = cut.groupBy("conv_id").agg(F.max_by(F.struct("turns", "above", "end"), "k").alias("b")).select("conv_id", "b.*")
    ended = last.select("conv_id", F.element_at(_path(block), -1).alias("id"))
    without = convs.join(last, "conv_id", "left_anti").select("conv_id", F.lit(ROOT).alias("id"))
    ends = end_digests(ended.union(without))

    parents = below.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    inner = shares.drop("saved").join(sums, "id").join(parents, "parent", "left").crossJoin(root.select(F.col("conv_id").alias("top")))
    inner = inner.select(
        "id", "conv_id", "depth", F.coalesce("parent_conv_id", "top").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens"
    )
    topmost = root.select(F.lit(ROOT).alias("id"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs")
    topmost = topmost.join(children, "id", "left").join(lower, "id", "left").select(
        *topmost.columns,
        "n_children",
        F.coalesce("below_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("below_saved", F.lit(0)).alias("saved_tokens"),
    )
    return inner.union(topmost).join(ends, "id", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
