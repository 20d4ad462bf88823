"""The prefix trie against a version that holds all prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from siteloom.llm import queries, trie

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def conversations(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    found = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        found.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return found


def rebuilt(rows):
    own = conversations(rows)
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    rounded = {c: c - (c % 100 if c >= 0 else -(-c % 100)) for c in own}
    return {c: own.get(rounded[c], [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


def directly(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(o[: len(k)] == k and len(o) > len(k) for o in below)]
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(key))
        yield (
            min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(children), len(leaves),
            sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(ends.encode()).hexdigest(),
        )


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def made_rows(seed, n=120, deep=9, words=3):
    """Few different turns, so that conversations share and branch at any depth; odd rows among them."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-250, 1200), n):
        for t in range(rng.randint(1, deep)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["", "é🙂", "a" * 40, None][:words])))
    rows += [rng.choice(rows) for _ in range(30)]  # repeated rows
    rows += [(None, 1, "user", "nobody's"), (7000, 3, None, "x" * 100_000), (7001, 0, "user", None)]
    return rows


@pytest.mark.parametrize("block", [1, 2, 4])
def test_trie_directly(spark, block):
    rows = made_rows(block)
    turns = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS place", "'x' AS said", "2 AS k", "'y' AS above", "0 AS n")
    assert ordered(trie.nodes(trie.rebuilt(turns.repartition(3)), block).collect()) == ordered(directly(rebuilt(rows)))


def test_trie_of_whole_conversations(spark):
    rows = made_rows(11, n=60, deep=40, words=1)  # long chains, ten blocks deep
    rows = [(c, t, "user", x) for c, t, _, x in rows]
    turns = spark.createDataFrame(rows, TURNS)
    assert ordered(trie.nodes(trie.whole(turns)).collect()) == ordered(directly(conversations(rows)))


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert ordered(queries.op11_prefix_trie(spark, SF).collect()) == ordered(directly(rebuilt(rows)))


def test_copies_and_long_lists(spark, monkeypatch):
    """Ids that end at one node come in several pieces, from several tasks."""
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(c, t, "user", "again") for c in range(1, 400) for t in range(3)]
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    assert ordered(trie.nodes(trie.whole(turns), 2).collect()) == ordered(directly(conversations(rows)))


def test_no_turns(spark):
    nothing = spark.createDataFrame([], TURNS)
    assert trie.nodes(trie.rebuilt(nothing)).count() == 0
    turnless = spark.createDataFrame([(101, 0, "user", "only turn")], TURNS)
    h = zlib.crc32(b"101") % 6
    expected = [(101, 0, None, 1, 0 if h else 1, 1, 0)]
    found = trie.nodes(trie.rebuilt(turnless)).where("depth = 0").drop("ends_sha256").collect()
    assert list(map(tuple, found)) == expected


def test_turns_are_grouped_only_where_siblings_diverge(spark):
    rows = [(c, t, "user", f"turn {t}" if c or t < 9 else "other") for c in range(3) for t in range(12)]
    cut = trie.blocks(trie.whole(spark.createDataFrame(rows, TURNS)), 4)
    families, below = trie.turn_nodes(cut, 4)
    assert families.count() == 4  # two common blocks, and two that differ
    assert below.count() == 12 + 3
    assert below.where(F.col("depth") <= 9).select("n_convs").distinct().collect()[0][0] == 3
