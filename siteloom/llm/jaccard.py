"""Near duplicates: an exact join of word n-gram sets by Jaccard similarity.

Two sets that are similar enough share one of the rarest n-grams of each (the
prefix filter), so sets meet by n-gram.  Over the sets that meet, a signature
tree is built: its nodes hold the OR and the AND of their sets' bitmaps, the
least number of bits, the range of sizes, and the most n-grams that a set has
left from the meeting n-gram on.  A dual traversal leaves out pairs of nodes
whose greatest possible overlap is too small, or that hang together already.
What is left hangs together in clusters; within each, the same trees over whole
sets give the links, and every link is checked set by set.

Groups of copies cost no pairs: equal sets are one node, named by a 64-bit
digest (two of a thousand million different sets share one with probability
0.03), sets that a task meets together are linked there at once, and no pair of
nodes under one root is compared.  A cluster of more than ``BLOCK`` sets or
``BLOCK_GRAMS`` n-grams is cut into blocks by size and by rank in the order of
the least n-gram, so a block's bounds hold whatever its sets share.  Blocks are joined
inside, then by a few members of neighbouring blocks; then the sets outside of
the cluster's main root are compared with those other blocks whose bitmaps and
sizes leave room for a link.

Defined results: a null or empty text, or one without words, has an empty set
and links with nothing; a text of fewer words than the n-gram is one n-gram;
texts of any length are read whole; rows that repeat are copies; a row with a
null id takes part, but names no component (the component of nulls only is
null); an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.operators.ranking import running
from siteloom.operators.staging import written

from .common import lower_ascii, prepare

BITMAP_WORDS = 16  # 1024 bits
FEW, BLOCK, BLOCK_GRAMS, SAMPLES = 8, 4000, 4_000_000, 8
#: Pairs of nodes that are judged at a time, and most bits of a wide bitmap.
PAIRS_AT_ONCE, WIDEST = 4096, 1 << 16
#: A task links what it meets among so many texts, or n-grams, at a time.
LOCAL_TEXTS, LOCAL_GRAMS = 8000, 6_000_000
#: Sets of more n-grams are told apart by how many of these they share, unless
#: so many sets share one that they hang together anyway.
LONG, CROWD = 1200, 200
#: A task reduces its links to a forest of so many nodes at a time.
FOREST = 1_000_000
LEVELS = 1 << 20  # counters of n-grams that many texts hold

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_RADIX = 0x100000001B3  # odd, so powers have inverses modulo 2^64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Shingler:
    """Hashed n-gram sets of texts, by arithmetic on their bytes.

    A word's hash is the difference of two prefix sums of byte times power,
    brought back to power 0; an n-gram's mixes those of its words.
    """

    def __init__(self, n: int):
        self.n = n
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _reach(self, size: int) -> None:
        if len(self.powers) < size:
            size = 1 << size.bit_length()
            steps = np.full(size, _RADIX, np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
            steps[1:] = pow(_RADIX, -1, 1 << 64)
            self.inverses = np.multiply.accumulate(steps)

    def words(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        self._reach(len(data) + 1)
        data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
        blank = np.ones(len(data) + 2, bool)
        blank[1:-1] = _BLANK[data]
        ends = np.flatnonzero(blank[1:] != blank[:-1])
        first, last = ends[::2], ends[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        return _mix((sums[last] - sums[first]) * self.inverses[first])

    def __call__(self, text: str | None) -> np.ndarray:
        """The set as sorted 64-bit hashes."""
        h = self.words(text) if text else np.zeros(0, np.uint64)
        if not len(h):
            return h
        n = min(self.n, len(h))
        rows = len(h) - n + 1
        made = np.full(rows, n, np.uint64)
        for k in range(n):
            made = _mix(made + h[k : k + rows] * np.uint64(0x9E3779B97F4A7C15 + 2 * k))
        return np.unique(made)


def overlap_needed(a: int, b: int, percent: int) -> int:
    """Least size of the intersection at which sets of ``a`` and ``b`` link."""
    return -(-percent * (a + b) // (100 + percent))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


class Union:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def bitmap(hashes: np.ndarray, width: int = BITMAP_WORDS * 64) -> np.ndarray:
    bits = np.zeros(width, bool)
    bits[(hashes >> np.uint64(7)).astype(np.int64) % width] = True
    return np.packbits(bits).view(np.uint64)


class SignatureTree:
    """Sets in a given order as leaves, two nodes to a parent.

    ``levels[0]`` are the sets, the last level is the root.  Each has arrays over
    its nodes: least and most size, most n-grams left (``reach``), OR and AND of
    the bitmaps, least bits of a set, and the group if all sets are of one (-1).
    """

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, groups: np.ndarray, reach: np.ndarray | None = None, height: int = 0):
        least = np.bitwise_count(bitmaps).sum(1, dtype=np.int64)
        level = (sizes, sizes, sizes if reach is None else reach, bitmaps, bitmaps, least, groups)
        self.levels = [level]
        while len(level[0]) > 1 or len(self.levels) < height:
            at = np.arange(0, len(level[0]), 2)
            last = np.minimum(at + 1, len(level[0]) - 1)
            level = (
                np.minimum(level[0][at], level[0][last]),
                np.maximum(level[1][at], level[1][last]),
                np.maximum(level[2][at], level[2][last]),
                level[3][at] | level[3][last],
                level[4][at] & level[4][last],
                np.minimum(level[5][at], level[5][last]),
                np.where(level[6][at] == level[6][last], level[6][at], -1),
            )
            self.levels.append(level)


def may_link(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether any set below node ``i`` of level ``x`` may link with any below node
    ``j`` of level ``y`` and is of another group.

    A set misses at least as many of its elements in the other as it has bits
    that the other lacks.  For all sets below a node, those are at least the bits
    that all have and none of the others has, and at least the bits of the
    poorest set less those that any have in common.  With ``m`` elements missing,
    sets of ``a`` and ``b`` elements link only if (100 + p) (a - m) >= p (a + b).
    """
    low_x, high_x, reach_x, or_x, and_x, least_x, group_x = (c[i] for c in x)
    low_y, high_y, reach_y, or_y, and_y, least_y, group_y = (c[j] for c in y)
    common = np.bitwise_count(or_x & or_y).sum(1, dtype=np.int64)
    miss_x = np.maximum(np.bitwise_count(and_x & ~or_y).sum(1, dtype=np.int64), least_x - common)
    miss_y = np.maximum(np.bitwise_count(and_y & ~or_x).sum(1, dtype=np.int64), least_y - common)
    both = 100 + percent
    return (
        (100 * high_x >= both * np.maximum(miss_x, 0) + percent * low_y)
        & (100 * high_y >= both * np.maximum(miss_y, 0) + percent * low_x)
        & (both * np.minimum(reach_x, reach_y) >= percent * (low_x + low_y))
        & ((group_x < 0) | (group_x != group_y))
    )


def tree_pairs(a: SignatureTree, b: SignatureTree, percent: int, tally: Counter | None = None) -> Iterator[tuple[int, int]]:
    """Places in ``a`` and ``b`` (of equal height) of sets that may link and are in
    different groups.  ``tally`` counts pairs of nodes: judged and pruned."""
    same = a is b
    one = np.zeros(1, np.int64)
    stack = [(len(a.levels) - 1, one, one)]
    while stack:
        level, i, j = stack.pop()
        if len(i) > PAIRS_AT_ONCE:
            stack += [(level, i[k : k + PAIRS_AT_ONCE], j[k : k + PAIRS_AT_ONCE]) for k in range(0, len(i), PAIRS_AT_ONCE)]
            continue
        fits = may_link(a.levels[level], i, b.levels[level], j, percent)
        if tally is not None:
            tally["judged"] += len(i)
            tally["pruned"] += int(len(i) - fits.sum())
        i, j = i[fits], j[fits]
        if not len(i):
            continue
        if level == 0:
            yield from zip(i.tolist(), j.tolist(), strict=True)
            continue
        left = np.concatenate([2 * i, 2 * i, 2 * i + 1, 2 * i + 1])
        right = np.concatenate([2 * j, 2 * j + 1, 2 * j, 2 * j + 1])
        inside = (left < len(a.levels[level - 1][0])) & (right < len(b.levels[level - 1][0]))
        if same:  # each pair once, and no set with itself
            inside &= left < right if level == 1 else left <= right
        stack.append((level - 1, left[inside], right[inside]))


def _batch(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def common_levels(docs: DataFrame, n: int, text: str, least: int = 64) -> np.ndarray:
    """For each of ``LEVELS`` hashes of n-grams, the logarithm of how many texts
    hold it, 0 below ``least``.  Texts are counted where a task meets an n-gram
    more than twice; the order that this gives is a matter of speed only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, size = Shingler(n), [], 0

        def flush() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            values, times = values[times > 2], times[times > 2]
            slots = (values % np.uint64(LEVELS)).astype(np.int32)
            return _batch([slots, times.astype(np.int64)], [pa.int32(), pa.int64()], ["slot", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(shingles(t))
                size += len(held[-1])
                if size > LOCAL_GRAMS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counted = docs.select(docs[text].cast("string")).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # at most LEVELS rows of a few bytes
    found = counted.where(F.col("n") >= least).select("slot", F.log2("n").cast("int").alias("level")).toArrow()
    levels = np.zeros(LEVELS, np.int8)
    levels[found.column("slot").to_numpy()] = found.column("level").to_numpy()
    return levels


def prefix_size(size: int, percent: int) -> int:
    """How many of the rarest n-grams of a set are looked at: of two linked sets
    at least one of these is common to both; for ``LONG`` sets, whose bitmaps
    are too full to tell, half as many more, and then several are."""
    spare = size - -(-percent * size // 100)
    return min(size, spare + 1 + (spare // 2 if size > LONG else 0))


def common_needed(a: int, b: int, percent: int) -> int:
    """How many of the n-grams looked at are common to linked sets of these sizes.

    An n-gram common to both stands at most as many places further on in one set
    as this has others that the first lacks.
    """
    both = overlap_needed(a, b, percent)
    p, q, miss_a, miss_b = prefix_size(a, percent), prefix_size(b, percent), a - both, b - both
    return max(1, min(p - miss_a, q - miss_a - miss_b), min(q - miss_b, p - miss_a - miss_b))


def prefix_of(hashes: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    size = prefix_size(len(hashes), percent)
    order = np.lexsort((hashes, levels[(hashes % np.uint64(LEVELS)).astype(np.int64)]))
    return hashes[order[:size]]


PLACED = "doc_id long, mark long, size int, key long, local long, grams array<long>, bits binary"
PLACED_NAMES = ["doc_id", "mark", "size", "key", "local", "grams", "bits"]
PLACED_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]


def key_of(hashes: np.ndarray) -> int:
    """Digest of a set, negative for none so that it differs from that of a text."""
    return int(_mix(hashes + _A).sum(dtype=np.uint64) & np.uint64(0x7FFFFFFFFFFFFFFF)) if len(hashes) else -1


def place(batches: Iterator[pa.RecordBatch], n: int, percent: int, levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every text (doc_id, mark, text) with the key of its set; the first of each set
    also with its rarest n-grams and bitmap.  Sets of one task that follow each other at an
    n-gram are compared, and ``local`` is the root that their links lead to."""
    shingles = Shingler(n)
    rows: list[list] = []
    sets: dict[int, np.ndarray] = {}
    last: dict[int, int] = {}
    union, total = Union(), 0

    def flush() -> pa.RecordBatch:
        for row in rows:
            row[4] = union.find(row[3])
        made = _batch(list(zip(*rows, strict=True)) or [()] * 7, PLACED_KINDS, PLACED_NAMES)
        rows.clear(), sets.clear(), last.clear(), union.parent.clear()
        return made

    for batch in batches:
        for doc_id, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = shingles(text)
            key = key_of(own)
            if key < 0 or key in sets:
                rows.append([doc_id, mark, len(own), key, key, None, None])
                continue
            rare = prefix_of(own, levels, percent).view(np.int64).tolist()
            for other in {last[g] for g in rare if g in last}:
                if union.find(other) != union.find(key) and linked(own, sets[other], percent):
                    union.join(other, key)
            last.update(dict.fromkeys(rare, key))
            sets[key] = own
            rows.append([doc_id, mark, len(own), key, key, rare, bitmap(own).tobytes()])
            total += len(own)
            if len(rows) >= LOCAL_TEXTS or total >= LOCAL_GRAMS:
                yield flush()
                total = 0
    yield flush()


def _runs(batches: Iterator[pa.RecordBatch], width: int, at: int, most: int) -> Iterator[list[tuple]]:
    """Rows that agree in the first ``width`` columns, in lists of at most ``most``.
    Of rows that follow each other with the same key in column ``at`` the first is kept."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:width] != held[-1][:width]:
                yield held
                held = []
            elif held and row[at] == held[-1][at]:
                continue
            elif len(held) >= most:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


EDGES, EDGE_KINDS, EDGE_NAMES = "a long, b long", [pa.int64(), pa.int64()], ["a", "b"]


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(list(zip(*rows, strict=True)) or [(), ()], EDGE_KINDS, EDGE_NAMES)


NEAR, NEAR_KINDS, NEAR_NAMES = "a long, b long, need int", [pa.int64(), pa.int64(), pa.int32()], ["a", "b", "need"]


def near_pairs(sizes: list[int], reach: list[int], bits: list[bytes], groups: list[int], percent: int) -> Iterator[tuple[int, int]]:
    """Places of sets in different groups that may link; a few make no tree."""
    if len(sizes) > FEW:
        # sets of about one size that begin with the same bits are neighbours
        order = sorted(range(len(sizes)), key=lambda i: (size_class(sizes[i], percent), bits[i]))
        rows = np.frombuffer(b"".join([bits[i] for i in order]), np.uint64).reshape(len(bits), BITMAP_WORDS)
        of = lambda values: np.array([values[i] for i in order], np.int64)
        tree = SignatureTree(of(sizes), rows, of(groups), of(reach))
        for p, q in tree_pairs(tree, tree, percent):
            yield order[p], order[q]
        return
    whole = [int.from_bytes(b, "little") for b in bits]
    for j in range(1, len(sizes)):
        for i in range(j):
            if groups[i] != groups[j] and (100 + percent) * min(reach[i], reach[j]) >= percent * (sizes[i] + sizes[j]):
                common = whole[i] & whole[j]
                most = min(sizes[i] - (whole[i] ^ common).bit_count(), sizes[j] - (whole[j] ^ common).bit_count())
                if (100 + percent) * most >= percent * (sizes[i] + sizes[j]):
                    yield i, j


def size_class(size: int, percent: int) -> int:
    """Sets that link are of one class or of two that follow each other, but for rounding."""
    return int(math.log(max(size, 1)) / math.log(100.0 / min(percent, 99)))


def meet(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (gram, chunk, local, key, size, reach, bits) by gram, chunk, size and key: pairs that
    may link by their sizes, bitmaps and ``reach``, the n-grams that a set has left from
    this one on, which is the most that two sets share whose first n-gram in common
    this is.  ``need`` is 1 where they hang together at once (these pairs are a
    forest of the chunk), else how many n-grams they must meet at.  A chunk has
    at most ``BLOCK`` rows.
    """
    out: list[tuple] = []
    for run in _runs(batches, 2, 3, 1 << 60):
        keys, sizes = [r[3] for r in run], [r[4] for r in run]
        if len(run) > 1:
            union = Union()
            for r in run:
                union.join(r[2], r[3])
            reach = [_reach(r[4], r[5]) for r in run]
            for i, j in near_pairs(sizes, reach, [r[6] for r in run], [union.find(k) for k in keys], percent):
                need = common_needed(sizes[i], sizes[j], percent) if min(sizes[i], sizes[j]) > LONG else 1
                if need > 1 and len(run) <= CROWD:
                    out.append((min(keys[i], keys[j]), max(keys[i], keys[j]), need))
                elif union.join(keys[i], keys[j]):
                    out.append((keys[i], keys[j], 1))
        if len(out) > 10_000:
            yield _batch(list(zip(*out, strict=True)), NEAR_KINDS, NEAR_NAMES)
            out = []
    yield _batch(list(zip(*out, strict=True)) or [(), (), ()], NEAR_KINDS, NEAR_NAMES)


def _reach(size: int, left: int) -> int:
    """Sets that are told apart by the number of meetings must meet at all of them."""
    return size if size > LONG else left


CHUNKS = "gram long, low int, high int, reach int, first long"


def chunk_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, chunk, key, size, reach) by gram and chunk: one row for each chunk."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    out = [
        (run[0][0], min(r[3] for r in run), max(r[3] for r in run), max(_reach(r[3], r[4]) for r in run), min(r[2] for r in run))
        for run in _runs(batches, 2, 2, 1 << 60)
    ]
    yield _batch(list(zip(*out, strict=True)) or [()] * 5, kinds, names)


def join_chunks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``CHUNKS`` by gram and least size: chunks hang together that leave room for a link.

    Chunks that do are one from then on, with the widest of their bounds, so each
    gives one row at most; those too small for all that follow are dropped.
    """
    gram, open_, out = None, [], []
    for batch in batches:
        for own_gram, low, high, left, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own_gram != gram:
                gram, open_ = own_gram, []
            apart = []
            joined = (low, high, left, first)
            for other in open_:
                if 100 * other[1] < percent * low:
                    continue
                if (100 + percent) * min(other[2], left) >= percent * (other[0] + low):
                    out.append((other[3], first, 1))
                    joined = (min(joined[0], other[0]), max(joined[1], other[1]), max(joined[2], other[2]), first)
                else:
                    apart.append(other)
            open_ = [*apart, joined]
        if len(out) > 10_000:
            yield _batch(list(zip(*out, strict=True)), NEAR_KINDS, NEAR_NAMES)
            out = []
    yield _batch(list(zip(*out, strict=True)) or [(), (), ()], NEAR_KINDS, NEAR_NAMES)


def _frequent(meetings: DataFrame, percent: int) -> DataFrame:
    """Meetings at an n-gram of more than ``BLOCK`` sets, cut by rank into chunks of ``BLOCK``:
    pairs inside the chunks, a star for each chunk, and chunks that leave room.

    The sets of such an n-gram hang together, as too many to tell; a link may only
    be between sets that do, and what hangs together is compared in blocks.
    """
    by = [F.col(c).asc() for c in ("size", "key")]
    cut = running(meetings.distinct(), ["gram"], by).withColumn("chunk", F.floor((F.col("rank") - 1) / BLOCK).cast("long"))
    cut = written(cut)
    inside = _dealt(cut.select("gram", "chunk", "local", "key", "size", "reach", "bits"), "gram", "chunk", then=("size", "key"))
    heads = _dealt(cut.select("gram", "chunk", "key", "size", "reach"), "gram", "chunk", then=("key",)).mapInArrow(chunk_heads, CHUNKS)
    joined = _dealt(heads, "gram", then=("low", "first")).mapInArrow(lambda b: join_chunks(b, percent), NEAR)
    least = cut.groupBy("gram", "chunk").agg(F.min("key").alias("a"))
    star = cut.join(least, ["gram", "chunk"]).where("a <> key").select("a", F.col("key").alias("b"), F.lit(1).alias("need"))
    return inside.mapInArrow(lambda b: meet(b, percent), NEAR).union(joined).union(star)


def join_sets(keys: list[int], roots: list[int], sets: list[np.ndarray], sides: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links between sets under different roots that join these (a forest).  Of
    two sets of a pair, one at least has a true side."""
    order = sorted(range(len(keys)), key=lambda i: (size_class(len(sets[i]), percent), int(sets[i][0]), keys[i]))
    union = Union()
    for i in order:
        union.join(roots[i], keys[i])
    groups = np.array([union.find(keys[i]) for i in order], np.int64)
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    width = min(max(1 << (2 * int(sizes.max()) - 1).bit_length(), BITMAP_WORDS * 64), WIDEST)
    bits = np.array([bitmap(sets[i], width) for i in order])
    some = np.array([p for p, i in enumerate(order) if sides[i]], np.int64)
    if not len(some):
        return []
    whole = SignatureTree(sizes, bits, groups)
    if len(some) == len(order):
        pairs = tree_pairs(whole, whole, percent)
    else:
        part = SignatureTree(sizes[some], bits[some], groups[some], height=len(whole.levels))
        pairs = tree_pairs(part, whole, percent)
    found = []
    for p, q in pairs:
        i, j = order[int(some[p])], order[q]
        if union.find(keys[i]) != union.find(keys[j]) and linked(sets[i], sets[j], percent):
            union.join(keys[i], keys[j])
            found.append((keys[i], keys[j]))
    return found


def compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, block, side, key, root, hashes) by cluster, block and key: links.
    Blocks are bounded when they are dealt, by sets and by n-grams."""
    for run in _runs(batches, 2, 3, 1 << 60):
        sets = [np.frombuffer(r[5], np.uint64) for r in run]
        yield _edges(join_sets([r[3] for r in run], [r[4] for r in run], sets, [r[2] for r in run], percent))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the least node that links lead to; alternating stars.

    Every round points nodes at smaller ones, and rows are first reduced in each
    task to a forest, so a round moves at most two rows for each node and task.
    """

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union = Union()
        nodes: set[int] = set()

        def rows() -> pa.RecordBatch:
            found = [(n, r) for n in nodes if (r := union.find(n)) != n]
            return _batch(list(zip(*found, strict=True)) or [(), ()], [pa.int64(), pa.int64()], ["node", "root"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nodes.update((a, b))
                union.join(a, b)
            if len(nodes) >= FOREST:  # what hangs together beyond that meets in a later round
                yield rows()
                union, nodes = Union(), set()
        yield rows()

    edges = edges.select(F.col(edges.columns[0]).alias("node"), F.col(edges.columns[1]).alias("root"))
    links = edges.mapInArrow(forest, "node long, root long").checkpoint()
    while True:
        both = links.unionByName(links.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("least")).select("node", F.least("node", "least").alias("least"))
        # every neighbour, and the node, points at the least of the neighbourhood
        stars = both.join(least, "node").select(F.col("root").alias("a"), "least").union(least.select("node", "least"))
        nexts = stars.where("a <> least").distinct().select(F.col("a").alias("node"), F.col("least").alias("root"))
        nexts = nexts.mapInArrow(forest, "node long, root long").distinct().checkpoint()
        # done when every node has one root and no root has a root
        many = nexts.groupBy("node").count().where("count > 1").limit(1)
        deep = nexts.select("root").distinct().join(nexts.select(F.col("node").alias("root")), "root", "left_semi").limit(1)
        links = nexts
        if many.union(deep.select("root", F.lit(1))).isEmpty():
            return links


def _dealt(df: DataFrame, *by: str, then: tuple[str, ...] = ()) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*by, *then)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row: sets link when
    100 * intersection >= ``percent`` * union."""
    rows, _ = _rooted(docs, n, percent, doc_id, text)
    named = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component"))
    return rows.join(named, "root", "left").select(
        "doc_id",
        F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the least id (null
    after all others), of rows with this id the first by a hash of the text, of rows
    that repeat any.  Rows with an empty set stay."""
    rows, mark = _rooted(docs, n, percent, doc_id, text)
    rows = rows.where("root is not null")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    kept = rows.groupBy("root").agg(F.min_by(F.struct("doc_id", "mark"), order).alias("w")).select("w.*")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])
    texts = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("n"))
    gone = texts.join(kept, same(texts, kept), "left_anti")
    twice = texts.where("n > 1").join(kept, same(texts, kept), "left_semi")
    own = _free_name("mark", docs.columns)
    marked = docs.withColumn(own, mark)
    is_one = lambda df: marked[doc_id].cast("long").eqNullSafe(df["doc_id"]) & (marked[own] == df["mark"])
    # few rows where copies are few; Spark broadcasts them only up to its limit
    left = marked.join(gone, is_one(gone), "left_anti")
    if twice.isEmpty():
        return left.select(docs.columns)
    again = marked.join(twice, is_one(twice), "left_semi").dropDuplicates([doc_id, own])
    return left.join(twice, left[doc_id].cast("long").eqNullSafe(twice["doc_id"]) & (left[own] == twice["mark"]), "left_anti").unionByName(again).select(docs.columns)


def _free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column has it in any case."""
    lower = {c.lower() for c in taken}
    while name in lower:
        name = f"_{name}"
    return name


def _rooted(docs: DataFrame, n: int, percent: int, doc_id: str, text: str) -> tuple[DataFrame, Column]:
    """``doc_id``, ``mark``, ``size``, ``root`` of every row (no root for an empty set),
    and the mark, a hash of a row's text, as a column of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    mark = F.xxhash64(docs[text].cast("string"))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), mark.alias("mark"), docs[text].cast("string").alias("text"))
    levels = spark.sparkContext.broadcast(common_levels(rows, n, "text"))  # LEVELS bytes
    placed = written(rows.mapInArrow(lambda b: place(b, n, percent, levels.value), PLACED))

    # n-grams at which sets meet that aren't linked
    grams = placed.where("grams is not null").select(F.posexplode("grams").alias("pos", "gram"), "local", "key", "size")
    bounds = [F.min("local").alias("low"), F.max("local").alias("high"), F.count("*").alias("n")]
    shared = written(grams.groupBy("gram").agg(*bounds).where("low <> high").select("gram", (F.col("n") > BLOCK).alias("frequent")))
    bits = placed.where("bits is not null").groupBy("key").agg(F.first("bits").alias("bits"))
    meetings = grams.join(shared, "gram").join(bits, "key")
    meetings = meetings.select("gram", "local", "key", "size", (F.col("size") - F.col("pos")).alias("reach"), "bits", "frequent")
    few = meetings.where("not frequent").select("gram", F.lit(0).cast("long").alias("chunk"), "local", "key", "size", "reach", "bits")
    near = _dealt(few, "gram", then=("size", "key")).mapInArrow(lambda b: meet(b, percent), NEAR)
    if not shared.where("frequent").isEmpty():
        near = near.union(_frequent(meetings.where("frequent").drop("frequent"), percent))
    met = near.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("need").alias("need"))
    near = written(met.where("n >= need").select("a", "b"))
    local = placed.where("key <> local").select("key", "local").distinct()

    # clusters of sets that hang together, but not by links alone
    cluster = components(near.union(local))
    of = local.groupBy("key").agg(F.min("local").alias("root"))
    members = (
        near.select(F.explode(F.array("a", "b")).alias("key")).union(local.select("key")).union(local.select("local")).distinct()
        .join(cluster.withColumnsRenamed({"node": "key", "root": "cluster"}), "key", "left")
        .join(of, "key", "left")
        .select("key", F.coalesce("cluster", "key").alias("cluster"), F.coalesce("root", "key").alias("root"))
    )
    open_clusters = near.select(F.col("a").alias("key")).distinct().join(members, "key").select("cluster").distinct()
    wanted = written(members.join(open_clusters, "cluster", "left_semi"))
    sets = _sets(rows, placed, wanted, n)

    # blocks: a small cluster is one; a large one is cut by size class, and that by rank in the order of the least n-gram
    step = F.lit(math.log(100.0 / min(percent, 99)))
    sized = wanted.join(sets.select("key", "size", "least"), "key")
    totals = sized.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    sized = sized.join(totals.select("cluster", ((F.col("n") > BLOCK) | (F.col("s") > BLOCK_GRAMS)).alias("large")), "cluster")
    sized = written(sized.withColumn("class", F.floor(F.log(F.col("size").cast("double")) / step).cast("int")))
    blocked = sized.where("not large").select("key", "cluster", "root", "large", F.lit(0).cast("long").alias("block"))
    if not sized.where("large").isEmpty():
        blocked = blocked.union(_blocks(sized.where("large")).select("key", "cluster", "root", "large", "block"))
    held = blocked.join(sets.select("key", "hashes"), "key").withColumn("side", F.lit(True))
    compared = lambda df: _dealt(df.select("cluster", "block", "side", "key", "root", "hashes"), "cluster", "block", then=("key",)).mapInArrow(
        lambda b: compare(b, percent), EDGES
    )
    links = written(compared(held).union(local))
    if not blocked.where("large").isEmpty():
        links = _across(held.where("large"), links, compared, percent)
    root = components(links).withColumnRenamed("node", "key")
    keyed = placed.select("doc_id", "mark", "size", "key")
    rooted = keyed.join(root, "key", "left")
    return rooted.select("doc_id", "mark", "size", F.when(F.col("key") >= 0, F.coalesce("root", "key")).alias("root")), mark


def _blocks(sized: DataFrame) -> DataFrame:
    """Sets of large clusters with their ``block``: at most ``BLOCK`` sets, and no more n-grams
    than ``BLOCK_GRAMS`` and one set's, whatever the sets share."""
    placed = running(sized, ["cluster", "class"], [F.col("least").asc(), F.col("key").asc()], sums={"grams": "size"})
    part = F.floor((F.col("rank") - 1) / BLOCK) + F.floor(F.col("grams") / BLOCK_GRAMS)
    return placed.withColumn("block", (F.col("class") * F.lit(1 << 32).cast("long") + part).cast("long"))


def _sets(rows: DataFrame, placed: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``key``, ``size``, ``least``, ``hashes`` of the wanted sets, made again from the texts.  Rows
    that surely aren't wanted are passed over by a bitmap of ids of fixed size."""
    spark, slots = rows.sparkSession, 1 << 23
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int")
    ids = placed.where("grams is not null").join(wanted.select("key"), "key", "left_semi").select(slot.alias("slot"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(slots, bool)
        for batch in batches:
            flags[batch.column(0).to_numpy()] = True
        words = np.packbits(flags, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield _batch([at.astype(np.int32), words[at]], [pa.int32(), pa.int64()], ["word", "bits"])

    # at most an eighth of a million words of 64 slots
    words = ids.mapInArrow(pack, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    flags = np.zeros(slots // 64, np.int64)
    flags[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(np.unpackbits(flags.view(np.uint8), bitorder="little").astype(bool))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for batch in batches:
            some = batch.filter(pa.array(shared.value[batch.column(0).to_numpy()]))
            made = {key_of(h): h for h in map(shingles, some.column(1).to_pylist()) if len(h)}
            own = list(made.values())
            columns = [list(made), [len(h) for h in own], [int(h[0] >> np.uint64(1)) for h in own], [h.tobytes() for h in own]]
            yield _batch(columns, [pa.int64(), pa.int64(), pa.int64(), pa.binary()], ["key", "size", "least", "hashes"])

    made = rows.select(slot, "text").mapInArrow(make, "key long, size long, least long, hashes binary")
    first = F.first(F.struct("size", "least", "hashes")).alias("s")
    return written(made.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(first).select("key", "s.*"))


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, block, guest, hashes) by cluster and block: for each block, and
    for its guests, the root of their signature tree as one row."""
    names = ["cluster", "block", "guest", "low", "high", "either", "all", "least"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    nodes: dict[bool, list] = {}
    at = None

    def rows() -> pa.RecordBatch:
        made = [(*at, g, low, high, o.tobytes(), a.tobytes(), least) for g, (low, high, o, a, least) in nodes.items()]
        return _batch(list(zip(*made, strict=True)) or [()] * len(names), kinds, names)

    for batch in batches:
        for cluster, block, guest, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (cluster, block):
                if nodes:
                    yield rows()
                at, nodes = (cluster, block), {}
            hashes = np.frombuffer(data, np.uint64)
            bits, size = bitmap(hashes), len(hashes)
            count = int(np.bitwise_count(bits).sum())
            for kind in (False, True) if guest else (False,):  # a guest is also one of its block
                low, high, either, every, least = nodes.get(kind, (size, size, bits, bits, count))
                nodes[kind] = (min(low, size), max(high, size), either | bits, every & bits, min(least, count))
    if nodes:
        yield rows()


SUMMARY = "cluster long, block long, guest boolean, low long, high long, either binary, all binary, least long"


def roomy(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (cluster, and of two blocks block, low, high, either, all, least), those whose sets may link."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_pylist() for c in batch.columns]
        node = lambda k: (
            np.array(columns[k + 1]), np.array(columns[k + 2]), np.array(columns[k + 2]),
            *(np.frombuffer(b"".join(columns[k + m]), np.uint64).reshape(-1, BITMAP_WORDS) for m in (3, 4)),
            np.array(columns[k + 5]), np.full(batch.num_rows, -1),
        )
        at = np.arange(batch.num_rows)
        fits = may_link(node(1), at, node(7), at, percent)
        kept = batch.filter(pa.array(fits))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(7)], names=["cluster", "guests", "hosts"])


def _across(held: DataFrame, links: DataFrame, compared, percent: int) -> DataFrame:
    """Links between the blocks of large clusters."""

    def rooted(by: DataFrame) -> DataFrame:
        root = components(by).withColumnsRenamed({"node": "key", "root": "now"})
        return held.join(root, "key", "left").withColumn("root", F.coalesce("now", "root")).drop("now")

    # some members of the main root of each block, with those of the block before
    now = rooted(links)
    top = F.max_by("root", F.struct("c", "root")).alias("root")
    main = now.groupBy("cluster", "block", "root").agg(F.count("*").alias("c")).groupBy("cluster", "block").agg(top)
    some = now.join(main, ["cluster", "block", "root"], "left_semi").withColumn("slot", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(SAMPLES)))
    some = some.groupBy("cluster", "block", "slot").agg(F.min_by(F.struct("key", "root", "hashes"), "key").alias("s"))
    before = main.select("cluster", "block", F.lag("block").over(Window.partitionBy("cluster").orderBy("block")).alias("before"))
    ring = some.join(before.where("before is not null"), ["cluster", "block"]).select("cluster", F.col("before").alias("block"), "s")
    links = written(links.union(compared(ring.unionByName(some.select("cluster", "block", "s")).select("cluster", "block", F.lit(True).alias("side"), "s.*"))))

    # sets outside of the main root of the cluster, against the other blocks that have room for links
    now = rooted(links)
    main = now.groupBy("cluster", "root").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    now = written(now.join(main, "cluster").withColumn("guest", F.col("root") != F.col("main")).drop("main", "side", "large"))
    nodes = _dealt(now.select("cluster", "block", "guest", "hashes"), "cluster", "block").mapInArrow(summaries, SUMMARY)
    nodes = written(nodes.withColumn("class", F.shiftright("block", 32)))
    # sets of classes further apart than two are too different in size
    of = lambda kind: nodes.where("guest" if kind == "g" else "not guest").select(
        "cluster", "class", *[F.col(c).alias(f"{kind}_{c}") for c in ("block", "low", "high", "either", "all", "least")]
    )
    guests = of("g").withColumn("class", F.explode(F.sequence(F.col("class") - 2, F.col("class") + 2)))
    pairs = guests.join(of("h"), ["cluster", "class"]).where("g_block <> h_block").drop("class")
    pairs = written(pairs.mapInArrow(lambda b: roomy(b, percent), "cluster long, guests long, hosts long"))
    task = F.xxhash64("guests", "hosts").alias("block")
    sent = now.where("guest").join(pairs.withColumn("block", F.col("guests")), ["cluster", "block"])
    met = now.join(pairs.withColumn("block", F.col("hosts")), ["cluster", "block"])
    both = sent.select("cluster", task, F.lit(True).alias("side"), "key", "root", "hashes").unionByName(
        met.select("cluster", task, F.lit(False).alias("side"), "key", "root", "hashes")
    )
    return written(links.union(compared(both)))
