"""Document fingerprints from improbable features.

Every window of 16 bytes is ranked by how rare its entropy is among ordinary
texts; a window that is the least likely one of enough of the runs of 16
windows that hold it is a feature.  Features are hashed into a chain of Bloom filters, each of which
takes a bounded number of them.  Two fingerprints are compared filter by
filter, by the bits they share beyond what chance would give.

Defined results: a null text is an empty one, whose fingerprint is empty and is
like only another empty one; a text shorter than a window is one feature; a
text of any length is read whole; equal texts have equal fingerprints and
likeness 1; in ``compare_neighbours`` rows follow each other by id, nulls first,
ties by a hash of the text, and the first follows the last; an empty table gives no rows;
other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

WINDOW, POPULARITY, FILTER_BITS, FILTER_HASHES, FILTER_FEATURES = 16, 4, 2048, 5, 160
#: Entropies are in thousandths of the most possible; ``ORDINARY`` is that of the
#: middle window of prose, below ``VOID`` a window says nothing.
RANKS, ORDINARY, VOID = 1000, 790, 250
#: Windows, and filters, that are held at a time.
AT_ONCE, FILTERS_AT_ONCE = 1 << 18, 256

# n log2 n of a count, as whole numbers, so that sums don't depend on their order
_SCALE = 1 << 20
_NLOGN = np.array([0] + [round(n * np.log2(n) * _SCALE) for n in range(1, WINDOW + 2)], np.int64)
_STEP = np.diff(_NLOGN)  # from n to n + 1 of a byte value


def window_entropies(data: np.ndarray) -> np.ndarray:
    """Entropy of each window of bytes, in thousandths of the most possible;
    ``AT_ONCE`` windows at a time, so long texts need no more than their ranks."""
    n = len(data) - WINDOW + 1
    if n <= AT_ONCE:
        return _entropies(data)
    return np.concatenate([_entropies(data[k : k + AT_ONCE + WINDOW - 1]) for k in range(0, n, AT_ONCE)])


def _entropies(data: np.ndarray) -> np.ndarray:
    """As the window moves by one byte, only two counts change, and how often a
    byte occurs just before or after it is read from its sorted places."""
    n = len(data) - WINDOW + 1
    order = np.argsort(data, kind="stable")
    keys = data[order].astype(np.int64) * (len(data) + WINDOW) + order
    at = np.arange(len(data))
    before, after = np.empty(len(data), np.int64), np.empty(len(data), np.int64)
    before[order] = at - np.searchsorted(keys, keys - (WINDOW - 1))
    after[order] = np.searchsorted(keys, keys + (WINDOW - 1), "right") - 1 - at
    first = np.bincount(data[:WINDOW], minlength=256)
    moved = _STEP[before[WINDOW:]] - _STEP[after[: n - 1]]
    # the byte that leaves is counted in the old window; if the one that comes is
    # its equal, the count goes down and up again
    total = int(_NLOGN[first].sum()) + np.concatenate([[0], np.cumsum(moved)])
    entropy = np.log2(WINDOW) - total / (_SCALE * WINDOW)
    return np.clip(np.rint(entropy / np.log2(WINDOW) * RANKS), 0, RANKS).astype(np.int16)


def rarity(entropy: np.ndarray) -> np.ndarray:
    """Precedence of windows: entropies far from those of ordinary prose come
    first (least value); runs of one or two byte values come last."""
    rank = RANKS - np.abs(entropy - ORDINARY)
    return np.where(entropy < VOID, 2 * RANKS, rank).astype(np.int16)


def feature_places(rank: np.ndarray) -> np.ndarray:
    """Windows that are the leftmost least of at least ``POPULARITY`` of the runs
    of ``WINDOW`` windows that hold them (of any run, if there is no full one)."""
    n = len(rank)
    span = min(WINDOW, n)
    runs = n - span + 1
    votes = np.zeros(n, np.int8)
    for start in range(0, runs, AT_ONCE):
        own = rank[start : min(start + AT_ONCE, runs) + span - 1].astype(np.int64)
        key = own * (1 << 40) + np.arange(len(own))
        done, least = 1, key
        while done < span:  # sliding least by doubling
            step = min(done, span - done)
            least = np.minimum(least[: len(least) - step], least[step:])
            done += step
        votes[start : start + len(own)] += np.bincount(least & ((1 << 40) - 1), minlength=len(own)).astype(np.int8)
    return np.flatnonzero((votes >= min(POPULARITY, runs)) & (rank < 2 * RANKS))


def _mixed(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of unsigned 64-bit words."""
    h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def hashed_features(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[places]
    hashes = _mixed(np.ascontiguousarray(windows).view("<u8"))
    _, first = np.unique(hashes, return_index=True)
    return hashes[np.sort(first)]


def bloom_chain(hashes: np.ndarray) -> np.ndarray:
    """Filters (rows of bits): each takes the next ``FILTER_FEATURES`` features."""
    chain = np.zeros((-(-len(hashes) // FILTER_FEATURES), FILTER_BITS), bool)
    row = np.arange(len(hashes)) // FILTER_FEATURES
    for k in range(FILTER_HASHES):
        chain[row, (hashes >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = True
    return chain


class Prepared:
    """A text with the ranks of its windows."""

    __slots__ = ("chain", "data", "name", "rank", "text")

    def __init__(self, text: str, data: np.ndarray | None = None, rank: np.ndarray | None = None):
        self.text = text
        self.data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if data is None else data
        if rank is None:
            rank = rarity(window_entropies(self.data)) if len(self.data) >= WINDOW else np.zeros(0, np.int16)
        self.rank = rank
        if len(self.data) < WINDOW:
            digest = hashlib.sha1(self.data.tobytes()).digest()[:8]
            hashes = np.frombuffer(digest if len(self.data) else b"", "<u8")
        else:
            places = feature_places(self.rank)
            hashes = hashed_features(self.data, places if len(places) else np.array([int(np.argmin(rank))]))
        self.chain = bloom_chain(hashes)
        self.name = base64.b64encode(np.packbits(self.chain, axis=1).tobytes()).decode()


def fingerprint(text: str | None) -> str:
    return Prepared(text or "").name


def joined(own: Prepared, head: int, other: Prepared, size: int) -> Prepared:
    """``head`` code points of ``own``, then ``size`` of ``other``; only windows
    over the joint are ranked anew."""
    left, right = own.text[:head], other.text[:size]
    a, b = len(left.encode("utf-8", "surrogatepass")), len(right.encode("utf-8", "surrogatepass"))
    data = np.concatenate([own.data[:a], other.data[:b]])
    if a < WINDOW or b < WINDOW:
        return Prepared(left + right, data)
    seam = rarity(window_entropies(data[a - WINDOW + 1 : a + WINDOW - 1]))
    rank = np.concatenate([own.rank[: a - WINDOW + 1], seam, other.rank[: b - WINDOW + 1]])
    return Prepared(left + right, data, rank)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the filters of the shorter chain of the best share of bits, less
    what two filters of such fill share by chance, 0 to 1."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b) and (a == b).all():
        return 1.0
    bits_b = b.sum(1, dtype=np.float32)[None, :]
    best = np.zeros(len(a), np.float32)
    for k in range(0, len(a), FILTERS_AT_ONCE):
        x = a[k : k + FILTERS_AT_ONCE].astype(np.float32)
        top = best[k : k + FILTERS_AT_ONCE]
        for m in range(0, len(b), FILTERS_AT_ONCE):
            few = bits_b[:, m : m + FILTERS_AT_ONCE]
            shared, bits_a = x @ b[m : m + FILTERS_AT_ONCE].astype(np.float32).T, x.sum(1)[:, None]
            least = np.minimum(bits_a, few)
            chance = bits_a * few / FILTER_BITS
            floor = chance + 0.1 * (least - chance)  # a little over chance, so that noise counts as nothing
            share = np.clip((shared - floor) / np.maximum(least - floor, 1e-6), 0, 1)
            np.maximum(top, share.max(1), out=top)
    return float(best.mean())


def chain_of(name: str) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(base64.b64decode(name), np.uint8))
    return bits.reshape(-1, FILTER_BITS).astype(bool)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the fingerprint of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(
        run, "doc_id long, fingerprint string"
    )


PAIR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PAIR_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held: tuple | None = None
    for batch in batches:
        out = []
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for piece, guest, doc_id, text in zip(*columns, strict=True):
            if held is not None and held[0] != piece:
                held = None
            if guest and held is None:
                continue
            now = Prepared(text)
            if held is not None:
                _, _, own_id, own = held
                n = len(own.text)
                size = min(n // 2, len(now.text))
                edited = joined(own, n - n // 2, now, size)
                digest = hashlib.sha256(edited.data.tobytes()).hexdigest()
                out.append(
                    (own_id, n, digest, own.name, edited.name, likeness(own.chain, edited.chain), likeness(own.chain, now.chain))
                )
            held = None if guest else (piece, guest, doc_id, now)
        rows = list(zip(*out, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)


def _pieces(rows: DataFrame, pieces: int) -> tuple[DataFrame, int]:
    """``rows`` (doc_id, tie, text) with ``piece``: numbers, below the second result, of
    ranges in the order of (doc_id, tie), nulls first, of about as many rows each.

    Ranges begin at quantiles of the ids; where several fall on one id (a third
    of all rows may have it, or none), its rows are cut by ``tie`` as well.
    Quantiles are doubles and only propose the bounds: these are whole numbers,
    and a row whose id rounds up to a bound is told from it by the id itself.
    """
    spark, lowest = rows.sparkSession, -1.7976931348623157e308
    number = F.coalesce(F.col("doc_id").cast("double"), F.lit(lowest))
    found = rows.select(number.alias("d")).approxQuantile("d", [k / pieces for k in range(1, pieces)], 0.2 / pieces)
    cuts = sorted(set(found) - {lowest})
    heads = [lowest, *cuts]
    table, first = [], 0
    for range_, head in enumerate(heads):
        shares = max(found.count(head) + (head == lowest), 1)
        hot = shares > (2 if head == lowest else 1)
        bound = None if head == lowest else min(int(head), (1 << 63) - 1)
        table.append((range_, bound, shares if hot else 0, first))
        first += shares + 1 if hot else 1
    # a row for each range, so no more than ``pieces``
    ranges = F.broadcast(spark.createDataFrame(table, "range int, head long, shares int, first int"))
    ordered = Bucketizer(splits=[float("-inf"), *cuts, -lowest, float("inf")], inputCol="d", outputCol="b").transform(rows.withColumn("d", number))
    share = F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * F.col("shares"))
    share = F.least(F.greatest(share, F.lit(0)), F.col("shares") - 1)
    is_head = F.col("doc_id").eqNullSafe(F.col("head"))
    own = F.col("first") + F.when(F.col("doc_id") < F.col("head"), -1).when(F.col("shares") == 0, 0).when(is_head, share).otherwise(F.col("shares"))
    ordered = ordered.join(ranges, F.col("b").cast("int") == F.col("range"))
    return ordered.select(own.cast("int").alias("piece"), "doc_id", "tie", "text"), first


def compare_neighbours(docs: DataFrame, pieces: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text beside its edited self (the last half replaced by the start of
    the next text, by id) and beside the next text.

    Ids are cut into about ``pieces`` ranges; each range is read in order by one
    task, and gets the first row of the range after it as a guest.
    """
    spark = docs.sparkSession
    prepare(spark)
    pieces = pieces or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(own).alias("tie"), own.alias("text"))
    dealt, pieces = _pieces(rows, pieces)
    at = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")
    # the first row of each piece is the guest of the piece before; the first of all, of the last
    firsts = dealt.groupBy("piece").agg(F.min(at).alias("f"))
    order = Window.orderBy("piece")  # one narrow row for each piece
    last = firsts.agg(F.max("piece").alias("last"))
    hosts = firsts.withColumn("host", F.lag("piece").over(order)).crossJoin(F.broadcast(last))
    hosts = hosts.select(F.coalesce("host", "last").alias("host"), F.col("f.doc_id").alias("g_id"), F.col("f.tie").alias("g_tie"))
    guests = rows.join(F.broadcast(hosts), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tie") == F.col("g_tie")))
    guests = guests.select(F.col("host").alias("piece"), F.lit(True).alias("guest"), "doc_id", "tie", "text")
    guests = guests.dropDuplicates(["piece", "doc_id", "tie"])  # a first row that repeats
    both = dealt.select("piece", F.lit(False).alias("guest"), "doc_id", "tie", "text").unionByName(guests)
    placed = both.repartitionById(pieces, F.col("piece")).sortWithinPartitions("piece", "guest", "doc_id", "tie")
    return placed.select("piece", "guest", "doc_id", "text").mapInArrow(_neighbours, PAIR_SCHEMA)
