"""Language-model scores of texts by the marginal of a subword lattice.

The pieces of an existing vocabulary and its scores weigh the segmentations.
The probability of a text is the sum over all segmentations of its words and
its end, by a forward recursion in log space; no piece crosses a space, so it
is the product over the words, each summed over its own segmentations.

The vocabulary's scores are ranks (minus the number of the merge), not
logarithms; ``Link`` turns them into probabilities by Zipf's and Mandelbrot's
law, whose two parameters are the likeliest ones for the pieces of all
training rows.  ``SHARE`` of a piece's probability is that of its score, however
large the corpus; the rest is its share of the training pieces (with a share of
1 the scores alone weigh).  A smoothed count of whole words is given beside the
score.

How it runs: a task cuts its rows into blocks of bounded size and makes each
block's dictionary, so a word meets the others of its kind once for each block.
The words of all blocks are dealt by word, where they get their counts over the
training rows of the corpus; each distinct training word is cut into pieces
once; and every block gets its words back with counts and log-probabilities.
No word's rows and no block's words are gathered in one row, and the driver
gets one count for each piece of the vocabulary.

Defined results: a null text is an empty one, of one token, its end; texts and
words of any length are scored whole; with no training row all counts are 0 and
the law has middling parameters; rows that repeat are counted and scored as
often as they occur; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.operators.staging import written

from .common import lower_ascii, prepare

#: A block ends at so many distinct words or words.
BLOCK_DISTINCT, BLOCK_WORDS = 300_000, 4_000_000
#: How much of a piece's probability comes from the vocabulary's score.
SHARE = 0.5
SPACE = "▁"
LOG10 = math.log(10)

#: A row is a word of a block (``word`` set), or a text as places in its block's dictionary.
PARTS = "block long, place int, word binary, learned long, doc_id long, learn boolean, n_tokens long, places binary, times binary"
PART_NAMES = [c.split()[0] for c in PARTS.split(", ")]
PART_KINDS = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]


@cache
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Block:
    """Rows until their dictionary is full."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.texts: list[tuple[int | None, bool, int, np.ndarray, np.ndarray]] = []
        self.words = 0

    def add(self, doc_id: int | None, learn: bool, text: str) -> None:
        words = lower_ascii(text).encode("utf-8", "surrogatepass").split()
        own, number = Counter(words), self.number
        for w in own:
            if w not in number:
                number[w] = len(number)
        places = np.fromiter(map(number.__getitem__, own), "<u4", len(own))
        times = np.fromiter(own.values(), "<u4", len(own))
        self.texts.append((doc_id, learn, len(words) + 1, places, times))
        self.words += len(words)

    def full(self) -> bool:
        return len(self.number) >= BLOCK_DISTINCT or self.words >= BLOCK_WORDS

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """The dictionary with counts over the block's training texts, then its texts."""
        learned = np.zeros(len(self.number), np.int64)
        for _, learn, _, places, times in self.texts:
            if learn:
                learned[places] += times
        n = len(self.number)
        if n:
            of = {"block": np.full(n, block), "place": np.arange(n, dtype=np.int32), "word": list(self.number), "learned": learned}
            yield _batch(n, of)
        for k in range(0, len(self.texts), 500):
            doc_ids, learn, sizes, places, times = zip(*self.texts[k : k + 500], strict=True)
            of = {"doc_id": doc_ids, "learn": learn, "n_tokens": sizes, "places": [p.tobytes() for p in places], "times": [t.tobytes() for t in times]}
            yield _batch(len(sizes), {"block": np.full(len(sizes), block), **of})


def _batch(n: int, of: dict) -> pa.RecordBatch:
    columns = [pa.array(of[name], k) if name in of else pa.nulls(n, k) for name, k in zip(PART_NAMES, PART_KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=PART_NAMES)


def _split(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 24
    block = Block()
    for batch in texts:
        for doc_id, learn, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            block.add(doc_id, bool(learn), text or "")
            if block.full():
                yield from block.rows(number)
                block, number = Block(), number + 1
    yield from block.rows(number)


class Vocabulary:
    """Pieces and ranks of a vocabulary: 0 for the best score; bytes come last."""

    def __init__(self, path: str):
        sp = _processor(path)
        n = self.n = sp.get_piece_size()
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.byte = np.array([sp.is_byte(i) for i in range(n)])
        self.usable = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)])
        plain = self.usable & ~self.byte
        self.rank = np.zeros(n)
        self.rank[plain] = scores[plain].max(initial=0) - scores[plain]
        self.rank[self.byte] = self.rank.max(initial=0) + 1
        self.names = {i: sp.id_to_piece(i) for i in np.flatnonzero(self.usable).tolist()}


class Link:
    """log p of a piece of rank r: minus ``slope`` times log(``shift`` + r), normed
    over the vocabulary; the parameters that make the counts likeliest."""

    SLOPES, SHIFTS = np.arange(0.1, 2.05, 0.05), (1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0, 10_000.0)

    def __init__(self, vocabulary: Vocabulary, counts: np.ndarray):
        ranks, n = vocabulary.rank[vocabulary.usable], counts[vocabulary.usable].astype(np.float64)
        best = -math.inf
        self.slope, self.shift = 1.0, 10.0
        if n.sum() > 0:
            for shift in self.SHIFTS:
                logs = np.log(shift + ranks)
                mean = float((n * logs).sum() / n.sum())
                for slope in self.SLOPES.tolist():
                    likely = -slope * mean - math.log(np.exp(-slope * logs).sum())
                    if likely > best:
                        best, self.slope, self.shift = likely, slope, shift
        logs = -self.slope * np.log(self.shift + ranks)
        self.logs = np.full(vocabulary.n, -math.inf)
        self.logs[vocabulary.usable] = logs - math.log(np.exp(logs).sum())


class Lattice:
    """Log-probabilities of words, summed over their segmentations."""

    def __init__(self, vocabulary: Vocabulary, counts: np.ndarray, ends: int, share: float = SHARE):
        """``counts`` of the pieces, and ``ends``, in the training rows."""
        chance = np.exp(Link(vocabulary, counts).logs)
        seen = np.where(vocabulary.usable, counts, 0)
        if seen.sum() > 0:
            chance = share * chance + (1 - share) * seen / seen.sum()
        end = (ends + 1.0) / (seen.sum() + ends + 2.0)
        self.end = math.log(end)
        logs = np.log(np.where(vocabulary.usable, chance, 1.0)) + math.log1p(-end)
        plain = np.flatnonzero(vocabulary.usable & ~vocabulary.byte).tolist()
        self.logs = {vocabulary.names[i]: float(logs[i]) for i in plain}
        self.bytes = {int(vocabulary.names[i][3:5], 16): float(logs[i]) for i in np.flatnonzero(vocabulary.byte).tolist()}
        self.longest = max(map(len, self.logs), default=1)

    def word(self, word: str) -> float:
        """log P: forward[j] = log sum over pieces that end at j of exp(forward[i] + log p)."""
        text, get, longest, exp, log = SPACE + word, self.logs.get, self.longest, math.exp, math.log
        n = len(text)
        forward = [0.0] + [-math.inf] * n
        for j in range(1, n + 1):
            ways = [
                forward[i] + p for i in range(max(0, j - longest), j) if (p := get(text[i:j])) is not None
            ]
            c = text[j - 1]
            if c not in self.logs:  # its bytes
                ways.append(forward[j - 1] + sum(self.bytes[b] for b in c.encode("utf-8", "surrogatepass")))
            best = max(ways)
            forward[j] = best if len(ways) == 1 else best + log(sum([exp(x - best) for x in ways]))
        return forward[n]


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    """Rows (word, c), each word of the corpus once: pieces by occurrence."""
    sp = _processor(vocabulary)
    total = np.zeros(sp.get_piece_size(), np.int64)
    for batch in batches:
        words, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        for k in range(0, len(words), 1000):
            found = sp.encode([w.decode("utf-8", "surrogatepass") for w in words[k : k + 1000]])
            ids = np.concatenate([np.array(x, np.int64) for x in found])
            n = np.repeat(times[k : k + 1000], [len(x) for x in found])
            np.add.at(total, ids, n)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["piece", "n"])


def _weigh(batches: Iterator[pa.RecordBatch], lattice: Lattice) -> Iterator[pa.RecordBatch]:
    """Rows (block, place, c, word), equal words together: the word's log10-probability in its place."""
    word, held = None, 0.0
    for batch in batches:
        logs = np.empty(batch.num_rows)
        for k, w in enumerate(batch.column(3).to_pylist()):
            if w != word:
                word, held = w, lattice.word(w.decode("utf-8", "surrogatepass")) / LOG10
            logs[k] = held
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(logs)], names=["block", "place", "c", "log"])


SCORES = "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(texts: pa.Table, words: pa.Table, tokens: int, distinct: int, ends: int, log_end: float) -> pa.Table:
    """The scores of a block's texts from its words (place, c, log)."""
    n = words.num_rows
    c, logs = np.zeros(n, np.int64), np.zeros(n)
    at = words.column("place").to_numpy()
    c[at], logs[at] = words.column("c").to_numpy(), words.column("log").to_numpy()
    scale = math.log10(tokens + 0.5 * (distinct + 1))
    base = np.log10(c + 0.5) - scale
    known, bases, scores = [], [], []
    for places, times in zip(texts.column("places").to_pylist(), texts.column("times").to_pylist(), strict=True):
        p, t = np.frombuffer(places, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
        known.append(int(t[c[p] > 0].sum()) + (ends > 0))
        bases.append(float((base[p] * t).sum()) + math.log10(ends + 0.5) - scale)
        scores.append(float((logs[p] * t).sum()) + log_end)
    return pa.table(
        {
            "doc_id": texts.column("doc_id"),
            "learned": texts.column("learn"),
            "n_tokens": texts.column("n_tokens"),
            "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array([tokens] * texts.num_rows, pa.int64()),
            "base_score": pa.array(bases, pa.float64()),
            "score": pa.array(scores, pa.float64()),
        }
    )


def score(
    docs: DataFrame, learn: Column, vocabulary: str, doc_id: str = "doc_id", text: str = "text", share: float = SHARE
) -> DataFrame:
    """``SCORES`` of every row; rows where ``learn`` is true train the model."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(docs[doc_id].cast("long"), F.coalesce(learn, F.lit(False)), docs[text].cast("string"))
    parts = written(rows.mapInArrow(_split, PARTS))
    texts = parts.where("word is null").select("block", "doc_id", "learn", "n_tokens", "places", "times")
    words = parts.where("word is not null").select("word", "block", "place", "learned")

    # counts over the corpus; what lies together of a word is one row for each block
    own = Window.partitionBy("word")
    counted = words.withColumn("c", F.sum("learned").over(own))
    counted = written(counted.withColumn("first", F.row_number().over(own.orderBy("block")) == 1).select("word", "block", "place", "c", "first"))
    trained = counted.where("first and c > 0")
    sums = trained.agg(F.sum("c").alias("words"), F.count("*").alias("distinct")).first()
    ends = texts.where("learn").count()

    # at most one row for each piece of the vocabulary
    found = trained.select("word", "c").mapInArrow(lambda b: _pieces(b, vocabulary), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = Vocabulary(vocabulary)
    counts = np.zeros(pieces.n, np.int64)
    for r in found.collect():
        counts[r["piece"]] = r["n"]
    lattice = Lattice(pieces, counts, ends, share)
    shared = spark.sparkContext.broadcast(lattice)  # a row for each piece of the vocabulary

    tokens, distinct = (sums["words"] or 0) + ends, sums["distinct"] + (ends > 0)
    log_end = lattice.end / LOG10
    back = counted.select("block", "place", "c", "word").mapInArrow(lambda b: _weigh(b, shared.value), "block long, place int, c long, log double")
    return (
        texts.groupBy("block")
        .cogroup(back.groupBy("block"))
        .applyInArrow(lambda t, w: _score(t, w, tokens, distinct, ends, log_end), SCORES)
    )


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 1, F.lit(False))
