"""Language of texts, and of the spans of a mixed text.

The scripts of a word narrow the languages that it may be in; the others are
scored by the word's character n-grams (naive Bayes, trained from labelled
rows); Viterbi over the words, with a penalty for every switch, labels spans.
A text's language is that of the most letters.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
with no labelled row all texts are ``und``; texts and words of any length are
read whole (a word of more than ``MOST`` bytes counts as several, its pieces);
ties go to the language that sorts first; rows that repeat give equal rows; an
empty table gives no rows; ``identify`` leaves other columns out, ``keep``
returns all columns.  Training rows with a null language or text are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, sample_limit

UNKNOWN = "und"
#: Starts of Unicode ranges and their scripts (fixed values); 0 is common to all.
SCRIPT_STARTS = np.array(
    [0x0, 0x41, 0x5B, 0x61, 0x7B, 0xAA, 0xAB, 0xBA, 0xBB, 0xC0, 0x2B0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900,
     0x980, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000,
     0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000, 0x30000]
)
SCRIPTS = [0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 0, 2, 3, 4, 5, 6, 0, 7,
           8, 9, 0, 10, 11, 12, 1, 2, 0, 13, 14, 0, 15, 0, 11, 0, 15, 0, 15, 0]
SCRIPT_OF = np.array(SCRIPTS)
N_SCRIPTS = 16

#: n-grams of up to LONGEST bytes are hashed into FEATURES; words of more than
#: MOST bytes are labelled in pieces; about SAMPLE rows of a language are learned from, by COUNTERS tasks.
FEATURE_BITS, LONGEST, MOST, SAMPLE, COUNTERS = 16, 5, 100, 4000, 16
FEATURES = 1 << FEATURE_BITS
SLICE = 20_000  # words whose n-grams are held at a time
SWITCH = 12.0  # nats that a change of language costs
DAMPING = 2.5  # n-grams of a word overlap, so each counts for less


def pieces(word: bytes) -> list[bytes]:
    """A long word in pieces of at most ``MOST`` bytes, cut between code points.

    A piece stands after a space and what n-grams over the joint need of the
    piece before; all but the last end in a space.
    """
    made, start = [], 0
    while start < len(word):
        end = min(start + MOST, len(word))
        while end < len(word) and word[end] & 0xC0 == 0x80:
            end -= 1
        made.append(word[max(0, start - LONGEST + 1) : start] + b" " + word[start:end] + (b" " if end < len(word) else b""))
        start = end
    return made


def words_of(text: str) -> list[bytes]:
    """The words of a text, long ones as their ``pieces``."""
    words = lower_ascii(text).encode("utf-8", "surrogatepass").split()
    if max(map(len, words), default=0) <= MOST:
        return words
    return [p for w in words for p in ([w] if len(w) <= MOST else pieces(w))]


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, each between its ends, and the word's number
    for each.  Those of a piece end in it, so pieces have the n-grams of their word."""
    marked, before = [], []
    for w in words:
        joint, space, piece = w.partition(b" ")
        if space:
            before.append(len(joint))
            marked.append((joint or b"^") + (piece[:-1] if piece.endswith(b" ") else piece + b"$"))
        else:
            before.append(0)
            marked.append(b"^" + w + b"$")
    data = np.frombuffer(b"".join(marked), np.uint8)
    sizes = np.array([len(m) for m in marked], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes to the end of the word
    rolled = data.astype(np.uint64)
    inside = np.repeat(sizes - np.array(before, np.int64), sizes) if any(before) else None  # bytes from the piece's start to its end
    grams, numbers = [], []
    for size in range(2, LONGEST + 1):
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + data[size - 1 :]
        at = left[: len(rolled)] >= size
        if inside is not None:  # the n-gram's last byte is in the piece
            at &= left[: len(rolled)] - size < inside[: len(rolled)]
        at = np.flatnonzero(at)
        mixed = rolled[at] ^ (rolled[at] >> np.uint64(31))
        grams.append((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
        numbers.append(word[at])
    return np.concatenate(grams), np.concatenate(numbers)


class Model:
    """Log-probabilities of features by language, and the scripts of each."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray, remember: int = 600_000):
        self.languages = languages
        self.remember = remember
        self.words: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(languages)), np.float32)
        self.letters = np.zeros(0, np.int32)
        if not languages:
            return
        totals = counts.sum(1, keepdims=True)
        logs = np.log((counts + 0.5) / (totals + 0.5 * FEATURES))
        # what all languages share says nothing; the rest is bounded, so that no word decides alone
        self.logs = np.ascontiguousarray((logs - logs.mean(0, keepdims=True)).T.astype(np.float32))
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        self.may = share > 0.01  # language by script

    def _learn(self, words: list[bytes]) -> None:
        """Scores of words not met so far."""
        grams, numbers = word_grams(words)
        rows = np.stack([np.bincount(numbers, column[grams], len(words)) for column in self.logs.T], 1) / DAMPING
        sizes = np.array([len(w) if w.isalpha() else -1 for w in words], np.int32)
        for k in np.flatnonzero(sizes < 0).tolist():
            sizes[k] = self._narrow(words[k], rows[k])
        rows = np.clip(rows - rows.max(1, keepdims=True), -4.0 * SWITCH, 0).astype(np.float32)
        rows[sizes == 0] = 0
        base = len(self.words)
        self.words.update(zip(words, range(base, base + len(words)), strict=True))
        self.scores = np.concatenate([self.scores[:base], rows])
        self.letters = np.concatenate([self.letters[:base], sizes])

    def _narrow(self, word: bytes, score: np.ndarray) -> int:
        """Letters of a word; languages not written in their scripts score least."""
        word = word.partition(b" ")[2] or word
        letters = [c for c in word.decode("utf-8", "surrogatepass") if c.isalpha()]
        scripts = {int(SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, ord(c), "right") - 1]) for c in set(letters) if c > "\x7f"} - {0}
        if scripts:
            may = self.may[:, sorted(scripts)].any(1)
            if may.any():
                score[~may] = score.min() - SWITCH
        return len(letters)

    def places(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Rows of ``scores`` for the words of each text; the memory is bounded."""
        if len(self.words) > self.remember:
            self.words.clear()
        new = set().union(*texts) if texts else set()
        new = sorted(w for w in new if w not in self.words)
        for k in range(0, len(new), SLICE):
            self._learn(new[k : k + SLICE])
        get = self.words.__getitem__
        return [np.fromiter(map(get, words), np.int64, len(words)) for words in texts]

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best sequence of languages for rows of scores.

        If no run of words gains more in other languages than one switch costs,
        the best single language is the best path; else Viterbi is run.
        """
        total = scores.sum(0, dtype=np.float64)
        best = int(total.argmax())
        if len(self.languages) == 1:
            return np.zeros(len(scores), np.int64)
        others = np.delete(scores, best, 1).max(1) - scores[:, best]
        run = np.concatenate([[0.0], np.cumsum(others, dtype=np.float64)])
        if (run - np.minimum.accumulate(run)).max() <= SWITCH:
            return np.full(len(scores), best)
        return viterbi(scores)

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, np.ndarray, list[bytes]]]:
        """Language, score, labels of the words, and the words of each text."""
        split = [words_of(t) if t else [] for t in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0, np.zeros(len(words), np.int64), words) for words in split]
        out = []
        for words, at in zip(split, self.places(split), strict=True):
            letters = self.letters[at]
            if not letters.any():
                out.append((UNKNOWN, 0.0, np.zeros(len(words), np.int64), words))
                continue
            labels = self.path(self.scores[at])
            weights = np.bincount(labels, letters, len(self.languages))
            best = int(weights.argmax())
            sure = self.scores[at][labels == best].sum(0, dtype=np.float64)
            chance = 1.0 / float(np.exp(sure - sure.max()).sum())
            out.append((self.languages[best], float(weights[best] / weights.sum()) * chance, labels, words))
        return out


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best path when any change of label costs ``switch``."""
    n, k = scores.shape
    rows = scores.tolist()
    state, back = list(rows[0]), []
    for row in rows[1:]:
        top = max(state)
        come, at = top - switch, state.index(top)
        back.append([i if state[i] >= come else at for i in range(k)])
        state = [(state[i] if state[i] >= come else come) + row[i] for i in range(k)]
    path = [state.index(max(state))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1], np.int64)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` rows of each language at most.

    The sample is by a hash of the row, at a rate that the number of different rows of
    the language gives, and rows that repeat count once; feature counts are summed by
    Spark and the driver gets one row of ``FEATURES`` counts for each language.
    """
    rows = labelled.select(
        F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"), F.xxhash64(doc_id, text).alias("h")
    ).where("text is not null and lang is not null")
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not known:
        return Model([], np.zeros((0, FEATURES)), np.zeros((0, N_SCRIPTS)))
    limit = F.create_map(*[F.lit(x) for k, n in known.items() for x in (k, sample_limit(sample, n))])
    # the sample is bounded, and so is the number of tasks that count in it
    chosen = rows.where(F.col("h") <= limit[F.col("lang")]).dropDuplicates(["lang", "h"])
    chosen = chosen.select("text", "lang").repartition(COUNTERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(name, Counter()).update(words_of(t))
                codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
                kinds = SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, codes, "right") - 1]
                seen = scripts.setdefault(name, np.zeros(N_SCRIPTS, np.int64))
                seen += np.bincount(kinds, minlength=N_SCRIPTS)
        names = sorted(words)
        grams = {name: np.zeros(FEATURES, np.int64) for name in names}
        for name in names:
            own = list(words[name])
            times = np.fromiter(words[name].values(), np.int64, len(own))
            for k in range(0, len(own), SLICE):
                found, numbers = word_grams(own[k : k + SLICE])
                np.add.at(grams[name], found, times[k + numbers])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array([grams[n].tobytes() for n in names], pa.binary()),
                pa.array([scripts[n].tobytes() for n in names], pa.binary()),
            ],
            names=["lang", "grams", "scripts"],
        )

    def add(group: pa.Table) -> pa.Table:
        total = [
            sum(np.frombuffer(x, np.int64) for x in group.column(c).to_pylist()).tobytes() for c in ("grams", "scripts")
        ]
        return pa.table({"lang": group.column("lang")[:1].combine_chunks(), "grams": pa.array([total[0]], pa.binary()), "scripts": pa.array([total[1]], pa.binary())})

    schema = "lang string, grams binary, scripts binary"
    # what meets for a language: at most COUNTERS rows of half a megabyte
    sums = sorted(chosen.mapInArrow(count, schema).groupBy("lang").applyInArrow(add, schema).collect())
    return Model(
        [r["lang"] for r in sums],
        np.array([np.frombuffer(r["grams"], np.int64) for r in sums]).reshape(len(sums), FEATURES),
        np.array([np.frombuffer(r["scripts"], np.int64) for r in sums]).reshape(len(sums), N_SCRIPTS),
    )


class Identifier:
    """A trained model that is broadcast: ``FEATURES`` times languages numbers."""

    def __init__(self, labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE):
        self.model = train(labelled, text, lang, sample=sample)
        self.shared = labelled.sparkSession.sparkContext.broadcast(self.model)

    def identify(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """``doc_id``, ``lang_pred`` and ``score`` (0 to 1)."""
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                found = model.judge(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

        return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(
            run, "doc_id long, lang_pred string, score double"
        )

    def spans(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per span of words in one language: ``first_word``, ``n_words``, ``lang``."""
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                rows = []
                for d, (lang, _, labels, words) in zip(batch.column(0).to_pylist(), model.judge(batch.column(1).to_pylist()), strict=True):
                    if not words:
                        continue
                    cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(words)]
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        rows.append((d, a, b - a, lang if lang == UNKNOWN else model.languages[labels[a]]))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "first_word", "n_words", "lang"]
                )

        return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(
            run, "doc_id long, first_word long, n_words long, lang string"
        )

    def keep(self, docs: DataFrame, least: float = 0.3, text: str = "text") -> DataFrame:
        """Rows whose text has a known language with a score of ``least``, all columns."""
        shared, at = self.shared, docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                found = model.judge(batch.column(at).to_pylist())
                yield batch.filter(pa.array([f[0] != UNKNOWN and f[1] >= least for f in found], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))
