"""Line-first cleaning: rules judge each line, lines that fail are removed, and
a document that loses too much of its text is rejected.

Defined results: a null text has no words and fails; an empty text the same;
lines without a word are neither judged nor removed; a text of any length is
judged whole; rows that repeat give equal rows; an empty table gives no rows;
``judge`` leaves other columns out, ``keep`` returns all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters counted as symbols, and the six white-space characters.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
SEPARATORS = frozenset([b"|", b">", b"\xc2\xbb", b"\xc2\xb7", b"\xe2\x80\xa2"])
SENTENCE_ENDS = ".!?:;…"
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "privacy policy",
    "sign up for our newsletter",
    "terms of use",
)
WINDOW = 5

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_removed_words long, kept boolean, clean_text string"
)


@dataclass(frozen=True)
class Rules:
    """``symbols`` and ``shouts`` (exclamation marks) are the most that a line
    may have per word, ``separators`` the share of its words that may separate
    links; a line of ``sentence_words`` or more needs the mark of a sentence; one
    of ``repeat_words`` or more needs so many ``distinct`` words as a share;
    ``loss`` is the most of its words that a document may lose."""

    symbols: float = 0.5
    shouts: float = 0.34
    separators: float = 0.2
    sentence_words: int = 8
    repeat_words: int = 10
    distinct: float = 0.3
    loss: float = 0.4


def line_fails(line: str, words: list[bytes], rules: Rules) -> bool:
    n = len(words)
    if sum(map(line.count, SYMBOLS)) > rules.symbols * n or line.count("!") > rules.shouts * n:
        return True
    if n >= rules.sentence_words and not any(c in line for c in SENTENCE_ENDS):
        return True
    if n >= 3 and sum(map(SEPARATORS.__contains__, words)) >= rules.separators * n:
        return True
    if n >= rules.repeat_words and len(set(words)) < rules.distinct * n:
        return True
    low = line.lower()
    return any(phrase in low for phrase in BOILERPLATE)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that occur at least twice, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    # exact: each window is renamed step by step, pairs of names to dense names
    names = ids[:n]
    for k in range(1, WINDOW):
        _, names = np.unique(names * len(number) + ids[k : k + n], return_inverse=True)
        if len(_) == n:
            return 0
    found = np.bincount(names)[names] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(found)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def judge_text(text: str | None, rules: Rules) -> tuple:
    text = text or ""
    words: list[bytes] = []
    seen: set[str] = set()
    kept_lines, duplicates, removed = [], 0, 0
    for line in text.split("\n"):
        own = line.encode("utf-8", "surrogatepass").split()
        if not own:
            kept_lines.append(line)
            continue
        words += own
        again = line in seen
        seen.add(line)
        duplicates += again
        if again or line_fails(line, own, rules):
            removed += len(own)
        else:
            kept_lines.append(line)
    n = len(words)
    repeats = repeated_words(words)
    failed = n < 10 or 100 * repeats > 20 * n
    kept = not failed and removed <= rules.loss * n
    chars = len(text) - sum(map(text.count, SPACES))
    return n, chars, sum(map(text.count, SYMBOLS)), duplicates, repeats, failed, removed, kept, "\n".join(kept_lines)


def judge(
    docs: DataFrame, rules: Rules = Rules(), with_text: bool = True, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Counts, verdict and (``with_text``) the cleaned text of every document."""
    schema = SCHEMA if with_text else SCHEMA.removesuffix(", clean_text string")
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.bool_(), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge_text(t, rules) for t in batch.column(1).to_pylist()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] or [
                pa.array([], k) for k in kinds
            ]
            columns = columns if with_text else columns[:-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names[: len(columns) + 1])

    return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(run, schema)


def keep(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The rows whose text is not rejected, with all their columns."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([judge_text(t, rules)[7] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
