"""Packing of documents into sequences of a fixed number of tokens.

A document's ids are cut into pieces: every full window is a sequence of its
own; what remains is cut into pieces of at most ``chunk`` ids, which
Karmarkar-Karp multiway differencing spreads over near-equal windows, block by
block.  A block is a bounded number of pieces, gathered while a task streams
over its rows, so nothing is shuffled and no task holds more than one block.

Defined results: a null text is an empty one and has only the end id; rows
that repeat are packed as often as they occur; a document of any length is cut
into as many pieces as it needs; an empty table gives no rows; other columns
are left out.  Sequence ids are unique over the table: they begin with the
number of the task.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY, CHUNK, BLOCK, END_ID = 2048, 512, 384, 1
#: Runs of so many characters, all or none of them white space, go to the tokenizer itself.
LONG_RUN = 20_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: those that
    print stand for themselves, the others follow at 256 in their order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer's vocabulary and its order of merges (a token's id is its rank)
    are handed to an encoder that makes no offsets and strings for each token and
    so takes a fifth of the time; tests hold both equal for every code point.
    """

    def __init__(self, path: str, text_only: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from public_tokenizers import PATTERN
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = text_only
        alphabet = byte_alphabet()
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in special}
        self.fast = Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.long = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")
        #: texts with a special token's string are rare and left to the tokenizer
        self.control = None if text_only or not special else re.compile("|".join(map(re.escape, special)))

    def encode(self, text: str) -> bytes:
        if (self.control and self.control.search(text)) or (len(text) >= LONG_RUN and self.long.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.encode_plainly(text)

    def encode_plainly(self, text: str) -> bytes:
        """For texts without long runs, special tokens' strings being ordinary text."""
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@cache
def encoder(tokenizer_path: str, text_only: bool = False) -> Encoder:
    return Encoder(tokenizer_path, text_only)


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of ``sizes`` in ``windows`` near-equal lots.

    Each partial partition is a tuple of lots in falling order of their sums;
    the two with the largest imbalance are merged, largest lot with smallest.
    """
    if windows == 1:
        return [list(range(len(sizes)))]
    # (−imbalance, tie, sums as they differ from the smallest, lots); lots not listed are empty
    heap: list[tuple[int, int, list[int], list[list[int]]]] = [
        (-s, i, [s], [[i]]) for i, s in enumerate(sizes)
    ]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, lots_a = heapq.heappop(heap)
        _, _, b, lots_b = heapq.heappop(heap)
        sums, lots = _merge(a, lots_a, b, lots_b, windows)
        heapq.heappush(heap, (-sums[0] if sums else 0, tie, sums, lots))
        tie += 1
    lots = heap[0][3] if heap else []
    return lots + [[] for _ in range(windows - len(lots))]


def _merge(a: list[int], lots_a: list, b: list[int], lots_b: list, windows: int) -> tuple[list[int], list]:
    """``a`` and ``b`` list the largest lots only, the rest being zero."""
    free = windows - len(a) - len(b)
    if free >= 0:  # the lots of one fall on empty lots of the other
        pairs = sorted([*zip(a, lots_a, strict=True), *zip(b, lots_b, strict=True)], key=lambda p: -p[0])
    else:
        full_a = a + [0] * (windows - len(a))
        full_b = b + [0] * (windows - len(b))
        full_lots_a = lots_a + [[] for _ in range(windows - len(a))]
        full_lots_b = lots_b + [[] for _ in range(windows - len(b))]
        pairs = sorted(
            (
                (x + y, p + q)
                for x, y, p, q in zip(full_a, reversed(full_b), full_lots_a, reversed(full_lots_b), strict=True)
            ),
            key=lambda p: -p[0],
        )
    least = pairs[-1][0] if len(pairs) == windows else 0
    sums, lots = [s - least for s, _ in pairs], [lot for _, lot in pairs]
    if free < 0 or least:
        return sums, lots
    while sums and sums[-1] == 0 and not lots[-1]:
        sums.pop()
        lots.pop()
    return sums, lots


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; one more as long as any is exceeded."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        lots = differencing(sizes, windows)
        if all(sum(sizes[i] for i in lot) <= capacity for lot in lots):
            return [lot for lot in lots if lot]
        windows += 1


def padded(length: int, capacity: int) -> int:
    """A sequence whose length is a power of two stays as it is."""
    return length if length & (length - 1) == 0 else capacity


def _pack(
    batches: Iterator[pa.RecordBatch], path: str, capacity: int, chunk: int, block: int, text_only: bool
) -> Iterator[pa.RecordBatch]:
    encode = encoder(path, text_only).encode
    end = np.array([END_ID], "<u4").tobytes()
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    sequence = first
    pieces: list[tuple[int, int, int, int, int]] = []  # doc_id, start, length, crc, doc_tokens
    out: list[tuple] = []

    def flush() -> None:
        nonlocal sequence
        for lot in pack_block([p[2] for p in pieces], capacity):
            total, offset = sum(pieces[i][2] for i in lot), 0
            for i in lot:
                out.append((*pieces[i], sequence, offset, padded(total, capacity)))
                offset += pieces[i][2]
            sequence += 1
        pieces.clear()

    def rows() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 8)],
            names=[c.split()[0] for c in SCHEMA.split(", ")],
        )
        out.clear()
        return made

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(text or "") + end
            tokens = len(ids) // 4
            whole = tokens - tokens % capacity
            for start in range(0, whole, capacity):
                crc = zlib.crc32(ids[4 * start : 4 * (start + capacity)])
                out.append((doc_id, start, capacity, crc, tokens, sequence, 0, capacity))
                sequence += 1
            for start in range(whole, tokens, chunk):
                part = ids[4 * start : 4 * (start + chunk)]
                pieces.append((doc_id, start, len(part) // 4, zlib.crc32(part), tokens))
                if len(pieces) >= block:
                    flush()
            if len(out) >= 20_000:
                yield rows()
    if pieces:
        flush()
    yield rows()


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    chunk: int = CHUNK,
    block: int = BLOCK,
    doc_id: str = "doc_id",
    text: str = "text",
    text_only: bool = False,
) -> DataFrame:
    """One row per piece: document, ``start``, ``length``, the pieces' CRC and
    its place (``sequence_id``, ``offset``); ``padded_length`` is that of its sequence.

    ``capacity`` and ``chunk`` are ids; ``chunk`` divides ``capacity``; ``block``
    bounds the pieces that one differencing run takes.  With ``text_only`` the
    strings of special tokens are ordinary text.
    """
    return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(
        lambda batches: _pack(batches, tokenizer_path, capacity, chunk, block, text_only), SCHEMA
    )
