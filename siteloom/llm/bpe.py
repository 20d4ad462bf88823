"""Byte-level BPE encoding and decoding from a file of ranks.

Two tiers: a minimal perfect hash over the vocabulary resolves a pre-token that
is a token as a whole; any other is merged with a heap over its linked bytes.
Ids of short stretches of text are remembered, in bounded memory.

Defined results: a null text is an empty one, with no ids; a text or a
pre-token of any length is encoded whole; rows that repeat give equal rows; an
empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .stretches import SPACE, StretchCache

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PerfectHash:
    """Minimal perfect hash by displacement: ``len(keys)`` slots, one for each key.

    Keys fall into buckets; each bucket, largest first, takes the first
    displacement that sends all its keys to free slots; a bucket of one key
    takes a free slot outright.
    """

    MIX, PER_BUCKET = 0x9E3779B97F4A7C15, 3

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // self.PER_BUCKET)
        self.shift = [0] * self.buckets
        self.keys: list[bytes] = [b""] * n
        hashed = [xxhash.xxh3_64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashed):
            members[h % self.buckets].append(i)
        taken = bytearray(n)
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        singles = [b for b in order if len(members[b]) == 1]
        for b in order:
            if len(members[b]) < 2:
                break
            d = 0
            while True:
                slots = [self._slot(hashed[i], d) for i in members[b]]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for i, s in zip(members[b], slots, strict=True):
                taken[s] = 1
                self.keys[s] = keys[i]
        free = (s for s in range(n) if not taken[s])
        for b, s in zip(singles, free, strict=False):
            self.shift[b] = -s - 1
            self.keys[s] = keys[members[b][0]]

    def _slot(self, h: int, d: int) -> int:
        return ((((h >> 20) + d * self.MIX) * self.MIX & 0xFFFFFFFFFFFFFFFF) >> 29) % self.n

    def find(self, key: bytes) -> int:
        """The key's slot, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return slot if self.keys[slot] == key else -1


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.hash = PerfectHash(list(ranks))
        self.slot_ids = [ranks[k] for k in self.hash.keys]
        top = max(ranks.values(), default=-1) + 1
        self.texts = [b""] * top
        for token, i in ranks.items():
            self.texts[i] = token
        self.names = [str(i) for i in range(top)]
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.cache = StretchCache(self._stretches)
        self.words: dict[str, bytes] = {}

    def _stretches(self, stretches: list[str]) -> list[bytes]:
        """Ids of each stretch; those of its pre-tokens are remembered too."""
        words, out, findall = self.words, [], self.pattern.findall
        for s in stretches:
            if len(words) > self.cache.remember:
                words.clear()
            parts = []
            for match in findall(s):
                ids = words.get(match)
                if ids is None:
                    ids = self._word(match.encode("utf-8", "surrogatepass"))
                    if len(match) <= self.cache.longest:
                        words[match] = ids
                parts.append(ids)
            out.append(b"".join(parts))
        return out

    def _word(self, word: bytes) -> bytes:
        slot = self.hash.find(word)
        ids = [self.slot_ids[slot]] if slot >= 0 else self.merge(word)
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token: its bytes are linked parts; the pair of neighbours
        with the least rank is joined first, the leftmost of equals."""
        rank, n = self.ranks.get, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, start, end = heappop(heap)
            middle = after[start]
            if middle < 0 or middle >= end or after[middle] != end:
                continue  # one of the parts has been joined meanwhile
            after[start], after[middle] = end, -1
            if end < n:
                before[end] = start
                if (r := rank(word[start : after[end]])) is not None:
                    heappush(heap, (r, start, after[end]))
            if (left := before[start]) >= 0 and (r := rank(word[left:end])) is not None:
                heappush(heap, (r, left, end))
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[word[at : after[at]]])
            at = after[at]
        return ids

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.cache.encode(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.texts.__getitem__, ids))


@cache
def encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(ranks_path), pattern)


def _columns(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str, row) -> Iterator[tuple[list, list]]:
    made = encoder(ranks_path, pattern)
    for batch in batches:
        rows = []
        for found in made.cache.encode_all([t or "" for t in batch.column(1).to_pylist()]):
            ids = np.frombuffer(found, "<u4").tolist()
            rows.append((len(ids), *row(made, ids, made.decode(ids))))
        yield batch.column(0), list(zip(*rows, strict=True)) or [()] * 3


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids (little-endian unsigned 32-bit) and the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda _, ids, decoded: (np.array(ids, "<u4").tobytes(), decoded)
        for doc_ids, (n, ids, decoded) in _columns(batches, ranks_path, pattern, row):
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(run, SCHEMA)


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encode``, with digests in place of ids and bytes, which stay in their task."""

    def row(made: Encoder, ids: list[int], decoded: bytes) -> tuple[str, str]:
        said = " ".join(map(made.names.__getitem__, ids)).encode()
        return hashlib.sha256(said).hexdigest(), hashlib.sha256(decoded).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, (n, ids, decoded) in _columns(batches, ranks_path, pattern, row):
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(run, DIGESTS)
