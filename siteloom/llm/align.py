"""Alignment of the tokens of two tokenizers, with corpus-wide counts of linked pairs.

Both encode the same bytes, a space and the text.  Where a token of each ends at
the same byte a group ends; two tokens whose bytes overlap are linked.  The
overlap of two tokens is one stretch between neighbouring token ends of either
side, so a text has as many links as it has different ends.

Counting by external spilling: a task gathers documents into blocks of bounded
size and sorts a block's pair-document records by radix (of the B id), B id and
A id.  A block's records of one radix are a run, cut into frames that zstd
compresses; all frames are written to one table.  Frames of a radix, at most
about ``FAN_IN`` blocks of them together, are merged by a heap: what lies before the next
frame's first pair is complete and is summed.  What several such merges counted
is merged once more for the whole radix, in order of B ids, so a B id's highest
count is known when its last pair has passed.  The counts, in frames again,
then meet the records of their radix, and sums by document stream back to the
blocks.  A frequent pair is one entry of each frame, never a gathered group.

Bounds: a block has about ``BLOCK_LINKS`` links and at most ``BLOCK_DOCS``
documents, or is one document; the counts of a radix are at most the pairs of
ids in it (25 million for vocabularies of 50 257 and 32 000 and 64 radices).

Defined results: a text that is null, empty, or not given back byte by byte by
both sides has no tokens, zeros and an empty digest; strings of special tokens
are ordinary text; documents with equal ids are rows of their own and a null id
stays null; texts of any length are aligned whole; an empty table gives no
rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.operators.staging import written

from . import packing, piece
from .common import prepare
from .stretches import SPACE

BLOCK_LINKS, BLOCK_DOCS, RADICES, FRAME, FAN_IN = 1_000_000, 50_000, 64, 4096, 256
#: Characters whose new stretches are encoded together.
AT_ONCE = 400_000

#: A block's documents (``radix`` null), or a frame of its records.
PARTS = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "sha array<string>, radix int, first long, pairs binary, records binary"
)
COUNTED = "radix int, first long, pairs binary"
SUMS = "block long, sums binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers of 0 or more, each in the least width that holds it, compressed."""
    parts = []
    for a in arrays:
        top = int(a.max(initial=0))
        width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - (w == 8)))
        parts.append(np.array([width, len(a)], "<u4").tobytes() + a.astype(f"<u{width}").tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unsqueeze(data: bytes) -> list[np.ndarray]:
    data, at, arrays = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        width, n = np.frombuffer(data, "<u4", 2, at).tolist()
        arrays.append(np.frombuffer(data, f"<u{width}", n, at + 8).astype(np.int64))
        at += 8 + width * n
    return arrays


def pack_pairs(codes: np.ndarray, *more: np.ndarray) -> bytes:
    """Rising codes as steps from their first, and an array or two beside them."""
    return squeeze(np.diff(codes, prepend=codes[:1]), *more)


def unpack_pairs(first: int, data: bytes) -> list[np.ndarray]:
    steps, *more = unsqueeze(data)
    return [first + np.cumsum(steps), *more]


class Aligner:
    """Stretches of text to their ids on both sides; those of short ones are remembered, in bounded memory."""

    def __init__(self, a_path: str, b_path: str, remember: int = 200_000, longest: int = 48):
        self.a, self.b = packing.encoder(a_path, True), piece.encoder(b_path)
        self.remember, self.longest = remember, longest
        alphabet = packing.byte_alphabet()
        tokens = self.a.tokenizer.get_vocab()
        self.n_a = max(tokens.values()) + 1
        self.a_size = np.zeros(self.n_a, np.int64)
        for token, i in tokens.items():
            self.a_size[i] = len(token) if all(c in alphabet for c in token) else len(token.encode())
        v = self.b.vocabulary
        self.n_b = len(v.pieces)
        self.b_bytes = [bytes([v.byte_of[i]]) if i in v.byte_of else p.replace(piece.SPACE, " ").encode() for i, p in enumerate(v.pieces)]
        self.b_size = np.array([len(x) for x in self.b_bytes])
        # white space that a piece of B may join to what stands before it
        joined = "".join({y for x, y in v.together if y in SPACE and x not in SPACE})
        more = f"(?:[{joined}][{SPACE}]*[^{SPACE}]*)*" if joined else ""
        #: white space, then other characters: no token of either side crosses from one such stretch into the next
        self.stretch = re.compile(f"[{SPACE}]*[^{SPACE}]+{more}|[{SPACE}]+") if v.cut_at_space else None
        self.names = [str(i) for i in range(max(self.n_a, self.n_b))]
        #: stretch -> ids of either side, groups in writing, number of groups; None: B's bytes differ
        self.known: dict[str, tuple[bytes, bytes, str, int] | None] = {}
        self.old: dict[str, tuple[bytes, bytes, str, int] | None] = {}

    def stretches(self, text: str) -> list[str] | None:
        """Of a space and the text; None if it has no tokens."""
        if not text or piece.SPACE in text:  # B writes both this sign and a space as this sign
            return None
        return self.stretch.findall(" " + text) if self.stretch else [" " + text]

    def learn(self, stretches: set[str]) -> None:
        """Encode and align the stretches that aren't known, all of them together."""
        if len(self.known) > self.remember:
            self.known, self.old = {}, self.known
        new = stretches.difference(self.known)
        again = [s for s in new if s in self.old]
        self.known.update((s, self.old[s]) for s in again)
        new = list(new.difference(again))
        if not new:
            return
        b = self.b.ids_of([s.replace(" ", piece.SPACE) for s in new])
        if not self.b.lossless:
            said = [b"".join([self.b_bytes[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in b]
            other = {s for s, x in zip(new, said, strict=True) if x != s.encode("utf-8", "surrogatepass")}
            self.known.update(dict.fromkeys(other))
            b = [x for s, x in zip(new, b, strict=True) if s not in other]
            new = [s for s in new if s not in other]
        a = self.a_ids(new)
        for stretch, own_a, own_b, found in zip(new, a, b, self.groups(a, b), strict=True):
            self.known[stretch] = own_a, own_b, *found

    def a_ids(self, stretches: list[str]) -> list[bytes]:
        """Ids of each stretch.  Those with words are encoded behind one another, as no
        token crosses from one into the white space at the start of the next."""
        together = [s for s in stretches if len(s) < packing.LONG_RUN and s[0] in SPACE and s[-1] not in SPACE]
        flat = np.frombuffer(self.a.encode_plainly("".join(together)), "<u4")
        sizes = np.fromiter((len(s.encode("utf-8", "surrogatepass")) for s in together), np.int64, len(together))
        ends = np.searchsorted(np.cumsum(self.a_size[flat]), np.cumsum(sizes)) + 1
        data, made, start = flat.tobytes(), {}, 0
        for s, end in zip(together, ends.tolist(), strict=True):
            made[s] = data[4 * start : 4 * end]
            start = end
        return [made[s] if s in made else self.a.encode(s) for s in stretches]

    def groups(self, a: list[bytes], b: list[bytes]) -> list[tuple[str, int]]:
        """``a1,a2|b1;a3|b2``, ids between bytes at which tokens of both sides end, and how many such groups."""
        flat_a, flat_b = (np.frombuffer(b"".join(x), "<u4") for x in (a, b))
        end_a, end_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, both) + 1, np.searchsorted(end_b, both) + 1
        name_a, name_b = ([self.names[i] for i in x.tolist()] for x in (flat_a, flat_b))
        out, i, j = [], 0, 0
        for p, q in zip(last_a.tolist(), last_b.tolist(), strict=True):
            if p - i == 1 and q - j == 1:
                out.append(f"{name_a[i]}|{name_b[j]}")
            else:
                out.append(f"{','.join(name_a[i:p])}|{','.join(name_b[j:q])}")
            i, j = p, q
        # a stretch ends with a group
        ends = (np.searchsorted(last_a, np.cumsum([len(x) // 4 for x in a])) + 1).tolist()
        return [(out[k] if n == k + 1 else ";".join(out[k:n]), n - k) for k, n in zip([0, *ends[:-1]], ends, strict=True)]

    def forget(self, stretches: set[str]) -> None:
        for s in stretches:
            if len(s) > self.longest:
                self.known.pop(s, None)

    def texts(self, texts: list[str]) -> Iterator[tuple[bytes, bytes, str, int]]:
        """Of each text: ids of both sides, groups in writing, number of groups."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and size < AT_ONCE:
                group.append(self.stretches(texts[at]))
                size += len(texts[at])
                at += 1
            seen = set().union(*(g for g in group if g))
            self.learn(seen)
            for g in group:
                found = [self.known[s] for s in g or ()]
                if not found or None in found:
                    yield b"", b"", "", 0
                else:
                    a, b, out, n = zip(*found, strict=True)
                    yield b"".join(a), b"".join(b), ";".join(out), sum(n)
            self.forget(seen)

    def code(self, a: np.ndarray, b: np.ndarray, radices: int) -> np.ndarray:
        """Pairs as numbers in the order of radix, B id, A id."""
        return ((b % radices) * -(-self.n_b // radices) + b // radices) * self.n_a + a


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


class Block:
    """Documents until their links fill a block."""

    def __init__(self, made: Aligner):
        self.made = made
        self.a: list[bytes] = []
        self.b: list[bytes] = []
        self.rows: list[tuple] = []
        self.links = 0

    def add(self, doc_id: int | None, a: bytes, b: bytes, out: str, n_groups: int) -> None:
        n_a, n_b = len(a) // 4, len(b) // 4
        links = n_a + n_b - n_groups  # different ends of tokens
        sha = hashlib.sha256(out.encode()).hexdigest() if out else ""
        self.a.append(a)
        self.b.append(b)
        self.rows.append((doc_id, n_a, n_b, n_groups, links, sha))
        self.links += links

    def full(self, most_links: int) -> bool:
        return self.links >= most_links or len(self.rows) >= BLOCK_DOCS

    def parts(self, block: int, radices: int, frame: int) -> Iterator[dict]:
        names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "sha")
        yield {"block": block} | dict(zip(names, map(list, zip(*self.rows, strict=True)), strict=True))
        a = np.frombuffer(b"".join(self.a), "<u4").astype(np.int64)
        b = np.frombuffer(b"".join(self.b), "<u4").astype(np.int64)
        if not len(a):
            return
        end_a, end_b = np.cumsum(self.made.a_size[a]), np.cumsum(self.made.b_size[b])
        ends = np.concatenate([end_a, end_b])
        ends.sort(kind="stable")  # two rising runs
        ends = ends[np.append(True, ends[1:] != ends[:-1])]
        codes = self.made.code(a[np.searchsorted(end_a, ends)], b[np.searchsorted(end_b, ends)], radices)
        n = len(self.rows)
        key = codes * n + np.repeat(np.arange(n), [r[4] for r in self.rows])
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        times = np.diff(np.append(first, len(key)))
        codes, docs = np.divmod(key[first], n)
        start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))  # of each pair's records
        of_pair, total, with_docs = codes[start], np.add.reduceat(times, start), np.diff(np.append(start, len(codes)))
        bounds = np.append(start, len(codes))
        radix = of_pair // (-(-self.made.n_b // radices) * self.made.n_a)
        for r, low, high in _stretches_of(radix):
            for k in range(low, high, frame):
                top = min(k + frame, high)
                at = slice(bounds[k], bounds[top])
                yield {
                    "block": block,
                    "radix": r,
                    "first": int(of_pair[k]),
                    "pairs": pack_pairs(of_pair[k:top], total[k:top]),
                    "records": squeeze(with_docs[k:top], docs[at], times[at]),
                }


def _stretches_of(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each stretch of equal neighbours."""
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist()
    return zip(values[start].tolist(), start, [*start[1:], len(values)], strict=True)


def _arrow(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def _split(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, radices: int, frame: int, most_links: int) -> Iterator[pa.RecordBatch]:
    made = aligner(a_path, b_path)
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    block = Block(made)
    for batch in batches:
        texts = made.texts([t or "" for t in batch.column(1).to_pylist()])
        for doc_id, found in zip(batch.column(0).to_pylist(), texts, strict=True):
            block.add(doc_id, *found)
            if block.full(most_links):
                yield _arrow(list(block.parts(number, radices, frame)), PARTS)
                block, number = Block(made), number + 1
    if block.rows:
        yield _arrow(list(block.parts(number, radices, frame)), PARTS)


class Merge:
    """A heap of open frames that come in the order of their first pairs."""

    def __init__(self):
        #: (next pair, number, pairs, counts, how many are taken)
        self.open: list[tuple[int, int, np.ndarray, np.ndarray, int]] = []
        self.number = 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        heapq.heappush(self.open, (int(codes[0]), self.number, codes, counts, 0))
        self.number += 1

    def before(self, limit: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs and their sums below ``limit`` (all if None), which no later frame has."""
        codes, counts = [], []
        while self.open and (limit is None or self.open[0][0] < limit):
            _, number, own, times, start = heapq.heappop(self.open)
            end = len(own) if limit is None else int(np.searchsorted(own, limit))
            codes.append(own[start:end])
            counts.append(times[start:end])
            if end < len(own):
                heapq.heappush(self.open, (int(own[end]), number, own, times, end))
        if not codes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return sums(np.concatenate(codes), np.concatenate(counts))


def sums(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[start], np.add.reduceat(counts, start)


class Frames:
    """Pairs and counts gathered into frames."""

    def __init__(self, frame: int):
        self.frame, self.codes, self.more, self.size = frame, [], [], 0

    def add(self, codes: np.ndarray, *more: np.ndarray) -> None:
        self.codes.append(codes)
        self.more.append(more)
        self.size += len(codes)

    def take(self, rest: bool = False) -> Iterator[tuple[int, bytes]]:
        """(first pair, packed) of each whole frame; of all with ``rest``."""
        if not self.size or (self.size < self.frame and not rest):
            return
        codes = np.concatenate(self.codes)
        more = [np.concatenate(m) for m in zip(*self.more, strict=True)]
        end = len(codes) if rest else len(codes) - len(codes) % self.frame
        for k in range(0, end, self.frame):
            at = slice(k, min(k + self.frame, end))
            yield int(codes[k]), pack_pairs(codes[at], *(m[at] for m in more))
        self.codes, self.more, self.size = [codes[end:]], [tuple(m[end:] for m in more)], len(codes) - end


def _merged(batches: Iterator[pa.RecordBatch], frame: int, n_a: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (group, radix, first, pairs) in this order become frames of their groups' sums.

    With ``n_a`` each pair also says whether its count is the highest of its B
    id; pairs of the last B id are held back until another comes.
    """
    group, radix = None, None
    merge, frames = Merge(), Frames(frame)
    held: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def out(limit: int | None) -> list[dict]:
        nonlocal held
        codes, counts = merge.before(limit)
        if n_a is None:
            frames.add(codes, counts)
        else:
            codes, counts = np.append(held[0], codes), np.append(held[1], counts)
            b = codes // n_a
            whole = len(b) if limit is None else int(np.searchsorted(b, b[-1])) if len(b) else 0
            held = codes[whole:], counts[whole:]
            if whole:
                start = np.flatnonzero(np.append(True, b[1:whole] != b[: whole - 1]))
                top = np.repeat(np.maximum.reduceat(counts[:whole], start), np.diff(np.append(start, whole)))
                frames.add(codes[:whole], counts[:whole], (counts[:whole] == top).astype(np.int64))
        return [{"radix": radix, "first": f, "pairs": p} for f, p in frames.take(rest=limit is None)]

    for batch in batches:
        rows = []
        for key, own_radix, first, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != group:
                if group is not None:
                    rows += out(None)
                group, radix, merge, frames = key, own_radix, Merge(), Frames(frame)
            elif merge.number:
                rows += out(first)
            merge.add(*unpack_pairs(first, pairs))
        if rows:
            yield _arrow(rows, COUNTED)
    if group is not None:
        yield _arrow(out(None), COUNTED)


def _sums_by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, block or null for counts, first, pairs, records), counts first in each group."""
    group, counted = None, []
    for batch in batches:
        rows = []
        for key, block, first, pairs, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != group:
                group, counted = key, []
            if block is None:
                counted.append(unpack_pairs(first, pairs))
                continue
            if len(counted) > 1:
                counted = [[np.concatenate(c) for c in zip(*counted, strict=True)]]
            codes, counts, best = counted[0]
            at = np.searchsorted(codes, unpack_pairs(first, pairs)[0])
            with_docs, docs, times = unsqueeze(records)
            order = np.argsort(docs, kind="stable")
            docs = docs[order]
            start = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
            whole = np.repeat(counts[at], with_docs) * times
            highest = np.repeat(best[at], with_docs) * times
            by_doc = [np.add.reduceat(x[order], start) for x in (highest, whole)]
            rows.append({"block": block, "sums": squeeze(docs[start], *by_doc)})
        if rows:
            yield _arrow(rows, SUMS)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block, its documents first and then their sums, become rows of documents."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "sha"]
    columns, best, count = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows() -> pa.RecordBatch:
        *own, sha = columns
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in (*own, best, count)), pa.array(sha, pa.string())],
            names=[c.split()[0] for c in RESULT.split(", ")],
        )

    for batch in batches:
        of = {n: batch.column(n).to_pylist() for n in (*names, "sums")}
        for k, data in enumerate(of["sums"]):
            if data is None:
                if columns:
                    yield rows()
                columns = [of[n][k] for n in names]
                best, count = np.zeros(len(columns[0]), np.int64), np.zeros(len(columns[0]), np.int64)
            else:
                docs, more_best, more_count = unsqueeze(data)
                best[docs] += more_best
                count[docs] += more_count
    if columns:
        yield rows()


class Alignment:
    """Documents aligned, with their pair-document records in a table."""

    def __init__(
        self,
        docs: DataFrame,
        a_path: str,
        b_path: str,
        radices: int = RADICES,
        frame: int = FRAME,
        fan_in: int = FAN_IN,
        block_links: int = BLOCK_LINKS,
        doc_id: str = "doc_id",
        text: str = "text",
    ):
        prepare(docs.sparkSession)
        self.frame, self.radices, self.made = frame, radices, aligner(a_path, b_path)
        self.parts = written(
            docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(
                lambda batches: _split(batches, a_path, b_path, radices, frame, block_links), PARTS
            )
        )
        blocks = self.parts.where("radix IS NULL").count()
        self.slices = max(1, -(-blocks // fan_in))
        self.records = self.parts.where("radix IS NOT NULL").withColumn(
            "slice", F.pmod(F.xxhash64("block"), F.lit(self.slices)).cast("int")
        )

    def _merge(self, frames: DataFrame, key: list[str], n_a: int | None) -> DataFrame:
        frame = self.frame
        return (
            frames.withColumn("key", F.concat_ws(" ", *key))
            .select("key", "radix", "first", "pairs")
            .repartition("key")
            .sortWithinPartitions("key", "first")
            .mapInArrow(lambda batches: _merged(batches, frame, n_a), COUNTED)
        )

    def counted(self) -> DataFrame:
        """Frames of pairs with their counts and whether these are the highest of their B id."""
        frames = self.records
        if self.slices > 1:
            frames = self._merge(frames, ["radix", "slice"], None)
        return self._merge(frames, ["radix"], self.made.n_a)

    def pair_counts(self) -> DataFrame:
        """One row for each linked pair of ids: ``a``, ``b``, ``count``, ``best``."""
        n_a, radices = self.made.n_a, self.radices
        per = -(-self.made.n_b // radices)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, first, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    codes, counts, best = unpack_pairs(first, pairs)
                    slot = codes // n_a
                    b = slot % per * radices + slot // per
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(codes % n_a), pa.array(b), pa.array(counts), pa.array(best == 1)],
                        names=["a", "b", "count", "best"]
                    )

        return self.counted().mapInArrow(rows, "a long, b long, count long, best boolean")

    def documents(self) -> DataFrame:
        """One row per document: tokens, groups, links and what the corpus counts say of the links."""
        kept = written(self.counted())
        slices = F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1))).alias("slice")
        no_block = F.lit(None).cast("long").alias("block")
        dictionary = kept.select("radix", slices, no_block, "first", "pairs", F.lit(None).cast("binary").alias("records"))
        records = self.records.select("radix", "slice", "block", "first", "pairs", "records")
        sums = (
            dictionary.union(records)
            .repartition("radix", "slice")
            .sortWithinPartitions("radix", "slice", F.col("block").asc_nulls_first(), "first")
            .select(F.concat_ws(" ", "radix", "slice").alias("key"), "block", "first", "pairs", "records")
            .mapInArrow(_sums_by_document, SUMS)
        )
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "sha"]
        own = self.parts.where("radix IS NULL").select("block", *names, F.lit(None).cast("binary").alias("sums"))
        empty = [F.lit(None).cast(own.schema[n].dataType).alias(n) for n in names]
        return (
            own.union(sums.select("block", *empty, "sums"))
            .repartition("block")
            .sortWithinPartitions("block", F.col("sums").isNotNull())
            .mapInArrow(_documents, RESULT)
        )


def align(docs: DataFrame, a_path: str, b_path: str, **options) -> DataFrame:
    """See ``Alignment.documents``."""
    return Alignment(docs, a_path, b_path, **options).documents()


def groups(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The groups of each document in writing: ``a1,a2|b1;a3|b2,b3``, empty without tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(a_path, b_path)
        for batch in batches:
            out = [g[2] for g in made.texts([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "groups"])

    return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(rows, "doc_id long, groups string")
