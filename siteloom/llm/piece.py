"""SentencePiece encoding and decoding with a BPE model, by vectorised merge rounds.

The words that a batch shows for the first time lie behind one another in flat
numpy arrays of symbols.  Each round takes the least rank of a pair of
neighbours in every word, merges the leftmost pairs of that rank in all words at
once, and closes the gaps; a word leaves when no pair of it is in the
vocabulary.  Encodings of short words are remembered, in bounded memory.

A round may merge several pairs of a word only where a pair that arises from a
merge doesn't come before those still to merge (a rank as low or lower).  From
the first such pair on the word waits for the next round, so the order is that
of one merge at a time, the leftmost of equals first.

Words are cut before a space after another character, which is exact as no
piece of the vocabulary holds a space there (checked when the model is read), and,
if long, between characters that are neighbours in no piece.

Defined results: a null text is an empty one, with no ids; texts and words of
any length are encoded whole; rows that repeat give equal rows; an empty table
gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: A word, with the spaces before it.
WORD = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
#: Marks that may follow a word; they are encoded by themselves where no piece joins them to it.
MARKS = ".,;:!?)\"'"
NONE = np.iinfo(np.int64).max
#: Words beyond this many characters are cut further where that is exact.
LONG_WORD = 64
#: Characters of new words that go through the rounds together.
AT_ONCE = 400_000

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Pieces, their pairs and ranks, read from a model by its library."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = self.model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.unknown = model.unk_id()
        bytes_of = {self.pieces[i]: i for i in range(size) if model.is_byte(i)}
        self.byte_ids = [bytes_of.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids) if i != self.unknown}
        self.falls_back = bool(bytes_of)

        # symbols: the pieces, then characters that occur in pieces only
        number = {self.pieces[i]: i for i in plain}
        self.characters = {p: i for p, i in number.items() if len(p) == 1}
        for p in list(number):
            for c in p:
                if c not in number:
                    number[c] = self.characters[c] = size + len(number)
        self.n_symbols = max(number.values(), default=0) + 2
        self.symbol_of = np.full(sys.maxunicode + 1, -1, np.int64)
        self.symbol_of[[ord(c) for c in self.characters]] = list(self.characters.values())
        self.names = [str(i) for i in range(size)]
        #: what a piece says; nothing for control pieces
        self.said = ["" if model.is_control(i) else " ⁇ " if i == self.unknown else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.strings = {i: p for p, i in number.items()}
        ranks = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        keys, rank, merged = [], [], []
        self.together: set[str] = set()
        for i in plain:
            p = self.pieces[i]
            for k in range(1, len(p)):
                self.together.add(p[k - 1 : k + 1])
                left, right = number.get(p[:k]), number.get(p[k:])
                if left is not None and right is not None:
                    keys.append(left * self.n_symbols + right)
                    rank.append(ranks[model.get_score(i)])
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], NONE)
        self.ranks = np.append(np.array(rank, np.int64)[order], NONE)
        self.merged = np.append(np.array(merged, np.int64)[order], -1)
        self.cut_at_space = not any(b == SPACE and a != SPACE for a, b in self.together)
        #: lengths of the pieces of spaces, if these have the least score of all
        runs = [i for i in plain if len(self.pieces[i]) > 1 and not self.pieces[i].strip(SPACE)]
        last = {min(map(model.get_score, plain))} == set(map(model.get_score, runs))
        self.space_runs = [len(self.pieces[i]) for i in runs] if last else []

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; ``NONE`` where it is no piece."""
        key = left * self.n_symbols + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), self.merged[at]


class Encoder:
    def __init__(self, path: str, remember: int = 400_000, longest: int = 48):
        self.vocabulary = Vocabulary(path)
        self.remember, self.longest = remember, longest
        #: word -> its ids as little-endian unsigned 32-bit bytes, in decimal, and decoded
        self.young: dict[str, tuple[bytes, str, str]] = {}
        self.old: dict[str, tuple[bytes, str, str]] = {}
        self.most_spaces = self._most_spaces()

    def _most_spaces(self) -> int:
        """The length of the pieces into which a long run of spaces falls from the left, or 0.

        Runs merge last and the leftmost first, so if the longest piece stands
        before any rest, it is made of the first spaces before others are met.
        """
        longest = max(self.vocabulary.space_runs, default=0)
        runs = self.merge([SPACE * n for n in range(longest, 2 * longest + 1)])
        return longest if all(self.vocabulary.strings[r[0]] == SPACE * longest for r in runs) else 0

    def words(self, text: str) -> list[str]:
        """Words of the normalised text: spaces are ``▁``, one of them before the text."""
        if not text:
            return []
        if not self._plain(text):
            text = self.vocabulary.model.normalize(text)
        else:
            text = " " + text
        return self.split(text.replace(" ", SPACE))

    def split(self, text: str) -> list[str]:
        """Words of a text that is normalised."""
        words = WORD.findall(text) if self.vocabulary.cut_at_space else [text]
        if max(map(len, words), default=0) <= LONG_WORD:
            return words
        return [part for w in words for part in ([w] if len(w) <= LONG_WORD else self._cut(w))]

    @cached_property
    def lossless(self) -> bool:
        """Whether what ids say is always the text, but for its signs of a space."""
        return self._identity and self.vocabulary.falls_back

    @cached_property
    def _identity(self) -> bool:
        """Whether the model's normaliser only marks spaces and puts one in front."""
        probe = "".join(chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000) + "ﬁＡ  a  "
        return self.vocabulary.model.normalize(probe) == SPACE + probe.replace(" ", SPACE)

    def _plain(self, text: str) -> bool:
        return self._identity and "\x00" not in text

    def _cut(self, word: str) -> list[str]:
        """A long word in parts that no piece joins."""
        together, most = self.vocabulary.together, self.most_spaces
        parts = []
        bare = word.lstrip(SPACE)
        spaces = len(word) - len(bare)
        if most and spaces - 1 > most:  # the last space may belong to what follows
            whole = (spaces - 1) // most
            parts = [SPACE * most] * whole
            word = word[whole * most :]
        start = 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in together:
                parts.append(word[start:k])
                start = k
        parts.append(word[start:])
        return parts

    def learn(self, words: set[str]) -> None:
        """Make sure that all these words are remembered until the next call."""
        if len(self.young) > self.remember:
            self.young, self.old = {}, self.young
        new = words.difference(self.young)
        for w in new:
            if w in self.old:
                self.young[w] = self.old[w]
        missing = [w for w in new if w not in self.young]
        split = {}
        for w in missing:
            word = w.rstrip(MARKS)
            if 0 < len(word) < len(w) and w[len(word) - 1 : len(word) + 1] not in self.vocabulary.together:
                split[w] = word
        parts = {part for w, word in split.items() for part in (word, w[len(word) :])}
        whole = [*(w for w in missing if w not in split), *parts.difference(self.young, missing)]
        size, group = 0, []
        for w in whole:
            group.append(w)
            size += len(w)
            if size >= AT_ONCE:
                self._learn(group)
                size, group = 0, []
        self._learn(group)
        for w, before in split.items():
            word, marks = self.young[before], self.young[w[len(before) :]]
            self.young[w] = word[0] + marks[0], f"{word[1]},{marks[1]}", word[2] + marks[2]
        self.forget(parts.difference(words))

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of each word (without spaces inside) as bytes; nothing is remembered."""
        parts: dict[str, bytes] = {}
        cut = []
        for w in words:
            own = []
            for part in [w] if len(w) <= LONG_WORD else self._cut(w):
                word = part.rstrip(MARKS)
                if 0 < len(word) < len(part) and part[len(word) - 1 : len(word) + 1] not in self.vocabulary.together:
                    own += [word, part[len(word) :]]
                else:
                    own.append(part)
            cut.append(own)
            parts.update(dict.fromkeys(own, b""))
        names, size, group = list(parts), 0, []
        for k, w in enumerate(names):
            group.append(w)
            size += len(w)
            if size >= AT_ONCE or k == len(names) - 1:
                symbols, ends = self._merged(group)
                odd = (symbols < 0) | (symbols >= len(self.vocabulary.pieces))
                data = symbols.astype("<u4").tobytes()
                starts = [0, *ends[:-1].tolist()]
                for part, a, b, more in zip(group, starts, ends.tolist(), np.add.reduceat(odd, starts).tolist(), strict=True):
                    parts[part] = np.array(self._with_bytes(symbols[a:b].tolist()), "<u4").tobytes() if more else data[4 * a : 4 * b]
                size, group = 0, []
        return [parts[own[0]] if len(own) == 1 else b"".join([parts[p] for p in own]) for own in cut]

    def forget(self, words: set[str]) -> None:
        """Long words aren't kept."""
        for w in words:
            if len(w) > self.longest:
                self.young.pop(w, None)

    def _learn(self, words: list[str]) -> None:
        """Merge these words and remember them."""
        v = self.vocabulary
        symbols, ends = self._merged(words)
        plain = (symbols >= 0) & (symbols < len(v.pieces))
        odd = np.add.reduceat(~plain, np.append(0, ends[:-1])) if len(words) else []
        data, flat = symbols.astype("<u4").tobytes(), symbols.tolist()
        start = 0
        for word, end, characters in zip(words, ends.tolist(), odd, strict=True):
            if characters:
                ids = self._with_bytes(flat[start:end])
                self.young[word] = np.array(ids, "<u4").tobytes(), ",".join(map(str, ids)), self.surface(ids)
            else:
                ids = flat[start:end]
                self.young[word] = data[4 * start : 4 * end], ",".join([v.names[i] for i in ids]), "".join([v.said[i] for i in ids])
            start = end

    def _with_bytes(self, symbols: list[int]) -> list[int]:
        v, ids = self.vocabulary, []
        for s in symbols:
            if 0 <= s < len(v.pieces):
                ids.append(s)
            else:
                text = v.strings[s] if s >= 0 else chr(-s - 1)
                ids += [v.byte_ids[b] for b in text.encode("utf-8", "surrogatepass")] if v.falls_back else [v.unknown]
        return ids

    def merge(self, words: list[str]) -> list[list[int]]:
        """Symbols of each word after all merges; a character without a symbol is minus its code, less one."""
        symbols, ends = self._merged(words)
        return [part.tolist() for part in np.split(symbols, ends[:-1])] if words else []

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge``, the symbols of all words behind one another and where each word ends."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        symbols = self.vocabulary.symbol_of[codes]
        symbols = np.where(symbols < 0, -codes - 1, symbols)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = self._pairs(symbols, word)
        while len(symbols):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, start)
            sizes = np.diff(np.append(start, len(word)))
            least_of = np.repeat(least, sizes)
            over = least_of == NONE
            if over.any():
                done.append((word[over], symbols[over]))
                symbols, word, rank, made, least_of = (x[~over] for x in (symbols, word, rank, made, least_of))
                if not len(symbols):
                    break
            chosen = self._chosen(symbols, word, rank, made, least_of)
            symbols[chosen] = made[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[chosen] = True
            symbols, word, rank, made, changed = (x[keep] for x in (symbols, word, rank, made, changed))
            again = np.flatnonzero(changed | np.append(changed[1:], False))
            rank[again], made[again] = self._pairs_at(symbols, word, again)
        if not done:
            return symbols, np.zeros(len(words), np.int64)
        of_word = np.concatenate([d[0] for d in done])
        order = np.argsort(of_word, kind="stable")
        return np.concatenate([d[1] for d in done])[order], np.cumsum(np.bincount(of_word, minlength=len(words)))

    def _pairs(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._pairs_at(symbols, word, np.arange(len(symbols)))

    def _pairs_at(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that begin at these places."""
        after = np.minimum(at + 1, len(symbols) - 1)
        rank, made = self.vocabulary.pair(symbols[at], symbols[after])
        rank[(after == at) | (word[at] != word[after])] = NONE
        return rank, made

    def _chosen(self, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Places of the pairs that merge in this round."""
        at = np.flatnonzero(rank == least)
        # of pairs that overlap in a chain every other one, from the left
        first = np.append(True, at[1:] != at[:-1] + 1)
        place = np.arange(len(at))
        at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
        # a pair that would arise and not come later than the rest ends its word's round
        n, last = len(symbols), len(symbols) - 1
        own, result = word[at], made[at]
        right = np.minimum(at + 2, last)
        to_right, _ = self.vocabulary.pair(result, symbols[right])
        to_right[(at + 2 >= n) | (word[right] != own)] = NONE
        left = np.maximum(at - 1, 0)
        joined = np.append(False, at[1:] == at[:-1] + 2)  # the left neighbour has just been merged
        before = np.where(joined, np.append(0, result[:-1]), symbols[left])
        to_left, _ = self.vocabulary.pair(before, result)
        to_left[(at == 0) | (word[left] != own)] = NONE
        early = np.minimum(to_left, to_right) <= least[at]
        if not early.any():
            return at
        count = np.cumsum(early) - early  # early ones before each
        base = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), count, 0))
        return at[count == base]

    def surface(self, ids: list[int]) -> str:
        """What ids say: pieces with their spaces, bytes as UTF-8 (``U+FFFD`` for each that is none)."""
        v = self.vocabulary
        out, run = [], bytearray()
        for i in ids:
            if i in v.byte_of:
                run.append(v.byte_of[i])
                continue
            if run:
                out.append(_utf8(run))
                run.clear()
            out.append(v.said[i])
        return "".join(out) + (_utf8(run) if run else "")

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        self.learn(set(words))
        return np.frombuffer(b"".join(self.young[w][0] for w in words), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the one space that encoding puts in front goes."""
        first = next((i for i in ids if not self.vocabulary.model.is_control(i)), 0)
        text = self.surface(ids)
        return text.removeprefix(" ") if self.vocabulary.pieces[first][:1] == SPACE else text


def _utf8(run: bytearray) -> str:
    """Bytes as UTF-8, each byte that begins no whole character as ``U+FFFD``."""
    out, at, data = [], 0, bytes(run)
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def groups(made: Encoder, texts: list[str]) -> Iterator[list[list[str]]]:
    """Lists of words of some texts at a time, all of them remembered until the next are asked for."""
    group: list[list[str]] = []
    size = 0
    for k, text in enumerate(texts):
        group.append(made.words(text))
        size += len(text)
        if size >= AT_ONCE or k == len(texts) - 1:
            seen = set().union(*group)
            made.learn(seen)
            yield group
            made.forget(seen)
            group, size = [], 0


def _rows(batches: Iterator[pa.RecordBatch], path: str, row, schema: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    made = encoder(path)
    for batch in batches:
        rows = []
        for group in groups(made, [t or "" for t in batch.column(1).to_pylist()]):
            known = made.young
            for words in group:
                rows.append(row([known[w] for w in words]))
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(columns, schema, strict=True))],
            names=["doc_id", *(name for name, _ in schema)],
        )


def _decoded(parts: list[tuple[bytes, str, str]]) -> str:
    return "".join([p[2] for p in parts]).removeprefix(" ")  # the space put in front


def encode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids (little-endian unsigned 32-bit) and the text decoded from them."""
    schema = [("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())]

    def row(parts: list[tuple[bytes, str, str]]) -> tuple:
        ids = b"".join([p[0] for p in parts])
        return len(ids) // 4, ids, _decoded(parts)

    return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(
        lambda batches: _rows(batches, model_path, row, schema), SCHEMA
    )


def encode_digests(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encode``, with digests in place of ids and text, which stay in their task."""
    schema = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def row(parts: list[tuple[bytes, str, str]]) -> tuple:
        ids = ",".join([p[1] for p in parts]).encode()
        decoded = _decoded(parts).encode("utf-8", "surrogatepass")
        return sum([len(p[0]) for p in parts]) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(
        lambda batches: _rows(batches, model_path, row, schema), DIGESTS
    )
