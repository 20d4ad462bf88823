"""Texts cut where no token of a byte-level BPE crosses, with a bounded memory."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: White space by Unicode, as pre-tokenizers see it (fixed values).
SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
#: White space, then other characters: no token crosses from these into white space.
STRETCH = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Marks that may follow a word; no token crosses from an ASCII letter into one.
MARKS = ".,;:!?)\"'"
AT_ONCE = 400_000


class StretchCache:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    ``encode_many`` gives the ids of stretches; those of short ones are kept in
    two generations of ``remember`` entries each, so the memory is bounded.  A
    stretch met for the first time is a word and the marks after it, if it ends
    in marks, and the word may be known.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], remember: int = 400_000, longest: int = 48):
        self.encode_many, self.remember, self.longest = encode_many, remember, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text; what is new in about ``AT_ONCE`` characters is encoded together."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(STRETCH.findall(text))
            size += len(text)
            if size >= AT_ONCE:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[list[str]]) -> Iterator[bytes]:
        if len(self.young) > self.remember:
            self.young, self.old = {}, self.young
        known = self.young
        new = set().union(*group).difference(known)
        self._recall(new)
        split = {}
        for s in new:
            word = s.rstrip(MARKS)
            if len(word) < len(s) and word[-1:].isascii() and word[-1:].isalpha():
                split[s] = word
        parts = set(split.values())
        parts.update(s[len(word) :] for s, word in split.items())
        parts = parts.difference(known)
        self._recall(parts)
        missing = list(parts.union(new.difference(split)))
        known.update(zip(missing, self.encode_many(missing), strict=True))
        for s, word in split.items():
            known[s] = known[word] + known[s[len(word) :]]
        for stretches in group:
            yield b"".join(map(known.__getitem__, stretches))
        for s in [s for s in (*missing, *split) if len(s) > self.longest]:
            known.pop(s, None)

    def _recall(self, stretches: set[str]) -> None:
        """Those of the older generation become young and leave the set."""
        again = [s for s in stretches if s in self.old]
        self.young.update((s, self.old[s]) for s in again)
        stretches.difference_update(again)
