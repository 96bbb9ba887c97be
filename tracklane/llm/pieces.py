"""Whole texts encoded piece by piece with bounded caches, for byte-level BPE vocabularies.

The splitting pattern of these vocabularies always ends a match before a space that follows another
character than white space, and before a space that another character than white space follows. A text
cut at such spaces can therefore be encoded piece by piece, and equal pieces need work only once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

# Spaces with white space on both sides (or at the end) are the only ones at which a text may not be cut.
_INNER_SPACE = re.compile(r" (?<=\s )(?:\s|\Z)")  # the space first: it is what a search can look for
_CUT = re.compile(r"(?<!\s) | (?=\S)")
LONG_PIECE = 200
LATIN_END = "\u0250"
MARKS = frozenset(".,")


def cut(text: str) -> list[str]:
    """Pieces of ``text``, each but the first without its leading space."""
    if _INNER_SPACE.search(text):
        return _CUT.split(text)
    return text.split(" ")


class Cache(dict):
    """Results for short strings; emptied when it holds ``limit`` of them."""

    def __init__(self, make: Callable[[str], object], limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, key: str):
        made = self.make(key)
        if len(key) <= LONG_PIECE:
            if len(self) >= self.limit:
                self.clear()
            self[key] = made
        return made


class TextEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``encode_word`` gives the ids of one match of ``pattern``. ``limit`` bounds the pieces that are remembered;
    a full cache is emptied. A null text is empty.
    """

    def __init__(self, encode_word: Callable[[str], bytes], pattern: str, limit: int = 1_000_000):
        self._matches = regex.compile(pattern).findall
        self._word = encode_word
        self._words = Cache(encode_word, limit // 10)  # of pieces that are not one word
        self._pieces = Cache(self._spaced, limit)

    def _spaced(self, piece: str) -> bytes:
        # Latin letters alone are one match, as is a mark behind them; the pattern sees to everything else.
        if piece.isalpha() and (piece.isascii() or max(piece) < LATIN_END):
            return self._word(" " + piece)
        if piece[-1:] in MARKS and piece[:-1].isalpha() and (piece.isascii() or max(piece) < LATIN_END):
            return self._pieces[piece[:-1]] + self._words[piece[-1]]  # most of these words stand alone too
        return self._of(" " + piece)

    def _of(self, text: str) -> bytes:
        return b"".join(map(self._words.__getitem__, self._matches(text)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = cut(text)
        first = self._of(pieces.pop(0))
        return first + b"".join(map(self._pieces.__getitem__, pieces))
