"""Encoders over the vocabulary files of public tokenizers, made once per Python worker."""

from __future__ import annotations

import json
import re
from array import array

from tracklane.llm.memory import only
from tracklane.llm.pieces import TextEncoder


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class AddedTokens:
    """Encodes texts in which the added tokens of a vocabulary stand for their ids; ``between`` encodes the rest.

    As in the library, the leftmost token is taken first and the longest of those that start there.
    """

    def __init__(self, tokens: dict[str, int], between: TextEncoder):
        self._ids = {token: array("I", [i]).tobytes() for token, i in tokens.items()}
        self._between = between
        longest_first = sorted(tokens, key=len, reverse=True)
        self._split = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split

    def encode(self, text: str | None) -> bytes:
        if not text or not any(token in text for token in self._ids):
            return self._between.encode(text)
        parts = self._split(text)  # stretches between tokens at even places
        return b"".join(self._ids[part] if i % 2 else self._between.encode(part) for i, part in enumerate(parts))


def library_encoder(path: str, added: bool = False) -> TextEncoder | AddedTokens:
    """``_library_encoder`` of this worker, with what it remembers."""
    return only(("library", path, added), lambda: _library_encoder(path, added))


def _library_encoder(path: str, added: bool) -> TextEncoder | AddedTokens:
    """Ids by the tokenizers library. Words go to its BPE model one by one, spelled in the letters that stand
    for bytes. With ``added``, the added tokens of the file are found in a text as by the library as it is loaded;
    without, their strings are ordinary text, as under its ``encode_special_tokens``."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    model = library.model
    shown = {b: b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    letters = {b: shown.get(b, 256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)} | shown

    letters_space = chr(letters[32])

    def ids(word: str) -> bytes:
        # Of the printable ASCII signs only the space is spelled otherwise.
        plain = word.isascii() and word.isprintable()
        spelled = word.replace(" ", letters_space) if plain else word.encode().decode("latin-1").translate(letters)
        return array("I", [t.id for t in model.tokenize(spelled)]).tobytes()

    words = TextEncoder(ids, public_pattern())
    tokens = json.loads(library.to_str())["added_tokens"] if added else []
    if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with conditions on their surroundings are not supported")
    return AddedTokens({t["content"]: t["id"] for t in tokens}, words) if tokens else words
