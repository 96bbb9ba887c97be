"""Byte-level BPE by prefixes: each prefix of a byte string has one valid last token.

An encoding is a BPE result exactly if every two neighbours are one for their joined bytes. So the last
token of a prefix is the one token that ends there, is its own encoding, and stands well beside the last
token of what is left of it. The table of last tokens gives the encoding of every prefix, takes appended
bytes without another look at the earlier ones, and is redone after an edit only until it agrees again.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from tracklane.llm.memory import only
from tracklane.llm.pieces import TextEncoder
from tracklane.llm.vocab import public_pattern

NEVER = float("inf")


class Vocabulary:
    """Token bytes and ranks; joins of lower rank come first, the leftmost first among equals."""

    def __init__(self, ranks: dict[bytes, int], remember: int = 1_000_000):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._edges: dict[int, tuple[list, list] | None] = {}
        self._beside: dict[int, bool] = {}
        self._remember = remember
        self.usable = {token: rank for token, rank in ranks.items() if self.edges(rank) is not None}
        begins, closes = ({part(t, i) for t in ranks for i in range(1, len(t))} for part in (lambda t, i: t[:i], lambda t, i: t[i:]))
        self._begins = {rank for token, rank in ranks.items() if token in begins}
        self._closes = {rank for token, rank in ranks.items() if token in closes}
        self._rights: dict[int, list] = {}
        self._lefts: dict[int, list] = {}

    def _last_join(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose join makes ``token``; None if its bytes don't become that one token."""
        parts = [self.ranks[bytes([b])] for b in self.bytes[token]]
        while len(parts) > 2:
            joins = [(self.ranks.get(self.bytes[a] + self.bytes[b], NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(joins)
            if rank >= token:
                return None
            parts[i : i + 2] = [rank]
        return tuple(parts) if len(parts) == 2 else None

    def edges(self, token: int) -> tuple[list, list] | None:
        """Tokens at the left and at the right edge while ``token`` is put together, each with the rank of the
        join that ends it; None for a token that no text gives."""
        if token not in self._edges:
            found: tuple[list, list] | None = ([(token, NEVER)], [(token, NEVER)])
            if len(self.bytes[token]) > 1:
                join = self._last_join(token)
                left, right = (self.edges(join[0]), self.edges(join[1])) if join else (None, None)
                if left is None or right is None:
                    found = None
                else:
                    found[0].extend((t, min(until, token)) for t, until in left[0])
                    found[1].extend((t, min(until, token)) for t, until in right[1])
            self._edges[token] = found
        return self._edges[token]

    def beside(self, left: int, right: int) -> bool:
        """Whether the bytes of both together are encoded as just these two."""
        known = self._beside.get(left << 32 | right)
        if known is None:
            known = self._apart(left, right)
            if len(self._beside) >= self._remember:
                self._beside.clear()
            self._beside[left << 32 | right] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        # Only tokens that some token begins with, and such that some token ends with, can be joined.
        rights, lefts, rank = self._rights.get(left), self._lefts.get(right), self.ranks.get
        if rights is None:
            rights = self._rights[left] = [(self.bytes[t], until) for t, until in self.edges(left)[1] if t in self._begins]
        if lefts is None:
            lefts = self._lefts[right] = [(self.bytes[t], until) for t, until in self.edges(right)[0] if t in self._closes]
        for a, a_until in rights:
            for b, b_until in lefts:
                join = rank(a + b)
                # Of equal joins the leftmost is done first: one inside `left` before this, one inside `right` after.
                if join is not None and join < a_until and join <= b_until:
                    return False
        return True

    def extend(self, data: bytes, last: list[int], end: int) -> None:
        """Append the last tokens of the next prefixes of ``data``, up to that of length ``end``."""
        usable, known = self.usable, self._beside
        for at in range(len(last), end + 1):
            for start in range(max(0, at - self.longest), at):
                token = usable.get(data[start:at])
                if token is None:
                    continue
                if start:
                    fits = known.get(last[start] << 32 | token)
                    if not (self.beside(last[start], token) if fits is None else fits):
                        continue
                last.append(token)
                break
            else:
                raise ValueError("the vocabulary lacks single bytes")


class PrefixEncoding:
    """A byte string with the last token of each of its prefixes; ``last[0]`` stands for the empty one."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.vocabulary.extend(self.data, self.last, len(self.data))

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put ``data`` in place of ``[start, end)``; gives the number of prefixes that were looked at again."""
        before, moved = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        self.last = before[: start + 1]
        same, edited = 0, start + len(data)
        for at in range(start + 1, len(self.data) + 1):
            self.vocabulary.extend(self.data, self.last, at)
            # A last token depends on those at most one token's length before it, all of them behind the edit.
            same = same + 1 if at > edited and self.last[at] == before[at - moved] else 0
            if same >= self.vocabulary.longest:
                self.last += before[at - moved + 1 :]
                return at - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes[self.last[end]])
        return out[::-1]


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


def prefix_encoder(path: str) -> TextEncoder:
    return only(("prefix", path), lambda: _prefix_encoder(path))


def _prefix_encoder(path: str) -> TextEncoder:
    vocabulary = load(path)

    def ids(word: str) -> bytes:
        return array("I", PrefixEncoding(vocabulary, word.encode()).tokens()).tobytes()

    return TextEncoder(ids, public_pattern())


def encode(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Ids of every whole text: ``id``, ``ids array<int>``. A null or empty text has no ids; rows are kept one
    by one, repeated ones and those without an id too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_encoder(path)
        for batch in batches:
            for part in small(batch):
                ids = [np.frombuffer(encoder.encode(t), "<i4") for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), int_lists(ids)], names=[id, "ids"])

    kept = docs.select(id, text)
    return kept.mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the bytes of all ids of a row; null ids give no bytes."""
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load(path).bytes
        for batch in batches:
            for part in small(batch):
                column = part.column(part.schema.get_field_index(ids))
                texts = [b"".join(map(tokens.__getitem__, row)) if row else b"" for row in column.to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def small(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that what is made of it at a time stays small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def int_lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
