"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

The cost of a run of ``n`` tokens of one document is ``linear * n + quadratic * n * n``: attention stays inside
a document. Runs are dealt in descending order, each to the cheapest sequence that has room for it; where none
has, it is cut at the largest room. Documents are packed window by window inside a Spark partition, so packing
needs no shuffle and holds one window of ids at a time. A window's rooms add up to its tokens: whole
sequences, and shorter ones at powers of two for the rest, so that no sequence needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracklane.llm.bpe import small
from tracklane.llm.vocab import library_encoder


@dataclass(frozen=True)
class Packing:
    """``window`` is the number of tokens packed together; a window ends with the document that fills it."""

    capacity: int = 2048
    end_id: int = 1
    window: int = 1 << 20
    linear: float = 1.0
    quadratic: float = 1 / 1024


def rooms(total: int, capacity: int) -> np.ndarray:
    """Sizes of sequences that ``total`` tokens fill without padding."""
    whole, rest = divmod(total, capacity)
    return np.array([capacity] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


def balance(lengths: list[int], rule: Packing) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every run; all of each document, nothing twice."""
    runs = []
    for doc, n in enumerate(lengths):
        runs += [(min(rule.capacity, n - start), doc, start) for start in range(0, n, rule.capacity)]
    runs.sort(key=lambda r: (-r[0], r[1], r[2]))
    size = rooms(sum(lengths), rule.capacity)
    free, cost, placed = size.copy(), np.zeros(len(size)), []
    for n, doc, start in runs:
        while n:
            fits = free >= n
            where = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(free))
            part = min(n, int(free[where]))
            placed.append((doc, start, part, where, int(size[where] - free[where])))
            free[where] -= part
            cost[where] += rule.linear * part + rule.quadratic * part * part
            n, start = n - part, start + part
    return placed


def pack(
    docs: DataFrame, path: str, rule: Packing = Packing(), text: str = "text", id: str = "doc_id", added: bool = False
) -> DataFrame:
    """One row per run: ``id``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id``, ``offset``, ``sequence_length``.

    A null or empty text is its end id alone. Repeated rows are packed like others, each on its own. ``added``
    tokens of the vocabulary are found in texts, or else taken as ordinary text.
    """
    kind = docs.schema[id].dataType.simpleString()
    schema = (
        f"`{id}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
        "offset bigint, sequence_length bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = library_encoder(path, added), np.array([rule.end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        names, ids, id_type, tokens = [], [], None, 0

        def packed() -> pa.RecordBatch:
            nonlocal first
            lengths = [len(x) // 4 for x in ids]
            rows = balance(lengths, rule)
            size = rooms(sum(lengths), rule.capacity)
            doc, start, length, where, offset = np.array(rows, np.int64).T
            out = pa.record_batch([
                pa.array(names, id_type).take(pa.array(doc)), pa.array(start), pa.array(length),
                pa.array([ids[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in rows], pa.binary()),
                pa.array(np.array(lengths, np.int64)[doc]), pa.array(where + first), pa.array(offset), pa.array(size[where]),
            ], names=[id, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length"])
            first += len(size)
            return out

        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in small(batch):
                for name, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    names.append(name)
                    ids.append(encoder.encode(t) + end)
                    tokens += len(ids[-1]) // 4
                    if tokens >= rule.window:
                        yield packed()
                        names, ids, tokens = [], [], 0
        if ids:
            yield packed()

    return docs.select(id, text).mapInArrow(run, schema)
