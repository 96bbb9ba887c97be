"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine ``c`` are ``2 - 2c`` apart in squared distance, before and after a rotation. The rotated
vectors are split into blocks of few dimensions, and the squared distance allowed is shared out in proportion to
their dimensions: a pair within the whole is within the share of one block at least. Each block is joined by
range on a grid over its first two coordinates, and what any block finds is verified on the vectors themselves.

A pair counts in the first block that allows it, so nothing has to be made distinct. The tasks give out, for
each vector, a number of links, and as many links as hold its groups together, never all pairs. Equal vectors of
a label are one class with a weight. Cells with many vectors are cut into parts that meet two at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.bpe import small
from tracklane.llm.components import components
from tracklane.session import settle

PAIRS_AT_ONCE = 20_000


@dataclass(frozen=True)
class Alike:
    """``part`` is the number of vectors of a cell that a task takes from either side."""

    cosine: float = 0.93
    block_width: int = 8
    part: int = 4096
    slack: float = 1e-5  # over the rounding of rotated vectors to 32 bits
    seed: int = 3


@lru_cache(maxsize=8)
def _blocks(width: int, rule: Alike) -> tuple[np.ndarray, list[slice], np.ndarray]:
    """Rotation, blocks and squared-distance shares for vectors of ``width`` components."""
    rotation, _ = np.linalg.qr(np.random.default_rng(rule.seed).normal(size=(width, width)))
    blocks = [slice(i, min(i + rule.block_width, width)) for i in range(0, width, rule.block_width)]
    share = np.array([b.stop - b.start for b in blocks]) / width
    return rotation, blocks, (2 - 2 * rule.cosine) * share + rule.slack


def usable_vector(vec: str, label: str) -> str:
    """SQL condition: a label, and finite components that are not all zero."""
    return (
        f"`{label}` IS NOT NULL AND `{vec}` IS NOT NULL AND exists(`{vec}`, x -> x != 0) AND "
        f"forall(`{vec}`, x -> x IS NOT NULL AND abs(x) < double('infinity'))"  # NaN is above it
    )


def links(vectors: DataFrame, rule: Alike = Alike(), id: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``vectors``: ``id``, ``n_links``, ``component_id``, ``kept``.

    Vectors without a label, null, zero, or with null or non-finite components are linked with nothing, and so
    are rows without an id (their ``component_id`` is null). Vectors of different lengths are not linked.
    Repeated rows are vectors of their own, linked with each other.
    """
    fit = F.expr(usable_vector(vec, label)) & F.col(id).isNotNull()
    keys = [F.xxhash64(label, vec), F.xxhash64(F.lit(rule.seed), vec, label)]
    marked = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("vec"), *(
        F.when(fit, k).alias(n) for k, n in zip(keys, ("k1", "k2"))
    ))
    members = settle(marked.select("id", "k1", "k2"))
    classes = settle(
        marked.where("k1 IS NOT NULL").groupBy("k1", "k2")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    )
    found = settle(_meet(_posted(classes.drop("k1", "k2"), rule), rule))
    counts = found.where("other IS NULL").groupBy("rep").agg(F.sum("n").alias("n"))
    groups = components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    # An id may stand in several classes; its rows are told apart by class.
    of_class = (
        classes.select("k1", "k2", "rep", "weight").join(counts, "rep", "left")
        .join(groups, F.col("rep") == F.col("node"), "left")
        .select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    component = F.coalesce("component", "id")
    return members.join(of_class, ["k1", "k2"], "left").select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _posted(classes: DataFrame, rule: Alike) -> DataFrame:
    """A row per class, block and cell that it lives in or may have a partner in.

    A pair in two cells meets in the later of them, so a class visits later cells only."""
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    schema = f"label {kinds['label']}, width int, block int, cell_x bigint, cell_y bigint, home boolean, rep {kinds['rep']}, weight bigint, raw binary, turned binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch):
                for width in sorted({len(v) for v in part.column("vec").to_pylist()}):
                    rows = np.flatnonzero([len(v) == width for v in part.column("vec").to_pylist()])
                    some = part.take(pa.array(rows))
                    raw = np.array(some.column("vec").to_pylist(), np.float64)
                    scaled = np.ldexp(raw, -np.frexp(np.abs(raw).max(1, keepdims=True))[1])  # exact, and no square overflows
                    rotation, blocks, shares = _blocks(width, rule)
                    turned = (scaled / np.linalg.norm(scaled, axis=1, keepdims=True) @ rotation).astype(np.float32)
                    bytes_ = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (scaled, turned)]
                    for b, (cut, share) in enumerate(zip(blocks, shares)):
                        plane = np.zeros((len(turned), 2))
                        plane[:, : min(2, cut.stop - cut.start)] = turned[:, cut][:, :2]
                        radius = np.sqrt(share) * (1 + 1e-9)
                        home = np.floor(plane / (2 * radius)).astype(np.int64)
                        low = np.floor((plane - radius) / (2 * radius)).astype(np.int64)
                        high = np.floor((plane + radius) / (2 * radius)).astype(np.int64)
                        at, cells = [], []
                        for dx in (-1, 0, 1):
                            for dy in (-1, 0, 1):
                                cell = home + (dx, dy)
                                if (dx, dy) >= (0, 0):
                                    there = np.flatnonzero(((low <= cell) & (cell <= high)).all(1))
                                    at.append(there)
                                    cells.append(cell[there])
                        at, cells = np.concatenate(at), np.concatenate(cells)
                        pick = pa.array(at)
                        yield pa.record_batch([
                            some.column("label").take(pick), pa.array(np.full(len(at), width, np.int32)), pa.array(np.full(len(at), b, np.int32)),
                            pa.array(cells[:, 0]), pa.array(cells[:, 1]), pa.array((cells == home[at]).all(1)),
                            some.column("rep").take(pick), some.column("weight").take(pick), *(x.take(pick) for x in bytes_),
                        ], names=names)

    return classes.select("label", "rep", "weight", "vec").mapInArrow(run, schema)


def _meet(posted: DataFrame, rule: Alike) -> DataFrame:
    """(``rep``, ``n``, null): links of a class in one task; (``rep``, null, ``other``): links that hold a task's groups together."""
    posted = settle(posted)
    cell = ["label", "width", "block", "cell_x", "cell_y"]
    sizes = posted.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / rule.part).cast("int").alias("parts"), F.max("home").alias("lived_in"))
    own = F.pmod(F.xxhash64("rep", "raw"), F.col("parts")).cast("int")
    tasks = (
        posted.join(sizes.where("lived_in"), cell)
        .withColumn("part", own)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"one": F.least("part", "with"), "two": F.greatest("part", "with")})
        .drop("with", "parts", "lived_in")
    )
    kind = posted.schema["rep"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        return _task(table, rule)

    return tasks.groupBy(*cell, "one", "two").applyInArrow(run, f"rep {kind}, n bigint, other {kind}")


def _task(table: pa.Table, rule: Alike) -> pa.Table:
    width, b = table["width"][0].as_py(), table["block"][0].as_py()
    one, two = table["one"][0].as_py(), table["two"][0].as_py()
    part, home = np.asarray(table["part"]), np.asarray(table["home"])
    raw = np.frombuffer(b"".join(table["raw"].to_pylist()), np.float64).reshape(-1, width)
    turned = np.frombuffer(b"".join(table["turned"].to_pylist()), np.float32).reshape(-1, width).astype(np.float64)
    weight = np.asarray(table["weight"])
    _, blocks, shares = _blocks(width, rule)
    sizes = np.linalg.norm(raw, axis=1)
    count, root = np.zeros(len(raw), np.int64), np.arange(len(raw))
    holding: list[tuple[int, int]] = []

    def near(i: np.ndarray, j: np.ndarray, block: int) -> np.ndarray:
        x, y = turned[i][:, blocks[block]], turned[j][:, blocks[block]]
        return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        gaps = (turned[i] - turned[j]) ** 2
        within = np.stack([gaps[:, cut].sum(1) <= share for cut, share in zip(blocks, shares)], 1)
        first = within[:, b] & ~within[:, :b].any(1)
        i, j = i[first], j[first]
        real = np.einsum("ij,ij->i", raw[i], raw[j]) / (sizes[i] * sizes[j]) >= rule.cosine
        i, j = i[real], j[real]
        np.add.at(count, i, weight[j])
        np.add.at(count, j, weight[i])
        while len(apart := np.flatnonzero(root[i] != root[j])):
            x, y = i[apart[0]], j[apart[0]]
            holding.append((x, y))
            root[root == root[y]] = root[x]

    left, right = np.flatnonzero(part == one), np.flatnonzero(part == two)
    for at in range(0, len(left), 256):
        i = left[at : at + 256]
        apart = near(i, right, b) <= shares[b] + rule.slack
        apart &= home[i][:, None] | home[right][None, :]
        if one == two:
            apart &= i[:, None] < right[None, :]
        for earlier in range(b):
            if not apart.any():
                break
            apart &= near(i, right, earlier) > shares[earlier] - rule.slack
        x, y = np.nonzero(apart)
        for k in range(0, len(x), PAIRS_AT_ONCE):
            verify(i[x[k : k + PAIRS_AT_ONCE]], right[y[k : k + PAIRS_AT_ONCE]])

    rep, counted = table["rep"].combine_chunks(), np.flatnonzero(count)
    pairs = np.array(holding, np.int64).reshape(-1, 2)
    nothing = pa.nulls
    return pa.table({
        "rep": pa.concat_arrays([rep.take(pa.array(counted)), rep.take(pa.array(pairs[:, 0]))]),
        "n": pa.concat_arrays([pa.array(count[counted]), nothing(len(pairs), pa.int64())]),
        "other": pa.concat_arrays([nothing(len(counted), rep.type), rep.take(pa.array(pairs[:, 1]))]),
    })
