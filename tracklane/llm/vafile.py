"""Exact top-k inner products with a vector-approximation file.

Vectors are kept in blocks of bounded size: quantised cells, one byte a component, and apart from them the exact
integers. A scan of the cells gives bounds of every score. The k-th best lower bound over all blocks leaves few
candidates per query; their exact vectors are read in the order of their upper bounds, until the k-th result
found is certain. Queries come in blocks too, numbered
within the vectors of their length, so a task holds a block of vectors and a bounded set of queries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.session import settle

CELLS = 256


@dataclass(frozen=True)
class VaFile:
    """``rows`` and ``queries`` per block, ``together`` query blocks per task, ``scale`` of the components before
    they are floored to integers."""

    k: int = 5
    scale: float = 256.0
    rows: int = 2048
    queries: int = 256
    together: int = 4


def top_k(vectors: DataFrame, is_query: Column, rule: VaFile = VaFile(), id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score``: the best ``k`` of all other vectors, all where there
    are fewer; ties go to the smaller id.

    Rows without an id or vector, with an empty one, or with null or non-finite components, take no part, and vectors meet those of
    their own length only. A row is no candidate of a query with its id. Scores must fit 64-bit integers.
    """
    finite = F.expr(f"`{vec}` IS NOT NULL AND size(`{vec}`) > 0 AND forall(`{vec}`, x -> x IS NOT NULL AND abs(x) < double('infinity'))")
    whole = settle(
        vectors.where(finite & F.col(id).isNotNull())
        .select(F.col(id).alias("id"), F.transform(vec, lambda x: F.floor(x.cast("double") * rule.scale).cast("long")).alias("v"), is_query.alias("asks"))
    )
    n, asked = whole.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks, query_blocks = max(1, -(-n // rule.rows)), max(1, -(-asked // rule.queries))
    stored = settle(_blocks(whole, blocks))
    queries = settle(_blocks(whole.where("asks"), query_blocks).select("width", "block", "ids", "exact"))

    # Each block of vectors meets each set of query blocks, in a task of its own.
    sets = -(-query_blocks // rule.together)
    cells = stored.select("width", "block", "n", "ids", "low", "step", "cells").withColumn("asking", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    asking = queries.select(
        "width", F.col("block").alias("query_block"), (F.col("block") % sets).alias("asking"), F.col("ids").alias("query_ids"), F.col("exact").alias("query"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    place = ["width", "block", "asking"]
    kind = whole.schema["id"].dataType.simpleString()
    bounded = settle(
        cells.groupBy(*place).cogroup(asking.groupBy(*place)).applyInArrow(
            lambda a, b: _scan(a, b, rule),
            f"width int, block int, asking int, query_id {kind}, query bigint, wanted binary, at array<int>, lower array<double>, upper array<double>",
        )
    )
    best = bounded.select("width", "query", F.explode(F.slice(F.sort_array("lower", asc=False), 1, rule.k)).alias("lower"))
    order = Window.partitionBy("width", "query").orderBy(F.desc("lower"))
    # The k-th best lower bound of a query; none where it has fewer candidates.
    sure = best.withColumn("place", F.row_number().over(order)).where(F.col("place") == rule.k).select("width", "query", F.col("lower").alias("sure"))
    open_ = bounded.join(sure, ["width", "query"], "left").select(
        *place, "query_id", "query", "wanted",
        F.filter(F.arrays_zip("upper", "at"), lambda c: F.coalesce(c["upper"] >= F.col("sure"), F.lit(True))).alias("open"),
    ).where(F.size("open") > 0)
    exact = stored.select("width", "block", "ids", "exact").withColumn("asking", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    scored = open_.groupBy(*place).cogroup(exact.groupBy(*place)).applyInArrow(
        lambda a, b: _visit(a, b, rule), f"width int, query bigint, query_id {kind}, vec_id {kind}, score bigint"
    )
    ranked = Window.partitionBy("width", "query").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= rule.k).select("query_id", "rank", "vec_id", "score")


def _blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """Blocks of about equal size, dealt by row position, so that repeated ids and vectors spread too."""
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.select(
        "id", "v", F.size("v").alias("width"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block")
    )

    def pack(table: pa.Table) -> pa.Table:
        width, n = table["width"][0].as_py(), table.num_rows
        exact = np.array(table["v"].to_pylist(), np.int64).reshape(n, width)
        order = np.lexsort([*exact.T[::-1], np.asarray(table["id"])])
        exact = exact[order]
        low, high = exact.min(0).astype(float), exact.max(0).astype(float)
        step = np.maximum((high - low) / (CELLS - 1), 1e-300)
        cells = np.clip(np.floor((exact - low) / step), 0, CELLS - 1).astype(np.uint8)
        return pa.table({
            "width": table["width"].slice(0, 1), "block": table["block"].slice(0, 1), "n": pa.array([n], pa.int32()),
            "ids": pa.array([table["id"].combine_chunks().take(pa.array(order)).to_pylist()], pa.list_(table["id"].type)),
            "low": pa.array([low.tobytes()], pa.binary()), "step": pa.array([step.tobytes()], pa.binary()),
            "cells": pa.array([cells.tobytes()], pa.binary()), "exact": pa.array([exact.tobytes()], pa.binary()),
        })

    return dealt.groupBy("width", "block").applyInArrow(
        pack, f"width int, block int, n int, ids array<{kind}>, low binary, step binary, cells binary, exact binary"
    )


def _scan(cells: pa.Table, asking: pa.Table, rule: VaFile) -> pa.Table:
    """Score bounds of a block for each query; what the block's own k-th lower bound leaves of it."""
    names = ["width", "block", "asking", "query_id", "query", "wanted", "at", "lower", "upper"]
    id_type = asking["query_ids"].type.value_type
    types = [pa.int32(), pa.int32(), pa.int32(), id_type, pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    out: list[list] = [[] for _ in names]
    if cells.num_rows and asking.num_rows:
        block, width, n = cells.slice(0, 1).to_pylist()[0], cells["width"][0].as_py(), cells["n"][0].as_py()
        low, step = (np.frombuffer(block[c], float) for c in ("low", "step"))
        code = np.frombuffer(block["cells"], np.uint8).reshape(n, width).astype(float)
        # A cell's edges, a little outside of them: quantising rounds.
        below, above = low + (code - 1e-6) * step, low + (code + 1 + 1e-6) * step
        ids = np.array(block["ids"])
        for row in asking.to_pylist():
            queries = np.frombuffer(row["query"], np.int64).reshape(-1, width)
            plus, minus = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
            least, most = plus @ below.T + minus @ above.T, plus @ above.T + minus @ below.T
            room = 1 + 1e-12 * (plus @ np.abs(above).T - minus @ np.abs(above).T + plus @ np.abs(below).T - minus @ np.abs(below).T)
            least, most = least - room, most + room
            for q, name in enumerate(row["query_ids"]):
                others = ids != name
                values = least[q][others]
                sure = np.partition(values, -rule.k)[-rule.k] if len(values) >= rule.k else -np.inf
                at = np.flatnonzero(others & (most[q] >= sure))
                for column, value in zip(out, (
                    width, block["block"], block["asking"], name, row["query_block"] << 32 | q, queries[q].tobytes(), at, least[q][at], most[q][at],
                )):
                    column.append(value)
    return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=names)


def _visit(open_: pa.Table, exact: pa.Table, rule: VaFile) -> pa.Table:
    """Exact scores in the order of upper bounds, until no open one can enter the best k."""
    id_type, out = open_["query_id"].type, []
    if open_.num_rows and exact.num_rows:
        width, ids = exact["width"][0].as_py(), exact["ids"][0].as_py()
        vectors = np.frombuffer(exact["exact"][0].as_py(), np.int64).reshape(-1, width)
        for row in open_.to_pylist():
            wanted = np.frombuffer(row["wanted"], np.int64)
            best: list[tuple[int, object]] = []
            for c in sorted(row["open"], key=lambda c: -c["upper"]):
                if len(best) == rule.k and c["upper"] < -best[-1][0]:
                    break
                best = sorted([*best, (-int(vectors[c["at"]] @ wanted), ids[c["at"]])])[: rule.k]
            out += [(width, row["query"], row["query_id"], name, -score) for score, name in best]
    columns = list(zip(*out)) or [[]] * 5
    types = [pa.int32(), pa.int64(), id_type, id_type, pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["width", "query", "query_id", "vec_id", "score"])
