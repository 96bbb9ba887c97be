r"""Prefix trie of conversations: who shares how many first turns, and what one copy of them would save.

A node is a distinct sequence of first turns. It is found by a key of 128 bits that is the exclusive or of hashes of
its turns at their places, so the keys of a long conversation are made in chunks. Nodes with the same members form a
chain, named by its smallest member and their number; a conversation meets one chain after the other, each with
fewer members, so its path has at most about the square root of twice the number of turns.

The leaves of the trie are sorted by path and cut into shards. A shard writes its chains as balanced parentheses and
answers for each open one: where it closes (range min-max tree over blocks of excess), how many leaf pairs lie
between (rank), and what the nodes between save (cumulative sums). Chains on the first and on the last path of a
shard, its spine, may go on in its neighbours; their parts are merged in one pass over the spines of all shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklane.session import settle

WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256().hexdigest()


@dataclass(frozen=True)
class Layout:
    """``chunk`` turns of a conversation or chain are summed at a time, what lies before (or behind) is carried; a
    shard has ``leaves`` leaves and ``entries`` entries of paths at most (a longer path is a shard of its own)."""

    chunk: int = 4096
    leaves: int = 1 << 16
    entries: int = 1 << 19


class Parentheses:
    """Balanced parentheses (1 opens) with a range min-max tree over the excess."""

    def __init__(self, bits: np.ndarray, block: int = 256):
        self.bits, self.block = bits, block
        excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        blocks = max(1, -(-len(bits) // block))
        padded = np.full(blocks * block, excess[-1] + 1 if len(bits) else 1, np.int64)
        padded[: len(bits)] = excess
        self.excess, self.grid = excess, padded.reshape(blocks, block)
        self.lows = [self.grid.min(1)]
        self.highs = [self.grid.max(1)]
        while len(self.lows[-1]) > 1:
            low, high = self.lows[-1], self.highs[-1]
            if len(low) % 2:
                low, high = np.append(low, low[-1]), np.append(high, high[-1])
                self.lows[-1], self.highs[-1] = low, high
            self.lows.append(low.reshape(-1, 2).min(1))
            self.highs.append(high.reshape(-1, 2).max(1))
        pairs = np.zeros(len(bits) + 1, np.int64)
        if len(bits) > 1:
            np.cumsum((bits[:-1] == 1) & (bits[1:] == 0), out=pairs[1:-1])
            pairs[-1] = pairs[-2]
        self._pairs = pairs

    def rank_leaves(self, upto: np.ndarray) -> np.ndarray:
        """Leaf pairs that open before each position."""
        return self._pairs[upto]

    def findclose(self, opens: np.ndarray, batch: int = 4096) -> np.ndarray:
        """Position of the parenthesis that closes each of ``opens``: the first behind it with less excess."""
        parts = [self._findclose(opens[i : i + batch]) for i in range(0, len(opens), batch)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _findclose(self, opens: np.ndarray) -> np.ndarray:
        target = self.excess[opens] - 1
        at = opens // self.block
        behind = np.arange(self.block)[None, :] > (opens % self.block)[:, None]
        hit = behind & (self.grid[at] <= target[:, None])
        out = at * self.block + hit.argmax(1)
        far = np.flatnonzero(~hit.any(1))
        if not len(far):
            return out
        node, goal, level = at[far], target[far], np.zeros(len(far), np.int64)
        climbing = np.ones(len(far), bool)
        for k, (low, high) in enumerate(zip(self.lows, self.highs)):  # up, to the first right neighbour that spans the goal
            mine = np.flatnonzero(climbing)
            right = np.minimum(node[mine] + 1, len(low) - 1)
            there = (node[mine] % 2 == 0) & (right > node[mine]) & (low[right] <= goal[mine]) & (goal[mine] <= high[right])
            stay = mine[there]
            node[stay], level[stay], climbing[stay] = node[stay] + 1, k, False
            node[mine[~there]] //= 2
        for k in range(len(self.lows) - 1, 0, -1):  # down, left first
            mine = np.flatnonzero(level >= k)
            left = 2 * node[mine]
            node[mine] = left + (self.lows[k - 1][left] > goal[mine])
        hit = self.grid[node] <= goal[:, None]
        out[far] = node * self.block + hit.argmax(1)
        return out


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as (``conv_id``, ``part``, ``id``, ``digest``, ``words``) and stretches as (``conv_id``, ``part``, ``first``,
    ``before``): a turn is number ``id - first + before + 1`` of its conversation.

    By turn, null first, equal ones by role and text; null roles and texts are empty; rows without a conversation
    are left out. Rows are spread by range, so a conversation may lie in many tasks."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text")).select(
        *order, F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"),
        F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"),
    )
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # its upper bits number the task
    rows = settle(sorted_.select("conv_id", place.alias("id"), "digest", "words").withColumn("part", F.shiftright("id", 33)))
    stretches = rows.groupBy("conv_id", "part").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    return rows, settle(stretches.withColumn("before", before))


def rebuilt(turns: DataFrame, group: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations with the head of another: ``conv_id``, ``length``; and their turns: ``conv_id``, ``depth`` (from 1),
    ``digest``, ``words``.

    Conversation c starts with the first h turns of conversation c - c % group (as many as there are), h = crc32(c) %
    shared, and goes on with its own turns after its first h. Ids are whole numbers; % takes the sign of c."""
    rows, stretches = numbered(turns)
    kind = turns.schema["conv_id"].dataType.simpleString()
    sizes = stretches.groupBy("conv_id").agg(F.sum("n").alias("n"))
    heads_of = sizes.select(F.col("conv_id").alias("root"), F.col("n").alias("root_n"))
    head = F.crc32(F.col("conv_id").cast("string")) % shared
    convs = sizes.withColumns({"root": (F.col("conv_id") - F.col("conv_id") % group).cast(kind), "head": head}).join(heads_of, "root", "left")
    lead = F.least("head", F.coalesce("root_n", F.lit(0)))
    convs = settle(convs.withColumn("lead", lead).select(
        "conv_id", "root", "head", "lead", (F.col("lead") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length")
    ))
    place = F.col("id") - F.col("first") + F.col("before") + 1
    where = stretches.join(convs, "conv_id")  # by stretch, so that a long conversation meets many rows
    own = rows.join(where, ["conv_id", "part"]).where(place > F.col("head")).select(
        "conv_id", (place - F.col("head") + F.col("lead")).alias("depth"), "digest", "words"
    )
    firsts = rows.where(F.col("conv_id") % group == 0).join(stretches.where(F.col("before") < shared), ["conv_id", "part"])
    firsts = firsts.where(place < shared).select(F.col("conv_id").alias("root"), place.alias("depth"), "digest", "words")
    borrowed = convs.where("lead > 0").join(firsts, "root").where("depth <= lead").select("conv_id", "depth", "digest", "words")
    return convs.select("conv_id", "length"), own.unionByName(borrowed)


def keyed(steps: DataFrame, convs: DataFrame, layout: Layout) -> DataFrame:
    """``conv_id``, ``depth``, ``words`` and the node's key ``k1``, ``k2``."""
    lanes = [F.xxhash64(F.lit(i), "digest", F.col("depth").cast("bigint")).alias(f"e{i}") for i in (1, 2)]
    steps = settle(steps.select("conv_id", "depth", "words", F.expr(f"(depth - 1) div {layout.chunk}").alias("cell"), *lanes))
    long_ = convs.where(F.col("length") > layout.chunk).select("conv_id")
    cells = steps.join(long_, "conv_id", "left_semi").groupBy("conv_id", "cell").agg(*[F.bit_xor(f"e{i}").alias(f"e{i}") for i in (1, 2)])
    earlier = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select("conv_id", "cell", *[F.bit_xor(f"e{i}").over(earlier).alias(f"c{i}") for i in (1, 2)])
    so_far = Window.partitionBy("conv_id", "cell").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.withColumns({f"x{i}": F.bit_xor(f"e{i}").over(so_far) for i in (1, 2)}).join(carried, ["conv_id", "cell"], "left")
    return settle(rows.select(
        "conv_id", "depth", "words", *[F.col(f"x{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))).alias(f"k{i}") for i in (1, 2)]
    ))


ENTRY = "struct<m:bigint,n:bigint,own:bigint,leaves:bigint,saved:bigint,children:bigint>"
SHARD = f"part int, no int, m bigint, n bigint, parent bigint, leaves bigint, saved bigint, children bigint, first array<{ENTRY}>, last array<{ENTRY}>"
_ENTRY = pa.list_(pa.struct([(name, pa.int64()) for name in ("m", "n", "own", "leaves", "saved", "children")]))
_SHARD = pa.schema([
    ("part", pa.int32()), ("no", pa.int32()), *[(name, pa.int64()) for name in ("m", "n", "parent", "leaves", "saved", "children")],
    ("first", _ENTRY), ("last", _ENTRY),
])


def shared_length(one: list, two: list) -> int:
    n = 0
    for a, b in zip(one, two):
        if a != b:
            break
        n += 1
    return n


def shard(leaves: list[tuple[list, bool]]) -> tuple[dict[str, np.ndarray], list[dict], list[dict]]:
    """The chains that lie in one shard alone, and those of its first and of its last path, without what the next
    chain of the same path adds. ``leaves``: paths of (m, n, own) in order, and whether a leaf of one member follows."""
    bits, opened = bytearray([1]), [0]
    m, n, own, parent, children = [None], [0], [0], [-1], [0]
    stack, path, first = [0], [], None
    for entries, tail in leaves:
        names = [e[0] for e in entries]
        same = shared_length(path, names)
        bits += bytes(len(stack) - 1 - same)
        del stack[same + 1 :]
        for e in entries[same:]:
            opened.append(len(bits))
            bits.append(1)
            children[stack[-1]] += 1
            parent.append(stack[-1])
            stack.append(len(m))
            for column, value in zip((m, n, own, children), (*e, 0)):
                column.append(value)
        if tail:
            bits += b"\1\0"
            children[stack[-1]] += 1
        path = names
        first = first or list(stack)
    last = list(stack)
    bits += bytes(len(stack))

    pairs = Parentheses(np.frombuffer(bytes(bits), np.uint8))
    opens = np.array(opened, np.int64)
    closes = pairs.findclose(opens)
    found = pairs.rank_leaves(closes) - pairs.rank_leaves(opens)
    weight = np.zeros(len(bits), np.int64)
    weight[opens] = own
    weight = np.cumsum(weight)
    below = weight[closes] - weight[opens]

    def spine(nodes: list[int]) -> list[dict]:
        out = []
        for level, i in enumerate(nodes):
            kids = {p[level + 1] for p in (first, last) if len(p) > level + 1 and p[level] == i}
            out.append({
                "m": m[i], "n": n[i], "own": own[i], "leaves": int(found[i] - sum(found[k] for k in kids)),
                "saved": int(below[i] - sum(below[k] + own[k] for k in kids)), "children": children[i] - len(kids),
            })
        return out

    inner = np.setdiff1d(np.arange(len(m)), [*first, *last])
    pick = lambda values: [values[i] for i in inner]
    rows = {
        "m": pick(m), "n": pick(n), "parent": [m[parent[i]] for i in inner], "leaves": found[inner], "saved": below[inner], "children": pick(children)
    }
    return rows, spine(first), spine(last)


def _shards(leaves: DataFrame, layout: Layout) -> DataFrame:
    """Rows of ``SHARD``: chains of one shard, and a row with the spine of each shard (``first`` and ``last``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        held, entries = [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal held, entries, no
            rows, first, last = shard(held)
            many = len(rows["m"])
            columns = [[part] * (many + 1), [no] * (many + 1), *([*rows[k], None] for k in ("m", "n", "parent", "leaves", "saved", "children"))]
            columns += [[None] * many + [first], [None] * many + [last]]
            held, entries, no = [], 0, no + 1
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SHARD)], schema=_SHARD)

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                piece = batch.slice(start, 1024)
                for m, n, own, tail in zip(*(c.to_pylist() for c in piece.columns)):
                    if held and (len(held) >= layout.leaves or entries + len(m) > layout.entries):
                        yield from closed()
                    held.append((list(zip(m, n, own)), tail))
                    entries += len(m)
        if held:
            yield from closed()

    order = leaves.select("path.m", "path.n", "path.own", "tail", "conv_id")
    return order.repartitionByRange("m", "conv_id").sortWithinPartitions("m", "conv_id").drop("conv_id").mapInArrow(run, SHARD)


def merged(spines: Iterator[tuple[list[dict], list[dict]]]) -> Iterator[tuple]:
    """(m, n, parent, leaves, saved, children) of the chains on spines, the root (m and n null) last. Holds one path."""
    stack: list[dict] = []

    def closed(upto: int) -> Iterator[tuple]:
        while len(stack) > upto:
            e = stack.pop()
            up = stack[-1] if stack else None
            yield e["m"], e["n"], up and up["m"], e["leaves"], e["saved"], e["children"]
            if up is not None:
                up["leaves"] += e["leaves"]
                up["saved"] += e["saved"] + e["own"]
                up["children"] += 1

    for first, last in spines:
        same = shared_length([e["m"] for e in stack], [e["m"] for e in first])
        yield from closed(same)
        for here, e in zip(stack, first):
            for name in ("leaves", "saved", "children"):
                here[name] += e[name]
        stack += [dict(e) for e in first[same:]]
        same = shared_length([e["m"] for e in first], [e["m"] for e in last])
        yield from closed(same)
        stack += [dict(e) for e in last[same:]]
    yield from closed(0)


def _merged_spines(spines: DataFrame) -> DataFrame:
    """One row per shard comes together in one task and is read as a stream."""
    names = ["m", "n", "parent", "leaves", "saved", "children"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((f, z) for b in batches for i in range(b.num_rows) for f, z in zip(*(c.to_pylist() for c in b.slice(i, 1).columns)))
        out: list[tuple] = []
        for row in merged(rows):
            out.append(row)
            if len(out) == 10_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    one = spines.repartition(1).sortWithinPartitions("part", "no").select("first", "last")
    return one.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _digests(ends: DataFrame) -> DataFrame:
    """``m``, ``n``, ``n_ends``, ``ends`` (SHA-256 of the ids, ascending): a digest is made from first to last, so the ids
    of a chain pass through one task, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, count = None, None, 0
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["m", "n", "n_ends", "ends"])

        for batch in batches:
            for m, n, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (m, n) != now:
                    if now:
                        out.append((*now, count, digest.hexdigest()))
                    now, digest, count = (m, n), hashlib.sha256(str(conv).encode()), 1
                else:
                    digest.update(f",{conv}".encode())
                    count += 1
            if len(out) >= 10_000:
                yield flushed()
                out = []
        if now:
            out.append((*now, count, digest.hexdigest()))
        if out:
            yield flushed()

    order = ends.repartition("m", "n").sortWithinPartitions("m", "n", "conv_id")
    return order.select("m", "n", "conv_id").mapInArrow(run, "m bigint, n bigint, n_ends bigint, ends string")


def trie(convs: DataFrame, steps: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """All nodes over ``convs`` (``conv_id`` bigint, ``length``) and their turns ``steps`` (``conv_id``, ``depth`` from 1,
    ``digest`` of the turn, ``words`` in its text): ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    The root holds every conversation, those without a turn too; no conversations give no rows. Equal conversations
    end at one node."""
    whole = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    keys = keyed(steps, convs, layout)
    nodes = settle(keys.groupBy("k1", "k2", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("m"), F.max("words").alias("words")))
    cell = F.expr(f"(depth - 1) div {layout.chunk}").alias("cell")
    top = F.max_by(F.struct("k1", "k2"), "depth").alias("top")
    cells = settle(nodes.groupBy("m", "n", cell).agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.sum("words").alias("words"), top))
    chains = cells.groupBy("m", "n").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), ((F.col("n") - 1) * F.sum("words")).alias("own"), F.max_by("top", "hi").alias("top")
    )
    # A conversation's path: the last node of each chain it is in with others.
    shared = chains.where("n > 1").select("top.k1", "top.k2", F.col("hi").alias("depth"), "m", "n", "own")
    met = keys.select("conv_id", "k1", "k2", "depth").join(shared, ["k1", "k2", "depth"])
    paths = met.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "m", "n", "own"))).alias("path"))
    path = F.coalesce("path", F.array().cast("array<struct<depth:bigint,m:bigint,n:bigint,own:bigint>>"))
    members = convs.join(paths, "conv_id", "left").select("conv_id", "length", path.alias("path"))
    last = F.get("path", F.size("path") - 1)
    members = settle(members.withColumn("tail", F.col("length") > F.coalesce(last["depth"], F.lit(0))))
    ended = members.where("NOT tail").select("conv_id", last["m"].alias("m"), last["n"].alias("n"))
    ends = settle(_digests(ended))

    # One leaf per conversation with a tail of its own, and one per chain where all members end.
    bare = ends.where("n_ends = n").select("m", "n")
    spots = members.where("NOT tail AND size(path) > 0").withColumns({"m": last["m"], "n": last["n"]}).where("conv_id = m")
    leaves = members.where("tail").select("path", "tail", "conv_id").unionByName(spots.join(bare, ["m", "n"]).select("path", "tail", "conv_id"))
    shards = settle(_shards(leaves, layout))
    names = ["m", "n", "parent", "leaves", "saved", "children"]
    spines = settle(_merged_spines(shards.where("first IS NOT NULL")))
    tails = members.where("tail").select(
        F.col("conv_id").alias("m"), F.lit(1).cast("bigint").alias("n"), last["m"].alias("parent"), F.lit(1).cast("bigint").alias("leaves"),
        F.lit(0).cast("bigint").alias("saved"), F.lit(0).cast("bigint").alias("children"), F.sha2(F.col("conv_id").cast("string"), 256).alias("ends"),
    )
    found = shards.where("first IS NULL").select(*names).unionByName(spines.where("m IS NOT NULL"))
    found = found.join(ends.select("m", "n", "ends"), ["m", "n"], "left").unionByName(tails)

    behind = Window.partitionBy("m", "n").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    spans = cells.select("m", "n", "cell", F.coalesce(F.sum("words").over(behind), F.lit(0)).alias("behind"))
    ranges = chains.select("m", "n", "lo", "hi").join(found, ["m", "n"])
    of_cell = spans.join(ranges, ["m", "n"])
    down = Window.partitionBy("m", "n", "cell").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = nodes.select("m", "n", "depth", "words", cell).withColumn("words", F.sum("words").over(down)).join(of_cell, ["m", "n", "cell"])
    is_last = F.col("depth") == F.col("hi")
    inner = rows.select(
        F.col("m").alias("conv_id"), "depth",
        F.when(F.col("depth") > F.col("lo"), F.col("m")).otherwise(F.coalesce("parent", F.lit(whole[0]))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(is_last, F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * (F.col("words") + F.col("behind"))).alias("saved_tokens"),
        F.when(is_last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
    )
    total = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    top = total.unionByName(spines.where("m IS NULL").select("leaves", "saved", "children"), True)
    top = top.unionByName(ends.where("m IS NULL").select("ends"), True)  # three rows at most
    root = top.agg(*[F.max(c).alias(c) for c in top.columns]).where("n_convs > 0").select(
        "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs",
        F.coalesce("children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return root.unionByName(inner)
