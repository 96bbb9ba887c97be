"""Near-duplicates by an inverted join over the coordinates of MinHash signatures.

Documents with equal shingle sets are one class. A class is posted under the pair (coordinate, value) of each of
its ``coordinates`` minima. Two classes above the match threshold share at least ``matches`` pairs, so when the
pairs of each are put in one order, rarest first, they share one among the first ``coordinates - matches + 1``:
only this prefix is joined, and a pair that no other class has needs no posting at all. Collisions of two
classes that meet are counted on their signatures, and links confirmed on their full shingle sets.

First each class meets one hub, the class in its posting lists with the least of its own, then for the other
``rounds`` one hub of each of its lists. This settles groups of copies without meeting in all pairs. The last round
joins those classes of a list that are not yet in one component, so no link between components is lost. A sketch of
one byte per coordinate goes along with each posting: two classes meet only if as many bytes are equal as
coordinates must be, and if their sizes allow the threshold.

A large group of texts a little below the threshold would still meet in all pairs there. Two bounds on the full sets
keep them apart, and no link is lost by either: for classes in lists of more than ``crowd`` the shingles are counted
that other classes of such lists have too, as a link has no others in common; and each class has ``parities`` bits that
tell whether an even or odd number of its shingles fall on them, so that two sets differ in no fewer shingles than bits.
In such a list only classes outside of its largest component look for others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.llm.bpe import small
from tracklane.llm.components import components
from tracklane.llm.memory import only
from tracklane.plans.joins import beside
from tracklane.session import settle


@dataclass(frozen=True)
class NearCopies:
    """``threshold`` in percent. A pair at 80 % has 38.4 of 48 equal coordinates on average and fewer than 22
    once in 30 million times."""

    words: int = 5
    threshold: int = 80
    coordinates: int = 48
    matches: int = 22
    rounds: int = 2
    seed: int = 7
    crowd: int = 16
    parities: int = 1024


class Shingler:
    """Distinct word shingles of a text as 64-bit hashes, and their MinHash signature."""

    def __init__(self, rule: NearCopies, limit: int = 300_000):
        rng = np.random.default_rng(rule.seed)
        self.rule, self.limit = rule, limit
        self.known: dict[bytes, int] = {}
        self.place = rng.integers(0, 1 << 63, rule.words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.scale = rng.integers(0, 1 << 63, rule.coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, rule.coordinates, dtype=np.uint64)

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted; fewer words than a shingle make one of all of them, no words none."""
        words = (text or "").encode().lower().split()  # bytes: only A-Z change, and white space is ASCII's
        if not words:
            return np.zeros(0, np.uint64)
        n = self.rule.words
        if len(words) < n:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        hashes, size = self._hashes(words), len(words) - n + 1
        mixed = np.zeros(size, np.uint64)
        for i in range(n):
            mixed += hashes[i : i + size] * self.place[i]
        for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(by))) * np.uint64(factor)
        return np.unique(mixed ^ (mixed >> np.uint64(31)))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The upper 32 bits of each coordinate's smallest hash."""
        out = np.empty(len(self.scale), np.uint32)
        for k, (a, b) in enumerate(zip(self.scale, self.shift)):
            out[k] = (shingles * a + b).min() >> np.uint64(32)
        return out.view(np.int32)


    def parity(self, shingles: np.ndarray) -> np.ndarray:
        """For each bit whether an odd number of shingles fall on it, 64 in a number."""
        odd = np.bincount((shingles % np.uint64(self.rule.parities)).astype(np.int64), minlength=self.rule.parities) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _shingler(rule: NearCopies) -> Shingler:
    return only(rule, lambda: Shingler(rule))


def _print(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, rule: NearCopies = NearCopies(), text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id``, ``n_shingles``, ``print`` (of the whole set; null for an empty one), ``signature array<int>``, ``parity array<bigint>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(rule)
        for batch in batches:
            for part in small(batch, 512):
                sets = [shingler.shingles(t) for t in part.column(1).to_pylist()]
                yield pa.record_batch([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_print(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([shingler.signature(s) if len(s) else None for s in sets], pa.list_(pa.int32())),
                    pa.array([shingler.parity(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ], names=[id, "n_shingles", "print", "signature", "parity"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(run, f"`{id}` {kind}, n_shingles bigint, print binary, signature array<int>, parity array<bigint>")


def near_copies(docs: DataFrame, rule: NearCopies = NearCopies(), text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_shingles``, ``component_id`` (smallest id reachable over links,
    itself included), ``kept``.

    Null and empty texts have no shingles and are linked with nothing. Rows without an id are linked with nothing
    either; their ``component_id`` is null and ``kept`` true. Rows that share an id are in one component, and the
    id counts as kept in each.
    """
    rows = settle(signatures(docs, rule, text, id).withColumnRenamed(id, "doc"))
    usable = rows.where("doc IS NOT NULL AND print IS NOT NULL")
    classes = settle(usable.groupBy("print").agg(
        F.min("doc").alias("rep"), F.first("signature").alias("signature"), F.first("parity").alias("parity"), F.first("n_shingles").alias("size")
    ))
    sketches = classes.select("print", "size", *[_lane(g, rule.coordinates).alias(f"lane{g}") for g in range(_lanes(rule))])
    posted = settle(_postings(classes, rule).join(sketches, "print"))
    # Only these can be in a pair; a class is found again by its print, should rows share an id.
    texts = settle(docs.select(F.col(id).alias("rep"), F.col(text).alias("text")).join(posted.select("rep").distinct(), "rep"))

    posted = _bounded(posted, texts, rule)

    tried, links, parts = [], [], None
    for turn in range(rule.rounds + 1):
        placed = posted.withColumn("part", F.col("rep"))
        if parts is not None:
            placed = posted.join(parts, F.col("rep") == F.col("node"), "left").withColumn("part", F.coalesce("component", "rep"))
        pairs = _across(placed, classes, rule) if turn == rule.rounds else _to_hubs(placed, turn, rule)
        for before in tried:
            pairs = pairs.join(before, ["p", "q"], "left_anti")
        alike = settle(_alike(pairs, classes, rule))
        tried.append(alike.select("p", "q"))
        links.append(settle(_confirmed(alike, texts, rule)))
        linked = reduce(DataFrame.unionByName, links)
        parts = components(linked.select("a", "b"))

    # Rows of a class, of a link and of an id hold together; components runs over ids.
    copies = usable.join(classes.select("print", "rep"), "print").where("doc != rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    groups = components(linked.select("a", "b").unionByName(copies))
    found = rows.join(groups, rows["doc"] == groups["node"], "left")
    component = F.coalesce("component", "doc")
    return found.select(
        F.col("doc").alias(id), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )


def _postings(classes: DataFrame, rule: NearCopies) -> DataFrame:
    """``entry`` (coordinate and value), ``rep``, ``print``, ``shared`` (entries of the class that others have too): the
    prefix of each class, entries of one class left out."""
    entries = classes.select("rep", "print", F.posexplode("signature").alias("k", "v")).select(
        "rep", "print", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v")).alias("entry")
    )
    shared = entries.groupBy("entry").agg(F.count(F.lit(1)).alias("posted")).where("posted > 1")
    ranked = entries.join(shared, "entry").groupBy("print").agg(
        F.first("rep").alias("rep"), F.sort_array(F.collect_list(F.struct("posted", "entry"))).alias("entries")
    )
    prefix = rule.coordinates - rule.matches + 1
    room = F.greatest(F.lit(0), F.lit(prefix) - (F.lit(rule.coordinates) - F.size("entries")))  # entries of its own come first
    prefixes = ranked.select("rep", "print", F.size("entries").alias("shared"), F.explode(F.slice("entries", F.lit(1), room)).alias("e"))
    return prefixes.select("e.entry", "rep", "print", "shared")


def _bounded(posted: DataFrame, texts: DataFrame, rule: NearCopies) -> DataFrame:
    """``posted`` with ``held`` (postings of the entry), ``most`` (shingles that a link over it can have in common at most)
    and ``central`` (the share that others have too); postings that no link can come from are left out."""
    lists = posted.groupBy("entry").agg(F.count(F.lit(1)).alias("held"))
    listed = settle(beside(posted, lists, ["entry"]))
    crowded = F.col("held") > rule.crowd
    reach = _foreign(listed.where(crowded).select("rep", "print").distinct(), texts, rule)
    # Counted among the classes of long lists, so it bounds no link over a short one.
    most = F.when(crowded, F.coalesce("found", F.lit(0))).otherwise(F.col("size"))
    central = F.when(crowded, F.col("most") / F.col("size")).otherwise(F.col("shared") / F.lit(rule.coordinates))
    known = beside(listed, reach, ["print"], "left").withColumn("most", most).withColumn("central", central).drop("found", "shared")
    return settle(known.where(100 * F.col("most") >= rule.threshold * F.col("size")))


def _to_hubs(placed: DataFrame, turn: int, rule: NearCopies) -> DataFrame:
    """Pairs of a class and the hub of an entry, in different parts and with sketches alike: in the first turn one for
    each class, the most central hub, then no more than there are postings."""
    order = F.struct(-F.col("central"), "print") if turn == 0 else F.struct(F.xxhash64("print", "entry", F.lit(turn)), "print")
    seen = F.struct("print", "part", "size", "most", "central", *_lane_names(rule))
    hubs = placed.groupBy("entry").agg(F.min_by(seen, order).alias("hub"))
    near = _sizes_allow("x", "hub", rule) & _sketches_alike("x", "hub", rule)
    met = placed.alias("x").join(hubs, "entry").where(F.expr("part != hub.part") & near)
    if turn == 0:
        met = met.groupBy("x.print").agg(F.min_by("hub", F.struct(-F.col("hub.central"), "hub.print")).alias("hub"))
    return met.select(F.least("print", "hub.print").alias("p"), F.greatest("print", "hub.print").alias("q")).distinct()


LANE = 7  # bytes of a sketch in one number: the eighth stays free, so that sums below have no overflow


def _lanes(rule: NearCopies) -> int:
    return -(-rule.coordinates // LANE)


def _lane_names(rule: NearCopies) -> list[str]:
    return [f"lane{g}" for g in range(_lanes(rule))]


def _lane(g: int, coordinates: int) -> Column:
    """The low bytes of up to ``LANE`` coordinates in one number."""
    count = min(LANE, coordinates - LANE * g)
    parts = [F.shiftleft(F.get("signature", F.lit(LANE * g + j)).cast("long").bitwiseAND(255), 8 * j) for j in range(count)]
    return reduce(Column.bitwiseOR, parts)


def _equal_bytes(one: str, two: str, rule: NearCopies) -> Column:
    """How many coordinates have equal low bytes: no fewer than are equal."""
    low, high = (F.lit(sum(byte << 8 * j for j in range(LANE))).cast("long") for byte in (0x7F, 0x80))
    unequal = []
    for lane in _lane_names(rule):
        apart = F.col(f"{one}.{lane}").bitwiseXOR(F.col(f"{two}.{lane}"))
        # The sum sets the upper bit of each byte with a lower bit.
        unequal.append(F.bit_count((apart.bitwiseAND(low) + low).bitwiseOR(apart).bitwiseAND(high)))
    return F.lit(rule.coordinates) - reduce(Column.__add__, unequal)


def _sketches_alike(one: str, two: str, rule: NearCopies) -> Column:
    return _equal_bytes(one, two, rule) >= rule.matches


def _sizes_allow(one: str, two: str, rule: NearCopies) -> Column:
    """Whether two sets reach the threshold if they have as many shingles in common as they can at most."""
    common = F.least(f"{one}.most", f"{two}.most")
    return (100 + rule.threshold) * common >= rule.threshold * (F.col(f"{one}.size") + F.col(f"{two}.size"))


def _few_differ(bits: Column, sizes: Column, rule: NearCopies) -> Column:
    """Whether two sets of ``sizes`` together reach the threshold if they differ in as many shingles as bits."""
    return (100 + rule.threshold) * bits <= (100 - rule.threshold) * sizes


def _across(placed: DataFrame, classes: DataFrame, rule: NearCopies) -> DataFrame:
    """Pairs of an entry that are not in one part and that no bound keeps apart."""
    lists = placed.groupBy("entry", "part").agg(F.count(F.lit(1)).alias("n"))
    lists = lists.groupBy("entry").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count(F.lit(1)).alias("parts"))
    open_ = settle(beside(placed, lists.where("parts > 1").select("entry", "main"), ["entry"]))
    near = _sketches_alike("x", "y", rule)
    apart = F.expr("x.entry = y.entry AND x.part != y.part AND (y.part = y.main OR x.print < y.print)") & _sizes_allow("x", "y", rule)

    few = open_.where(F.col("held") <= rule.crowd)
    met = few.where("part != main").alias("x").join(few.alias("y"), apart & near).select("x.print", F.col("y.print").alias("other"))

    words = range(rule.parities // 64)
    bits = classes.select("print", *[F.get("parity", F.lit(w)).alias(f"bits{w}") for w in words])
    crowded = settle(open_.where(F.col("held") > rule.crowd).join(bits, "print"))
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"x.bits{w}").bitwiseXOR(F.col(f"y.bits{w}"))) for w in words])
    alike = _few_differ(differ, F.col("x.size") + F.col("y.size"), rule) & near
    met = met.unionByName(
        crowded.where("part != main").alias("x").join(crowded.alias("y"), apart & alike).select("x.print", F.col("y.print").alias("other"))
    )
    return met.select(F.least("print", "other").alias("p"), F.greatest("print", "other").alias("q")).distinct()


def _foreign(classes: DataFrame, texts: DataFrame, rule: NearCopies) -> DataFrame:
    """``print``, ``found``: how many shingles of a class others of ``classes`` have too, or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(rule)
        for batch in batches:
            for part in small(batch, 256):
                prints, sets = part.column(0).to_pylist(), [shingler.shingles(t) for t in part.column(1).to_pylist()]
                own = [(p, s) for p, s in zip(prints, sets) if _print(s) == p]  # rows may share an id
                yield pa.record_batch([
                    pa.array([p for p, _ in own], pa.binary()),
                    pa.array([s.view(np.int64) for _, s in own], pa.list_(pa.int64())),
                ], names=["print", "sets"])

    sets = classes.join(texts, "rep").select("print", "text").mapInArrow(run, "print binary, sets array<bigint>").dropDuplicates(["print"])
    held = settle(sets.select(F.xxhash64("print").alias("key"), F.explode("sets").alias("s")))  # equal keys raise the count of both
    shared = held.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s")
    found = beside(held, shared, ["s"]).groupBy("key").agg(F.count(F.lit(1)).alias("found"))
    return classes.select("print", F.xxhash64("print").alias("key")).join(found, "key").select("print", "found")


def _alike(pairs: DataFrame, classes: DataFrame, rule: NearCopies) -> DataFrame:
    """Pairs (p, q) with enough equal coordinates and few enough bits that differ, with the ids ``a`` and ``b`` of their
    classes."""
    p = classes.select(F.col("print").alias("p"), F.col("rep").alias("a"), F.struct("signature", "parity", "size").alias("x"))
    q = classes.select(F.col("print").alias("q"), F.col("rep").alias("b"), F.struct("signature", "parity", "size").alias("y"))
    equal = F.aggregate(F.zip_with("x.signature", "y.signature", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    differ = F.aggregate(F.zip_with("x.parity", "y.parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    few = _few_differ(differ, F.col("x.size") + F.col("y.size"), rule)
    return pairs.join(p, "p").join(q, "q").where((equal >= rule.matches) & few).select("p", "q", "a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, rule: NearCopies) -> DataFrame:
    """Pairs whose full shingle sets are as alike as the rule asks, as the ids ``a`` and ``b``."""
    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("a_text"))
    two = texts.select(F.col("rep").alias("b"), F.col("text").alias("b_text"))
    kind = texts.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(rule)
        held: dict[str, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            if text not in held:
                if len(held) >= 64:
                    held.clear()
                held[text] = shingler.shingles(text)
            return held[text]

        for batch in batches:
            keep = []
            for p, q, a_text, b_text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                a, b = of(a_text), of(b_text)
                common = len(np.intersect1d(a, b, assume_unique=True))
                # Rows may share an id; the pair is about those whose sets have its prints.
                keep.append(100 * common >= rule.threshold * (len(a) + len(b) - common) and _print(a) == p and _print(b) == q)
            yield pa.RecordBatch.from_arrays(batch.columns[4:], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(one, "a").join(two, "b").select("p", "q", "a_text", "b_text", "a", "b")
    return both.mapInArrow(run, f"a {kind}, b {kind}").distinct()
