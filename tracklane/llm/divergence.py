r"""Source divergence audit: which sources of a language differ from each other, and by which terms.

One pass per document cuts it into terms: ``bytes.translate`` lowers A-Z and blanks every other ASCII byte but a-z,
``bytes.split`` gives the terms, a Counter its frequencies. A task adds the counts up by group (language, source) before
anything is shuffled. All later arithmetic is on whole numbers.

A term that a group lacks has the same share as all others it lacks, so pairs of sources are compared sparsely: terms
of one source only through the number of its terms with each share, terms of neither by their number, and only terms of
both one by one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.session import settle

LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))
TABLE = bytes(b | 0x20 if b in LETTERS else b if b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class Audit:
    """``holders`` documents of a language hold a kept term; shares are whole parts of ``unit``; ``ranks`` terms of a
    group are reported. A task adds up ``entries`` counts, out of ``held_bytes`` of text, before it sends them on."""

    holders: int = 3
    unit: int = 1_000_000_000
    ranks: int = 200
    entries: int = 250_000
    held_bytes: int = 128 << 20
    pairs: int = 1 << 20


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def frequencies(docs: DataFrame, rule: Audit = Audit(), text: str = "text") -> DataFrame:
    """Partial counts (``lang``, ``source``, ``term``, ``n``, ``docs``) of each task, to be added up. Every group has at
    least one row; one with a null term stands for the group alone. Null texts, languages and sources are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        told: set[tuple[str, str]] = set()
        size = entries = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, held) in groups.items():
                words = [*([None] if (lang, source) not in told else []), *held]
                told.add((lang, source))
                for at in range(0, len(words), 50_000):
                    part = words[at : at + 50_000]
                    yield pa.record_batch([
                        pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([n[w] if w is not None else 0 for w in part], pa.int64()),
                        pa.array([held[w] if w is not None else 0 for w in part], pa.int64()),
                    ], names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            for lang, source, body in zip(*(c.to_pylist() for c in batch.columns)):
                n, held = groups.setdefault((lang, source), (Counter(), Counter()))
                words, before = terms(body), len(held)
                n.update(words)
                held.update(Counter(words).keys())
                size += len(body)
                entries += len(held) - before + 1
                if size >= rule.held_bytes or entries >= rule.entries:
                    yield from flushed()
                    size = entries = 0
            if len(told) > rule.entries:
                told.clear()  # a group may be told of again
        yield from flushed()

    empty = F.lit("")
    kept = docs.select(
        F.coalesce(F.col("lang").cast("string"), empty).alias("lang"), F.coalesce(F.col("source").cast("string"), empty).alias("source"),
        F.coalesce(F.col(text), empty).cast("binary").alias("body"),
    )
    return kept.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def _share(n: Column, whole: Column, rule: Audit) -> Column:
    """``1 + floor(unit * (n + 1) / whole)``, in decimals so that no product overflows; null if ``whole`` is 0."""
    n, whole = n.cast("decimal(19,0)"), whole.cast("decimal(19,0)")
    return F.call_function("div", (n + 1) * F.lit(rule.unit).cast("decimal(10,0)"), F.nullif(whole, F.lit(0).cast("decimal(19,0)"))) + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


@dataclass(frozen=True)
class Counts:
    """``groups``: lang, source, ``no`` (from 0 in each language), ``total`` (of kept terms), ``n_terms``, ``kept`` (terms
    of the language), ``lang_total``, ``rest`` (share of a term that the group lacks). ``held``: lang, no, term, ``p``
    (share in the group), ``rest``, ``q`` (share in the language)."""

    groups: DataFrame
    held: DataFrame


def count(docs: DataFrame, rule: Audit = Audit(), text: str = "text") -> Counts:
    """Counts of every kept term and group; both tables are written once."""
    of_term, lead = Window.partitionBy("lang", "term"), Window.partitionBy("lang", "term").orderBy("source")
    # One exchange by term serves the sums by group and those over a language.
    added = frequencies(docs, rule, text).repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    rows = settle(
        added.withColumns({
            "lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term),
            "first": (F.row_number().over(lead) == 1).cast("int"),
        }).where(F.col("term").isNull() | (F.col("lang_docs") >= rule.holders)).select("lang", "source", "term", "n", "lang_n", "first")
    )
    is_term = F.col("term").isNotNull().cast("long")
    sums = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(is_term).alias("n_terms"), F.sum(is_term * F.col("first")).alias("firsts"))
    of_lang = Window.partitionBy("lang")
    groups = settle(
        sums.withColumns({
            "kept": F.sum("firsts").over(of_lang), "lang_total": F.sum("total").over(of_lang),
            "no": F.row_number().over(of_lang.orderBy("source")) - 1,
        }).select(
            "lang", "source", "no", "total", "n_terms", "kept", "lang_total",
            _share(F.lit(0), F.col("total") + F.col("kept"), rule).alias("rest"),
        )
    )
    held = rows.where("term IS NOT NULL").join(groups, ["lang", "source"]).select(
        "lang", "no", "term", _share(F.col("n"), F.col("total") + F.col("kept"), rule).alias("p"), "rest",
        _share(F.col("lang_n"), F.col("lang_total") + F.col("kept"), rule).alias("q"),
    )
    return Counts(groups, settle(held))


def marked_terms(counts: Counts, rule: Audit = Audit()) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value``, ``rank``: the terms that a group has more of than its language."""
    over = counts.held.where("p > q").select("lang", "no", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "no").orderBy(F.desc("value"), "item")
    best = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rule.ranks)
    return best.join(counts.groups.select("lang", "no", "source"), ["lang", "no"]).select("lang", "source", "item", "value", "rank")


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _shared_terms(held: DataFrame, rule: Audit) -> DataFrame:
    """``lang``, ``a``, ``b``, ``value``: over the terms that both have, what their gaps exceed those by which the terms
    are counted as one source's own. The list of a term has an entry per source."""
    lists = held.groupBy("lang", "term").agg(F.collect_list(F.struct("no", "p", "rest")).alias("held")).where(F.size("held") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            lists, names = batch.column(1), langs.dictionary
            ends = np.asarray(lists.offsets).astype(np.int64)
            base, sizes = ends[0], np.diff(ends)
            no, p, rest = (np.asarray(lists.flatten().field(i)).astype(np.int64) for i in range(3))
            many = int(no.max()) + 1 if len(no) else 1
            lang = np.repeat(np.asarray(langs.indices).astype(np.int64), sizes)
            wide, first = np.repeat(sizes, sizes), np.repeat(ends[:-1] - base, sizes)  # of each entry: those of its term
            upto = np.cumsum(wide)
            at = 0
            while at < len(no):
                # As many entries on the left as make about rule.pairs pairs, one at least.
                stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + rule.pairs, "right")))
                left = np.repeat(np.arange(at, stop), wide[at:stop])
                right = first[left] + np.arange(len(left)) - np.repeat(np.cumsum(wide[at:stop]) - wide[at:stop], wide[at:stop])
                left, right = left[left != right], right[left != right]
                value = _gaps(p[left], p[right]) - _gaps(p[left], rest[right]) - _gaps(rest[left], p[right]) + _gaps(rest[left], rest[right])
                key, where = np.unique((lang[left] * many + no[left]) * many + no[right], return_inverse=True)
                sums = np.zeros(len(key), np.int64)
                np.add.at(sums, where, value)
                yield pa.record_batch([
                    names.take(pa.array(key // (many * many))), pa.array((key // many % many).astype(np.int32)),
                    pa.array((key % many).astype(np.int32)), pa.array(sums),
                ], names=["lang", "a", "b", "value"])
                at = stop

    return lists.select("lang", "held").mapInArrow(run, "lang string, a int, b int, value bigint")


def pairs(counts: Counts, rule: Audit = Audit()) -> DataFrame:
    """``lang``, ``source``, ``item`` (another source of the language), ``value`` (the gaps of all kept terms), ``rank``.
    There are as many rows as the result is asked to have: all ordered pairs of a language's sources."""
    shares = counts.held.groupBy("lang", "no", "p").agg(F.count(F.lit(1)).alias("k"))
    other = counts.groups.select("lang", F.col("no").alias("other"), F.col("rest").alias("other_rest"))
    p, rest, k = F.col("p"), F.col("other_rest"), F.col("k")
    own = shares.join(other, "lang").where("no != other").select("lang", F.explode(F.array(
        F.struct(F.col("no").alias("a"), F.col("other").alias("b"), (k * _gap(p, rest)).alias("value")),
        F.struct(F.col("other").alias("a"), F.col("no").alias("b"), (k * _gap(rest, p)).alias("value")),
    )).alias("x")).select("lang", "x.*")
    sums = own.unionByName(_shared_terms(counts.held, rule)).groupBy("lang", "a", "b").agg(F.sum("value").alias("found"))
    one = counts.groups.select("lang", "source", F.col("no").alias("a"), F.col("n_terms").alias("x"), F.col("rest").alias("x_rest"), "kept")
    two = counts.groups.select("lang", F.col("source").alias("item"), F.col("no").alias("b"), F.col("n_terms").alias("y"), F.col("rest").alias("y_rest"))
    lacked = (F.col("kept") - F.col("x") - F.col("y")) * _gap(F.col("x_rest"), F.col("y_rest"))
    both = one.join(two, "lang").where("a != b").join(sums, ["lang", "a", "b"], "left")
    value = F.coalesce(lacked, F.lit(0)) + F.coalesce("found", F.lit(0))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.select("lang", "source", "item", value.alias("value")).withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, rule: Audit = Audit(), text: str = "text") -> DataFrame:
    """``lang``, ``source``, ``part`` ("pair" or "term"), ``item``, ``value``, ``rank``, over all documents.

    Null texts, languages and sources are empty; a repeated row counts each time; a group without terms is compared
    like others; a language without kept terms has pairs of value 0. No documents give no rows."""
    counts = count(docs, rule, text)
    found = None
    for part, rows in (("pair", pairs(counts, rule)), ("term", marked_terms(counts, rule))):
        rows = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
        found = rows if found is None else found.unionByName(rows)
    return found
