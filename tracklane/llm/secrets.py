r"""Secret scans with DataFrame functions only.

Fixed patterns find the base spans. Further spans come from two Markov models of characters, one of random
strings and one of ordinary identifiers: a token is a secret if the first makes it likelier by enough. Both are
trained on labelled samples out of the documents: what the fixed patterns find is random, long words are
ordinary. Counts cover all documents; where there are few finds the random model stays near a uniform one.

Positions count code points. They come from splitting a text at a pattern: the lengths of what lies between
the matches and of the matches themselves add up to them.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three base kinds, in their order: fixed values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPAN = "array<struct<start:bigint,kind_no:int,kind:string,end:bigint>>"


@dataclass(frozen=True)
class Markov:
    """``min_length`` and ``distinct`` symbols of a scored token, ``ordinary_length`` of a word that is a sample of
    the ordinary ones, ``smoothing`` counts added to those after each symbol, spread evenly in the random model
    and by overall frequency in the ordinary one, ``margin`` of the log-likelihood ratio (nats)."""

    min_length: int = 16
    distinct: int = 7
    ordinary_length: int = 12
    smoothing: float = 100.0
    margin: float = 10.0


def _spans(text: Column, pattern: str, kind_no: int, keep) -> Column:
    """Spans of the leftmost non-overlapping matches that pass ``keep``; nothing but a search where there is none.
    ``pattern`` has one way to match at each place, so the search for a match and the split agree."""
    parts = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
    none = F.array().cast(SPAN)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["m"])
        span = F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(KINDS[kind_no]).alias("kind"), end.alias("end"))
        out = F.when(keep(x["m"]), F.array_append(state["out"], span)).otherwise(state["out"])
        return F.struct(end.alias("at"), out.alias("out"))  # behind the last match there is a gap only, m is null

    matched = F.filter(parts, lambda x: x["m"].isNotNull())
    spans = F.aggregate(matched, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")), step)["out"]
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then by kind; an array of (start, kind_no, kind, end)."""
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    assign = _spans(text, ASSIGN, 0, lambda m: F.char_length(value(m)) >= 8)
    # A run of 16 or 32 characters and more starts where the run does, so the bound may stand in the pattern.
    access = _spans(text, ACCESS.replace("+", "{12,}"), 1, lambda m: F.lit(True))
    hexes = _spans(text, HEX.replace("+", "{32,}"), 2, lambda m: F.lit(True))
    return F.array_sort(F.concat(assign, access, hexes))


def train(docs: DataFrame, rule: Markov = Markov(), text: str = "text") -> list[float]:
    """Log-likelihood ratios of each symbol after each symbol, random against ordinary.

    The table has one row per pair of ``SYMBOLS`` at most, whatever the corpus; it is all that the driver gets.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    value = F.filter(F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2)), lambda m: F.char_length(m) >= 8)
    access = F.regexp_extract_all(body, F.lit(ACCESS.replace("+", "{12,}")), F.lit(0))
    hexes = F.regexp_extract_all(body, F.lit(HEX.replace("+", "{32,}")), F.lit(0))
    words = F.regexp_extract_all(body, F.lit(f"(?<![A-Za-z0-9+/_=-])[A-Za-z/_-]{{{rule.ordinary_length},}}(?![A-Za-z0-9+/_=-])"), F.lit(0))
    samples = docs.select(
        F.explode(F.concat(
            F.transform(F.concat(value, access, hexes), lambda s: F.struct(F.lit(1).alias("random"), s.alias("s"))),
            F.transform(words, lambda s: F.struct(F.lit(0).alias("random"), s.alias("s"))),
        )).alias("x")
    ).select("x.random", "x.s")
    pairs = samples.select(
        "random", F.explode(F.expr("transform(sequence(1, char_length(s) - 1), i -> substring(s, i, 2))")).alias("pair")
    )
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = len(SYMBOLS)
    of_next = {b: 1 + sum(counts.get((0, a + b), 0) for a in SYMBOLS) for b in SYMBOLS}
    overall = {1: dict.fromkeys(SYMBOLS, 1 / size), 0: {b: n / sum(of_next.values()) for b, n in of_next.items()}}
    logs = {}
    for label in (1, 0):
        for a in SYMBOLS:
            after = sum(counts.get((label, a + b), 0) for b in SYMBOLS) + rule.smoothing
            for b in SYMBOLS:
                logs[label, a + b] = math.log((counts.get((label, a + b), 0) + rule.smoothing * overall[label][b]) / after)
    return [logs[1, a + b] - logs[0, a + b] for a in SYMBOLS for b in SYMBOLS]


def scan(docs: DataFrame, rule: Markov = Markov(), text: str = "text", base: str = "base", found: str = "found") -> DataFrame:
    """Adds (or replaces) the columns named ``base`` and ``found``, arrays of (start, kind_no, kind, end): the base spans, and these with the
    spans of the Markov models that overlap none of them. Null texts are empty; rows stay as they are."""
    body = F.coalesce(F.col(text), F.lit(""))
    table = F.from_json(F.lit(json.dumps(train(docs, rule, text))), "array<double>")  # folded into one constant
    token = f"[A-Za-z0-9+/_=-]{{{rule.min_length},}}"

    def ratio(m: Column) -> Column:
        code = lambda i: F.instr(F.lit(SYMBOLS), F.substr(m, i, F.lit(1))) - 1
        steps = F.sequence(F.lit(1), F.char_length(m) - 1)
        return F.aggregate(steps, F.lit(0.0), lambda total, i: total + F.get(table, code(i) * len(SYMBOLS) + code(i + 1)))

    varied = lambda m: F.size(F.array_distinct(F.split(m, ""))) >= rule.distinct
    likely = _spans(body, token, 3, lambda m: varied(m) & (ratio(m) > rule.margin))
    both = F.struct(base_spans(body).alias("base"), likely.alias("likely"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (base, found)]
    row, spans = (f"{n}_{uuid.uuid4().hex}" for n in ("row", "spans"))  # whatever the columns of docs are called
    together = docs.select(F.struct(*kept).alias(row), both.alias(spans))
    apart = F.filter(
        f"{spans}.likely", lambda x: ~F.exists(f"{spans}.base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    )
    return together.select(
        f"{row}.*", F.col(f"{spans}.base").alias(base), F.array_sort(F.concat(f"{spans}.base", apart)).alias(found)
    )


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each stretch of ``spans`` (sorted by start, may overlap) replaced by ``mark``."""

    def step(state: Column, s: Column) -> Column:
        between = F.substr(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        out = F.when(s["start"] < state["at"], state["out"]).otherwise(F.concat(state["out"], between, F.lit(mark)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    rest = lambda state: F.concat(state["out"], F.substr(text, (state["at"] + 1).cast("int")))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)
