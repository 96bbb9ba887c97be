r"""Personal data by candidate gradient boosting, with DataFrame functions only.

Fixed patterns find the base spans, which always stay. Generators of high recall propose further spans, which may
overlap. Each candidate gets small whole numbers that tell its format and its context; none of them tells what sets
base spans apart by definition (a leading plus, the @ itself). Candidates that meet a base span are the positive
examples, all others are unlabelled. Boosted trees learn one from the other, so a candidate of the format and
context of known ones scores high. On candidates held out by their text scores are calibrated: each generator gets the
lowest threshold at which most candidates of that score are known; without one it adds nothing.

The numbers of a candidate are few, so counts of each combination over all documents hold all that the trees learn
from (``FEATURES`` bounds how many there are); they are added up by Spark, and splits are chosen on the sums.

Positions count code points. The texts between matches and the matches give them by a running sum over 4, 16, 64 and
more places: every operation is at most n log n in the length of a text, none is by pairs. A null or empty text has no
spans; ties, repeated rows and rows without an id are treated like others.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, in their order: fixed values. Possessive where the greedy form matches the same, and
# a run of characters is tried from its start only, or from the last match: so no text takes quadratic time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "likely_email", "likely_ip", "likely_number")
BASE = 4

# Generators. A bracketed or spaced sign stands for the plain one.
AT, DOT = r"(?:\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?|\x20?@\x20?)", r"(?:\x20?[\[({]\x20?(?:(?i:dot)|\.)\x20?[\])}]\x20?|\.)"
LIKE_EMAIL = rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)*+"
LIKE_IP = r"(?<![0-9])[0-9]{1,3}+(?:\x20?[\[({]?\x20?\.\x20?[\])}]?\x20?[0-9]{1,3}+){3}"
LIKE_NUMBER = r"\(?[0-9](?:[\x20().\/-]{0,2}+[0-9]){6,}+"

CUES = (
    r"(?i)\b(?:tel|telefon|phone|call|fax|mobile|cell|whatsapp|sms)\b",
    r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    r"(?i)\b(?:card|visa|mastercard|amex|account|iban|pay|payment)\b",
    r"(?i)\b(?:order|invoice|ref|version|isbn|serial|sku|part|id|no|nr|build|page)\b",
)
# What a candidate is told by, and the number of values of each: 110,592 combinations at most.
FEATURES = {"kind": 3, "digits": 6, "groups": 4, "longest": 4, "last": 4, "left": 4, "right": 3, "cue": 4 + 1, "luhn": 2}
SPAN = "array<struct<start:bigint,kind_no:int,end:bigint>>"
CANDIDATE = f"array<struct<start:bigint,end:bigint,known:boolean,fold:int,{','.join(f'{f}:int' for f in FEATURES)}>>"


@dataclass(frozen=True)
class Boosting:
    """``rounds`` trees of ``depth`` levels with shrinkage ``rate``; ``ridge`` steadies leaves, a split has ``fewest``
    candidates on each side. One candidate text of ``folds`` is held out; of held-out candidates with the score of a chosen
    one a share of ``precision`` is known (calibrated), and above a threshold are ``support`` at least. ``context`` code
    points are read on the left."""

    rounds: int = 20
    depth: int = 3
    rate: float = 0.4
    ridge: float = 1.0
    fewest: int = 5
    folds: int = 5
    precision: float = 0.9
    support: int = 20
    context: int = 32


def running(values: Column, add: Callable[[Column, Column], Column], nothing: Column) -> Column:
    """For each place of an array, ``add`` over all values up to it. Step k adds up runs of 4^k; a step that the array is
    too short for is left out. 14 steps do for more places than an array of a JVM holds."""

    def widened(a: Column, step: Column) -> Column:
        before = lambda i, j: F.coalesce(_at(a, i - step * j), nothing)
        one = lambda v, i: add(add(add(v, before(i, 1)), before(i, 2)), before(i, 3))
        return F.when(F.size(a) > step, F.transform(a, one)).otherwise(a)

    return F.aggregate(F.array(*[F.lit(4**k) for k in range(14)]), values, widened)


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that it names more than once: the value is worked out one time."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _at(array: Column, place: Column) -> Column:
    return F.get(array, place)


def _matches(text: Column, pattern: str, may: Column) -> Column:
    """Matches of a pattern: an array of (start, end, m, before, after); ``before`` and ``after`` are the texts up to the
    neighbouring matches. ``may`` is a cheap condition that a text with a match meets."""
    parts = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))

    def placed(rows: Column) -> Column:
        sizes = F.transform(rows, lambda x: F.char_length(x["gap"]) + F.coalesce(F.char_length(x["m"]), F.lit(0)))
        ends = running(sizes.cast("array<bigint>"), lambda a, b: a + b, F.lit(0).cast("bigint"))
        both = F.arrays_zip(rows.alias("r"), ends.alias("e"))
        made = F.transform(both, lambda x, i: F.struct(
            (x["e"] - F.char_length(x["r"]["m"])).alias("start"), x["e"].alias("end"), x["r"]["m"].alias("m"),
            x["r"]["gap"].alias("before"), F.coalesce(_at(rows, i + 1)["gap"], F.lit("")).alias("after"),
        ))
        return F.filter(made, lambda x: x["m"].isNotNull())  # behind the last match there is a gap only

    found = once(parts, placed)
    none = F.array().cast("array<struct<start:bigint,end:bigint,m:string,before:string,after:string>>")
    return F.when(may & F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check: every second digit from the right counts double, cast out nines."""
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int")))
    marks = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(marks, F.lit(0), lambda a, b: a + b) % 10 == 0


def _kept(found: Column, kind_no: int, keep: Callable[[Column], Column] | None = None) -> Column:
    if keep is not None:
        found = F.filter(found, lambda x: keep(x["m"]))
    return F.transform(found, _span(kind_no))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by start, then by kind: an array of (start, kind_no, end)."""
    between = lambda m, low, high: F.length(_digits(m)).between(low, high)
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    small = lambda m: F.regexp_like(m, F.lit(rf"^(?:{part}\.){{3}}{part}$"))
    valid = lambda m: F.when(between(m, 14, 19), luhn(_digits(m))).otherwise(False)
    digit = F.regexp_like(text, F.lit("[0-9]"))
    return F.array_sort(F.concat(
        _kept(_matches(text, EMAIL, F.contains(text, F.lit("@"))), 0),
        _kept(_matches(text, IP, digit), 1, small),
        _kept(_matches(text, CARD.replace("++", "{13,}+"), digit), 2, valid),
        _kept(_matches(text, PHONE, F.contains(text, F.lit("+"))), 3, lambda m: between(m, 10, 15)),
    ))


def _bin(value: Column, *edges: int) -> Column:
    """How many of ``edges`` a number reaches."""
    return reduce(Column.__add__, [(value >= e).cast("int") for e in edges])


def _described(found: Column, kind: int, rule: Boosting) -> Column:
    """Numbers of ``FEATURES`` for the matches of a generator; left and right are the characters beside it."""

    def one(x: Column) -> Column:
        m, digits = x["m"], _digits(x["m"])
        if kind == 0:
            tail = F.regexp_extract(m, f"{AT}(.*)$", 1)
            pieces = F.split(tail, DOT)
        else:
            pieces = F.filter(F.split(m, "[^0-9]+"), lambda p: p != "")
        sizes = F.transform(pieces, lambda p: F.length(p))
        before, after = F.right(x["before"], F.lit(rule.context)), F.left(x["after"], F.lit(1))
        cue = F.lit(0)
        for no, words in reversed(list(enumerate(CUES, 1))):
            cue = F.when(F.regexp_like(before, F.lit(words)), no).otherwise(cue)
        edge = lambda c: F.when(c == "", 0).when(F.regexp_like(c, F.lit(r"^\s$")), 0).when(F.regexp_like(c, F.lit(r"^[\p{L}\p{N}]$")), 1)
        left = F.right(F.regexp_replace(before, r"\+$", ""), F.lit(1))
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.lit(False).alias("known"), F.pmod(F.xxhash64(m), F.lit(rule.folds)).cast("int").alias("fold"),
            F.lit(kind).alias("kind"), _bin(F.length(digits), 7, 10, 13, 16, 20).alias("digits"), _bin(F.size(pieces), 2, 3, 4).alias("groups"),
            _bin(F.array_max(sizes), 4, 5, 9).alias("longest"), _bin(_at(sizes, F.size(sizes) - 1), 2, 4, 5).alias("last"),
            edge(left).when(F.regexp_like(left, F.lit(r"""^["'(\[<,:;]$""")), 2).otherwise(3).alias("left"), edge(after).otherwise(2).alias("right"),
            cue.alias("cue"), F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False).cast("int").alias("luhn"),
        )

    return F.transform(found, one)


def _touching(spans: Column, others: Column) -> Column:
    """For each of ``spans`` (sorted by start), whether it shares a place with one of ``others``; an array of booleans.

    Sorted together, a span meets an earlier one if the farthest end so far is behind its start, and a later one if the
    nearest start to come is before its end."""
    mark = lambda own: lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"))
    both = F.array_sort(F.concat(F.transform(spans, mark(True)), F.transform(others, mark(False))))
    far, none = F.lit(2**62).cast("bigint"), F.lit(-1).cast("bigint")

    def met(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda x: F.when(x["own"], none).otherwise(x["end"])), F.greatest, none)
        starts = F.reverse(running(F.transform(F.reverse(rows), lambda x: F.when(x["own"], far).otherwise(x["start"])), F.least, far))
        # Of equal starts the other one comes first, being False.
        told = F.zip_with(F.arrays_zip(rows.alias("r"), ends.alias("e")), starts, lambda x, s: F.struct(
            x["r"]["own"].alias("own"), ((x["e"] > x["r"]["start"]) | (s < x["r"]["end"])).alias("met")
        ))
        return F.transform(F.filter(told, lambda x: x["own"]), lambda x: x["met"])

    return F.when(F.size(others) == 0, F.transform(spans, lambda x: F.lit(False))).otherwise(once(both, met))


def candidates(docs: DataFrame, rule: Boosting = Boosting(), text: str = "text", base: str = "base", proposed: str = "proposed") -> DataFrame:
    """Adds (or replaces) ``base``, an array of (start, kind_no, end), and ``proposed``, for each generator an array of
    (start, end, known, fold, features); known candidates meet a base span. Null texts are empty; rows stay as they are."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digit = F.regexp_like(body, F.lit("[0-9]"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (base, proposed)]
    row, spans, raw = (f"{n}_{uuid.uuid4().hex}" for n in ("row", "spans", "raw"))  # whatever the columns of docs are called
    found = [
        _described(_matches(body, LIKE_EMAIL, F.contains(body, F.lit("@")) | F.regexp_like(body, F.lit(r"[\[({]\x20?(?i:at)\x20?[\])}]"))), 0, rule),
        _described(_matches(body, LIKE_IP, digit), 1, rule), _described(_matches(body, LIKE_NUMBER, digit), 2, rule),
    ]
    one = docs.select(F.struct(*kept).alias(row), base_spans(body).alias(spans), F.array(*[f.cast(CANDIDATE) for f in found]).alias(raw))
    told = F.transform(raw, lambda c: F.zip_with(c, _touching(c, F.col(spans)), lambda x, met: x.withField("known", met)))
    return one.select(f"{row}.*", F.col(spans).alias(base), told.alias(proposed))


@dataclass(frozen=True)
class Model:
    """Trees as nested (feature, edge, left, right) with numbers at the leaves: less than the edge goes left. The
    threshold of each generator, None where it adds nothing."""

    trees: tuple
    start: float
    thresholds: tuple[float | None, ...]

    def score(self, x: Column) -> Column:
        """Log-odds of a candidate."""

        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, edge, left, right = node
            return F.when(x[feature] < edge, walk(left)).otherwise(walk(right))

        return reduce(Column.__add__, [walk(t) for t in self.trees], F.lit(self.start))

    def value(self, cell: dict[str, int]) -> float:
        def walk(node) -> float:
            while not isinstance(node, float):
                node = node[2] if cell[node[0]] < node[1] else node[3]
            return node

        return sum(map(walk, self.trees), self.start)

    def chosen(self, x: Column) -> Column:
        meets = [(x["kind"] == k) & (self.score(x) >= t) for k, t in enumerate(self.thresholds) if t is not None]
        return reduce(Column.__or__, meets, F.lit(False))


def _tree(cells: list[tuple[dict, float, float, int]], depth: int, rule: Boosting):
    """Newton step tree on (features, gradient, curvature, count): the split of the most gain at each node."""
    slope, curve = math.fsum(c[1] for c in cells), math.fsum(c[2] for c in cells)
    best = None
    if depth:
        for feature in FEATURES:
            sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0])
            for values, g, h, n in cells:
                held = sums[values[feature]]
                held[0] += g
                held[1] += h
                held[2] += n
            g = h = n = 0.0
            many = sum(s[2] for s in sums.values())
            for edge in sorted(sums)[1:]:
                before = max(v for v in sums if v < edge)
                g, h, n = g + sums[before][0], h + sums[before][1], n + sums[before][2]
                if min(n, many - n) < rule.fewest:
                    continue
                gain = g * g / (h + rule.ridge) + (slope - g) ** 2 / (curve - h + rule.ridge) - slope * slope / (curve + rule.ridge)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = gain, feature, edge
    if best is None:
        return -rule.rate * slope / (curve + rule.ridge)
    _, feature, edge = best
    halves = [c for c in cells if c[0][feature] < edge], [c for c in cells if c[0][feature] >= edge]
    return feature, edge, *(_tree(h, depth - 1, rule) for h in halves)


def fit(cells: list[tuple[dict[str, int], int, int]], back: list[tuple[dict[str, int], int, int]], rule: Boosting = Boosting()) -> Model:
    """Trees on ``cells`` (features, candidates, known ones), thresholds on ``back``. Without known ones, or with known
    ones only, nothing is learned and nothing added."""
    many, known = sum(n for _, n, _ in cells), sum(k for *_, k in cells)
    if not 0 < known < many:
        return Model((), 0.0, (None,) * FEATURES["kind"])
    start = math.log(known / (many - known))
    trees, odds = [], [start] * len(cells)
    for _ in range(rule.rounds):
        rows = []
        for (values, n, k), z in zip(cells, odds):
            p = 1 / (1 + math.exp(-z))
            rows.append((values, n * p - k, max(n * p * (1 - p), 1e-9), n))
        trees.append(_tree(rows, rule.depth, rule))
        step = Model((trees[-1],), 0.0, ())
        odds = [z + step.value(values) for (values, *_), z in zip(cells, odds)]
    model = Model(tuple(trees), start, ())
    thresholds = [threshold([(model.value(v), n, k) for v, n, k in back if v["kind"] == kind], rule) for kind in range(FEATURES["kind"])]
    return Model(model.trees, start, tuple(thresholds))


def threshold(judged: list[tuple[float, int, int]], rule: Boosting) -> float | None:
    """Lowest score (of score, candidates, known ones) whose calibrated share of known ones is high enough. Shares are
    calibrated by making them fall with the score: neighbours that don't are pooled."""
    pools: list[list] = []  # lowest score, candidates, known ones; from the highest score down
    for score, n, k in sorted(judged, reverse=True):
        pools.append([score, n, k])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] <= pools[-1][2] * pools[-2][1]:
            score, n, k = pools.pop()
            pools[-1] = [score, pools[-1][1] + n, pools[-1][2] + k]
    good = [p for p in pools if p[2] >= rule.precision * p[1]]
    return good[-1][0] - 1e-6 if sum(p[1] for p in good) >= rule.support else None


def train(found: DataFrame, rule: Boosting = Boosting(), proposed: str = "proposed") -> Model:
    """A model from the ``candidates`` of all documents. The driver gets one row for each combination of features."""
    flat = found.select(F.explode(F.flatten(F.col(proposed))).alias("x")).select("x.*")
    held = F.col("fold") == 0
    known = F.col("known").cast("long")
    sums = flat.groupBy(*FEATURES).agg(
        F.sum(F.when(~held, 1).otherwise(0)).alias("n"), F.sum(F.when(~held, known).otherwise(0)).alias("k"),
        F.sum(F.when(held, 1).otherwise(0)).alias("back_n"), F.sum(F.when(held, known).otherwise(0)).alias("back_k"),
    )
    rows = sorted(sums.collect(), key=tuple)
    values = lambda r: {f: r[f] for f in FEATURES}
    return fit([(values(r), r["n"], r["k"]) for r in rows if r["n"]], [(values(r), r["back_n"], r["back_k"]) for r in rows if r["back_n"]], rule)


def _span(kind_no: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"].alias("start"), F.lit(kind_no).alias("kind_no"), x["end"].alias("end"))


def _joined(pair: Column) -> Column:
    free = F.zip_with(pair["passed"], _touching(pair["passed"], pair["taken"]), lambda x, met: F.when(~met, x))
    return F.array_sort(F.concat(pair["taken"], F.filter(free, lambda x: x.isNotNull())))


def select(found: DataFrame, model: Model, base: str = "base", proposed: str = "proposed", spans: str = "spans") -> DataFrame:
    """Puts ``spans`` in place of ``proposed``: base spans and chosen candidates by start, then by kind. A candidate that
    meets a base span, or a chosen one of an earlier generator, is left out."""
    kept = [F.col(f"`{c}`") for c in found.columns if c not in (proposed, spans)]
    row, raw, taken = (f"{n}_{uuid.uuid4().hex}" for n in ("row", "raw", "taken"))
    out = found.select(F.struct(*kept).alias(row), F.col(proposed).alias(raw), F.col(base).cast(SPAN).alias(taken))
    for no, lowest in enumerate(model.thresholds):
        if lowest is not None:
            good = F.filter(F.get(raw, F.lit(no)), lambda x: ~x["known"] & model.chosen(x))
            both = F.struct(F.transform(good, _span(BASE + no)).alias("passed"), F.col(taken).alias("taken"))
            out = out.select(row, raw, once(both, _joined).cast(SPAN).alias(taken))  # one step at a time: expressions stay small
    return out.select(f"{row}.*", F.col(taken).alias(spans))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", _at(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(text: Column, spans: Column, mark: str = "[PERSONAL]") -> Column:
    """``text`` with each stretch of ``spans`` (sorted by start, may overlap) replaced by ``mark``; a null text stays."""
    reach = running(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0).cast("bigint"))
    chars = F.split(text, "")
    # A span starts a stretch if nothing before reaches it; a stretch ends where its farthest span does.
    rows = F.arrays_zip(spans.alias("s"), reach.alias("r"))

    def whole(a: Column) -> Column:
        opens = F.transform(a, lambda x, i: (i == 0) | (_at(a, i - 1)["r"] <= x["s"]["start"]))
        starts = F.transform(F.filter(F.arrays_zip(a.alias("a"), opens.alias("o")), lambda x: x["o"]), lambda x: x["a"]["s"]["start"])
        closes = F.transform(a, lambda x, i: F.when(F.coalesce(_at(a, i + 1)["s"]["start"] >= x["r"], F.lit(True)), x["r"]))
        return once(F.struct(starts.alias("starts"), F.filter(closes, lambda e: e.isNotNull()).alias("closes"), chars.alias("chars")), filled)

    def filled(x: Column) -> Column:
        cut = lambda at, to: F.array_join(F.slice(x["chars"], (at + 1).cast("int"), (to - at).cast("int")), "")
        behind = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(_at(x["closes"], i - 1))
        parts = F.transform(x["starts"], lambda s, i: F.concat(cut(behind(i), s), F.lit(mark)))
        return F.concat(F.array_join(parts, ""), cut(_at(x["closes"], F.size(x["closes"]) - 1), F.size(x["chars"])))

    return F.when(F.size(spans) > 0, once(rows, whole)).otherwise(text)
