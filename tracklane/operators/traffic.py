"""Traffic styles of routes whose stretches are rows: a sweep over each route from start to end.

Starts and ends of stretches are sorted by route and place. A task sweeps its range with a heap of the stretches that
are open, by list order: the style of an interval is that of the first listed stretch over its start. A route that
goes on in the next task hands over what is open and not hidden by an earlier listed stretch that ends later; the
rows of such a later part wait until all parts before it are known, and are swept then. So the stretches of one
route may be spread over any number of tasks. Routes of few stretches that lie whole in a batch are not swept: their
intervals are worked out on arrays, many routes at a time.
"""

from __future__ import annotations

import heapq
import itertools
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.operators.route import NO_DATA, NORMAL
from tracklane.plans.joins import beside
from tracklane.session import settle

BEGIN, STRETCH, CUT, END = range(4)
DONE, CARRY, WAITS = range(3)
AT_ONCE = 5000
FEW = 64


class Sweep:
    """A place on a route and the stretches open there."""

    def __init__(self, at: float | None = None, open_: list | None = None):
        self.at, self.open, self.count = at, open_ or [], 0

    def move(self, at: float) -> tuple[float, float, str] | None:
        """Go on to a place; the interval up to it, if there is one."""
        before, self.at = self.at, at
        if before is None or before == at:
            return None
        while self.open and self.open[0][2] <= before:
            heapq.heappop(self.open)
        return before, at, self.open[0][3] if self.open else NORMAL

    def add(self, order: tuple, end: float, style: str) -> None:
        if end > self.at:
            self.count += 1
            heapq.heappush(self.open, (order, self.count, end, style))

    def packed(self) -> bytes:
        """What a later part needs: of the open stretches those that outlast all listed before them."""
        kept, end = [], self.at
        for x in sorted(self.open):
            if x[2] > end:
                kept.append((x[0], len(kept), x[2], x[3]))
                end = x[2]
        return pickle.dumps((self.at, kept))


def _order(values: tuple) -> tuple:
    return tuple((v is not None, v) for v in values)


class Rows:
    """Output rows: what (DONE, CARRY, WAITS), route, part, start_m, end_m, style, packed."""

    def __init__(self, route: pa.DataType):
        self.types = [pa.int32(), route, pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.binary()]
        self.out: list[tuple] = []

    def interval(self, route, found: tuple | None) -> None:
        if found:
            self.out.append((DONE, route, None, *found, None))

    def flushed(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        columns = zip(*out) if out else [[]] * len(self.types)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, self.types)], names=NAMES)


NAMES = ["what", "route", "part", "start_m", "end_m", "style", "packed"]


def _runs(batch: pa.RecordBatch) -> np.ndarray:
    """Where the rows of each route start, and the end of the last."""
    route = batch.column(0)
    if len(route) < 2:
        return np.array([0, len(route)])
    one, two = route.slice(0, len(route) - 1), route.slice(1)
    same = pc.fill_null(pc.equal(one, two), False)
    same = np.asarray(pc.or_(same, pc.and_(pc.is_null(one), pc.is_null(two))))
    return np.concatenate([[0], np.flatnonzero(~same) + 1, [len(route)]])


def _short_routes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Intervals of whole routes of few stretches each: for all of them at once, the first listed stretch over each
    start, then the second, until every interval has one."""
    starts = _runs(batch)
    run = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at, kind, end = np.asarray(batch.column(1)), np.asarray(batch.column(2)), batch.column(3).to_numpy(zero_copy_only=False)
    marks = np.flatnonzero((kind == STRETCH) | (kind == CUT))
    here, there = marks[:-1], marks[1:]
    new = (run[here] == run[there]) & (at[here] != at[there])
    here, there = here[new], there[new]

    names = [f"o{i}" for i in range(batch.num_columns - 5)]
    listed = pa.table([pa.array(run), *batch.columns[5:], pa.array(np.arange(len(run)))], names=["run", *names, "row"])
    own = np.flatnonzero(kind == STRETCH)
    own = own[np.asarray(pc.sort_indices(listed.take(own), sort_keys=[(n, "ascending") for n in listed.column_names], null_placement="at_start"))]
    first = np.searchsorted(run[own], np.arange(len(starts)))
    found, todo, k = np.full(len(here), -1), np.arange(len(here)), 0
    while len(todo):
        todo = todo[first[run[here[todo]]] + k < first[run[here[todo]] + 1]]
        stretch = own[first[run[here[todo]]] + k]
        over = (at[stretch] <= at[here[todo]]) & (end[stretch] > at[here[todo]])
        found[todo[over]] = stretch[over]
        todo, k = todo[~over], k + 1
    bare = pa.array(found < 0)
    style = pc.if_else(bare, NORMAL, batch.column(4).take(pa.array(found, mask=found < 0)))
    n = len(here)
    return pa.record_batch([
        pa.array(np.full(n, DONE, np.int32)), batch.column(0).take(pa.array(here)), pa.nulls(n, pa.int32()),
        pa.array(at[here]), pa.array(at[there]), style.cast(pa.string()), pa.nulls(n, pa.binary()),
    ], names=NAMES)


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """The rows in order: as (True, whole routes of few stretches) and (False, any others, perhaps part of a route)."""
    held, going, nothing = None, False, object()  # ``going``: the rows at the start belong to a route handed out in part
    last = nothing
    for batch in itertools.chain(batches, [None]):
        if batch is None:
            chunk, final = held, True
        else:
            chunk, final = batch, False
            if held is not None and held.num_rows:
                chunk = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if chunk is None or not chunk.num_rows:
            continue
        starts = _runs(chunk)
        kind = np.asarray(chunk.column(2))
        going = going and chunk.column(0)[0].as_py() == last
        upto = len(starts) - 1
        if not final and starts[-1] - starts[-2] < AT_ONCE:
            upto -= 1  # the last route may go on
        held = chunk.slice(starts[upto])
        begins, ends = starts[:upto], starts[1 : upto + 1]
        stretches = np.concatenate([[0], np.cumsum(kind == STRETCH)])
        short = (kind[begins] == BEGIN) & (kind[ends - 1] == END) & (stretches[ends] - stretches[begins] <= FEW)
        if upto:
            if going:
                short[0] = False
            going = not final and upto == len(starts) - 1
            last = chunk.column(0)[int(ends[-1]) - 1].as_py() if going else nothing
            if going:
                short[-1] = False
        for mark, group in itertools.groupby(range(upto), lambda i: bool(short[i])):
            group = list(group)
            yield mark, chunk.slice(begins[group[0]], ends[group[-1]] - begins[group[0]])


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, rows, now, sweep, began = TaskContext.get().partitionId(), None, object(), Sweep(), False
    for short, batch in _parted(batches):
        if short:
            yield _short_routes(batch)
            continue
        rows = rows or Rows(batch.schema.field(0).type)
        for route, at, kind, end, style, *order in zip(*(c.to_pylist() for c in batch.columns)):
            if route != now:
                now, sweep, began = route, Sweep(), kind == BEGIN
            if kind == END:
                began = began and None  # nothing to hand over
            if began is False:
                rows.out.append((WAITS, route, part, at, None, None, pickle.dumps((kind, end, style, _order(order)))))
            elif kind in (STRETCH, CUT):
                rows.interval(route, sweep.move(at))
                if kind == STRETCH:
                    sweep.add(_order(order), end, style)
        if len(rows.out) >= AT_ONCE:
            yield rows.flushed()
    if began:
        rows.out.append((CARRY, now, part, None, None, None, sweep.packed()))
    if rows:
        yield rows.flushed()


def _skylines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each waiting part leaves open of its own, as CARRY rows."""
    rows, now, sweep = None, object(), None
    for batch in batches:
        rows = rows or Rows(batch.schema.field(0).type)
        for route, part, at, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if (route, part) != now:
                if sweep:
                    rows.out.append((CARRY, *now, None, None, None, sweep.packed()))
                now, sweep = (route, part), Sweep()
            kind, end, style, order = pickle.loads(packed)
            if kind != END:
                sweep.move(at)
            if kind == STRETCH:
                sweep.add(order, end, style)
        if len(rows.out) >= AT_ONCE:
            yield rows.flushed()
    if sweep and sweep.at is not None:
        rows.out.append((CARRY, *now, None, None, None, sweep.packed()))
    if rows:
        yield rows.flushed()


def _handed_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From what each part leaves open to what the parts behind it start with, route by route."""
    rows, now, at, open_ = None, object(), None, []
    for batch in batches:
        rows = rows or Rows(batch.schema.field(0).type)
        for route, part, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if route != now:
                now, at, open_ = route, None, []
            else:
                rows.out.append((CARRY, route, part, None, None, None, pickle.dumps((at, open_))))
            new_at, more = pickle.loads(packed)
            whole = Sweep(new_at if new_at is not None else at)
            for order, _, end, style in sorted([*open_, *more], key=lambda x: (x[0], -x[2])):
                whole.add(order, end, style)
            at, open_ = pickle.loads(whole.packed())
        if len(rows.out) >= AT_ONCE:
            yield rows.flushed()
    if rows:
        yield rows.flushed()


def _later_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of waiting parts; each part's CARRY row comes first."""
    rows, now, sweep = None, object(), None
    for batch in batches:
        rows = rows or Rows(batch.schema.field(0).type)
        for route, part, what, at, packed in zip(*(c.to_pylist() for c in batch.columns)):
            if (route, part) != now:
                now, sweep = (route, part), None
            if what == CARRY:
                where, open_ = pickle.loads(packed)
                sweep = Sweep(where)
                for order, _, end, style in open_:
                    sweep.add(order, end, style)
                continue
            kind, end, style, order = pickle.loads(packed)
            if kind in (STRETCH, CUT):
                rows.interval(route, sweep.move(at))
            if kind == STRETCH:
                sweep.add(order, end, style)
        if len(rows.out) >= AT_ONCE:
            yield rows.flushed()
    if rows:
        yield rows.flushed()


def traffic_segments(stretches: DataFrame, order: list[str], routes: DataFrame | float, route: str = "route_id") -> DataFrame:
    """Styled intervals ``route``, ``start_m``, ``end_m``, ``style`` of routes whose stretches are rows with ``offset_m``,
    ``length_m`` (any numbers; no offset is 0, no length covers nothing), ``style`` and the columns ``order``.

    ``routes`` has one row per route with its ``total_m``, and ``gone_m`` where a part from the start is travelled (it is
    without data, ahead of all stretches); a number is the length of every route that has stretches. Cuts are at 0, the
    total, and all starts and ends up to it.
    """
    kind = stretches.schema[route].dataType.simpleString()
    at = F.coalesce(F.col("offset_m").cast("double"), F.lit(0.0))
    rows = stretches.select(route, at.alias("_at"), F.coalesce(at + F.col("length_m").cast("double"), at).alias("_end"), F.lit(1).alias("_late"), *order, "style")
    if isinstance(routes, DataFrame):
        totals = settle(routes.select(route, F.col("total_m").cast("double").alias("_total"), *(["gone_m"] if "gone_m" in routes.columns else [])))
        rows = beside(rows, totals.select(route, "_total"), [route])
        if "gone_m" in totals.columns:
            gone = totals.filter("gone_m > 0").select(route, F.lit(0.0).alias("_at"), F.col("gone_m").cast("double").alias("_end"), F.lit(0).alias("_late"), F.lit(NO_DATA).alias("style"), "_total")
            rows = rows.unionByName(gone, allowMissingColumns=True)
    else:
        rows = rows.withColumn("_total", F.lit(float(routes)))
        totals = stretches.select(route).distinct().withColumn("_total", F.lit(float(routes)))
    names = ["_late", *order]
    # Equal stretches are one: the first listed.
    first = rows.groupBy(route, "_at", "_end", "_total").agg(F.min(F.struct(*names, "style")).alias("x"))
    first = settle(first)  # read for the bounds of the ranges, and again for the rows
    opens = F.col("kind") == STRETCH
    own = first.select("*", F.explode(F.array(F.lit(STRETCH), F.lit(CUT))).alias("kind")).select(
        route, F.when(opens, F.col("_at")).otherwise(F.col("_end")).alias("at"), "kind", F.when(opens, F.col("_end")).alias("_end"),
        F.when(opens, F.col("x.style")).alias("style"), *[F.when(opens, F.col(f"x.{n}")).alias(f"_o{i}") for i, n in enumerate(names)], "_total")
    bounds = [(F.lit(-math.inf), BEGIN), (F.lit(0.0), CUT), (F.col("_total"), CUT), (F.lit(math.inf), END)]
    frame = totals.select(route, "_total", F.explode(F.array(*[F.struct(at.alias("at"), F.lit(k).alias("kind")) for at, k in bounds])).alias("e"))
    frame = frame.select(route, "e.at", "e.kind", "_total")
    events = own.unionByName(frame, allowMissingColumns=True).where((F.col("at") <= F.col("_total")) | (F.col("kind") == END)).drop("_total")
    events = events.repartitionByRange(route, "at").sortWithinPartitions(route, "at", "kind")
    schema = f"what int, route {kind}, part int, start_m double, end_m double, style string, packed binary"
    swept = settle(events.select(route, "at", "kind", "_end", "style", *[f"_o{i}" for i in range(len(names))]).mapInArrow(_first_pass, schema))

    waits = swept.filter(F.col("what") == WAITS).select("route", "part", "start_m", "packed")
    by_part = waits.withColumn("kind", F.col("start_m") == math.inf).repartition("route", "part").sortWithinPartitions("route", "part", "start_m")
    left = by_part.select("route", "part", "start_m", "packed").mapInArrow(_skylines, schema).unionByName(swept.filter(F.col("what") == CARRY))
    handed = left.repartition("route").sortWithinPartitions("route", "part").select("route", "part", "packed").mapInArrow(_handed_on, schema)
    rest = swept.filter(F.col("what") == WAITS).unionByName(handed).withColumn("_first", F.col("what") != CARRY)
    rest = rest.repartition("route", "part").sortWithinPartitions("route", "part", "_first", "start_m")
    later = rest.select("route", "part", "what", "start_m", "packed").mapInArrow(_later_parts, schema)
    done = swept.filter(F.col("what") == DONE).unionByName(later)
    return done.select(F.col("route").alias(route), "start_m", "end_m", "style")
