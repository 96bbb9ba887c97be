"""The vehicle of calls that don't name one, found through trips and tasks as of the time of the call.

Trip and task calls often lack a vehicle label. Vehicle updates list the trips they serve and the tasks still to
come, and some trip and task calls do name their vehicle; each is a *sighting* of an id with a vehicle. A call gets
the vehicle of the last sighting of its trip at or before its time, else of the first one after it (a trip is
created before any vehicle lists it), then of its task, then of the trip that its task was last seen with.

Most ids are only ever seen with one vehicle. They are settled by a table with a row per id; just the ids seen with
several are looked up in time order, by the scan that cuts long histories.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.plans.history import Track, scan, unchunked
from tracklane.plans.joins import beside
from tracklane.session import settle


@dataclass(frozen=True)
class Calls:
    """Columns of a log. ``trips`` and ``tasks`` are lists on vehicle rows (None: the log has none); ids are told
    apart by ``keys`` (such as a dataset) too. ``time`` and ``ties`` number a row within its keys. ``alone``: a call
    that nothing else tells of belongs to the only vehicle of its keys, as in a log loaded for one vehicle."""

    vehicle: str = "vehicle_id"
    trip: str = "trip_id"
    task: str = "task_id"
    trips: str | None = "current_trips"
    tasks: str | None = None
    keys: tuple[str, ...] = ()
    time: str = "event_ms"
    ties: tuple[str, ...] = ("event_id",)
    slot: int = Track.slot
    max_rows: int = Track.max_rows
    alone: bool = False


def _known(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def sightings(log: DataFrame, id: str, ids: str | None, value: str, calls: Calls = Calls()) -> DataFrame:
    """(keys, time, ties, ``id``, ``value``) of each row that has a value, for its own id and each of its list ``ids``."""
    own = F.when(_known(F.col(id)), F.array(F.col(id))).otherwise(F.array().cast(f"array<{log.schema[id].dataType.simpleString()}>"))
    every = own if ids is None else F.array_union(own, F.coalesce(F.col(ids), own))
    rows = log.filter(_known(F.col(value))).select(*calls.keys, calls.time, *calls.ties, F.explode(every).alias("id"), F.col(value).alias("value"))
    return rows.filter(_known(F.col("id")))


def as_of(rows: DataFrame, seen: DataFrame, id: str, name: str, calls: Calls = Calls()) -> DataFrame:
    """Adds ``name``: the value that ``rows[id]`` was last seen with at or before the row's time, else first after it.
    Of sightings at one time the last by ``ties`` counts. Rows without an id get none."""
    keys = [*calls.keys, "id"]
    owners = settle(seen.groupBy(*keys).agg(F.min("value").alias("_low"), F.max("value").alias("_high")))
    named = rows.withColumn("id", F.col(id))
    placed = beside(named.filter(_known(F.col("id"))), owners, keys, "left")
    sole = placed.filter(F.col("_low").eqNullSafe(F.col("_high"))).withColumn(name, F.col("_low"))
    several = owners.filter("_low != _high")
    line = placed.filter("_low != _high").withColumn("_kind", F.lit(1)).unionByName(
        beside(seen, several.select(*keys), keys, "left_semi").withColumn("_kind", F.lit(0)), allowMissingColumns=True
    )
    track = Track(keys=tuple(keys), time=calls.time, ties=("_kind", *calls.ties), slot=calls.slot, max_rows=calls.max_rows)
    past = scan(line, track, prior={"_past": (F.col("value"), F.col("_kind") == 0)})
    both = scan(past, track, prior={"_next": (F.col("value"), F.col("_kind") == 0)}, reverse=True).filter("_kind = 1")
    looked_up = unchunked(both).withColumn(name, F.coalesce("_past", "_next"))
    without = rows.filter(~_known(F.col(id))).withColumn(name, F.lit(None).cast(seen.schema["value"].dataType))
    columns = [*rows.columns, name]
    return sole.select(*columns).unionByName(looked_up.select(*columns)).unionByName(without.select(*columns))


def resolve_vehicle(log: DataFrame, calls: Calls = Calls(), source: str = "vehicle_from") -> DataFrame:
    """The log with its vehicle column filled in, and ``source``: ``own``, ``trip``, ``task``, ``task_trip``, ``alone``, or
    NULL where nothing tells. An empty vehicle, trip or task is none. Rows that have a vehicle are not shuffled.
    """
    has = _known(F.col(calls.vehicle))
    place = [*calls.keys, calls.time, *calls.ties]
    by_trip = sightings(log, calls.trip, calls.trips, calls.vehicle, calls)
    by_task = sightings(log, calls.task, calls.tasks, calls.vehicle, calls)
    trip_of_task = sightings(log, calls.task, None, calls.trip, calls)
    # Only what the lookup needs travels; settled, since every step splits the rows.
    rows = settle(log.filter(~has).select(*place, F.col(calls.trip).alias("trip"), F.col(calls.task).alias("task")))
    rows = settle(as_of(as_of(rows, by_trip, "trip", "_trip", calls), by_task, "task", "_task", calls))
    rest = rows.filter("_trip is null and _task is null")
    rest = as_of(as_of(rest, trip_of_task, "task", "_via", calls), by_trip, "_via", "_task_trip", calls)
    done = rows.filter("_trip is not null or _task is not null").unionByName(rest.drop("_via"), allowMissingColumns=True)
    steps = {"trip": F.col("_trip"), "task": F.col("_task"), "task_trip": F.col("_task_trip")}
    if calls.alone:
        only = log.filter(has).groupBy(*calls.keys).agg(F.min(calls.vehicle).alias("_low"), F.max(calls.vehicle).alias("_high"))
        only = only.filter("_low = _high").select(*calls.keys, F.col("_low").alias("_only"))
        if calls.keys:
            done = beside(done, only, list(calls.keys), "left")
        else:
            done = done.withColumn("_at", F.lit(1)).join(F.broadcast(only.withColumn("_at", F.lit(1))), "_at", "left").drop("_at")  # one row
        steps["alone"] = F.col("_only")
    found = done.select(
        *place, F.coalesce(*steps.values()).alias("_vehicle"), F.coalesce(*[F.when(c.isNotNull(), n) for n, c in steps.items()]).alias(source)
    )
    filled = [F.col("_vehicle").alias(c) if c == calls.vehicle else F.col(f"o.`{c}`").alias(c) for c in log.columns]
    same = reduce(Column.__and__, [F.col(f"o.`{c}`").eqNullSafe(F.col(f"f.`{c}`")) for c in place])
    joined = log.filter(~has).alias("o").join(found.alias("f"), same, "left").select(*filled, source)
    return log.filter(has).select("*", F.lit("own").alias(source)).unionByName(joined)
