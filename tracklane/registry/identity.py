"""The fleet log with the vehicles of its trip and task calls found, and what hangs on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklane.operators import identity, layers, segments
from tracklane.registry.base import TRACK, query
from tracklane.views import read_view

CALLS = identity.Calls(tasks="tasks", slot=TRACK.slot)


def _sightings(name: str, id: str, ids: str | None, value: str) -> str:
    listed = f" union all select unnest({ids}), event_ms, event_id, {value} from fleet_calls where {value} is not null" if ids else ""
    return f"""{name} as (select id, event_ms, arg_max(value, event_id) as newest, arg_min(value, event_id) as oldest from (
  select {id} as id, event_ms, event_id, {value} as value from fleet_calls where {value} is not null{listed}
) where id is not null group by 1, 2)"""


def _as_of(name: str, rows: str, id: str, seen: str, value: str) -> str:
    return f"""{name}_past as (select r.*, s.newest from {rows} r asof left join {seen} s on r.{id} = s.id and r.event_ms >= s.event_ms),
{name} as (select r.* exclude (newest), coalesce(r.newest, s.oldest) as {value} from {name}_past r asof left join {seen} s on r.{id} = s.id and r.event_ms < s.event_ms)"""


RESOLVED = ", ".join([
    _sightings("by_trip", "trip_id", "current_trips", "vehicle_id"), _sightings("by_task", "task_id", "tasks", "vehicle_id"),
    _sightings("of_task", "task_id", None, "trip_id"), "unnamed as (select event_id, event_ms, trip_id, task_id from fleet_calls where vehicle_id is null)",
    _as_of("r1", "unnamed", "trip_id", "by_trip", "v1"), _as_of("r2", "r1", "task_id", "by_task", "v2"),
    _as_of("r3", "r2", "task_id", "of_task", "via"), _as_of("r4", "r3", "via", "by_trip", "v3"),
    """resolved as (
  select c.* exclude (vehicle_id), coalesce(c.vehicle_id, v1, v2, v3) as vehicle_id, case when c.vehicle_id is not null then 'own'
    when v1 is not null then 'trip' when v2 is not null then 'task' when v3 is not null then 'task_trip' end as vehicle_from
  from fleet_calls c left join r4 using (event_id)
)""",
])


def resolved(spark, sf):
    return identity.resolve_vehicle(read_view(spark, sf, "fleet_calls"), CALLS)


@query("resolve_vehicle", "fleet_calls", sql=f"with {RESOLVED} select event_id, event_ms, api, vehicle_id, vehicle_from from resolved")
def _(spark, sf):
    return resolved(spark, sf).select("event_id", "event_ms", "api", "vehicle_id", "vehicle_from")


@query("resolved_segment_trip_logs", "fleet_calls", sql=f"""
with {RESOLVED}, u as (select *, current_trips[1] as ident from resolved where api = 'updateVehicle'),
m as (select *, case when row_number() over w = 1 or ident is distinct from lag(ident) over w then 1 else 0 end as brk from u
  window w as (partition by vehicle_id order by event_ms, event_id)),
n as (select *, sum(brk) over w - 1 as segment_idx from m window w as (partition by vehicle_id order by event_ms, event_id)),
s as (select distinct vehicle_id, segment_idx, ident from n where ident is not null)
select s.vehicle_id, s.segment_idx, s.ident as segment_name, l.event_id, l.api, l.vehicle_from from s join resolved l
on l.vehicle_id = s.vehicle_id and l.trip_id = s.ident and l.api in ('createTrip', 'updateTrip')""")
def _(spark, sf):
    log = resolved(spark, sf).withColumn("ident", F.get("current_trips", F.lit(0)))
    found = segments.trip_segments(log, "ident", "raw_lat", "raw_lng", TRACK)
    rows = segments.segment_trip_logs(found, log).filter("event_id is not null")
    return rows.join(log.select("event_id", "vehicle_from"), "event_id").select(
        "vehicle_id", "segment_idx", "segment_name", "event_id", "api", "vehicle_from"
    )


@query("resolved_status_changes", "fleet_calls", sql=f"""
with {RESOLVED}, s as (select *, lag(trip_status) over (partition by vehicle_id order by event_ms, event_id) as was from resolved where trip_status is not null)
select vehicle_id, event_ms, event_id, trip_status as new_status from s where was is distinct from trip_status""")
def _(spark, sf):
    return segments.status_changes(resolved(spark, sf), TRACK)


@query("resolved_status_asof", "fleet_calls", sql=f"""
with {RESOLVED}, s as (select vehicle_id, event_ms, arg_max(trip_status, event_id) as status from resolved where trip_status is not null group by 1, 2),
p as (select event_id, vehicle_id, event_ms from resolved where resp_lat is not null and vehicle_id is not null)
select p.event_id, p.vehicle_id, p.event_ms, s.status from p asof left join s on p.vehicle_id = s.vehicle_id and p.event_ms > s.event_ms""")
def _(spark, sf):
    log = resolved(spark, sf)
    probes = layers.located(log).filter("vehicle_id is not null").select("event_id", "vehicle_id", "event_ms")
    return segments.status_asof(probes, log, TRACK).select("event_id", "vehicle_id", "event_ms", "status")
