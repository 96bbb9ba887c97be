"""Fleet tables expressed over the benchmark tables (events, lineitem, orders).

The text is shared by Spark and the checking engine; ``{US}`` (microseconds since the epoch) and
``{STR}`` (string type) are the only differences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FLEET_LOG = """
with base as (
  select event_id, user_id as vehicle_id, event_type, value,
         cast(regexp_extract(props, '[0-9]+', 0) as int) as k,
         cast(floor(({US} - 1704067200000000) / 1000000.0) as bigint) as event_ms
  from {events})
select event_id, vehicle_id, event_ms, k, value,
  case event_type when 'purchase' then 'updateTrip' when 'signup' then 'createTrip'
                  when 'error' then 'getVehicle' else 'updateVehicle' end as api,
  case when event_type = 'error' then concat('err-', cast(k as {STR})) end as error,
  case when k % 4 = 3 then null else cast(37.70 + (k % 5) * 0.01 as double) end as raw_lat,
  case when k % 4 = 3 then null else cast(-122.40 - (k % 5) * 0.01 as double) end as raw_lng,
  case when k % 6 = 5 then null else cast(37.70 + (k % 5) * 0.01 + (k % 3) * 0.00001 as double) end as resp_lat,
  case when k % 6 = 5 then null else cast(-122.40 - (k % 5) * 0.01 as double) end as resp_lng,
  case when k % 4 <> 3 then (k * 37) % 360 end as heading,
  case when k % 10 <> 0 then k % 10 end as heading_accuracy,
  round(value / 10.0 - 1.0, 3) as speed,
  case when k % 8 <> 0 then value end as accuracy,
  case k % 5 when 0 then 'GPS' when 1 then 'NETWORK' when 2 then 'PASSIVE'
             when 3 then 'FUSED_LOCATION_PROVIDER' else null end as sensor,
  event_ms + (k - 50) * 10 as client_ms,
  case k % 7 when 0 then 'NO_GUIDANCE' when 1 then 'ENROUTE_TO_DESTINATION' when 2 then 'OFF_ROUTE'
             when 3 then 'ARRIVED_AT_DESTINATION' else null end as nav_status,
  case when k % 3 = 0 then concat('route-', cast(k as {STR})) end as route,
  case when k % 2 = 0 then event_ms + k * 1000 end as eta_ms,
  case when k < 20 then null
       else concat('trip-', cast(vehicle_id as {STR}), '-', cast(cast(floor(event_ms / 600000.0) as bigint) as {STR})) end as trip_id,
  case when event_type in ('purchase', 'signup') then
    case k % 6 when 0 then 'NEW' when 1 then 'ENROUTE_TO_PICKUP' when 2 then 'ARRIVED_AT_PICKUP'
               when 3 then 'ENROUTE_TO_DROPOFF' when 4 then 'COMPLETE' else 'CANCELED' end end as trip_status
from base
"""

# The fleet log as its calls carry it: most trip and task calls don't name a vehicle; half of the trips are served by
# several vehicles, one after the other.
FLEET_CALLS = f"""
with log as ({FLEET_LOG}),
named as (select *, case when k >= 20 then concat('trip-', cast(case when vehicle_id % 2 = 0 then vehicle_id % 40 else vehicle_id end as {{STR}}), '-',
  cast(cast(floor(event_ms / 600000.0) as bigint) as {{STR}})) end as trip, concat('task-', cast(vehicle_id % 3 as {{STR}}), '-', cast(k % 25 as {{STR}})) as task from log)
select event_id, event_ms, k, case when api = 'getVehicle' then 'updateTask' else api end as api,
  case when api in ('createTrip', 'updateTrip') and k % 3 <> 0 then null when api = 'getVehicle' and k % 7 <> 0 then null else vehicle_id end as vehicle_id,
  case when api = 'updateVehicle' or (api = 'getVehicle' and k % 4 <> 0) then null else trip end as trip_id,
  case when api = 'getVehicle' then task end as task_id,
  case when api = 'updateVehicle' then split(trip, ',') end as current_trips,
  case when api = 'updateVehicle' and k % 5 = 0 then split(task, ',') end as tasks,
  raw_lat, raw_lng, resp_lat, resp_lng, trip_status
from named
"""

TASK_LOG = """
select concat(cast(l_orderkey as {STR}), '-', cast(l_linenumber as {STR})) as task_id,
  l_orderkey as vehicle_id, l_linenumber as stop_no, l_shipdate as event_time,
  l_partkey, l_suppkey, l_extendedprice,
  case l_linestatus when 'O' then 'OPEN' else 'CLOSED' end as state,
  case l_returnflag when 'A' then 'SUCCEEDED' when 'R' then 'FAILED' end as outcome,
  case when l_returnflag <> 'N' then 'LAST_VEHICLE_LOCATION' end as outcome_source,
  cast(37.0 + (l_partkey % 1000) * 0.001 as double) as planned_lat,
  cast(-122.0 - (l_partkey % 700) * 0.001 as double) as planned_lng,
  cast(37.0 + (l_partkey % 1000) * 0.001 + (l_suppkey % 10) * 0.0001 as double) as outcome_lat,
  cast(-122.0 - (l_partkey % 700) * 0.001 as double) as outcome_lng
from {lineitem}
"""

ROAD_STRETCH = """
select l_orderkey as route_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  cast((l_suppkey * 37) % 1000 as bigint) as offset_m, cast(l_quantity * 10 as bigint) as length_m,
  case l_returnflag when 'A' then 'SLOWER_TRAFFIC' when 'R' then 'TRAFFIC_JAM' else 'NORMAL' end as style
from {lineitem}
"""

RAW_LOG = """
select concat('e', cast(event_id as {STR})) as insert_id,
  case when event_type = 'error' then concat('e', cast(event_id - 1 as {STR})) end as parent_insert_id,
  case when event_type = 'error' then 'UpdateVehicleRestrictedLog' else 'UpdateVehicleLog' end as log_type,
  event_id, event_type, user_id as vehicle_id, ts, value, props,
  cast(regexp_extract(props, '[0-9]+', 0) as int) as k,
  cast(floor(({US}) / 1000.0) as bigint) as event_ms
from {events}
"""

TRIP_LOG = """
select concat('trip-', cast(o_orderkey as {STR})) as trip_id, o_orderkey as order_id, o_custkey as vehicle_id,
  o_orderdate as event_time,
  case o_orderstatus when 'F' then 'COMPLETE' when 'O' then 'NEW' else 'ENROUTE_TO_PICKUP' end as trip_status,
  cast(37.0 + (o_custkey % 500) * 0.001 as double) as pickup_lat,
  cast(-122.0 - (o_orderkey % 500) * 0.001 as double) as pickup_lng,
  case when o_orderstatus = 'F' then cast(37.0 + (o_custkey % 500) * 0.001 + 0.0005 as double) end as actual_pickup_lat,
  case when o_orderstatus = 'F' then cast(-122.0 - (o_orderkey % 500) * 0.001 as double) end as actual_pickup_lng
from {orders}
"""

VIEWS = {
    "fleet_log": FLEET_LOG,
    "fleet_calls": FLEET_CALLS,
    "task_log": TASK_LOG,
    "road_stretch": ROAD_STRETCH,
    "raw_log": RAW_LOG,
    "trip_log": TRIP_LOG,
}
# The order of stretches in a route and of versions of a task, total on the given columns.
STRETCH_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def read_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].replace("{US}", "unix_micros(cast(ts as timestamp))").replace("{STR}", "string")
    tables = {
        t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        for t in ("events", "lineitem", "orders")
        if "{" + t + "}" in text
    }
    return spark.sql(text, **tables)


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named views as common table expressions for the checking engine."""
    parts = []
    for name in names:
        text = VIEWS[name].replace("{US}", "epoch_us(ts)").replace("{STR}", "varchar")
        for table in ("events", "lineitem", "orders"):
            text = text.replace("{" + table + "}", table)
        parts.append(f"{name} as ({text})")
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ", ".join(parts) + ", " + body[15:]
    if body.lower().startswith("with "):
        return "with " + ", ".join(parts) + ", " + body[5:]
    return "with " + ", ".join(parts) + " " + body
