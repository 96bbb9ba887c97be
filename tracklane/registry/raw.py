"""Queries over raw rows: clean-up, classification, scans, formatting, upkeep."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tracklane.functions import text
from tracklane.operators import filters, view
from tracklane.registry.base import fleet, query, r3
from tracklane.sinks import datasets
from tracklane.sources import files, merge, payload
from tracklane.views import read_view

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)


def raw(spark, sf):
    return read_view(spark, sf, "raw_log")


def iso(ms):
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


@query("restricted_merge", "raw_log", sql="""
with o as (select parent_insert_id, arg_max(value, event_id) as v, arg_max(props, event_id) as p from raw_log where log_type like '%Restricted%' group by 1)
select r.insert_id, coalesce(o.v, r.value) as value, coalesce(o.p, r.props) as props, o.parent_insert_id is not null as merged
from raw_log r left join o on o.parent_insert_id = r.insert_id where r.log_type not like '%Restricted%'""")
def _(spark, sf):
    out = merge.restricted_merge(raw(spark, sf), "insert_id", "parent_insert_id", "log_type", ["event_id"], ["value", "props"])
    return out.select("insert_id", "value", "props", "merged")


@query("normalise_payload", "raw_log", sql="""
select insert_id, concat('{"current', case when k % 2 = 0 then 'trips":["t-' || k || '"]' else 'state":"on"' end,
  ',"lastlocation":{"lat":', k, '}}') as payload from raw_log""")
def _(spark, sf):
    rows = raw(spark, sf)
    part = F.when(F.col("k") % 2 == 0, F.concat(F.lit('"current_Trips":["t-'), F.col("k").cast("string"), F.lit('"]'))).otherwise('"CurrentState":{"value":"on"}')
    dirty = F.concat(F.lit('{"lastLocation":{"lat":{"value":'), F.col("k").cast("string"), F.lit('},"e_m":{}},"none":null,'), part, F.lit("}"))
    return rows.select("insert_id", payload.normalise_payload(dirty).alias("payload"))


@query("api_classify", "raw_log", sql="""
select insert_id, case event_type when 'purchase' then 'updateTrip' when 'signup' then 'createDeliveryVehicle' when 'error' then 'getTask'
  when 'view' then 'updateVehicle' end as api from raw_log""")
def _(spark, sf):
    kind = F.expr("""case event_type when 'purchase' then 'type.example.com/v1.UpdateTripLog' when 'signup' then 'v1.CREATEDELIVERYVEHICLELog'
      when 'error' then 'getTask' when 'view' then 'xupdatevehiclex' else 'SomethingElse' end""")
    return raw(spark, sf).select("insert_id", text.api_of(kind).alias("api"))


@query("trim_enums", "raw_log", sql="""
select insert_id, concat('S', k % 4) as tripstatus, case when k % 3 = 0 then 'GPS' else 'OLD' end as locationsensor,
  [concat('EXCLUSIVE', k % 2), 'SHARED'] as supportedtriptypes from raw_log""")
def _(spark, sf):
    rows = raw(spark, sf)
    status = F.concat(F.lit("TRIP_STATUS_S"), (F.col("k") % 4).cast("string"))
    sensor = text.renamed(F.when(F.col("k") % 3 == 0, F.lit("LOCATION_SENSOR_GPS")), F.lit("OLD"), "LOCATION_SENSOR_")
    kinds = F.array(F.concat(F.lit("EXCLUSIVE_TRIP"), (F.col("k") % 2).cast("string")), F.lit("SHARED_TRIP"))
    return rows.select("insert_id", text.trim_text(status, "TRIP_STATUS_").alias("tripstatus"), sensor.alias("locationsensor"), text.trim_each(kinds, "_TRIP").alias("supportedtriptypes"))


@query("wrap_payload", "raw_log", sql="""
select insert_id, case when k % 2 = 0 then '{"jsonPayload":{"a":' || k || '},"timestamp":"T' || k || '"}' else '{"jsonPayload":{"a":' || k || ',"timestamp":"T' || k || '"}}' end as payload,
  'T' || k as timestamp from raw_log""")
def _(spark, sf):
    rows = raw(spark, sf).select("insert_id", F.expr("""case when k % 2 = 0 then concat('{"jsonPayload":{"a":', k, '},"timestamp":"T', k, '"}')
      else concat('{"a":', k, ',"timestamp":"T', k, '"}') end""").alias("payload"))
    return payload.wrap_payload(rows)


@query("archive_unpivot", "raw_log", sql="""
select insert_id, case when event_type = 'error' then 'updateTask' else 'updateDeliveryVehicle' end as api,
  '{"k":' || k || '}' as request, case when k % 2 = 0 then '{"name":"n' || k || '"}' end as response,
  cast(null as varchar) as error, 'T' || k as event_time from raw_log where event_type <> 'signup'""")
def _(spark, sf):
    rows = raw(spark, sf).select("insert_id", F.expr("""concat('{"serverTime":"T', k, '","', case event_type when 'error' then 'updateTask' when 'signup' then 'unknownCall'
      else 'updateDeliveryVehicle' end, '":{"request":{"k":', k, '}', case when k % 2 = 0 then concat(',"response":{"name":"n', k, '"}') else '' end, '}}')""").alias("row"))
    return files.archive_unpivot(rows)


@query("union_method_tables", "raw_log", sql="""
select case event_type when 'error' then 'updateVehicle' when 'purchase' then 'createTrip' else 'updateTrip' end as api, insert_id,
  case when event_type = 'error' then vehicle_id end as vehicle_id, case when event_type = 'purchase' then value end as value,
  case when event_type not in ('error', 'purchase') then props end as props from raw_log""")
def _(spark, sf):
    rows = raw(spark, sf)
    return files.union_method_tables({
        "updateVehicle": rows.filter("event_type = 'error'").select("insert_id", "vehicle_id"),
        "createTrip": rows.filter("event_type = 'purchase'").select("insert_id", "value"),
        "updateTrip": rows.filter("event_type not in ('error', 'purchase')").select("insert_id", "props"),
    })


@query("dynamic_column", "raw_log", sql="select insert_id, cast(json_extract_string(props, '$.k') as bigint) as k_value, cast(null as varchar) as missing from raw_log")
def _(spark, sf):
    rows = raw(spark, sf)
    return rows.select("insert_id", view.dynamic_column(F.col("props"), "k", "bigint").alias("k_value"), view.dynamic_column(F.col("props"), "no.such").alias("missing"))


@query("column_category", "raw_log", sql="""
select unnest(['ts', 'eta_seconds', 'trip_distance', 'value', 'event_type', 'update_time', 'formattedDate']) as column_name,
  unnest(['timestamp', 'duration', 'distance', null, null, 'timestamp', null]) as category where (select count(*) from raw_log) > 0""")
def _(spark, sf):
    table = raw(spark, sf).select(
        "ts", F.col("k").alias("eta_seconds"), F.col("value").cast("string").alias("trip_distance"), "value", "event_type",
        iso(F.col("event_ms")).alias("update_time"), iso(F.col("event_ms")).alias("formattedDate"), "event_id",
    )
    return view.column_category(table, ["event_id"])


@query("key_inventory", "raw_log", sql="""
select key, count(*) as rows, case when key = 'timestamp' then 0 else 1 end as rank from
  (select unnest(case when k % 2 = 0 then ['timestamp', 'a'] when k % 3 = 0 then ['timestamp', 'b'] else ['c'] end) as key from raw_log) group by 1""")
def _(spark, sf):
    rows = raw(spark, sf)
    body = F.expr("""case when k % 2 = 0 then '{"timestamp":1,"a":{"x":2}}' when k % 3 = 0 then '{"timestamp":1,"b":[]}' else '{"c":null}' end""")
    return merge.key_inventory(rows, body)


def store_rows(spark, sf):
    name = F.expr("concat('projects/p/logs/', case event_type when 'error' then 'get_trip' when 'purchase' then 'update_trip' when 'signup' then 'list_vehicles' else 'update_vehicle' end)")
    return raw(spark, sf).select(
        "insert_id", F.col("vehicle_id").cast("string").alias("vehicle_id"), F.concat(F.lit("trip"), F.col("k").cast("string")).alias("trip_id"),
        F.lit("api/Fleet").alias("resource_type"), name.alias("log_name"), F.timestamp_millis("event_ms").alias("timestamp"), "event_ms",
    )


@query("scan_log_store", "raw_log", sql="""
select insert_id, event_ms from raw_log where cast(vehicle_id as varchar) in ('1', '2', '3') and event_ms >= 1704931200000
  and event_type not in ('error', 'signup')""")
def _(spark, sf):
    return filters.store_scan(store_rows(spark, sf), "vehicle_id", ["1", "2", "3"], NOW, 20).select("insert_id", "event_ms")


@query("scan_modifying_calls", "fleet_log", sql="select event_id, api from fleet_log where event_ms between 100000 and 2000000 and api <> 'getVehicle'")
def _(spark, sf):
    return filters.modifying_calls(fleet(spark, sf), 100_000, 2_000_000).select("event_id", "api")


@query("entity_filter", "raw_log", sql="""
select insert_id from raw_log where event_ms between 1704067200000 and 1706000000000 and event_type <> 'signup'
  and (cast(vehicle_id as varchar) = '7' or regexp_matches('trip' || k, 'trip1|trip77'))""")
def _(spark, sf):
    out = filters.entity_filter(
        store_rows(spark, sf), "7", "trip1, trip77,", datetime(2024, 1, 1, tzinfo=timezone.utc), datetime.fromtimestamp(1_706_000_000, timezone.utc),
        {n: n for n in ("vehicle_id", "trip_id")},
    )
    return out.select("insert_id")


@query("open_interval", "raw_log", sql="select insert_id, event_ms from raw_log where event_ms > 1704500000000 and event_ms < 1705500000000")
def _(spark, sf):
    return filters.open_interval(raw(spark, sf), 1_704_500_000_000, 1_705_500_000_000).select("insert_id", "event_ms")


@query("limited_scan", "raw_log", sql="select insert_id, event_id from raw_log order by ts desc, event_id desc limit 1000")
def _(spark, sf):
    return filters.limited(raw(spark, sf), None, [F.desc("ts"), F.desc("event_id")]).select("insert_id", "event_id")


@query("solution_type", "raw_log", sql="""
select vehicle_id as dataset_id, case when bool_or(event_type = 'signup') then 'LMFS' else 'ODRD' end as solution_type from raw_log group by 1""")
def _(spark, sf):
    rows = raw(spark, sf).withColumnRenamed("vehicle_id", "dataset_id")
    return merge.solution_type(rows, F.when(F.col("event_type") == "signup", "logs/update_delivery_vehicle").otherwise("logs/update_vehicle"))


@query("retention", "raw_log", sql="""
with o as (select vehicle_id as dataset_id, min(event_ms) as m, max(event_ms) + 2000000000 as stored from raw_log group by 1),
e as (select dataset_id, greatest(m + 4752000000, 1709251200000 + 3600000, stored) as x from o)
select dataset_id, x as expires_ms, x - 1709251200000 as left_ms, x - 1709251200000 <= 864000000 as warn, x < 1709251200000 as expired from e""")
def _(spark, sf):
    rows = raw(spark, sf).withColumnRenamed("vehicle_id", "dataset_id")
    at = F.timestamp_millis("event_ms")
    out = datasets.retention(rows, at, datetime(2024, 3, 1, tzinfo=timezone.utc), F.timestamp_millis(F.col("event_ms") + 2_000_000_000))
    return out.select("dataset_id", F.unix_millis("expires").alias("expires_ms"), "left_ms", "warn", "expired")


@query("dataset_identity", "raw_log", sql="""
select event_type, cast(arg_min(case when k % 2 = 0 then vehicle_id end, event_id) filter (where k % 2 = 0) as varchar) as first_vehicle,
  epoch_ms(cast(min(case when k % 5 = 0 then make_timestamp((event_ms - 1000) * 1000) else make_timestamp(event_ms * 1000) end) as timestamp)) as oldest_ms,
  strftime(min(case when k % 5 = 0 then make_timestamp((event_ms - 1000) * 1000) else make_timestamp(event_ms * 1000) end), '%Y-%m-%d') as first_date
from raw_log group by 1""")
def _(spark, sf):
    rows = raw(spark, sf)
    vehicle = F.when(F.col("k") % 2 == 0, F.col("vehicle_id").cast("string"))
    times = [F.when(F.col("k") % 5 == 0, F.timestamp_millis(F.col("event_ms") - 1000)), F.timestamp_millis("event_ms")]
    out = merge.dataset_identity(rows, vehicle, ["event_id"], times, ("event_type",))
    return out.select("event_type", "first_vehicle", F.unix_millis("oldest").alias("oldest_ms"), "first_date")


@query("anonymise", "raw_log", sql="""
select insert_id, '{"name":"providers/sample-project-id/vehicles/sample-vehicle-id","task":"tid_' || k || '_' || event_id || 'sample-task","by":"user"}' as payload from raw_log""")
def _(spark, sf):
    rows = raw(spark, sf)
    body = F.expr("""concat('{"name":"providers/proj-77/vehicles/veh-', vehicle_id, '","task":"tid_', k, '_', event_id, '-secret-', event_type, '","by":"jane"}')""")
    return rows.select("insert_id", datasets.anonymise(body, "proj-77", F.concat(F.lit("veh-"), F.col("vehicle_id").cast("string")), "jane").alias("payload"))


@query("parse_time", "raw_log", sql="select insert_id, case when k % 10 = 0 then null when k % 3 = 2 then event_ms - 19800000 else event_ms end as ms from raw_log")
def _(spark, sf):
    naive = F.date_format(F.timestamp_millis("event_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    given = F.when(F.col("k") % 10 == 0, "not a time").when(F.col("k") % 3 == 0, F.concat(F.lit("  "), naive)).when(F.col("k") % 3 == 1, F.concat(naive, F.lit("Z "))).otherwise(F.concat(naive, F.lit("+05:30")))
    return raw(spark, sf).select("insert_id", F.unix_millis(text.parse_time(given)).alias("ms"))


@query("pad_time", "raw_log", sql="""
select insert_id, case k % 5 when 0 then '2024-01-01' when 1 then '2024-01-01T00:00:00' when 2 then '2024-01-01T05:00:00' when 3 then '2024-01-01T05:06:00' else '2024-01-01T05:06:07Z' end as padded from raw_log""")
def _(spark, sf):
    given = F.expr("case k % 5 when 0 then '2024-01-01' when 1 then '2024-01-01T' when 2 then '2024-01-01T05' when 3 then '2024-01-01T05:06:' else '2024-01-01T05:06:07Z' end")
    return raw(spark, sf).select("insert_id", text.pad_time(given).alias("padded"))


@query("fmt_time", "raw_log", sql="select insert_id, strftime(make_timestamp(event_ms * 1000), '%m-%d %H:%M:%S') as from_time, strftime(make_timestamp(event_ms * 1000), '%m-%d %H:%M:%S') as from_text from raw_log")
def _(spark, sf):
    return raw(spark, sf).select(
        "insert_id", text.day_time(F.timestamp_millis("event_ms")).alias("from_time"), text.day_time_of_text(iso(F.col("event_ms"))).alias("from_text")
    )


@query("fmt_duration", "raw_log", sql="""
with d as (select insert_id, event_id * 7919 % 90000000 as ms, (event_id * 31 % 3000) - 1500 as s from raw_log),
p as (select *, ms // 3600000 as h, ms % 3600000 // 60000 as m, ms % 60000 // 1000 as c from d)
select insert_id, concat(case when h > 0 then h || ' hours ' else '' end, case when m > 0 then m || ' minutes ' else '' end, case when c > 0 then c || ' seconds' else '' end) as long_text,
  concat(case when s < 0 then '-' else '' end, case when abs(s) < 60 then '' else (abs(s) // 60) || 'm ' end, (abs(s) % 60) || 's') as short_text,
  case when ms >= 86400000 then (ceil(ms / 86400000.0)::bigint) || ' days' when ms >= 3600000 then (ceil(ms / 3600000.0)::bigint) || case when ceil(ms / 3600000.0) > 1 then ' hours' else ' hour' end
    when ms >= 60000 then (ceil(ms / 60000.0)::bigint) || case when ceil(ms / 60000.0) > 1 then ' minutes' else ' minute' end
    else (ceil(ms / 1000.0)::bigint) || case when ceil(ms / 1000.0) <> 1 then ' seconds' else ' second' end end as left_text
from p""")
def _(spark, sf):
    rows = raw(spark, sf).select("insert_id", (F.col("event_id") * 7919 % 90_000_000).alias("ms"), (F.col("event_id") * 31 % 3000 - 1500).alias("s"))
    return rows.select(
        "insert_id", text.long_duration(F.col("ms")).alias("long_text"), text.short_duration(F.col("s")).alias("short_text"), text.time_left(F.col("ms")).alias("left_text")
    )


@query("fmt_distance", "raw_log", sql="""
with d as (select insert_id, (event_id % 4000) + 0.3 as m from raw_log)
select insert_id, case when m < 1000 then format('{:.0f} m', m) else format('{:.2f} km', m / 1000) end as metric,
  case when m * 3.28084 < 5280 then format('{:.0f} ft', m * 3.28084) else format('{:.2f} mi', m * 0.000621371) end as imperial from
  (select insert_id, m::double as m from d)""")
def _(spark, sf):
    m = F.col("event_id") % 4000 + F.lit(0.3)
    return raw(spark, sf).select("insert_id", text.distance_metric(m).alias("metric"), text.distance_imperial(m).alias("imperial"))
