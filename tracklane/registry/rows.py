"""Queries on the functions of single rows, and the composed ingest from JSON datasets to the typed log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklane.functions import geo
from tracklane.operators import filters, layers, route, tasks
from tracklane.registry.base import fleet, query, r3
from tracklane.registry.files import fresh
from tracklane.sources import build, files, merge
from tracklane.views import read_view


@query("line_middle", "task_log", sql="""
with p as (select task_id, planned_lat as a, planned_lng as o, outcome_lat as b, outcome_lng as q, stop_no from task_log),
h as (select *, cos(radians(b)) * cos(radians(q - o)) as bx, cos(radians(b)) * sin(radians(q - o)) as byy from p)
select task_id,
  round(case when stop_no % 2 = 0 then degrees(atan2(sin(radians(a)) + sin(radians(b)), sqrt(pow(cos(radians(a)) + bx, 2) + byy * byy))) else b end, 6) as lat,
  round(case when stop_no % 2 = 0 then o + degrees(atan2(byy, cos(radians(a)) + bx)) else q end, 6) as lng
from h""")
def _(spark, sf):
    """Middle of a line of two points, or the middle vertex of one of three."""
    point = lambda a, o: F.struct(F.col(a).alias("latitude"), F.col(o).alias("longitude"))
    ends = [point("planned_lat", "planned_lng"), point("outcome_lat", "outcome_lng")]
    line = F.when(F.col("stop_no") % 2 == 0, F.array(*ends)).otherwise(F.array(*ends, ends[0]))
    out = read_view(spark, sf, "task_log").select("task_id", geo.line_middle(line).alias("m"))
    return out.select("task_id", r3(F.col("m.latitude"), "lat", 6), r3(F.col("m.longitude"), "lng", 6))


@query("route_of_row", "fleet_log", sql="""
select event_id, case when api in ('createTrip', 'getTrip', 'updateTrip') and k % 2 = 0 then concat('answer-', cast(k as varchar)) else coalesce(route, 'carried') end as route
from fleet_log""")
def _(spark, sf):
    answer = F.when(F.col("k") % 2 == 0, F.concat(F.lit("answer-"), F.col("k").cast("string")))
    return fleet(spark, sf).select("event_id", route.route_of_row(F.col("api"), answer, F.col("route"), F.lit("carried")).alias("route"))


@query("valid_coordinates", "fleet_log", sql="""
select event_id from fleet_log where raw_lat is not null and raw_lng is not null and k % 5 <> 4""")
def _(spark, sf):
    text = F.when(F.col("k") % 5 == 4, F.lit("n/a")).otherwise(F.col("raw_lat").cast("string"))
    return fleet(spark, sf).filter(filters.has_position(text, F.col("raw_lng").cast("string"))).select("event_id")


@query("task_calls", "fleet_log", sql="""
select event_id, case when api = 'createTrip' then 'createTask' else 'updateTask' end as api from fleet_log
where api in ('createTrip', 'updateTrip') and k % 3 <> 0""")
def _(spark, sf):
    log = fleet(spark, sf).select(
        "event_id", F.replace(F.col("api"), F.lit("Trip"), F.lit("Task")).alias("api"), F.when(F.col("k") % 3 != 0, F.lit("{}")).alias("response")
    )
    return filters.task_rows(log).select("event_id", "api")


@query("task_names", "task_log", sql="""
select task_id, task_id as tail, case when stop_no % 2 = 0 then task_id end as id from task_log""")
def _(spark, sf):
    name = F.concat(F.lit("providers/p/"), F.when(F.col("stop_no") % 2 == 0, F.lit("tasks/")).otherwise(F.lit("trips/")), F.col("task_id"))
    return read_view(spark, sf, "task_log").select("task_id", tasks.name_tail(name).alias("tail"), tasks.task_id_of(name).alias("id"))


@query("method_tables", "fleet_log", sql="select api, event_id from fleet_log where api = 'createTrip'")
def _(spark, sf):
    """A table that a project never wrote is an empty one."""
    made = fleet(spark, sf).filter("api = 'createTrip'").select("event_id")
    return files.union_method_tables({"createTrip": made, "getTask": files.method_table(spark, "never_written_table", made.schema)})


def _wire(log):
    """Log rows in the cloud form, every third as a bare payload."""
    stamp = F.date_format(F.timestamp_millis("event_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    point = lambda a, o: F.struct(F.col(a).alias("latitude"), F.col(o).alias("longitude"))
    kind = F.concat(F.lit("type.example.com/x.v1."), F.initcap(F.substring("api", 1, 1)), F.expr("substring(api, 2)"), F.lit("Log"))
    request = F.struct(F.struct(F.struct(point("raw_lat", "raw_lng").alias("raw_location"), F.col("speed")).alias("last_location")).alias("vehicle"))
    response = F.struct(
        F.concat(F.lit("providers/p/vehicles/"), F.col("vehicle_id").cast("string")).alias("name"),
        F.struct(point("resp_lat", "resp_lng").alias("location"), F.struct(F.col("heading").alias("value")).alias("heading")).alias("last_location"),
    )
    call = [kind.alias("@type"), request.alias("request"), response.alias("response")]
    whole = F.to_json(F.struct(stamp.alias("timestamp"), F.struct(*call).alias("jsonPayload")))
    return F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(stamp.alias("timestamp"), *call))).otherwise(whole)


def _datasets(spark, sf):
    """Datasets of at most 500 rows, one per line, each in one of the three forms."""
    log = fleet(spark, sf)
    rows = log.select((F.col("event_id") / 500).cast("long").alias("part"), _wire(log).alias("row"))
    joined = F.concat_ws(",", F.collect_list("row"))
    text = F.when(F.col("part") % 3 == 0, F.concat(F.lit("["), joined, F.lit("]"))).when(F.col("part") % 3 == 1, joined).otherwise(
        F.concat(F.lit('{"vehicle":"v","rawLogs":['), joined, F.lit("]}"))
    )
    return rows.groupBy("part").agg(text.alias("value"))


@query("build_log", "fleet_log", sql="""
select 'ODRD' as solution_type, api, cast(vehicle_id as varchar) as vehicle_id, event_ms, raw_lat, resp_lat, cast(heading as double) as resp_heading, speed from fleet_log""")
def _(spark, sf):
    """From dataset texts to the typed log in one call."""
    path = fresh(spark, "wire")
    _datasets(spark, sf).select("value").write.text(path)
    log = build.ingest(spark, path, per_line=True)
    return log.select("solution_type", "api", "vehicle_id", "event_ms", "raw_lat", "resp_lat", "resp_heading", "speed")


@query("scan_errors", "fleet_log", sql="""
with p as (select cast(floor(event_id / 500) as bigint) as part from fleet_log)
select 'broken' as what, count(distinct part) as n from p where part % 2 = 0 union all select 'rows', count(*) from p where part % 2 = 1""")
def _(spark, sf):
    """Every other dataset text is cut short: it is an error, and the others lose nothing."""
    path = fresh(spark, "broken")
    texts = _datasets(spark, sf).select(F.when(F.col("part") % 2 == 0, F.expr("left(value, length(value) - 2)")).otherwise(F.col("value")).alias("value"))
    texts.write.text(path)
    errors, rows = files.scan_errors(spark, path, per_line=True), files.scan_dataset_json(spark, path, per_line=True, strict=False)
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return count(errors, "broken").unionByName(count(rows, "rows"))


@query("server_skew", "fleet_log", sql="""
select event_id, abs(client_ms - (event_ms + 5)) / 1000.0 as delta_seconds, client_ms > event_ms + 5 as client_ahead, case when value < 50 then 'negative' else 'positive' end as speed_sign
from fleet_log where resp_lat is not null and value is not null""")
def _(spark, sf):
    """Layers of a typed log whose request and response sides differ."""
    log = fleet(spark, sf).withColumns({"server_ms": F.col("event_ms") + 5, "resp_speed": F.col("value") - 50})
    rows = layers.layer(log, lambda r: layers.speed_points(layers.clock_skew(r)))
    return rows.select("event_id", "delta_seconds", "client_ahead", "speed_sign")


@query("key_inventory_nested", "fleet_log", sql="""
select * from (select 'timestamp' as key, count(*) as rows, 0 as rank from fleet_log union all select 'vehicle.id', count(*), 1 from fleet_log
  union all select 'vehicle.fix.lat', count(raw_lat), 1 from fleet_log union all select 'trips', count(*), 1 from fleet_log) where rows > 0""")
def _(spark, sf):
    fix = F.struct(F.col("raw_lat").alias("lat"))
    body = F.to_json(F.struct(F.col("event_ms").alias("timestamp"), F.struct(F.col("vehicle_id").alias("id"), fix.alias("fix")).alias("vehicle"), F.array(F.struct("k")).alias("trips")))
    return merge.key_inventory(fleet(spark, sf), body, nested=True)


@query("geo_bounds_paths", "fleet_log", sql="""
with p as (select vehicle_id, case when vehicle_id % 2 = 0 then resp_lat end as a, case when vehicle_id % 2 = 0 then resp_lng end as o, raw_lat, raw_lng from fleet_log)
select vehicle_id, coalesce(max(a), max(raw_lat)) as north, coalesce(min(a), min(raw_lat)) as south, coalesce(max(o), max(raw_lng)) as east, coalesce(min(o), min(raw_lng)) as west
from p group by 1""")
def _(spark, sf):
    """Vehicles without response points are bounded by the points of their paths."""
    log = fleet(spark, sf)
    known = log.withColumns({c: F.when(F.col("vehicle_id") % 2 == 0, F.col(c)) for c in ("resp_lat", "resp_lng")})
    paths = log.select("vehicle_id", F.col("raw_lat").alias("lat"), F.col("raw_lng").alias("lng"))
    return layers.geo_bounds(known, "resp_lat", "resp_lng", ("vehicle_id",), paths)


@query("restricted_merge_nested", "raw_log", sql="""
with r as (select parent_insert_id, event_id from raw_log where event_type = 'error')
select insert_id, 's' || r.event_id as segment, 'p' || r.event_id as pickup, case when k % 2 = 1 then 'w' || r.event_id end as waypoints, cast(null as varchar) as other
from raw_log p left join r on r.parent_insert_id = p.insert_id where event_type <> 'error'""")
def _(spark, sf):
    """Restricted rows of a JSON dataset laid over sections, vehicles and trips that both sides have."""
    body = F.expr("""case when event_type = 'error' then concat('{"insertId":"', insert_id, '","jsonPayload":{"@type":"UpdateVehicleRestrictedLog","parentInsertId":"', parent_insert_id,
      '","request":{"vehicle":{"waypoints":"w', event_id, '"}},"response":{"currentRouteSegment":"s', event_id, '","other":"x","waypoints":{},"trip":{"pickupPoint":"p', event_id, '"}}}}')
      else concat('{"insertId":"', insert_id, '","jsonPayload":{"@type":"UpdateVehicleLog",', case when k % 2 = 1 then '"request":{},' else '' end, '"response":{"name":"n"}}}') end""")
    rows = read_view(spark, sf, "raw_log").select(F.lit("d").alias("file"), F.col("event_id").alias("pos"), body.alias("row"))
    part = lambda path: F.get_json_object("row", f"$.jsonPayload.{path}")
    return merge.merge_restricted_rows(rows).select(
        F.get_json_object("row", "$.insertId").alias("insert_id"), part("response.currentRouteSegment").alias("segment"),
        part("response.trip.pickupPoint").alias("pickup"), part("request.vehicle.waypoints").alias("waypoints"), part("response.waypoints").alias("other"),
    )
