"""Queries over the fleet log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklane.functions import geo, text
from tracklane.operators import detect, dwell, filters, layers, segments, state, trips, view
from tracklane.registry.base import TRACK, fleet, fleet_trips, query, r3
from tracklane.session import settle
from tracklane.sinks import datasets

W = "(partition by vehicle_id order by event_ms, event_id)"
BEFORE = "(partition by vehicle_id order by event_ms, event_id rows between unbounded preceding and 1 preceding)"


@query("log_index", "fleet_log", sql=f"select event_id, vehicle_id, event_ms, row_number() over {W} - 1 as idx from fleet_log")
def _(spark, sf):
    return state.log_index(fleet(spark, sf), TRACK)


@query("location_fallback", "fleet_log", sql="""
select event_id, case when resp_lat is null then raw_lat else resp_lat end as lat,
       case when resp_lat is null then raw_lng else resp_lng end as lng from fleet_log""")
def _(spark, sf):
    lat, lng = state.location_fallback(*[F.col(c) for c in ("resp_lat", "resp_lng", "raw_lat", "raw_lng")])
    return fleet(spark, sf).select("event_id", lat.alias("lat"), lng.alias("lng"))


FILL_SQL = """
select event_id, vehicle_id, coalesce({p}_lat, last_value({p}_lat ignore nulls) over w) as filled_lat,
  coalesce({p}_lng, last_value({p}_lng ignore nulls) over w) as filled_lng,
  cast(case when {p}_lat is null and last_value({p}_lat ignore nulls) over w is not null
    then coalesce(last_value(case when {p}_lat is not null then heading end ignore nulls) over w, 0) else heading end as double) as filled_heading
from fleet_log window w as (partition by vehicle_id order by event_ms, event_id rows between unbounded preceding and 1 preceding)"""


@query("ffill_location", "fleet_log", sql=FILL_SQL.format(p="raw"))
def _(spark, sf):
    out = state.fill_position(fleet(spark, sf), "raw_lat", "raw_lng", "heading", track=TRACK)
    return out.select("event_id", "vehicle_id", "filled_lat", "filled_lng", "filled_heading")


@query("ffill_response", "fleet_log", sql=FILL_SQL.format(p="resp"))
def _(spark, sf):
    out = state.fill_position(fleet(spark, sf), "resp_lat", "resp_lng", "heading", track=TRACK)
    return out.select("event_id", "vehicle_id", "filled_lat", "filled_lng", "filled_heading")


@query("ffill_route", "fleet_log", sql="""
with r as (select *, case when k % 6 = 0 then concat('traffic-', cast(k as varchar)) end as traffic,
  coalesce(nav_status like '%NO_GUIDANCE', false) as cleared from fleet_log),
s as (select *, not cleared and route is not null as brings from r),
t as (select *, last_value(case when cleared then {'r': null::varchar, 't': null::varchar}
    when brings then {'r': route, 't': traffic} end ignore nulls) over (partition by vehicle_id order by event_ms, event_id
    rows between unbounded preceding and 1 preceding) as u from s)
select event_id, vehicle_id, case when cleared then null when brings then route else u.r end as filled_route,
  case when cleared then null when brings then traffic else u.t end as filled_traffic from t""")
def _(spark, sf):
    log = fleet(spark, sf).withColumn("traffic", F.when(F.col("k") % 6 == 0, F.concat(F.lit("traffic-"), F.col("k").cast("string"))))
    out = state.fill_route(log, "route", "traffic", "nav_status", TRACK)
    return out.select("event_id", "vehicle_id", "filled_route", "filled_traffic")


@query("sensor_origin", "fleet_log", sql="""
select event_id, case when resp_lat is not null and sensor is null and k % 2 = 1 and k % 3 <> 0 then 'API' else sensor end as sensor
from fleet_log""")
def _(spark, sf):
    log = fleet(spark, sf)
    mask = F.when(F.col("k") % 3 != 0, "last_location,navigation_status").otherwise("navigation_status")
    origin = state.sensor_origin(F.col("sensor"), F.col("resp_lat").isNotNull(), F.col("k") % 2 == 0, mask)
    return log.select("event_id", origin.alias("sensor"))


@query("time_range", "fleet_log", sql="select event_id, event_ms from fleet_log where event_ms between 600000 and 1800000")
def _(spark, sf):
    return filters.time_range(fleet(spark, sf), 600_000, 1_800_000).select("event_id", "event_ms")


@query("type_filter", "fleet_log", sql="select event_id, api from fleet_log where api in ('updateVehicle', 'updateTrip')")
def _(spark, sf):
    return filters.type_filter(fleet(spark, sf), ["updateVehicle", "updateTrip"]).select("event_id", "api")


BACKFILL = """
b as (select vehicle_id, trip_id, min(event_ms) as s, max(event_ms) as e, min(row(event_ms, event_id)) as o
  from fleet_log where trip_id is not null group by 1, 2),
f as (select l.event_id, arg_min(b.trip_id, b.o) as filled_trip from fleet_log l join b
  on b.vehicle_id = l.vehicle_id and l.event_ms between b.s and b.e where l.trip_id is null group by 1)"""


@query("trip_filter", "fleet_log", sql=f"""
with {BACKFILL} select l.event_id from fleet_log l left join f using (event_id)
where (l.api in ('createTrip', 'updateTrip') and l.trip_id like '%p-7%') or coalesce(l.trip_id, f.filled_trip) like '%p-7%'""")
def _(spark, sf):
    log = state.trip_backfill(fleet_trips(spark, sf), track=TRACK)
    log = log.withColumn("request_trip", F.when(F.col("api").isin("createTrip", "updateTrip"), F.col("trip_id")))
    return filters.trip_filter(log, " p-7 ", "request_trip", "current_trips", "current_trips_filled").select("event_id")


@query("error_rows", "fleet_log", sql="select event_id, error from fleet_log where error is not null")
def _(spark, sf):
    return filters.error_rows(fleet(spark, sf)).select("event_id", "error")


@query("trip_bounds", "fleet_log", sql="""
select vehicle_id, trip_id, min(event_ms) as start_ms, max(event_ms) as end_ms from fleet_log where trip_id is not null group by 1, 2""")
def _(spark, sf):
    return state.trip_bounds(fleet_trips(spark, sf)).select("vehicle_id", "trip_id", "start_ms", "end_ms")


@query("trip_backfill", "fleet_log", sql=f"""
with {BACKFILL} select l.event_id, l.vehicle_id, l.trip_id, f.filled_trip from fleet_log l left join f using (event_id)""")
def _(spark, sf):
    out = state.trip_backfill(fleet_trips(spark, sf), track=TRACK)
    return out.select("event_id", "vehicle_id", "trip_id", F.col("current_trips_filled")[0].alias("filled_trip"))


SEGMENTS = f"""
filled as (select *, coalesce(raw_lat, last_value(raw_lat ignore nulls) over {BEFORE}) as lat,
  coalesce(raw_lng, last_value(raw_lng ignore nulls) over {BEFORE}) as lng from src),
u as (select * from filled where api in ('updateVehicle', 'updateDeliveryVehicle')),
m as (select *, case when row_number() over {W} = 1 or ident is distinct from lag(ident) over {W} then 1 else 0 end as brk from u),
n as (select *, sum(brk) over {W} - 1 as segment_idx, sum(case when brk = 1 and ident is null then 1 else 0 end) over {W} - 1 as nk from m),
seg as (select *, coalesce(ident, concat('non-trip-segment-', cast(nk as varchar))) as segment_name,
  lag(lat) over (partition by vehicle_id, segment_idx order by event_ms, event_id) as plat,
  lag(lng) over (partition by vehicle_id, segment_idx order by event_ms, event_id) as plng from n)"""
SEGMENT_SUMMARY = f"""
select vehicle_id, segment_idx, segment_name, count(*) as update_requests, min(event_ms) as first_ms,
  case when count(*) > 1 then max(event_ms) end as last_ms, max(event_ms) - min(event_ms) as duration_ms,
  round(coalesce(sum({geo.sql_distance('plat', 'plng', 'lat', 'lng')}), 0), 3) as distance_m,
  round(coalesce(sum({geo.sql_distance('plat', 'plng', 'lat', 'lng')}), 0) / 1000, 3) as distance_km,
  round(coalesce(sum({geo.sql_distance('plat', 'plng', 'lat', 'lng')}), 0) / 1609, 3) as distance_mi
from seg group by 1, 2, 3"""


def located_log(spark, sf, lat="raw_lat", lng="raw_lng"):
    return state.fill_position(fleet(spark, sf), lat, lng, "heading", track=TRACK)


def rounded_segments(df):
    return df.select(
        "vehicle_id", "segment_idx", "segment_name", "update_requests", "first_ms", "last_ms", "duration_ms",
        r3("distance_m"), r3("distance_km"), r3("distance_mi"),
    )


@query("trip_segments", "fleet_log", sql=f"with src as (select *, trip_id as ident from fleet_log), {SEGMENTS} {SEGMENT_SUMMARY}")
def _(spark, sf):
    return rounded_segments(segments.trip_segments(located_log(spark, sf), "trip_id", "filled_lat", "filled_lng", TRACK))


@query("trip_segments_backfilled", "fleet_log", sql=f"""
with {BACKFILL}, src as (select l.*, coalesce(l.trip_id, f.filled_trip) as ident from fleet_log l left join f using (event_id)),
{SEGMENTS} {SEGMENT_SUMMARY}""")
def _(spark, sf):
    log = state.trip_backfill(fleet_trips(spark, sf), track=TRACK)
    ident = segments.segment_ident(F.lit("ODRD"), F.col("current_trips"), F.col("current_trips_filled"))
    # two more ordered passes follow, so the back-filled log is written once, with the columns they need
    log = settle(log.select("vehicle_id", "event_ms", "event_id", "api", "raw_lat", "raw_lng", "heading", ident.alias("ident")))
    log = state.fill_position(log, "raw_lat", "raw_lng", "heading", track=TRACK)
    return rounded_segments(segments.trip_segments(log, "ident", "filled_lat", "filled_lng", TRACK))


POINTS_SQL = """select vehicle_id, segment_idx, segment_name, event_ms, event_id, lat, lng from seg where lat is not null"""


@query("segment_points", "fleet_log", sql=f"with src as (select *, trip_id as ident from fleet_log), {SEGMENTS} {POINTS_SQL} and event_ms between 300000 and 2000000")
def _(spark, sf):
    log = located_log(spark, sf)
    return segments.segment_points(log, "trip_id", "filled_lat", "filled_lng", TRACK, 300_000, 2_000_000)


@query("segment_points_response", "fleet_log", sql=f"""
with src as (select * exclude (raw_lat, raw_lng), resp_lat as raw_lat, resp_lng as raw_lng, trip_id as ident from fleet_log), {SEGMENTS} {POINTS_SQL}""")
def _(spark, sf):
    log = located_log(spark, sf, "resp_lat", "resp_lng")
    return segments.segment_points(log, "trip_id", "filled_lat", "filled_lng", TRACK)


@query("segment_trip_logs", "fleet_log", sql=f"""
with src as (select *, trip_id as ident from fleet_log), {SEGMENTS},
s as (select distinct vehicle_id, segment_idx, segment_name from seg)
select s.vehicle_id, s.segment_idx, s.segment_name, l.event_id, l.api from s left join fleet_log l
on l.vehicle_id = s.vehicle_id and l.trip_id = s.segment_name and l.api in ('createTrip', 'updateTrip')""")
def _(spark, sf):
    log = fleet(spark, sf)
    found = segments.trip_segments(log, "trip_id", "raw_lat", "raw_lng", TRACK)
    return segments.segment_trip_logs(found, log).select("vehicle_id", "segment_idx", "segment_name", "event_id", "api")


@query("last_trip", "fleet_log", sql=f"""
with src as (select *, trip_id as ident from fleet_log), {SEGMENTS}
select vehicle_id, arg_max(segment_name, segment_idx) as last_trip from seg group by 1""")
def _(spark, sf):
    return segments.last_trip(segments.trip_segments(fleet(spark, sf), "trip_id", "raw_lat", "raw_lng", TRACK))


@query("planned_paths", "fleet_log", sql=f"""
with src as (select *, trip_id as ident from fleet_log), {SEGMENTS},
p as (select vehicle_id, segment_idx, unnest([0, 1]) as seq, k from seg where brk = 1 and k % 3 = 0)
select vehicle_id, segment_idx, seq, cast(37.70 + ((k + seq) % 5) * 0.01 as double) as lat,
  cast(-122.40 - ((k + seq) % 5) * 0.01 as double) as lng from p""")
def _(spark, sf):
    point = lambda i: f"named_struct('latitude', cast(37.70 + ((k + {i}) % 5) * 0.01 as double), 'longitude', cast(-122.40 - ((k + {i}) % 5) * 0.01 as double))"
    log = fleet(spark, sf).withColumn("path", F.expr(f"case when k % 3 = 0 then array({point(0)}, {point(1)}) end"))
    return segments.planned_paths(log, "trip_id", "path", TRACK)


PAIRS = f"""
fix as (select * from fleet_log where raw_lat is not null),
pr as (select vehicle_id, event_id, lag(event_ms) over {W} as start_ms, event_ms as end_ms, event_ms - lag(event_ms) over {W} as interval_ms,
  lag(raw_lat) over {W} as start_lat, lag(raw_lng) over {W} as start_lng, raw_lat as end_lat, raw_lng as end_lng from fix),
pairs as (select * from pr where start_ms is not null)"""
PAIR_COLS = "vehicle_id, event_id, start_ms, end_ms, interval_ms, start_lat, start_lng, end_lat, end_lng"


@query("path_length", "fleet_log", sql=f"""
with {PAIRS} select f.vehicle_id, count(*) as points, round(coalesce(sum({geo.sql_distance('p.start_lat', 'p.start_lng', 'p.end_lat', 'p.end_lng')}), 0), 3) as distance_m
from fix f left join pairs p using (event_id) group by 1""")
def _(spark, sf):
    return segments.path_length(fleet(spark, sf), "raw_lat", "raw_lng", TRACK).select("vehicle_id", "points", r3("distance_m"))


@query("consecutive_pairs", "fleet_log", sql=f"with {PAIRS} select {PAIR_COLS} from pairs")
def _(spark, sf):
    return detect.consecutive_pairs(fleet(spark, sf), TRACK).select(*PAIR_COLS.split(", "))


@query("interval_stats", "fleet_log", sql=f"""
with {PAIRS} select vehicle_id, count(*) as pairs, round(avg(interval_ms), 3) as mean, round(median(interval_ms), 3) as median,
  cast(min(interval_ms) as double) as lowest, cast(max(interval_ms) as double) as highest, round(stddev_pop(interval_ms), 3) as spread
from pairs group by 1""")
def _(spark, sf):
    out = detect.interval_stats(fleet(spark, sf), TRACK)
    return out.select("vehicle_id", "pairs", r3("mean"), r3("median"), "lowest", "highest", r3("spread"))


GAPS = f"""{PAIRS},
gl as (select vehicle_id, least(10 * median(interval_ms), 60000.0) as threshold_ms from pairs group by 1),
gaps as (select p.*, threshold_ms from pairs p join gl using (vehicle_id) where interval_ms >= threshold_ms)"""


@query("missing_updates", "fleet_log", sql=f"""
with {GAPS} select vehicle_id, start_ms, end_ms, interval_ms, start_lat, start_lng, end_lat, end_lng, '' as state_transition,
  case when interval_ms <= 60000 then 2 when interval_ms < 600000 then 6 when interval_ms < 36000000 then 10 else 14 end as severity,
  round(threshold_ms, 3) as threshold_ms from gaps""")
def _(spark, sf):
    out = detect.missing_updates(fleet(spark, sf), TRACK)
    return out.withColumn("threshold_ms", F.round("threshold_ms", 3)).orderBy("interval_ms", "vehicle_id", "start_ms")


JUMPS = f"""{PAIRS},
v as (select *, {geo.sql_distance('start_lat', 'start_lng', 'end_lat', 'end_lng')} as distance_m,
  {geo.sql_distance('start_lat', 'start_lng', 'end_lat', 'end_lng')} / (interval_ms / 1000.0) as velocity_mps from pairs where interval_ms > 0),
jl as (select vehicle_id, least(median(velocity_mps) + 2 * stddev_pop(velocity_mps), 68.0) as threshold_mps from v group by 1),
jumps as (select v.*, threshold_mps from v join jl using (vehicle_id) where velocity_mps > threshold_mps and distance_m > 1)"""


@query("velocity_jumps", "fleet_log", sql=f"""
with {JUMPS} select vehicle_id, event_id, start_ms, end_ms, interval_ms, start_lat, start_lng, end_lat, end_lng,
  round(distance_m, 3) as distance_m, round(velocity_mps, 3) as velocity_mps, round(velocity_mps * 2.237, 3) as velocity_mph,
  case when velocity_mps <= 100 then 2 when velocity_mps < 1000 then 6 when velocity_mps < 2000 then 10 else 14 end as severity,
  round(threshold_mps, 3) as threshold_mps from jumps""")
def velocity_jumps(spark, sf):
    out = detect.velocity_jumps(fleet(spark, sf), TRACK)
    return out.select(
        "vehicle_id", "event_id", "start_ms", "end_ms", "interval_ms", "start_lat", "start_lng", "end_lat", "end_lng",
        r3("distance_m"), r3("velocity_mps"), r3("velocity_mph"), "severity", r3("threshold_mps"),
    )


def sql_heading(a, b, c, d):
    return (f"degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))))")


def sql_to_lat(lat, dist, head):
    return f"degrees(asin(sin(radians({lat})) * cos({dist} / 6378137.0) + cos(radians({lat})) * sin({dist} / 6378137.0) * cos(radians({head}))))"


@query("pair_heading", "fleet_log", sql=f"""
with {PAIRS}, h as (select *, {sql_heading('start_lat', 'start_lng', 'end_lat', 'end_lng')} as hd from pairs),
g as (select *, (hd + 450.0) - 360.0 * floor((hd + 450.0) / 360.0) - 180.0 as sh from h)
select vehicle_id, event_id, round(hd, 3) as heading_deg, round(sh, 3) as side_heading_deg,
  round({sql_to_lat('start_lat', 1000.0, 'sh')}, 6) as start_far_lat, round({sql_to_lat('end_lat', 900.0, 'sh')}, 6) as end_near_lat from g""")
def _(spark, sf):
    out = detect.heading_of_pairs(detect.consecutive_pairs(fleet(spark, sf), TRACK))
    return out.select("vehicle_id", "event_id", r3("heading_deg"), r3("side_heading_deg"), r3("start_far_lat", digits=6), r3("end_near_lat", digits=6))


@query("eta_deltas", "fleet_log", sql=f"""
with e as (select * from fleet_log where eta_ms is not null and raw_lat is not null),
d as (select *, (event_ms - lag(event_ms) over {W}) / 1000.0 as dt, (eta_ms - lag(eta_ms) over {W}) / 1000.0 as de from e)
select vehicle_id, event_id, event_ms, dt as delta_seconds, de as eta_change_seconds, least(dt, 300.0) as weight, raw_lat, raw_lng
from d where dt is not null""")
def _(spark, sf):
    return detect.eta_deltas(fleet(spark, sf), TRACK)


@query("dwell_locations", "fleet_log", sql="""
select vehicle_id, raw_lat as lat, raw_lng as lng, min(event_ms) as start_ms, max(event_ms) as end_ms,
  max(event_ms) - min(event_ms) as duration_ms, count(*) as updates, count(*) * 3 as weight
from fleet_log where raw_lat is not null group by 1, 2, 3 having count(*) >= 12""")
def _(spark, sf):
    return dwell.dwell_locations(fleet(spark, sf))


def jittered(spark, sf):
    """Fixes 5 to 30 m apart, so that places overlap and who leads hangs on the order."""
    return fleet(spark, sf).withColumns({
        "raw_lat": F.when(F.col("raw_lat").isNotNull(), F.expr("cast(37.7 as double) + ((k * 7 + event_id) % 11) * cast(0.00005 as double)")),
        "raw_lng": F.when(F.col("raw_lat").isNotNull(), F.expr("cast(-122.4 as double) - ((k * 5 + event_id * 3) % 13) * cast(0.00006 as double)")),
    })


@query("dwell_locations_jittered", "fleet_log", sql=f"""
with recursive fix as (
  select vehicle_id, event_ms, event_id, cast(37.7 as double) + ((k * 7 + event_id) % 11) * cast(0.00005 as double) as lat,
    cast(-122.4 as double) - ((k * 5 + event_id * 3) % 13) * cast(0.00006 as double) as lng from fleet_log where raw_lat is not null
), numbered as (select *, row_number() over (partition by vehicle_id order by event_ms, event_id) as n from fix),
led as (
  select vehicle_id, 1::bigint as n, [struct_pack(lat := lat, lng := lng, at := event_ms)] as leaders, 1 as cluster from numbered where n = 1
  union all
  select vehicle_id, n, case when hit = 0 then list_append(leaders, struct_pack(lat := lat, lng := lng, at := event_ms)) else leaders end,
    case when hit = 0 then len(leaders) + 1 else hit end
  from (
    select f.*, l.leaders, coalesce(list_position(list_transform(l.leaders, lambda x: {geo.sql_distance('x.lat', 'x.lng', 'f.lat', 'f.lng')} <= 20), true), 0) as hit
    from led l join numbered f on f.vehicle_id = l.vehicle_id and f.n = l.n + 1
  )
), sums as (
  select l.vehicle_id, l.cluster, count(*) as updates, max(f.event_ms) as end_ms, max(len(l.leaders)) as many from led l join numbered f using (vehicle_id, n) group by 1, 2
), leaders as (select vehicle_id, arg_max(leaders, n) as leaders from led group by 1)
select s.vehicle_id, round(leaders[cluster].lat, 6) as lat, round(leaders[cluster].lng, 6) as lng, leaders[cluster].at as start_ms, end_ms,
  end_ms - leaders[cluster].at as duration_ms, updates, updates * 3 as weight
from sums s join leaders using (vehicle_id) where updates >= 2""")
def _(spark, sf):
    found = dwell.dwell_locations(jittered(spark, sf), min_updates=2)
    return found.withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


@query("anomaly_context", "fleet_log", sql=f"""
with {GAPS} select l.vehicle_id, l.event_ms, l.event_id, count(*) as windows from fleet_log l join gaps g on g.vehicle_id = l.vehicle_id
and l.event_ms between g.start_ms - 60000 and g.end_ms + 60000 group by 1, 2, 3""")
def _(spark, sf):
    log = fleet(spark, sf)
    return detect.anomaly_context(log, detect.missing_updates(log, TRACK), TRACK)


@query("status_changes", "fleet_log", sql=f"""
with s as (select *, lag(trip_status) over {W} as was from fleet_log where trip_status is not null)
select vehicle_id, event_ms, event_id, trip_status as new_status from s where was is distinct from trip_status""")
def _(spark, sf):
    return segments.status_changes(fleet(spark, sf), TRACK)


@query("status_asof", "fleet_log", sql="""
with s as (select vehicle_id, event_ms, arg_max(trip_status, event_id) as status from fleet_log where trip_status is not null group by 1, 2),
p as (select event_id, vehicle_id, event_ms from fleet_log where resp_lat is not null)
select p.event_id, p.vehicle_id, p.event_ms, s.status, case s.status when 'NEW' then 30 when 'ARRIVED_AT_PICKUP' then 10
  when 'COMPLETE' then 30 when 'CANCELED' then 30 else 5 end as weight
from p asof left join s on p.vehicle_id = s.vehicle_id and p.event_ms > s.event_ms""")
def _(spark, sf):
    log = fleet(spark, sf)
    probes = layers.located(log).select("event_id", "vehicle_id", "event_ms")
    out = segments.status_asof(probes, log, TRACK)
    return out.select("event_id", "vehicle_id", "event_ms", "status", segments.status_weight(F.col("status")).alias("weight"))


@query("log_neighbours", "fleet_log", sql=f"""
select vehicle_id, event_id, lag(event_id) over {W} as prev_id, lead(event_id) over {W} as next_id,
  first_value(event_id) over {W} as first_id,
  last_value(event_id) over (partition by vehicle_id order by event_ms, event_id rows between unbounded preceding and unbounded following) as last_id
from fleet_log""")
def _(spark, sf):
    return segments.log_neighbours(fleet(spark, sf), TRACK)


@query("log_view", "fleet_log", sql="""
select event_id, vehicle_id, strftime(make_timestamp(event_ms * 1000), '%m-%d %H:%M:%S') as day_time, api as method,
  case when speed <> 0 then cast(floor(speed * 3.6 + 0.5) as bigint) end as kmph, cast(null as varchar) as sensor,
  replace(sensor, '_LOCATION_PROVIDER', '') as location, right(trip_id, 12) as current_trip12, cast(null as varchar) as vehicle_state,
  trip_status, nav_status from fleet_log order by event_ms, event_id""")
def _(spark, sf):
    return view.log_view(view.chronological(fleet(spark, sf)))


@query("log_with_anomalies", "fleet_log", sql=f"""
with {GAPS.replace('gl as', 'gl as')}, {JUMPS[len(PAIRS) + 1:]}
select vehicle_id, event_ms, api, cast(null as double) as speed, cast(null as bigint) as gap_ms from fleet_log where event_ms between 300000 and 2000000
union all select vehicle_id, start_ms, 'Jump', round(velocity_mps, 3), null from jumps where end_ms between 300000 and 2000000
union all select vehicle_id, start_ms, 'Missing Updates', null, interval_ms from gaps where start_ms between 300000 and 2000000""")
def _(spark, sf):
    log = fleet(spark, sf)
    pairs = detect.pairs_table(log, TRACK)
    jumps, gaps = detect.velocity_jumps(log, TRACK, pairs=pairs), detect.missing_updates(log, TRACK, pairs=pairs)
    out = detect.log_with_anomalies(log, jumps, gaps, 300_000, 2_000_000)
    return out.select("vehicle_id", "event_ms", "api", r3("jump_speed", "speed"), "gap_ms").orderBy("event_ms", "vehicle_id", "api")


@query("nearest_time", "fleet_log", sql="""
with p as (select vehicle_id, event_id as probe_id, event_ms as probe_ms from fleet_log where api = 'getVehicle'),
c as (select p.*, l.event_id as nearest_id, abs(l.event_ms - p.probe_ms) as gap_ms,
  row_number() over (partition by p.probe_id order by abs(l.event_ms - p.probe_ms), l.event_ms, l.event_id) as rn
  from p join fleet_log l on l.vehicle_id = p.vehicle_id and l.api <> 'getVehicle')
select vehicle_id, probe_id, probe_ms, nearest_id, gap_ms from c where rn = 1""")
def _(spark, sf):
    log = fleet(spark, sf)
    out = segments.nearest_time(log.filter("api = 'getVehicle'"), log.filter("api <> 'getVehicle'"), TRACK)
    return out.filter("nearest_id is not null")


@query("nearest_place", "fleet_log", sql=f"""
with p as (select event_id as probe_id, vehicle_id, resp_lat + 0.0005 as probe_lat, resp_lng + 0.0003 as probe_lng from fleet_log where resp_lat is not null and api = 'getVehicle'),
d as (select p.*, l.event_id as nearest_event_id, {geo.sql_distance('p.probe_lat', 'p.probe_lng', 'l.raw_lat', 'l.raw_lng')} as dm, l.event_ms
  from p join fleet_log l on l.vehicle_id = p.vehicle_id and l.raw_lat is not null),
c as (select *, row_number() over (partition by probe_id order by dm, event_ms, nearest_event_id) as rn from d where dm < 250)
select probe_id, vehicle_id, round(probe_lat, 6) as probe_lat, round(probe_lng, 6) as probe_lng, round(dm, 3) as distance_m, nearest_event_id from c where rn = 1""")
def _(spark, sf):
    log = fleet(spark, sf)
    probes = log.filter("resp_lat is not null and api = 'getVehicle'").select(
        F.col("event_id").alias("probe_id"), "vehicle_id", (F.col("resp_lat") + 0.0005).alias("probe_lat"), (F.col("resp_lng") + 0.0003).alias("probe_lng")
    )
    out = trips.nearest_place(probes, log, "raw_lat", "raw_lng", TRACK)
    return out.select("probe_id", "vehicle_id", r3("probe_lat", digits=6), r3("probe_lng", digits=6), r3("distance_m"), "nearest_event_id")


@query("gps_accuracy", "fleet_log", sql="""
select event_id, resp_lat as lat, resp_lng as lng, accuracy, coalesce(sensor, 'OTHER') as sensor_class from fleet_log
where resp_lat is not null and accuracy is not null and accuracy <> 0""")
def _(spark, sf):
    return layers.layer(fleet(spark, sf), layers.gps_accuracy).select("event_id", "lat", "lng", "accuracy", "sensor_class")


@query("clock_skew", "fleet_log", sql="""
select event_id, abs(client_ms - event_ms) / 1000.0 as delta_seconds, client_ms > event_ms as client_ahead from fleet_log where resp_lat is not null""")
def _(spark, sf):
    return layers.layer(fleet(spark, sf), lambda rows: layers.clock_skew(rows, server="event_ms")).select("event_id", "delta_seconds", "client_ahead")


@query("heading_vectors", "fleet_log", sql=f"""
select event_id, resp_lat as lat, resp_lng as lng, heading, round({sql_to_lat('resp_lat', 20.0, 'heading')}, 7) as to_lat,
  round(resp_lng + degrees(atan2(sin(radians(heading)) * sin(20.0 / 6378137.0) * cos(radians(resp_lat)),
    cos(20.0 / 6378137.0) - sin(radians(resp_lat)) * sin(radians({sql_to_lat('resp_lat', 20.0, 'heading')})))), 7) as to_lng
from fleet_log where resp_lat is not null and heading is not null and heading_accuracy is not null""")
def _(spark, sf):
    out = layers.layer(fleet(spark, sf), layers.heading_vectors)
    return out.select("event_id", "lat", "lng", "heading", r3("to_lat", digits=7), r3("to_lng", digits=7))


@query("speed_points", "fleet_log", sql="""
select event_id, resp_lat as lat, resp_lng as lng, case when speed < 0 then 'negative' else 'positive' end as speed_sign, abs(speed) as magnitude
from fleet_log where resp_lat is not null and speed is not null""")
def _(spark, sf):
    return layers.layer(fleet(spark, sf), lambda rows: layers.speed_points(rows, "speed")).select("event_id", "lat", "lng", "speed_sign", "magnitude")


@query("nav_status_points", "fleet_log", sql="""
select event_id, nav_status as nav_class, case nav_status when 'OFF_ROUTE' then 30 when 'ARRIVED_AT_DESTINATION' then 10 else 5 end as weight
from fleet_log where resp_lat is not null and nav_status is not null""")
def _(spark, sf):
    return layers.layer(fleet(spark, sf), layers.nav_status_points).select("event_id", "nav_class", "weight")


@query("raw_vs_fused", "fleet_log", sql="""
select event_id, coalesce(abs(raw_lat - resp_lat) < 0.00001 and abs(raw_lng - resp_lng) < 0.00001, false) as same_place from fleet_log""")
def _(spark, sf):
    same = layers.same_place(*[F.col(c) for c in ("raw_lat", "raw_lng", "resp_lat", "resp_lng")])
    return fleet(spark, sf).select("event_id", same.alias("same_place"))


@query("located_rows", "fleet_log", sql="""
select event_id, coalesce(resp_lat, raw_lat) as lat, coalesce(resp_lng, raw_lng) as lng from fleet_log where coalesce(resp_lat, raw_lat) is not null""")
def _(spark, sf):
    return layers.located(fleet(spark, sf), raw_lat="raw_lat", raw_lng="raw_lng").select("event_id", "lat", "lng")


@query("geo_bounds", "fleet_log", sql="""
select vehicle_id, max(resp_lat) as north, min(resp_lat) as south, max(resp_lng) as east, min(resp_lng) as west from fleet_log group by 1""")
def _(spark, sf):
    return layers.geo_bounds(fleet(spark, sf), "resp_lat", "resp_lng", ("vehicle_id",))


@query("dataset_span", "fleet_log", sql="select vehicle_id, min(event_ms) as min_ms, max(event_ms) as max_ms from fleet_log group by 1")
def _(spark, sf):
    return view.dataset_span(fleet(spark, sf), ("vehicle_id",))


@query("api_counts", "fleet_log", sql="select api, count(*) as rows from fleet_log group by 1")
def _(spark, sf):
    return view.api_counts(fleet(spark, sf))


@query("prune_time", "fleet_log", sql="""
select event_id, vehicle_id, event_ms from fleet_log where coalesce(case when k % 9 <> 0 then event_ms end, client_ms) between 500000 and 1500000""")
def _(spark, sf):
    log = fleet(spark, sf).withColumn("stamp", F.when(F.col("k") % 9 != 0, F.col("event_ms")))
    return datasets.prune_time(log, 500_000, 1_500_000, "stamp", "client_ms").select("event_id", "vehicle_id", "event_ms")


@query("copy_filtered", "fleet_log", sql="select event_id, api, 'clipboard' as dataset_id from fleet_log where api in ('updateVehicle', 'createTrip')")
def _(spark, sf):
    return datasets.copy_filtered(fleet(spark, sf), "clipboard", ["updateVehicle", "createTrip"]).select("event_id", "api", "dataset_id")


@query("eta_clock", "fleet_log", sql="""
select event_id, strftime(make_timestamp((case when k % 3 = 0 then client_ms when k % 3 = 1 then client_ms - 5000 else event_ms end + 1704067200000 + k * 1000) * 1000), '%m-%d %H:%M:%S') as eta_clock
from fleet_log where eta_ms is not null""")
def _(spark, sf):
    log = fleet(spark, sf).filter("eta_ms is not null")
    iso = lambda c: F.date_format(F.timestamp_millis(c + 1704067200000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    base = text.duration_base(
        F.when(F.col("k") % 3 == 0, iso(F.col("client_ms"))), F.when(F.col("k") % 3 == 1, iso(F.col("client_ms") - 5000)),
        F.timestamp_millis(F.col("event_ms") + 1704067200000),
    )
    return log.select("event_id", text.clock_after(base, F.col("k")).alias("eta_clock"))


# --- the same answers with every history of more than a few rows cut into chunks -------------------

SPLIT = TRACK.by(max_rows=20)


@query("velocity_jumps_split", "fleet_log", sql=f"""
with {JUMPS} select vehicle_id, event_id, start_ms, round(velocity_mps, 3) as velocity_mps, round(threshold_mps, 3) as threshold_mps from jumps""")
def _(spark, sf):
    out = detect.velocity_jumps(fleet(spark, sf), SPLIT, few=20)
    return out.select("vehicle_id", "event_id", "start_ms", r3("velocity_mps"), r3("threshold_mps"))


@query("ffill_location_split", "fleet_log", sql=FILL_SQL.format(p="raw"))
def _(spark, sf):
    out = state.fill_position(fleet(spark, sf), "raw_lat", "raw_lng", "heading", track=SPLIT)
    return out.select("event_id", "vehicle_id", "filled_lat", "filled_lng", "filled_heading")


@query("trip_segments_split", "fleet_log", sql=f"with src as (select *, trip_id as ident from fleet_log), {SEGMENTS} {SEGMENT_SUMMARY}")
def _(spark, sf):
    log = settle(state.fill_position(fleet(spark, sf), "raw_lat", "raw_lng", "heading", track=SPLIT).drop("_chunk", "_whole", "_key0"))
    return rounded_segments(segments.trip_segments(log, "trip_id", "filled_lat", "filled_lng", SPLIT))
