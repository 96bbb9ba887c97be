"""Queries over tasks, routes and trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklane.functions import geo
from tracklane.operators import route, tasks, traffic, trips
from tracklane.plans.history import Track
from tracklane.registry.base import fleet, fleet_trips, query, r3
from tracklane.session import settle
from tracklane.views import read_view

TIES = ("l_partkey", "l_suppkey", "l_extendedprice")
VERSION_ORDER = "l_shipdate, l_partkey, l_suppkey, l_extendedprice"
TASKS = Track(keys=("task_id",), time="event_ms", ties=TIES, slot=365 * 86_400_000)
DELTA = geo.sql_distance("planned_lat", "planned_lng", "outcome_lat", "outcome_lng")


def task_log(spark, sf):
    return read_view(spark, sf, "task_log").withColumn("event_ms", F.expr("unix_millis(cast(event_time as timestamp))"))


@query("task_versions", "task_log", sql="""
select task_id, vehicle_id, epoch_ms(event_time) as event_ms, state,
  row_number() over (partition by task_id order by event_time, l_partkey, l_suppkey, l_extendedprice) as version,
  epoch_ms(min(event_time) over (partition by task_id)) as first_update, epoch_ms(max(event_time) over (partition by task_id)) as last_update
from task_log""")
def _(spark, sf):
    rows = task_log(spark, sf).select("task_id", "vehicle_id", "event_ms", "state", *TIES)
    return tasks.task_versions(rows, TASKS).drop(*TIES)


LATEST = """
v as (select *, row_number() over (partition by task_id order by event_time desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) as rn
  from task_log where event_time <= timestamp '{until}'),
ids as (select distinct task_id from task_log),
st as (select ids.task_id, v.* exclude (task_id, rn) from ids left join v on v.task_id = ids.task_id and v.rn = 1)"""
LATE = "2100-01-01"


@query("tasks_as_of", "task_log", sql=f"""
with {LATEST.format(until='1998-01-01')} select task_id, state, outcome, outcome_source, planned_lat, planned_lng, outcome_lat, outcome_lng,
round(case when outcome_source is not null then {DELTA} end, 3) as planned_vs_actual_m from st""")
def _(spark, sf):
    out = tasks.tasks_as_of(task_log(spark, sf), 883_612_800_000, ("event_ms", *TIES))
    return out.withColumn("planned_vs_actual_m", F.round("planned_vs_actual_m", 3))


@query("tasks_latest", "task_log", sql=f"""
with {LATEST.format(until=LATE)} select task_id, state, outcome, round(case when outcome_source is not null then {DELTA} end, 3) as planned_vs_actual_m from st""")
def _(spark, sf):
    out = tasks.tasks_as_of(task_log(spark, sf), None, ("event_ms", *TIES))
    return out.select("task_id", "state", "outcome", r3("planned_vs_actual_m"))


@query("task_outcomes", "task_log", sql=f"""
with {LATEST.format(until=LATE)} select task_id, case outcome when 'SUCCEEDED' then 'succeeded' when 'FAILED' then 'failed' else 'other' end as outcome_class,
coalesce(case when outcome_source is not null then {DELTA} end > 50, false) as off_plan from st where planned_lat is not null""")
def _(spark, sf):
    out = tasks.task_outcomes(tasks.tasks_as_of(task_log(spark, sf), None, ("event_ms", *TIES)))
    return out.select("task_id", "outcome_class", "off_plan")


@query("task_latest_log", "task_log", sql=f"""
with {LATEST.format(until=LATE)} select task_id, epoch_ms(event_time) as event_ms, state, vehicle_id, stop_no from st""")
def _(spark, sf):
    out = tasks.task_latest_log(task_log(spark, sf), ("event_ms", *TIES), ("state", "vehicle_id", "stop_no"))
    return out.drop(*TIES)


def journeys(spark, sf):
    """Vehicle rows with nested journey segments: stop i of a row carries tasks i - 1 and i."""
    segs = "transform(sequence(1, stop_no), i -> named_struct('stop', named_struct('state', state, 'tasks', transform(sequence(greatest(i - 1, 1), i), j -> named_struct('taskId', concat(cast(vehicle_id as string), '-', cast(j as string)))))))"
    return read_view(spark, sf, "task_log").withColumn("segments", F.expr(segs))


@query("remaining_work", "task_log", sql="""
select task_id, l_partkey, l_suppkey, l_extendedprice, stop_no as remaining_segments, 2 * stop_no - 1 as remaining_tasks from task_log""")
def _(spark, sf):
    return journeys(spark, sf).select(
        "task_id", *TIES, tasks.remaining_segments(F.col("segments")).alias("remaining_segments"), tasks.remaining_tasks(F.col("segments")).alias("remaining_tasks")
    )


@query("vehicle_task_logs", "task_log", sql="""
with m as (select vehicle_id, max(stop_no) as n from task_log group by 1),
p as (select vehicle_id, concat(cast(vehicle_id as varchar), '-', cast(j as varchar)) as task_id from m, unnest(range(1, n + 1)) as t(j)
  union select vehicle_id, task_id from task_log)
select p.vehicle_id, task_id, epoch_ms(l.event_time) as event_ms, l.state from p join task_log l using (task_id)""")
def _(spark, sf):
    rows = task_log(spark, sf)
    return trips.vehicle_task_logs(journeys(spark, sf), rows, F.col("segments"), ("event_ms", "state"), labelled=rows)


@query("vehicle_task_logs_first20", "task_log", sql="""
with m as (select l_suppkey as vehicle_id, task_id, min(row(event_time, l_partkey, l_extendedprice, vehicle_id, stop_no)) as seen from task_log group by 1, 2),
r as (select *, row_number() over (partition by vehicle_id order by seen) as rn from m)
select r.vehicle_id, task_id, epoch_ms(l.event_time) as event_ms, l.state from r join task_log l using (task_id) where rn <= 20""")
def _(spark, sf):
    rows = task_log(spark, sf)
    own = rows.select(
        F.col("l_suppkey").alias("vehicle_id"), F.struct("event_ms", "l_partkey", "l_extendedprice", F.col("vehicle_id").alias("v"), "stop_no").alias("seen"),
        F.expr("array(named_struct('stop', named_struct('tasks', array(named_struct('taskId', task_id)))))").alias("segments"),
    )
    return trips.vehicle_task_logs(own, rows, F.col("segments"), ("event_ms", "state"), first_only=True, seen=F.col("seen"))


STRETCH = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("traffic_segments", "road_stretch", sql="""
with s as (select *, row_number() over (partition by route_id order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as ord from road_stretch),
c as (select distinct route_id, unnest([0, 1000, offset_m, offset_m + length_m]) as cut from s),
d as (select route_id, cut as start_m, lead(cut) over (partition by route_id order by cut) as end_m from c where cut <= 1000)
select d.route_id, d.start_m, d.end_m, coalesce(arg_min(s.style, s.ord), 'STYLE_NORMAL') as style
from d left join s on s.route_id = d.route_id and d.start_m >= s.offset_m and d.start_m < s.offset_m + s.length_m
where d.end_m is not null group by 1, 2, 3""")
def _(spark, sf):
    return traffic.traffic_segments(read_view(spark, sf, "road_stretch"), list(STRETCH), 1000)


@query("traffic_segments_real", "road_stretch", sql="""
with s as (select route_id, row_number() over (partition by route_id order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as ord,
    offset_m + cast(l_partkey % 8 as double) / 8 as a, offset_m + cast(l_partkey % 8 as double) / 8 + length_m + cast(l_suppkey % 4 as double) / 4 as b, style from road_stretch),
r as (select route_id, 700 + (route_id % 64) * 7.125 as total, case when route_id % 3 = 0 then (route_id % 50) * 8.5 end as gone from road_stretch group by route_id),
t as (select * from s union all select route_id, 0, 0, gone, 'STYLE_NO_DATA' from r where gone > 0),
c as (select distinct route_id, total, unnest([0, total, a, b]) as cut from t join r using (route_id)),
d as (select route_id, cut as start_m, lead(cut) over (partition by route_id order by cut) as end_m from c where cut <= total)
select d.route_id, d.start_m, d.end_m, coalesce(arg_min(t.style, t.ord), 'STYLE_NORMAL') as style
from d left join t on t.route_id = d.route_id and d.start_m >= t.a and d.start_m < t.b where d.end_m is not null group by 1, 2, 3""")
def _(spark, sf):
    """Fractional offsets, a length for each route, and a travelled part on some."""
    rows = read_view(spark, sf, "road_stretch").withColumns({
        "offset_m": F.expr("offset_m + cast(l_partkey % 8 as double) / 8"), "length_m": F.expr("length_m + cast(l_suppkey % 4 as double) / 4"),
    })
    routes = rows.select("route_id").distinct().select(
        "route_id", F.expr("700 + (route_id % 64) * 7.125D").alias("total_m"), F.expr("case when route_id % 3 = 0 then (route_id % 50) * 8.5D end").alias("gone_m"),
    )
    return traffic.traffic_segments(rows, list(STRETCH), routes)


@query("route_intervals", "road_stretch", sql="""
with r as (select *, 111319.49079327358 * 0.01 as total from road_stretch),
c as (select distinct route_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, offset_m, length_m, style, total,
  unnest([0.0, total, cast(offset_m as double), cast(offset_m + length_m as double)]) as cut from r),
d as (select *, lead(cut) over (partition by route_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice order by cut) as end_m from c where cut <= total)
select route_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(cut, 3) as start_m, round(end_m, 3) as end_m,
  case when cut >= offset_m and cut < offset_m + length_m then style else 'STYLE_NORMAL' end as style,
  round(cut / 111319.49079327358, 6) as from_lat, round(end_m / 111319.49079327358, 6) as to_lat from d where end_m is not null""")
def _(spark, sf):
    """One stretch on a straight north-bound route of 0.01 degrees per row."""
    rows = read_view(spark, sf, "road_stretch")
    path = F.expr("transform(array(0.0D, 0.002D, 0.007D, 0.01D), a -> named_struct('latitude', a, 'longitude', 10.0D))")
    stretch = F.array(F.struct("style", F.col("offset_m").alias("offsetmeters"), F.col("length_m").alias("lengthmeters")))
    rows = rows.select("route_id", *STRETCH, path.alias("points"), stretch.alias("stretches"))
    return route.route_intervals(rows, "points", "stretches").select(
        "route_id", *STRETCH, r3("start_m"), r3("end_m"), "style",
        r3(F.col("path")[0]["latitude"], "from_lat", 6), r3(F.element_at("path", -1)["latitude"], "to_lat", 6),
    )


@query("path_measure", "task_log", sql=f"""
with p as (select vehicle_id as route_id, stop_no, l_partkey, l_suppkey, l_extendedprice, planned_lat as lat, planned_lng as lng from task_log),
w as (select *, coalesce({geo.sql_distance('lag(lat) over w', 'lag(lng) over w', 'lat', 'lng')}, 0) as step
  from p window w as (partition by route_id order by stop_no, l_partkey, l_suppkey, l_extendedprice))
select route_id, stop_no, l_partkey, l_suppkey, l_extendedprice, round(step, 3) as step_m,
  round(sum(step) over (partition by route_id order by stop_no, l_partkey, l_suppkey, l_extendedprice), 2) as along_m from w""")
def _(spark, sf):
    points = read_view(spark, sf, "task_log").select(
        F.col("vehicle_id").alias("route_id"), F.col("stop_no").cast("long").alias("stop_no"), *TIES, F.col("planned_lat").alias("lat"), F.col("planned_lng").alias("lng")
    )
    out = route.path_measure(points, Track(keys=("route_id",), time="stop_no", ties=TIES, slot=1000))
    return out.select("route_id", "stop_no", *TIES, r3("step_m"), r3("along_m", digits=2))


def trip_log(spark, sf):
    return read_view(spark, sf, "trip_log").withColumn("event_ms", F.expr("unix_millis(cast(event_time as timestamp))"))


@query("pickup_dropoff", "trip_log", sql=f"""
select concat('trip-', cast(vehicle_id as varchar)) as trip_id, arg_max(pickup_lat, row(event_time, order_id)) as pickup_lat,
  arg_max(pickup_lng, row(event_time, order_id)) as pickup_lng,
  arg_min(actual_pickup_lat, row(event_time, order_id)) filter (where actual_pickup_lat is not null) as actual_pickup_lat,
  arg_min(actual_pickup_lng, row(event_time, order_id)) filter (where actual_pickup_lat is not null) as actual_pickup_lng
from trip_log group by 1""")
def _(spark, sf):
    rows = trip_log(spark, sf).withColumn("trip_id", F.concat(F.lit("trip-"), F.col("vehicle_id").cast("string")))
    return trips.pickup_dropoff(rows, ("event_ms", "order_id")).drop("pickup_delta_m")


def labelled_vehicles(spark, sf):
    """Vehicle rows that name their trips in one comma separated label (some blank)."""
    label = "concat('trip-', cast(vehicle_id as string), ', ,trip-', cast(vehicle_id + 1 as string))"
    return read_view(spark, sf, "task_log").select(F.col("l_suppkey").alias("vehicle_id"), F.expr(label).alias("trip_label"))


LABEL_PAIRS = """ln as (select l_suppkey, unnest([vehicle_id, vehicle_id + 1]) as o from task_log),
lp as (select distinct l_suppkey as vehicle_id, concat('trip-', cast(o as varchar)) as trip_id from ln)"""


@query("distinct_ids", "task_log", sql=f"with {LABEL_PAIRS} select * from lp")
def _(spark, sf):
    return trips.distinct_ids(labelled_vehicles(spark, sf), trips.label_ids(F.col("trip_label")), "trip_id")


@query("vehicle_trip_logs", "task_log", "trip_log", sql=f"""
with {LABEL_PAIRS} select lp.vehicle_id, trip_id, epoch_ms(t.event_time) as event_ms, t.trip_status from lp join trip_log t using (trip_id)""")
def _(spark, sf):
    return trips.vehicle_trip_logs(labelled_vehicles(spark, sf), trip_log(spark, sf), trips.label_ids(F.col("trip_label")), ("event_ms", "trip_status"))


@query("trip_vehicle_logs", "fleet_log", sql="""
with p as (select distinct trip_id, vehicle_id from fleet_log where api in ('createTrip', 'updateTrip') and trip_id is not null)
select l.trip_id, l.vehicle_id, l.event_id, l.event_ms from fleet_log l join p on p.trip_id = l.trip_id and p.vehicle_id = l.vehicle_id
where l.api not in ('createTrip', 'updateTrip')""")
def _(spark, sf):
    log = fleet_trips(spark, sf)
    calls = F.col("api").isin("createTrip", "updateTrip")
    return trips.trip_vehicle_logs(log.filter(calls & F.col("trip_id").isNotNull()), log.filter(~calls), "current_trips", ("event_id", "event_ms"))


@query("delivery_fallback", "fleet_log", "task_log", sql="""
select vehicle_id, event_id as row_id, 'vehicle' as kind from fleet_log union all
select vehicle_id, cast(l_partkey as bigint), 'delivery' from task_log where vehicle_id not in (select vehicle_id from fleet_log)""")
def _(spark, sf):
    own = fleet(spark, sf).select("vehicle_id", F.col("event_id").alias("row_id"), F.lit("vehicle").alias("kind"))
    stops = read_view(spark, sf, "task_log").select("vehicle_id", F.col("l_partkey").cast("long").alias("row_id"), F.lit("delivery").alias("kind"))
    return trips.delivery_fallback(own, stops)


@query("latest_per_trip", "trip_log", sql="""
with r as (select vehicle_id, trip_status, order_id, row_number() over (partition by vehicle_id, trip_status order by event_time desc, order_id desc) as rank from trip_log)
select * from r where rank <= 10""")
def _(spark, sf):
    rows = trip_log(spark, sf)
    out = trips.latest_per_trip(rows, [F.desc("event_ms"), F.desc("order_id")], ("vehicle_id", "trip_status"))
    return out.select("vehicle_id", "trip_status", "order_id", "rank")


@query("vehicle_log_bundle", "fleet_log", "task_log", "trip_log", sql=f"""
with {LABEL_PAIRS}, v as (select vehicle_id, event_ms, api from fleet_log),
d as (select vehicle_id, epoch_ms(event_time) as event_ms, 'updateDeliveryVehicle' as api from task_log where vehicle_id not in (select vehicle_id from v)),
t as (select lp.vehicle_id, epoch_ms(t.event_time) as event_ms, 'updateTrip' as api from lp join trip_log t using (trip_id)),
m as (select vehicle_id, max(stop_no) as n from task_log group by 1),
k as (select vehicle_id, concat(cast(vehicle_id as varchar), '-', cast(j as varchar)) as task_id from m, unnest(range(1, n + 1)) as u(j)),
s as (select k.vehicle_id, epoch_ms(l.event_time) as event_ms, 'updateTask' as api from k join task_log l using (task_id))
select * from v union all select * from d union all select * from t union all select * from s""")
def _(spark, sf):
    log, stops = fleet(spark, sf), task_log(spark, sf)
    tag = lambda df, api: df.select("vehicle_id", "event_ms", F.lit(api).alias("api"))
    named = trips.vehicle_trip_logs(labelled_vehicles(spark, sf), trip_log(spark, sf), trips.label_ids(F.col("trip_label")), ("event_ms",))
    done = trips.vehicle_task_logs(journeys(spark, sf), stops, F.col("segments"), ("event_ms",))
    bundle = trips.vehicle_log_bundle(
        log.select("vehicle_id", "event_ms", "api"), tag(named, "updateTrip"), tag(stops, "updateDeliveryVehicle"), tag(done, "updateTask")
    )
    return settle(bundle).orderBy(F.desc("event_ms"))  # the sort reads its rows twice


@query("decode_paths", "task_log", sql="""
select task_id, l_partkey, l_suppkey, l_extendedprice, unnest([0, 1]) as seq,
  round(unnest([planned_lat, outcome_lat]), 6) as lat, round(unnest([planned_lng, outcome_lng]), 6) as lng from task_log""")
def _(spark, sf):
    rows = read_view(spark, sf, "task_log")
    point = lambda a, o, q: f"concat('{{{q}latitude{q}: ', cast({a} as string), ', {q}longitude{q}: ', cast({o} as string), '}}')"
    listed = F.expr(f"concat('[', {point('planned_lat', 'planned_lng', chr(34))}, ',', {point('outcome_lat', 'outcome_lng', chr(34))}, ']')")
    loose = F.expr(f"concat({point('planned_lat', 'planned_lng', '')}, ', ', {point('outcome_lat', 'outcome_lng', '')})")
    path = F.when(F.col("stop_no") % 2 == 0, listed).otherwise(loose)
    out = rows.select("task_id", *TIES, route.decode_paths(path).alias("d")).select("task_id", *TIES, F.posexplode("d.points").alias("seq", "p"))
    return out.select("task_id", *TIES, "seq", r3(F.col("p.latitude"), "lat", 6), r3(F.col("p.longitude"), "lng", 6))


@query("traffic_segments_long", "road_stretch", sql="""
with s as (select *, row_number() over (partition by route_id order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as ord from
  (select * replace (l_suppkey as route_id) from road_stretch)),
c as (select distinct route_id, unnest([0, 1000, offset_m, offset_m + length_m]) as cut from s),
d as (select route_id, cut as start_m, lead(cut) over (partition by route_id order by cut) as end_m from c where cut <= 1000)
select d.route_id, d.start_m, d.end_m, coalesce(arg_min(s.style, s.ord), 'STYLE_NORMAL') as style
from d left join s on s.route_id = d.route_id and d.start_m >= s.offset_m and d.start_m < s.offset_m + s.length_m
where d.end_m is not null group by 1, 2, 3""")
def _(spark, sf):
    """Few routes with very many stretches each (one route per supplier)."""
    rows = read_view(spark, sf, "road_stretch").withColumn("route_id", F.col("l_suppkey"))
    return traffic.traffic_segments(rows, list(STRETCH), 1000)
