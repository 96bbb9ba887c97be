"""Cases on inline rows: state, segments, detectors, tasks, routes, trips, filters."""

import base64
import math
import random
import struct
import threading
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracklane.functions import geo
from tracklane.operators import detect, dwell, filters, layers, route, segments, state, tasks, traffic, trips, view
from tracklane.plans.history import Track


def test_fill_keeps_own_heading_and_fills_with_last(spark):
    rows = [(1, 1, 1, None, None, 90.0), (2, 1, 2, 1.0, 2.0, 180.0), (3, 1, 3, None, None, None), (4, 1, 4, 3.0, 4.0, None), (5, 1, 5, None, None, None)]
    log = spark.createDataFrame(rows, "event_id long, vehicle_id long, event_ms long, lat double, lng double, heading double")
    got = {r.event_id: (r.filled_lat, r.filled_lng, r.filled_heading) for r in state.fill_position(log, "lat", "lng", "heading").collect()}
    assert got == {1: (None, None, 90.0), 2: (1.0, 2.0, 180.0), 3: (1.0, 2.0, 180.0), 4: (3.0, 4.0, None), 5: (3.0, 4.0, 180.0)}


def test_fill_heading_defaults_to_zero(spark):
    log = spark.createDataFrame([(1, 1, 1, 1.0, 2.0, None), (2, 1, 2, None, None, None)], "event_id long, vehicle_id long, event_ms long, lat double, lng double, heading double")
    assert {r.event_id: r.filled_heading for r in state.fill_position(log, "lat", "lng", "heading").collect()} == {1: None, 2: 0.0}


def test_route_is_carried_with_its_traffic_and_cleared(spark):
    rows = [(1, "A", "jam", None), (2, None, None, "ENROUTE"), (3, "B", None, None), (4, None, None, None), (5, "C", "x", "NAVIGATION_STATUS_NO_GUIDANCE"), (6, None, None, None)]
    log = spark.createDataFrame([(i, 1, i, *r) for i, *r in rows], "event_id long, vehicle_id long, event_ms long, route string, traffic string, nav string")
    got = {r.event_id: (r.filled_route, r.filled_traffic) for r in state.fill_route(log, "route", "traffic", "nav").collect()}
    assert got == {1: ("A", "jam"), 2: ("A", "jam"), 3: ("B", None), 4: ("B", None), 5: (None, None), 6: (None, None)}


def test_segments_of_both_solutions(spark):
    ident = segments.segment_ident(F.col("s"), F.col("own"), F.col("filled"), F.col("stops"))
    rows = [("ODRD", ["b", "a"], None, None), ("ODRD", [], ["c"], None), ("ODRD", None, None, None), ("LMFS", ["a"], None, [1, 2]), ("LMFS", None, None, [])]
    df = spark.createDataFrame(rows, "s string, own array<string>, filled array<string>, stops array<int>")
    assert [r.i for r in df.select(ident.alias("i")).collect()] == ["a", "c", None, "Stops Left 2", "Stops Left 0"]


def test_single_row_segment_has_no_last_update(spark):
    log = spark.createDataFrame(
        [(1, 1, 10, "updateVehicle", None, 0.0, 0.0), (2, 1, 20, "updateVehicle", "t", 0.0, 0.0), (3, 1, 30, "getVehicle", "x", 0.0, 0.0), (4, 1, 40, "updateVehicle", "t", 0.0, 0.01)],
        "event_id long, vehicle_id long, event_ms long, api string, trip string, lat double, lng double",
    )
    a, b = sorted(segments.trip_segments(log, "trip", "lat", "lng").collect(), key=lambda r: r.segment_idx)
    assert (a.segment_name, a.last_ms, a.duration_ms, a.update_requests) == ("non-trip-segment-0", None, 0, 1)
    assert (b.segment_name, b.last_ms, b.duration_ms, b.update_requests) == ("t", 40, 20, 2)
    assert b.distance_m == pytest.approx(math.radians(0.01) * geo.EARTH_RADIUS_M)


def test_status_asof_is_strict(spark):
    log = spark.createDataFrame([(1, 1, 10, "NEW"), (2, 1, 20, "DONE"), (3, 1, 20, None), (4, 1, 21, None)], "event_id long, vehicle_id long, event_ms long, trip_status string")
    out = segments.status_asof(log.select("event_id", "vehicle_id", "event_ms"), log)
    assert {r.event_id: r.status for r in out.collect()} == {1: None, 2: "NEW", 3: "NEW", 4: "DONE"}


def test_missing_updates_states_and_threshold(spark):
    ms = [0, 5000, 10_000, 15_000, 75_000]
    log = spark.createDataFrame([(i, 1, t, 1.0, 1.0, f"VEHICLE_STATE_{'ONLINE' if i < 4 else 'OFFLINE'}") for i, t in enumerate(ms)], "event_id long, vehicle_id long, event_ms long, raw_lat double, raw_lng double, vehicle_state string")
    (r,) = detect.missing_updates(log, state="vehicle_state").collect()
    assert (r.start_ms, r.end_ms, r.interval_ms, r.state_transition, r.severity, r.threshold_ms) == (15_000, 75_000, 60_000, "ONLINE>OFFLINE", 2, 50_000.0)


def test_one_slow_pair_is_no_jump_and_same_time_is_ignored(spark):
    log = spark.createDataFrame([(1, 1, 0, 0.0, 0.0), (2, 1, 0, 1.0, 0.0), (3, 1, 10_000, 1.0, 0.001), (4, 2, 0, 0.0, 0.0), (5, 2, 1000, 0.0, 0.01)], "event_id long, vehicle_id long, event_ms long, raw_lat double, raw_lng double")
    assert [r.event_id for r in detect.velocity_jumps(log).collect()] == [5]


@pytest.mark.parametrize("tile_cells", [64, 5, 2])
def test_dwell_equals_sequential_clustering(spark, tile_cells):
    rnd = random.Random(3)
    rows = []
    for v in (1, 2):
        x = y = 0.0
        for i in range(600):
            x, y = (0.0, 0.0) if rnd.random() < 0.02 else (x + rnd.gauss(0, 6), y + rnd.gauss(0, 6))
            rows.append((i, v, i * 1000, 37.0 + x / 111_319.5, -122.0 + y / 88_900))
    r = geo.EARTH_RADIUS_M

    def metres(a, b, c, e):
        a, b, c, e = map(math.radians, (a, b, c, e))
        return 2 * r * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((e - b) / 2) ** 2)))

    want = set()
    for v in (1, 2):
        found = []
        for row in (x for x in rows if x[1] == v):
            hit = next((c for c in found if metres(c[0], c[1], row[3], row[4]) <= 20), None)
            if hit:
                hit[2], hit[4] = hit[2] + 1, row[2]
            else:
                found.append([row[3], row[4], 1, row[2], row[2]])
        want |= {(v, round(c[0], 9), c[2], c[3], c[4]) for c in found if c[2] >= 3}
    log = spark.createDataFrame(rows, "event_id long, vehicle_id long, event_ms long, raw_lat double, raw_lng double")
    got = {(x.vehicle_id, round(x.lat, 9), x.updates, x.start_ms, x.end_ms) for x in dwell.dwell_locations(log, min_updates=3, tile_cells=tile_cells).collect()}
    assert got == want


def test_dwell_leaders_are_not_broadcast(spark):
    """The driver holds no table that grows with the fixes, however small Spark takes it for."""
    log = spark.range(200).selectExpr("id % 40 as vehicle_id", "id as event_ms", "id as event_id", "37.0 + id * 0.001 as raw_lat", "10.0D as raw_lng")
    plan = dwell.dwell_locations(log, min_updates=1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_dwell_places_of_a_crawling_vehicle(spark):
    """Steps of 10 m: who leads hangs on all before, over many tiles."""
    rows = [(i, 1, i * 1000, 37.0 + i * 10 / 111_319.5, -122.0) for i in range(120)]
    log = spark.createDataFrame(rows, "event_id long, vehicle_id long, event_ms long, raw_lat double, raw_lng double")
    got = sorted((x.start_ms, x.updates) for x in dwell.dwell_locations(log, metres=25, min_updates=1, tile_cells=8).collect())
    assert got == [(i * 3000, 3) for i in range(40)]


def test_tasks_before_their_first_version_are_listed(spark):
    rows = [("a", 10, "OPEN", None, None, 37.0, -122.0, None, None), ("a", 20, "CLOSED", "SUCCEEDED", "LAST", 37.0, -122.0, 37.001, -122.0), ("b", 30, "OPEN", None, None, 37.0, -122.0, None, None)]
    df = spark.createDataFrame(rows, "task_id string, event_ms long, state string, outcome string, outcome_source string, planned_lat double, planned_lng double, outcome_lat double, outcome_lng double")
    got = {r.task_id: (r.state, r.planned_vs_actual_m) for r in tasks.tasks_as_of(df, 25, radius=6_371_000.0).collect()}
    assert got["b"] == (None, None) and got["a"][0] == "CLOSED" and got["a"][1] == pytest.approx(111.19, abs=0.01)
    assert {r.task_id: r.state for r in tasks.tasks_as_of(df, 15).collect()} == {"a": "OPEN", "b": None}


POINTS = [(37.42213, -122.0848), (37.4152, -122.0627), (37.427, -122.0854)]


def compact(points):
    raw = struct.pack("<BI", 1, len(points))
    for a, o in points:
        a, o = math.radians(a), math.radians(o)
        raw += struct.pack("<3d", math.cos(a) * math.cos(o), math.cos(a) * math.sin(o), math.sin(a))
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


@pytest.mark.parametrize("text", [
    "i_lcF~tchVhj@ciCwhAzlC",
    compact(POINTS),
    '[{"latitude": 37.42213, "longitude": -122.0848}, {"latitude": 37.4152, "longitude": -122.0627}, {"latitude": 37.427, "longitude": -122.0854}]',
    "{latitude: 37.42213, longitude: -122.0848},\n {latitude: 37.4152, longitude: -122.0627}, {latitude: 37.427, longitude: -122.0854}",
])
def test_decode_path(text):
    points, error = route.decode_path(text)
    assert error is None and len(points) == 3
    for got, want in zip(points, POINTS):
        assert got == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("text", ["", "not a path at all", '{"a": 1}', '[{"latitude": 1, "longitude": 2}, {"latitude": 3', '{"latitude": "1", "longitude": 2}', "{}}"])
def test_bad_path_is_an_error_value(text):
    assert route.decode_path(text) == (None, "not a path")


def test_path_length_of_array(spark):
    p = ", ".join(f"named_struct('latitude', {a}D, 'longitude', {o}D)" for a, o in POINTS)
    row = spark.sql(f"select array({p}) p, slice(array({p}), 1, 1) q").select(geo.path_length_m(F.col("p")).alias("p"), geo.path_length_m(F.col("q")).alias("q")).first()
    assert row.q == 0.0 and 4000 < row.p < 5500


def route_rows(spark, stretches, total_deg=0.009, n=3):
    pts = [{"latitude": total_deg * i / (n - 1), "longitude": 0.0} for i in range(n)] if n > 1 else [{"latitude": 0.0, "longitude": 0.0}]
    return spark.createDataFrame(
        [(1, pts, stretches)], "id int, points array<struct<latitude:double,longitude:double>>, stretches array<struct<style:string,offsetmeters:double,lengthmeters:double>>"
    )


def intervals(df, **kw):
    return [(round(r.start_m), round(r.end_m), r.style) for r in sorted(route.route_intervals(df, "points", "stretches", **kw).collect(), key=lambda r: r.start_m)]


def test_route_intervals(spark):
    jam = [("TRAFFIC_JAM", 200.0, 100.0), ("SLOWER_TRAFFIC", None, 100.0)]
    total = round(math.radians(0.009) * geo.EARTH_RADIUS_M)
    want = [(0, 100, "SLOWER_TRAFFIC"), (100, 200, "STYLE_NORMAL"), (200, 300, "TRAFFIC_JAM"), (300, total, "STYLE_NORMAL")]
    assert intervals(route_rows(spark, jam)) == want
    assert intervals(route_rows(spark, [])) == [(0, total, "STYLE_NORMAL")]
    assert intervals(route_rows(spark, None)) == [(0, total, "STYLE_NORMAL")]
    assert intervals(route_rows(spark, jam, n=1)) == [(0, 0, "STYLE_NO_DATA")]
    gone = intervals(route_rows(spark, jam), lat=F.lit(math.degrees(250 / geo.EARTH_RADIUS_M)), lng=F.lit(0.00001))
    assert gone == [(0, 100, "STYLE_NO_DATA"), (100, 200, "STYLE_NO_DATA"), (200, 250, "STYLE_NO_DATA"), (250, 300, "TRAFFIC_JAM"), (300, total, "STYLE_NORMAL")]


def test_one_route_of_many_points_and_stretches(spark):
    """Against a loop that looks each interval up; the work must not grow with points times stretches."""
    rnd = random.Random(4)
    many = 60_000
    deg = [i * 1e-6 for i in range(many)]
    at = [math.radians(d) * geo.EARTH_RADIUS_M for d in deg]
    jams = [(f"S{i}", float(i % 6000), rnd.choice([None, 0.0, 0.5, 7.0])) for i in rnd.sample(range(many), many)]
    df = spark.createDataFrame(
        [(1, [(d, 0.0) for d in deg], jams), (2, [(0.0, 0.0), (0.001, 0.0)], [("A", 50.0, 10.0), ("B", 40.0, 1000.0)]), (3, [], [("A", 0.0, 1.0)]), (4, None, None)],
        "id int, points array<struct<latitude:double,longitude:double>>, stretches array<struct<style:string,offsetmeters:double,lengthmeters:double>>",
    )
    spark.sparkContext.setJobGroup("long route", "", True)
    late = threading.Timer(60, spark.sparkContext.cancelJobGroup, ["long route"])
    late.start()
    try:
        got = {}
        for r in route.route_intervals(df, "points", "stretches").collect():
            got.setdefault(r.id, []).append(r)
    finally:
        late.cancel()
        for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(k, None)
    cuts = sorted(c for c in {0.0, at[-1], *[o for _, o, _ in jams], *[o + n for _, o, n in jams if n is not None]} if c <= at[-1] + 1e-6)
    mine = sorted(got[1], key=lambda r: r.start_m)
    assert [round(r.start_m, 4) for r in mine] == [round(c, 4) for c in cuts[:-1]] and [round(r.end_m, 4) for r in mine] == [round(c, 4) for c in cuts[1:]]
    for r in rnd.sample(mine, 50):
        assert r.style == next((s for s, o, n in jams if n is not None and o <= r.start_m < o + n), "STYLE_NORMAL")
        inner = [d for d, m in zip(deg, at) if r.start_m + 1e-6 < m < r.end_m - 1e-6]
        assert [p.latitude for p in r.path] == pytest.approx([math.degrees(r.start_m / geo.EARTH_RADIUS_M), *inner, math.degrees(r.end_m / geo.EARTH_RADIUS_M)], abs=2e-8)
    assert [(round(r.start_m), round(r.end_m), r.style) for r in got[2]] == [(0, 40, "STYLE_NORMAL"), (40, 50, "B"), (50, 60, "A"), (60, 111, "B")]
    assert [tuple(r)[1:] for r in got[3]] == [(0.0, 0.0, "STYLE_NO_DATA", [])] and [tuple(r)[1:] for r in got[4]] == [(0.0, 0.0, "STYLE_NO_DATA", None)]


def test_one_very_long_stretch(spark):
    df = spark.createDataFrame([(1, 1, 0, 1 << 24, "JAM")], "route_id int, ord int, offset_m int, length_m int, style string")
    got = sorted(tuple(r)[1:] for r in traffic.traffic_segments(df, ["ord"], 20_000_000).collect())
    assert got == [(0, 1 << 24, "JAM"), (1 << 24, 20_000_000, "STYLE_NORMAL")]


def test_traffic_segments_against_loop(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(1, 3), i, rnd.choice([None, rnd.randint(0, 1100)]), rnd.randint(0, 300), f"S{i % 4}") for i in range(60)]
    df = spark.createDataFrame(rows, "route_id int, ord int, offset_m int, length_m int, style string")
    want = set()
    for rid in {r[0] for r in rows}:
        mine = [(r[2] or 0, (r[2] or 0) + r[3], r[4]) for r in sorted(rows, key=lambda r: r[1]) if r[0] == rid]
        cuts = sorted(c for c in {0, 1000, *[m[0] for m in mine], *[m[1] for m in mine]} if c <= 1000)
        for a, b in zip(cuts, cuts[1:]):
            want.add((rid, a, b, next((m[2] for m in mine if m[0] <= a < m[1]), "STYLE_NORMAL")))
    got = {tuple(r) for r in traffic.traffic_segments(df, ["ord"], 1000).select("route_id", "start_m", "end_m", "style").collect()}
    assert got == want


@pytest.mark.parametrize("split", [False, True])
def test_traffic_with_fractions_totals_and_a_travelled_part(spark, split):
    """Against a loop; with ``split`` the routes, one of them with most stretches, lie in many tasks."""
    rnd = random.Random(5)
    totals = {1: 1000.5, 2: 400.25, 3: 77.0, 4: 10.0, 5: 0.0}
    gone = {1: 210.75, 3: 500.0, 4: None}
    rows = [(rnd.choice([1, 1, 1, 2, 3]), i // 2, i, rnd.choice([None, round(rnd.uniform(-5, 1100), 2)]), rnd.choice([None, 0.0, round(rnd.uniform(0, 300), 2)]), f"S{i % 5}") for i in range(400)]
    df = spark.createDataFrame(rows, "route_id int, a int, b int, offset_m double, length_m double, style string").repartition(5)
    routes = spark.createDataFrame([(r, t, gone.get(r)) for r, t in totals.items()], "route_id int, total_m double, gone_m double")
    want = set()
    for rid, total in totals.items():
        mine = [(r[3] or 0, (r[3] or 0) + (r[4] or 0), r[5]) for r in sorted(rows, key=lambda r: r[1:3]) if r[0] == rid]
        mine = [(0, gone.get(rid), "STYLE_NO_DATA")] * bool(gone.get(rid)) + mine
        cuts = sorted(c for c in {0, total, *[m[0] for m in mine], *[m[1] for m in mine]} if c <= total)
        for a, b in zip(cuts, cuts[1:]):
            want.add((rid, a, b, next((m[2] for m in mine if m[0] <= a < m[1]), "STYLE_NORMAL")))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, str(not split).lower())
    try:
        got = [tuple(r) for r in traffic.traffic_segments(df, ["a", "b"], routes).collect()]
    finally:
        spark.conf.unset(name)
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_place_is_strict_and_first_on_ties(spark):
    log = spark.createDataFrame([(1, 1, 20, 0.0, 0.0), (2, 1, 10, 0.0, 0.0), (3, 2, 5, 0.0, 179.9995), (4, 1, 1, 0.0, 0.0030)], "event_id long, vehicle_id long, event_ms long, lat double, lng double")
    probes = spark.createDataFrame([(1, 1, 0.0, 0.001), (2, 2, 0.0, -179.9995), (3, 1, 1.0, 1.0)], "probe_id int, vehicle_id long, probe_lat double, probe_lng double")
    got = {r.probe_id: r.nearest_event_id for r in trips.nearest_place(probes, log, "lat", "lng").collect()}
    assert got == {1: 2, 2: 3}  # the date line is no border, and nothing is near probe 3


def test_nearest_place_against_all_pairs_in_dense_places(spark):
    rnd = random.Random(9)
    at = lambda c, spread: (37.0 + c * 0.0006 + rnd.gauss(0, spread), -122.0 - c * 0.0004 + rnd.gauss(0, spread))
    log = [(i, 1 + i % 2, i * 7 % 301, *at(rnd.choice([0, 0, 0, 2, 9]), 0.00003)) for i in range(500)]
    probes = [(i, 1 + i % 2, *at(rnd.choice([0, 0, 1, 5]), 0.00003)) for i in range(300)]
    probes[7] = (7, log[6][1], *log[6][3:])
    r = geo.EARTH_RADIUS_M

    def metres(a, b, c, e):
        a, b, c, e = map(math.radians, (a, b, c, e))
        return 2 * r * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((e - b) / 2) ** 2)))

    want = {}
    for i, v, lat, lng in probes:
        near = min(((metres(lat, lng, x[3], x[4]), x[2], x[0]) for x in log if x[1] == v), default=None)
        if near and near[0] < 250:
            want[i] = near[2]
    df = spark.createDataFrame(log, "event_id long, vehicle_id long, event_ms long, lat double, lng double")
    asked = spark.createDataFrame(probes, "probe_id int, vehicle_id long, probe_lat double, probe_lng double")
    assert {x.probe_id: x.nearest_event_id for x in trips.nearest_place(asked, df, "lat", "lng").collect()} == want


def test_pickup_is_latest_planned_and_earliest_actual(spark):
    rows = [("t", 1, 1.0, 1.0, None, None), ("t", 2, 2.0, 2.0, 5.0, 5.0), ("t", 3, None, None, 6.0, 6.0)]
    df = spark.createDataFrame(rows, "trip_id string, event_ms long, pickup_lat double, pickup_lng double, actual_pickup_lat double, actual_pickup_lng double")
    r = trips.pickup_dropoff(df, ("event_ms",)).first()
    assert (r.pickup_lat, r.actual_pickup_lat) == (2.0, 5.0)


def test_entity_filter_rules(spark):
    logs = spark.createDataFrame([(1, "v", None, "trip1", None), (2, "w", None, "trip10", None), (3, None, "v", None, None), (4, None, None, None, "task2"), (5, None, None, "trip3", None)], "event_ms long, vehicle_id string, delivery_vehicle_id string, trip_id string, task_id string")
    ids = lambda **kw: sorted(r.event_ms for r in filters.entity_filter(logs, **kw).collect())
    assert ids(vehicle_id=" v ") == [1, 3]
    assert ids(ids="trip1") == [1]
    assert ids(ids="trip1, task2,") == [1, 2, 4]
    assert ids(vehicle_id="v", ids="trip3") == [1, 3, 5]
    with pytest.raises(ValueError):
        filters.entity_filter(logs, " ", ", ")


def test_trip_filter_ignores_backfill_for_own_list(spark):
    df = spark.createDataFrame([(1, None, [], ["abc"]), (2, None, None, ["abc"]), (3, "xabcx", None, None), (4, None, ["zzz"], None)], "i int, req string, own array<string>, filled array<string>")
    assert sorted(r.i for r in filters.trip_filter(df, " abc ", "req", "own", "filled").collect()) == [2, 3]
    assert filters.trip_filter(df, "  ", "req", "own", "filled").count() == 4


def test_store_scan_orders_newest_first(spark):
    rows = [("v", "x/Fleet", "p/update_vehicle", datetime(2024, 1, 9)), ("v", "x/Fleet", "p/get_trip", datetime(2024, 1, 9)), ("v", "x/Fleet", "p/create_vehicle", datetime(2024, 1, 10)), ("v", "x/Fleet", "p/update_vehicle", datetime(2024, 1, 1))]
    logs = spark.createDataFrame(rows, "vehicle_id string, resource_type string, log_name string, timestamp timestamp")
    got = filters.store_scan(logs, "vehicle_id", ["v"], datetime(2024, 1, 10, 12))
    assert [r.log_name for r in got.collect()] == ["p/create_vehicle", "p/update_vehicle"]


def test_layer_registry():
    reg = layers.default_layers()
    assert "trip_status" in reg.names("ODRD") and "trip_status" not in reg.names("LMFS")
    reg.add("mine", layers.Layer(lambda rows: rows, solutions=("LMFS",)))
    assert "mine" in reg.names("LMFS")


def test_log_view_of_deliveries(spark):
    log = spark.createDataFrame([(1, 1, 0, "updateDeliveryVehicle", "TASK_STATE_OPEN", 3, 0.0)], "event_id long, vehicle_id long, event_ms long, api string, task_state string, remaining_tasks int, speed double")
    row = view.log_view(log, "LMFS").first()
    assert (row.task_state, row.remaining_tasks, row.kmph, row.day_time) == ("OPEN", 3, None, "01-01 00:00:00")


def test_anomaly_context_counts_overlapping_windows(spark):
    log = spark.createDataFrame([(i, 1, i * 1000) for i in range(10)], "event_id long, vehicle_id long, event_ms long")
    anomalies = spark.createDataFrame([(1, 2000, 3000), (1, 3000, 4000)], "vehicle_id long, start_ms long, end_ms long")
    for track in (Track(), Track(slot=2000, max_rows=2)):
        got = {r.event_ms: r.windows for r in detect.anomaly_context(log, anomalies, track, 1000).collect()}
        assert got == {1000: 1, 2000: 2, 3000: 2, 4000: 2, 5000: 1}


def _joined_rows(df):
    """Rows made by the joins of a plan that was run."""
    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            nodes.append(node.plan())
        else:
            if name.endswith("Join"):
                total += node.metrics().apply("numOutputRows").value()
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
    return total


def test_nearest_place_of_a_parked_vehicle_makes_no_pairs(spark):
    rnd = random.Random(4)
    at = lambda: (37.0 + rnd.uniform(-4e-5, 4e-5), -122.0 + rnd.uniform(-5e-5, 5e-5))
    log = spark.createDataFrame([(i, 1, i, *at()) for i in range(4000)], "event_id long, vehicle_id long, event_ms long, lat double, lng double")
    probes = spark.createDataFrame([(i, 1, *at()) for i in range(4000)], "probe_id int, vehicle_id long, probe_lat double, probe_lng double")
    found = trips.near_points(probes, log, "lat", "lng")
    assert len({r.probe_lat for r in found.collect()}) == 4000
    assert 4000 < _joined_rows(found) < 1_000_000


def test_usual_paths_are_decoded_together(spark):
    plain = ['[{"latitude": 1, "longitude": -2.5e1}]', "{latitude: 1.25, longitude: 2}, {latitude: 3, longitude: 4}", "{'latitude':0.1234567890123456789,'longitude':1.7976931348623157E308}"]
    odd = [None, "", "[]", "[{}]", "_p~iF~ps|U_ulLnnqC_mqNvxq`@", "{longitude: 3, latitude: 4}, {latitude: 1, longitude: 2}", "{latitude: +3, longitude: 4.}",
           '[{"a":{"latitude": 1, "longitude": 2}}]', '[{"latitude": 1, "longitude": 2}, {"latitude": 1}]', '[{"latitude": 1, "longitude": 2}\x01]',
           '[{"latitude": 1, "longitude": 2}\x02,{"latitude": 3, "longitude": 4}]', "{latitude: 1, longitude: 2", 'x{"latitude": 1, "longitude": 2}']
    mark, sizes, _, _ = route._plain_lists(pa.array(plain + odd))
    assert mark.tolist() == [True] * len(plain) + [False] * len(odd) and sizes.tolist()[: len(plain)] == [1, 2, 1]
    beyond = '[{"latitude": 1e999, "longitude": 2}]'
    for texts in (plain, plain + odd, plain + [beyond]):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", "t", route.decode_paths(F.col("t")).alias("d")).collect()
        for r in rows:
            assert (None if r.d.points is None else [tuple(p) for p in r.d.points], r.d.error) == route.decode_path(r.t)


def test_short_routes_are_worked_out_on_arrays():
    """The same intervals as the sweep gives, whatever the cut into batches; only long and cut routes are left to the sweep."""
    rnd, rows = random.Random(4), []
    for rid in [None, *range(40)]:
        rows += [(rid, -math.inf, traffic.BEGIN), (rid, 0.0, traffic.CUT), (rid, 100.0, traffic.CUT), (rid, math.inf, traffic.END)]
        for i in range(100 if rid == 7 else rnd.randint(0, 6)):
            at, size = rnd.choice([-5.0, 0.0, rnd.randint(0, 20) * 5.0]), rnd.choice([0.0, float("nan"), rnd.randint(1, 60) * 1.0])
            rows += [(rid, at, traffic.STRETCH, at + size, rnd.choice([None, "A", "B"]), rnd.choice([None, 1, 2]), i), (rid, at + size, traffic.CUT)]
    rows = [r + (None,) * (7 - len(r)) for r in rows if not r[1] != r[1] and (r[1] <= 100 or r[2] == traffic.END)]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    names, types = list("abcdefg"), [pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.string(), pa.int32(), pa.int32()]
    want, now, sweep = [], object(), None
    for rid, at, kind, end, style, *order in rows:
        if rid != now:
            now, sweep = rid, traffic.Sweep()
        if kind in (traffic.STRETCH, traffic.CUT):
            found = sweep.move(at)
            want += [(rid, *found)] if found and rid != 7 else []
            if kind == traffic.STRETCH:
                sweep.add(traffic._order(order), end, style)
    for size in (1, 7, 50, 10_000):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names) for part in parts]
        got, left = [], []
        for short, batch in traffic._parted(iter(batches)):
            if short:
                got += [(r["route"], r["start_m"], r["end_m"], r["style"]) for r in traffic._short_routes(batch).to_pylist()]
            else:
                left += batch.column(0).to_pylist()
        assert got == want and left == [r[0] for r in rows if r[0] == 7]


def test_the_bundle_is_made_once_before_its_sort(spark, monkeypatch, tmp_path):
    from tracklane.registry import orders

    made = []
    monkeypatch.setattr(orders, "settle", lambda df: made.append(df) or df.limit(0))
    monkeypatch.setattr(orders, "read_view", lambda *_: spark.createDataFrame(
        [("1-1", 1, 1, datetime(2024, 1, 1), 1, 1, 1.0, "OPEN", "trip-1", 1)],
        "task_id string, vehicle_id long, stop_no int, event_time timestamp, l_partkey long, l_suppkey long, l_extendedprice double, state string, trip_id string, order_id long"))
    monkeypatch.setattr(orders, "fleet", lambda *_: spark.createDataFrame([(1, 5, "updateVehicle")], "vehicle_id long, event_ms long, api string"))
    from tracklane.registry.base import QUERIES

    assert QUERIES["vehicle_log_bundle"](spark, "").count() == 0 and len(made) == 1
    assert {r.api for r in made[0].collect()} == {"updateVehicle", "updateTrip", "updateTask"}


def test_task_ids_of_segments_with_gaps(spark):
    kind = "vehicle_id long, segments array<struct<stop: struct<tasks: array<struct<taskId: string>>>>>"
    some = [((([("a",), None, ("",), (None,), ("a",)]),),), (None,), ((None,),), (((([("b",)])),),), None]
    rows = spark.createDataFrame([(1, some), (2, None), (3, [])], kind)
    ids = trips.segment_task_ids(F.col("segments"))
    plan = rows.select(ids.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lambdafunction") == 1  # ids come out of a stop without a function call for each task
    assert [r.x for r in rows.select("vehicle_id", ids.alias("x")).orderBy("vehicle_id").collect()][1:] == [None, []]
    logs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("", 4), (None, 5)], "task_id string, at int")
    got = sorted(tuple(r) for r in trips.vehicle_task_logs(rows, logs, F.col("segments"), ("at",)).collect())
    assert got == [(1, "a", 1), (1, "a", 2), (1, "b", 3)]
