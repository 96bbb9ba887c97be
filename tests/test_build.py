"""Raw JSON to typed log to analyses, in both wire forms."""

import json

from pyspark.sql import functions as F

from tracklane.operators import segments, state, tasks, trips
from tracklane.plans.history import Track
from tracklane.sources import build, files

TRACK = Track(keys=("dataset_id",))


def read(spark, tmp_path, rows, solution):
    (tmp_path / "log.json").write_text(json.dumps({"solutionType": solution, "rawLogs": rows}))
    return build.build_log(files.scan_dataset_json(spark, str(tmp_path)), solution).cache()


def cloud(time, kind, request=None, response=None, **extra):
    return {"timestamp": time, "jsonPayload": {"@type": f"type.example.com/x.v1.{kind}Log", "request": request or {}, "response": response or {}, **extra}}


def test_cloud_rows(spark, tmp_path):
    place = lambda a: {"last_location": {"raw_location": {"latitude": a, "longitude": 2.0}, "heading": 10 * a, "bearing_accuracy": {"value": 3}}}
    rows = [
        cloud("2024-01-01T00:00:00.5Z", "CreateVehicle", {}, {"state": "VEHICLE_STATE_ONLINE", "vehicleId": "v1"}),
        cloud("2024-01-01T00:00:10Z", "UpdateVehicle", {"vehicle": {**place(1), "currentRouteSegment": "r"}, "updateMask": "last_location"},
              {"currentTrips": ["b", "a"], "lastLocation": {"rawLocation": {"latitude": 5, "longitude": 6}}}),
        {"timestamp": "2024-01-01T00:00:11Z", "jsonPayload": {"@type": "somethingElse"}},
        cloud("2024-01-01T00:00:20Z", "UpdateVehicle", {"vehicle": {"nav_status": "NAVIGATION_STATUS_OFF_ROUTE"}, "header": {"sdk": 1}}, {"navStatus": "NAVIGATION_STATUS_X"}),
        cloud("2024-01-01T00:00:30Z", "UpdateTrip", {"tripId": "a"}, {"status": "TRIP_STATUS_COMPLETE", "pickupPoint": {"point": {"latitude": 1, "longitude": 1}}}, errorResponse={"message": "bad"}),
    ]
    log = read(spark, tmp_path, rows, "ODRD")
    got = {r.event_id: r for r in log.collect()}
    assert sorted(got) == [0, 1, 3, 4]
    assert (got[0].vehicle_state, got[0].vehicle_id, got[0].event_ms) == ("ONLINE", "v1", 1704067200500)
    assert (got[1].lat, got[1].raw_lat, got[1].heading, got[1].heading_accuracy, got[1].sensor, got[1].current_trips) == (1.0, 1.0, 10.0, 3.0, "API", ["a", "b"])
    assert (got[3].nav_status, got[3].sensor, got[3].raw_lat) == ("NAVIGATION_STATUS_OFF_ROUTE", None, None)
    assert (got[4].trip_status, got[4].trip_id, got[4].error) == ("COMPLETE", "a", "bad")
    full = state.fill_position(state.trip_backfill(log, track=TRACK), "lat", "lng", "heading", track=TRACK)
    ident = segments.segment_ident(F.col("solution_type"), F.col("current_trips"), F.col("current_trips_filled"), F.col("journey_segments"))
    found = segments.trip_segments(full.withColumn("ident", ident), "ident", "filled_lat", "filled_lng", TRACK).orderBy("segment_idx").collect()
    assert [(r.segment_name, r.update_requests) for r in found] == [("a", 1), ("non-trip-segment-0", 1)]
    assert {r.event_id: r.filled_lat for r in full.collect()} == {0: None, 1: 1.0, 3: 1.0, 4: 1.0}
    assert trips.pickup_dropoff(log.filter("trip_id = 'a' and api like '%Trip'"), ("event_ms",)).first().pickup_lat == 1.0


def test_archive_delivery_rows(spark, tmp_path):
    stop = lambda *ids: {"stop": {"state": "NEW", "tasks": [{"taskId": i} for i in ids]}}
    point = lambda a: {"point": {"latitude": a, "longitude": 1.0}}
    name = "providers/p/deliveryVehicles/d1"
    rows = [  # newest first, as exported
        {"serverTime": "2024-01-01T00:00:40Z", "updateTask": {"request": {"taskId": "t1"}, "response": {
            "name": "providers/p/tasks/t1", "state": "CLOSED", "taskOutcome": "SUCCEEDED", "taskOutcomeLocationSource": "PROVIDER",
            "plannedLocation": point(1.0), "taskOutcomeLocation": point(1.001)}}},
        {"serverTime": "2024-01-01T00:00:30Z", "updateDeliveryVehicle": {"response": {"name": name, "remainingVehicleJourneySegments": [stop("t2")]}}},
        {"serverTime": "2024-01-01T00:00:20Z", "updateDeliveryVehicle": {
            "request": {"deliveryVehicle": {"lastLocation": {"location": {"latitude": 3, "longitude": 4}}, "remainingDistanceMeters": {"value": 70}}},
            "response": {"name": name, "remainingVehicleJourneySegments": [stop("t1", "t2"), stop()]}}},
        {"serverTime": "2024-01-01T00:00:10Z", "createTask": {"request": {"taskId": "t1", "task": {"type": "DELIVERY", "plannedLocation": point(1.0)}}, "response": {"name": "providers/p/tasks/t1", "state": "OPEN"}}},
    ]
    log = read(spark, tmp_path, rows, "LMFS")
    work = {r.event_id: (r.remaining_tasks, r.remaining_segments, r.vehicle_id) for r in log.filter("api = 'updateDeliveryVehicle'").collect()}
    assert work == {1: (1, 1, "d1"), 2: (2, 2, "d1")}
    assert log.filter("event_id = 2").first().remaining_distance_m == 70.0
    ident = segments.segment_ident(F.col("solution_type"), F.col("current_trips"), F.lit(None).cast("array<string>"), F.col("journey_segments"))
    found = segments.trip_segments(log.withColumn("ident", ident), "ident", "lat", "lng", TRACK).orderBy("segment_idx").collect()
    assert [r.segment_name for r in found] == ["Stops Left 2", "Stops Left 1"]
    calls = log.filter("api in ('createTask', 'updateTask') and has_response").withColumn("state", F.col("task_state"))
    early = tasks.tasks_as_of(calls, 1704067215000).first()
    late = tasks.tasks_as_of(calls, radius=6_371_000.0).first()
    assert (early.type, early.state, early.planned_vs_actual_m) == ("DELIVERY", "OPEN", None)
    assert (late.state, late.outcome, round(late.planned_vs_actual_m)) == ("CLOSED", "SUCCEEDED", 111)


def test_the_log_is_parsed_once_before_vehicles_are_looked_up(spark, tmp_path):
    rows = [
        cloud("2024-01-01T00:00:00Z", "UpdateVehicle", {}, {"vehicleId": "v1", "currentTrips": ["t1"]}),
        cloud("2024-01-01T00:00:05Z", "UpdateTrip", {"tripId": "t1"}, {"status": "NEW"}),
    ]
    log = read(spark, tmp_path, rows, "ODRD").unpersist(blocking=True)
    found = build.with_vehicles(log)
    assert sorted((r.event_id, r.vehicle_id, r.vehicle_from) for r in found.collect()) == [(0, "v1", "own"), (1, "v1", "trip")]
    assert "EvalPython" not in found._jdf.queryExecution().executedPlan().toString()  # payloads are cleaned in Python
