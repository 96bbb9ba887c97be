from datetime import datetime

import pytest

from tracklane.sinks.datasets import write_log
from tracklane.sources.store import LogTable

SCHEMA = (
    "n int, vehicle_id string, delivery_vehicle_id string, trip_id string, task_id string, timestamp timestamp, api string, "
    "current_trips array<string>, journey_segments array<struct<stop:struct<tasks:array<struct<taskId:string>>>>>"
)


@pytest.fixture(scope="module")
def store(spark):
    day = lambda d: datetime(2024, 1, d)
    journey = [{"stop": {"tasks": [{"taskId": "k1"}, {"taskId": "k2"}]}}, {"stop": {"tasks": None}}]
    rows = [
        (1, "v", None, "t1, t2,", None, day(1), "updateVehicle", ["t3"], None), (2, None, None, "t1", None, day(2), "createTrip", None, None),
        (3, None, None, "t3", None, day(3), "updateTrip", None, None), (4, None, None, "t9", None, day(4), "updateTrip", None, None),
        (5, None, "d", None, None, day(5), "updateDeliveryVehicle", None, journey), (6, None, None, None, "k1", day(6), "createTask", None, None),
        (7, None, "d", None, "k5", day(7), "updateTask", None, None), (8, None, None, None, "k9", day(8), "updateTask", None, None),
        (9, "v", "v", None, None, day(9), "updateDeliveryVehicle", None, None), (10, "v", None, "t3", None, day(10), "updateTrip", None, None),
        (11, "w", None, None, None, day(11), "updateVehicle", ["t3"], None), (12, "v", None, None, None, day(12), "updateVehicle", ["t3", "t4"], None),
    ]
    return LogTable(spark.createDataFrame(rows, SCHEMA))


def ids(df):
    return sorted(r.n for r in df.collect())


def test_lookups(store):
    assert ids(store.vehicle_and_trip_logs("v")) == [1, 2, 3, 9, 10, 12]
    assert ids(store.vehicle_and_trip_logs(trip_id="t3")) == [1, 3, 10, 12]
    assert ids(store.delivery_vehicle_logs("d")) == [5, 7] and ids(store.delivery_vehicle_logs("v")) == []
    assert ids(store.task_logs("d")) == [6, 7]


def test_bundle_is_newest_first(store):
    assert [r.n for r in store.bundle("d").collect()] == [7, 6, 5]
    assert store.solution_type("d") == "LMFS" and store.solution_type("v") == "ODRD"


def test_time_bounds_are_open(store):
    assert ids(LogTable(store.logs, datetime(2024, 1, 1), datetime(2024, 1, 3)).logs) == [2]


def test_partitioned_log_prunes(store, spark, tmp_path):
    write_log(store.logs, str(tmp_path / "log"), "timestamp")
    plan = spark.read.parquet(str(tmp_path / "log")).filter("event_date >= '2024-01-11'")
    assert plan.count() == 2
    assert "PartitionFilters: [isnotnull(event_date" in plan._jdf.queryExecution().executedPlan().toString()
