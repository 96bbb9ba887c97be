"""Vehicles of unnamed calls: order of sightings, several vehicles, tasks through trips, alone datasets, hot ids."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tracklane.operators.identity import Calls, resolve_vehicle

SCHEMA = "ds string, event_id long, event_ms long, vehicle_id string, trip_id string, task_id string, current_trips array<string>, tasks array<string>"
CALLS = Calls(tasks="tasks", keys=("ds",), slot=1000)


def brute(rows, alone=False):
    """Last sighting at or before, else first after; trip, task, trip of the task."""
    named = lambda x: x not in (None, "")

    def seen(pos, lists, value):
        out = []
        for r in rows:
            if named(r[value]):
                for i in {r[pos], *((r[lists] or []) if lists else [])}:
                    if named(i):
                        out.append((r[0], i, r[2], r[1], r[value]))
        return out

    by_trip, by_task, of_task = seen(4, 6, 3), seen(5, 7, 3), seen(5, None, 4)

    def look(sights, ds, i, at):
        mine = sorted((t, e, v) for d, x, t, e, v in sights if d == ds and x == i and ds is not None)
        past = [v for t, _, v in mine if t <= at]
        return past[-1] if past else next((v for t, _, v in mine if t > at), None)

    out = {}
    for ds, event, at, vehicle, trip, task, *_ in rows:
        source = "own"
        if not named(vehicle):
            via = look(of_task, ds, task, at) if named(task) else None
            steps = [("trip", look(by_trip, ds, trip, at) if named(trip) else None), ("task", look(by_task, ds, task, at) if named(task) else None),
                     ("task_trip", look(by_trip, ds, via, at) if named(via) else None)]
            every = {r[3] for r in rows if r[0] == ds and named(r[3])}
            steps.append(("alone", next(iter(every)) if alone and len(every) == 1 else None))
            source, vehicle = next(((n, v) for n, v in steps if v is not None), (None, None))
        out[ds, event] = vehicle, source
    return out


def found(spark, rows, calls=CALLS):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = resolve_vehicle(df, calls).collect()
    assert len(got) == len(rows)
    return {(r["ds"], r["event_id"]): (r["vehicle_id"], r["vehicle_from"]) for r in got}


def test_cases(spark):
    rows = [
        ("a", 1, 0, None, "t1", None, None, None),  # created before any vehicle lists it
        ("a", 2, 10, "v1", None, None, ["t1", "t2", ""], ["k1"]), ("a", 3, 20, "", "t1", None, None, None),
        ("a", 4, 30, "v2", None, None, ["t1"], None), ("a", 5, 30, None, "t1", None, None, None), ("a", 6, 25, None, "t1", None, None, None),
        ("a", 7, 5, None, None, "k1", None, None), ("a", 8, 6, None, "t2", "k2", None, None), ("a", 9, 7, None, None, "k2", None, None),
        ("a", 10, 8, None, "t9", "k9", None, None), ("b", 1, 0, None, "t1", None, None, None), ("b", 2, 0, "v7", "", "", [], None), ("c", 1, 0, None, None, None, None, None),
    ]
    got = found(spark, rows)
    assert got == brute(rows)
    assert got["a", 1] == ("v1", "trip") and got["a", 5] == ("v2", "trip") and got["a", 9] == ("v1", "task_trip") and got["b", 1] == (None, None)


def test_alone(spark):
    rows = [("b", 1, 0, None, "t1", None, None, None), ("b", 2, 0, "v7", None, None, None, None), ("c", 1, 0, None, None, None, None, None),
            ("d", 1, 0, "x", None, None, None, None), ("d", 2, 0, "y", None, None, None, None), ("d", 3, 0, None, None, None, None, None)]
    assert found(spark, rows, Calls(tasks="tasks", keys=("ds",), alone=True)) == brute(rows, True)
    only = [r for r in rows if r[0] == "b"]
    df = spark.createDataFrame(only, SCHEMA)
    assert {r["vehicle_id"] for r in resolve_vehicle(df, Calls(alone=True)).collect()} == {"v7"}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs(spark, seed):
    pick = random.Random(seed)
    some = lambda kind, n: pick.choice([None, *(f"{kind}{i}" for i in range(n))])
    rows = [
        (pick.choice("ab"), e, pick.randrange(80), some("v", 4), some("t", 6), some("k", 5), [some("t", 6) for _ in range(pick.randrange(3))], None)
        for e in range(160)
    ]
    assert found(spark, rows) == brute(rows)


def test_one_trip_with_most_rows_is_cut(spark):
    rows = [("a", e, e * 10, f"v{e // 50 % 3}" if e % 4 == 0 else None, "hot", None, None, None) for e in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["ds"], r["event_id"]): (r["vehicle_id"], r["vehicle_from"]) for r in resolve_vehicle(df, replace(CALLS, max_rows=100)).collect()}
    assert got == brute(rows)


def test_empty_log_and_rows_without_a_time(spark):
    assert found(spark, []) == {}
    rows = [("a", 1, 10, "v1", "t1", None, None, None), ("a", 2, 20, None, "t1", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).unionByName(spark.createDataFrame([("a", 3, None, None, "t1", None, None, None)], SCHEMA))
    got = {r["event_id"]: r["vehicle_id"] for r in resolve_vehicle(df, CALLS).select("event_id", F.col("vehicle_id")).collect()}
    assert got == {1: "v1", 2: "v1", 3: "v1"}
