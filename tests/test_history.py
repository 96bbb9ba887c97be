"""Ordered scans: equal to a plain loop, however histories are cut."""

import random

import pytest
from pyspark.sql import functions as F

from tracklane.operators import segments, state
from tracklane.plans.history import CHUNK, Track, chunked, runs, scan
from tracklane.plans.quantiles import summary_by_key

TRACKS = {
    "whole": Track(),
    "slots": Track(slot=50, max_rows=5),
    "busy": Track(slot=10_000, max_rows=5),
    "tiny": Track(slot=1, max_rows=1),
}


def make_rows(seed=1):
    """Vehicle 1 holds most rows, one vehicle is NULL, times tie, values have gaps."""
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        vehicle = rnd.choice([1, 1, 1, 1, 2, 3, None])
        rows.append((i, vehicle, rnd.randint(-50, 900) // 3 * 3, rnd.choice([None, None, float(i)]), rnd.choice([None, "a", "a", "b"])))
    return rows


SCHEMA = "event_id long, vehicle_id long, event_ms long, x double, id string"


def histories(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(make_rows(), SCHEMA)


@pytest.mark.parametrize("track", TRACKS.values(), ids=TRACKS)
@pytest.mark.parametrize("reverse", [False, True])
def test_scan(table, track, reverse):
    want = {}
    for rows in histories(make_rows()).values():
        rows = rows[::-1] if reverse else rows
        last, total, top = None, 0, None
        for r in rows:
            total += 1
            want[r[0]] = (last, total, top, rows[0][0])
            if r[3] is not None:
                last = r[3]
            top = r[0] if top is None else max(top, r[0])
    got = scan(
        table, track, prior={"p": (F.col("x"), F.col("x").isNotNull())}, running={"n": F.lit(1)},
        prior_max={"m": F.col("event_id")}, first={"f": F.col("event_id")}, reverse=reverse,
    )
    assert {r.event_id: (r.p, r.n, r.m, r.f) for r in got.collect()} == want


@pytest.mark.parametrize("track", TRACKS.values(), ids=TRACKS)
def test_runs(table, track):
    want = {}
    for rows in histories(make_rows()).values():
        n, nulls, before = -1, -1, None
        for i, r in enumerate(rows):
            start = i == 0 or r[4] != rows[i - 1][4]
            n += start
            nulls += start and r[4] is None
            want[r[0]] = (n, start, nulls if r[4] is None else None, None if start else rows[i - 1][3])
    got = runs(table, track, "id", previous={"px": "x"}).collect()
    assert {r.event_id: (r.run_idx, r.run_start, r.null_run_idx, r.px) for r in got} == want


def test_only_long_histories_are_cut(table):
    assert CHUNK not in chunked(table, Track()).columns
    cut = chunked(table, Track(slot=100, max_rows=100)).groupBy("vehicle_id").agg(F.countDistinct(CHUNK).alias("n")).collect()
    counts = {r.vehicle_id: r.n for r in cut}
    assert counts[1] > 5 and counts[2] == counts[3] == counts[None] == 1


def test_whole_scan_has_one_shuffle(table):
    plan = scan(table, Track(), prior={"p": (F.col("x"), None)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("few", [10, 1_000_000])
def test_summary_by_key(spark, few):
    import statistics

    rnd = random.Random(5)
    data = {k: [rnd.choice([0.0, rnd.random() * 50, 7.0]) for _ in range(n)] for k, n in ((1, 301), (2, 40), (3, 1), (4, 2), (5, 8))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k long, v double")
    for r in summary_by_key(df, ["k"], "v", few).collect():
        vs = data[r.k]
        assert r.pairs == len(vs) and r["lowest"] == min(vs) and r["highest"] == max(vs)
        assert r["median"] == pytest.approx(statistics.median(vs), abs=1e-12)
        assert r["mean"] == pytest.approx(statistics.fmean(vs)) and r["spread"] == pytest.approx(statistics.pstdev(vs))


@pytest.mark.parametrize("track", TRACKS.values(), ids=TRACKS)
def test_trip_backfill(spark, track):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([1, 1, 2]), rnd.randint(0, 300), rnd.choice([None, None, [], [f"t{rnd.randint(0, 9)}"], ["t1", "t5"]])) for i in range(250)]
    log = spark.createDataFrame(rows, "event_id long, vehicle_id long, event_ms long, current_trips array<string>")
    want = {}
    for v in (1, 2):
        mine = sorted((r for r in rows if r[1] == v), key=lambda r: (r[2], r[0]))
        bounds = {}
        for r in mine:
            for t in sorted(r[3] or []):
                lo, hi = bounds.get(t, (r[2], r[2]))
                bounds[t] = (min(lo, r[2]), max(hi, r[2]))
        for r in mine:
            hit = next((t for t, (lo, hi) in bounds.items() if lo <= r[2] <= hi), None)
            want[r[0]] = None if r[3] else hit and [hit]
    got = state.trip_backfill(log, track=track).collect()
    assert {r.event_id: r.current_trips_filled for r in got} == want


@pytest.mark.parametrize("track", TRACKS.values(), ids=TRACKS)
def test_nearest_time_and_neighbours(table, track):
    hist = histories(make_rows())
    near = {r.probe_id: (r.nearest_id, r.gap_ms) for r in segments.nearest_time(table.filter("event_id % 3 = 0"), table.filter("event_id % 3 <> 0"), track).collect()}
    for rows in hist.values():
        for p in (r for r in rows if r[0] % 3 == 0):
            best = min((r for r in rows if r[0] % 3), key=lambda r: (abs(r[2] - p[2]), r[2], r[0]))
            assert near[p[0]] == (best[0], abs(best[2] - p[2]))
    for r in segments.log_neighbours(table, track).collect():
        ids = [x[0] for x in hist[r.vehicle_id]]
        i = ids.index(r.event_id)
        assert (r.prev_id, r.next_id) == (ids[i - 1] if i else None, ids[i + 1] if i + 1 < len(ids) else None)
        assert (r.first_id, r.last_id) == (ids[0], ids[-1])


def test_trips_of_one_list_keep_its_order(spark):
    rows = [(1, 1, 10, ["b", "a"]), (1, 2, 20, None), (1, 3, 30, ["a", "b"])]
    log = spark.createDataFrame(rows, "vehicle_id long, event_id long, event_ms long, current_trips array<string>")
    got = {r.event_id: r.current_trips_filled for r in state.trip_backfill(log).collect()}
    assert got[2] == ["b"]
