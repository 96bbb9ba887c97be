"""Datasets cut by byte ranges against one pass over the whole text, and what lies around their rows."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tracklane.sources import build, files, ranges
from tracklane.sources.jsontext import row_spans


def value(pick, depth=0):
    kind = pick.randrange(7)
    if kind == 0:
        return pick.choice(["}", '"', "\\", '\\"', "{[", ",]}", "é日", "a}b{\"c", ""]) * pick.randrange(3)
    if kind < 3 or depth > 3:
        return pick.choice([None, pick.randrange(1000), "x"])
    if kind < 5:
        return {f"k{i}{pick.choice(['', '}', chr(92)])}": value(pick, depth + 1) for i in range(pick.randrange(4))}
    return [value(pick, depth + 1) for _ in range(pick.randrange(4))]


def texts(seed):
    pick = random.Random(seed)
    out = {}
    for i in range(14):
        rows = [{"a": value(pick), "text": "pad}" * pick.randrange(40), "b": value(pick)} for _ in range(pick.randrange(25))]
        env = {"vehicle": "v}", "bounds": {"north": 1, "x": [1, 2]}, "other": [{"rawLogs": [1]}], "rawLogs": rows, "retentionDate": "2024"}
        items = list(env.items())
        pick.shuffle(items)
        out[f"{i}.json"] = [
            lambda: json.dumps(dict(items), indent=pick.choice([None, 1]), ensure_ascii=False), lambda: json.dumps(rows, indent=pick.choice([None, 1])),
            lambda: ",\n".join(json.dumps(r) for r in [*rows, {"z": 1}]), lambda: json.dumps({"single": value(pick), "rawLogs": None}),
            lambda: json.dumps({**env, "rawLogs": {"z": 1}}), lambda: " " + json.dumps({**env, "rawLogs": [*rows, {"big": "}" * 3000}]}) + "\n", lambda: "[ ]",
        ][i % 7]()
    return out


def write(folder, found):
    for name, text in found.items():
        (folder / name).write_text(text)
    return str(folder)


@pytest.mark.parametrize("size", [300, 1500, None])
def test_ranges_give_the_rows_of_whole_texts(spark, tmp_path, size):
    given = texts(size or 1)
    found = ranges.cut(spark, write(tmp_path, given), size)
    got = {}
    for r in files.dataset_rows(found).collect():
        got.setdefault(os.path.basename(r.file), []).append((r.pos, r.row))
    for name, text in given.items():
        want = [text[a:b] for a, b in row_spans(text)]
        assert sorted(got.get(name, [])) == list(enumerate(want)), name
    around = {os.path.basename(r.file): json.loads(r.text) for r in found.around.collect()}
    for name, text in given.items():
        if name in ("0.json", "7.json"):
            assert around[name] == {**json.loads(text), "rawLogs": []}


def test_one_file_is_read_in_many_ranges(spark, tmp_path):
    rows = [{"i": i, "t": "}" * (i % 7)} for i in range(4000)]
    found = ranges.cut(spark, write(tmp_path, {"a.json": json.dumps({"vehicle": "v", "rawLogs": rows})}), 8000)
    assert found.ranges >= 8
    got = [(r.pos, json.loads(r.row)["i"]) for r in files.dataset_rows(found).collect()]
    assert sorted(got) == [(i, i) for i in range(4000)]


def test_a_row_over_many_ranges(spark, tmp_path):
    rows = [{"a": 1}, {"big": ["}" * 50] * 2000, "q": '"\\'}, {"a": 3}]
    found = ranges.cut(spark, write(tmp_path, {"a.json": json.dumps(rows)}), 1000)
    assert [json.loads(r.row) for r in files.dataset_rows(found).orderBy("pos").collect()] == rows


@pytest.mark.parametrize("text", ['{"rawLogs":[1,2}', "[1,2", '{"a":"x', "[1]]", "[1] x", "}", "[1,,2]", "{]", '{"rawLogs":[1]} 5', "nonsense"])
def test_broken_texts(spark, tmp_path, text):
    path = write(tmp_path, {"bad.json": text, "good.json": '[{"a":1}]'})
    assert [os.path.basename(r.file) for r in files.scan_errors(spark, path).collect()] == ["bad.json"]
    rows = files.scan_dataset_json(spark, path, strict=False).collect()
    assert [(os.path.basename(r.file), r.pos, r.row) for r in rows] == [("good.json", 0, '{"a":1}')]
    with pytest.raises(Exception, match="Not a dataset"):
        files.scan_dataset_json(spark, path).collect()


def test_meta_of_datasets(spark, tmp_path):
    point = lambda lat, lng: {"timestamp": "2024-01-01T00:00:00Z", "jsonPayload": {"response": {"last_location": {"raw_location": {"latitude": {"value": lat}, "longitude": lng}}}}}
    path = write(tmp_path, {
        "env.json": json.dumps({"vehicle": "v1", "projectId": "p", "logSource": "s", "solutionType": "LMFS", "rawLogs": [point(1, 2)], "retentionDate": "2030-01-01T00:00:00Z",
                                "bounds": {"north": 5, "south": 4, "east": 3, "west": 2}, "APIKEY": "secret"}),
        "array.json": json.dumps([point(0, -7), point(3.5, 1), {"logName": "x_delivery_vehicle", "jsonPayload": {}, "timestamp": "bad"}]), "none.json": "[]",
    })
    now = F.lit("2024-01-05T00:00:00Z").cast("timestamp")
    got = {os.path.basename(r.dataset_id): r for r in build.dataset_meta(ranges.cut(spark, path, 200), now).collect()}
    env, array, none = got["env.json"], got["array.json"], got["none.json"]
    assert (env.vehicle, env.project_id, env.log_source, env.solution_type, env.rows, env.north, env.retention_date.year) == ("v1", "p", "s", "LMFS", 1, 5.0, 2030)
    assert (array.vehicle, array.solution_type, array.rows, array.north, array.south, array.east, array.west) == ("", "LMFS", 3, 3.5, 0.0, 1.0, -7.0)
    assert str(array.retention_date)[:10] == "2024-02-25" and (none.rows, none.north, none.solution_type) == (0, None, "ODRD")
    assert str(none.retention_date)[:13] == "2024-01-05 01"


def test_ingest_finds_vehicles_and_believes_the_envelope(spark, tmp_path):
    call = lambda kind, at, body, labels=None: {"timestamp": f"2024-01-01T00:00:{at:02d}Z", "labels": labels or {}, "jsonPayload": {"@type": f"type/maps.fleetengine.v1.{kind}Log", **body}}
    rows = [
        call("CreateTrip", 1, {"request": {"tripId": "t1"}}), call("UpdateVehicle", 2, {"request": {"vehicleId": "v1"}, "response": {"currentTrips": ["t1"]}}),
        call("UpdateVehicle", 3, {"request": {"vehicleId": "v2"}, "response": {"currentTrips": ["t2"]}}), call("UpdateTrip", 4, {"request": {"tripId": "t2"}}),
    ]
    path = write(tmp_path, {"a.json": json.dumps({"solutionType": "LMFS", "rawLogs": rows}), "b.json": json.dumps(rows[:2] + [call("UpdateTrip", 9, {"request": {"tripId": "t9"}})])})
    got = {(os.path.basename(r.dataset_id), r.event_id): r for r in build.ingest(spark, path).collect()}
    assert [got["a.json", i].vehicle_id for i in range(4)] == ["v1", "v1", "v2", "v2"]
    assert [got["a.json", i].vehicle_from for i in range(4)] == ["trip", "own", "own", "trip"]
    assert got["a.json", 0].solution_type == "LMFS" and got["b.json", 0].solution_type == "ODRD"
    assert (got["b.json", 2].vehicle_id, got["b.json", 2].vehicle_from) == ("v1", "alone")


def test_what_tasks_get_about_ranges_needs_no_package(spark, tmp_path):
    """Executors without this package read it; the class of a broadcast value would be looked up there."""
    import pickletools

    from pyspark.serializers import CPickleSerializer

    files_ = ranges._plans(spark, write(tmp_path, texts(300)), None)
    sent = CPickleSerializer().dumps({n: f.sent() for n, f in files_.items()})
    assert not [a for _, a, _ in pickletools.genops(sent) if isinstance(a, str) and a.startswith("tracklane")]
    for file in files_.values():
        for start, state in file.starts.items():
            found = ranges.Range(file.sent(), start)
            assert found.state == state and found.is_first == (start == min(file.starts)) and found.is_last == (start == max(file.starts))
    assert ranges.Range(None, 0).state is None and ranges.Range(next(iter(files_.values())).sent(), 1).state is None


def test_a_dataset_is_one_file_on_any_number_of_partitions(spark, tmp_path):
    """With the shuffles of a union's sides coalesced apart, the ends of a dataset became files of their own."""
    from tracklane.registry import files as registered

    n = 40_000
    spark.range(n).selectExpr(
        "id as event_id", "timestamp_micros(1704067200000000 + id * 1000000) as ts", "id % 50 as user_id", "'view' as event_type", "1.0D as value",
        "concat('{\"k\": ', id % 100, '}') as props").write.parquet(str(tmp_path / "events.parquet"))
    sizes = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", *sizes)}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    for k, v in zip(sizes, ("64k", "1k")):
        spark.conf.set(k, v)
    try:
        found = registered.big_datasets(spark, str(tmp_path))
        assert found.rows.select("file").distinct().count() == 5
        assert files.dataset_rows(found).count() == n
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
