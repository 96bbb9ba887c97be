"""Files, payload clean-up, restricted rows, retention, exports, streams."""

import json
import pathlib
import uuid
import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tracklane.operators import layers
from tracklane.operators.filters import task_rows
from tracklane.sinks import datasets
from tracklane.sources import build, files, merge, payload
from tracklane.streaming import live


@pytest.mark.parametrize("given,want", [
    ({"top_level": {"nested_key": 1}}, {"toplevel": {"nestedkey": 1}}),
    ({"valueObj": {"value": "x"}}, {"valueobj": "x"}),
    ({"a": None, "b": {}, "c": [], "d": {"e": {"value": None}}}, {"c": []}),
    ({"a": [{"B_c": {"value": {"D_e": 1}}}]}, {"a": [{"bc": {"de": 1}}]}),
])
def test_clean(given, want):
    assert payload.clean(given) == want


def test_normalise_column(spark):
    df = spark.createDataFrame([('{"B":1,"a_B":{"value":2}}',), ('{"x":1},{"y":2}',), ("{bad",), (None,)], "p string")
    got = [r.p for r in df.select(payload.normalise_payload(F.col("p")).alias("p")).collect()]
    assert got == ['{"ab":2,"b":1}', '[{"x":1},{"y":2}]', None, None]
    assert [r.p for r in payload.normalise_rows(df, "p").collect()] == got
    same = df.select(payload.payload_hash(F.lit('{"b":1,"a":2}')) == payload.payload_hash(F.lit('{"a":2,"b":1}'))).first()[0]
    assert same


def test_remove_empty_keeps_emptied_parent():
    assert payload.without_empty_objects({"a": {"b": {}}, "c": {}, "d": 1}) == {"a": {}, "d": 1}


def test_json_scan_forms(spark, tmp_path):
    (tmp_path / "envelope.json").write_text(json.dumps({"vehicle": "v", "rawLogs": [{"a": 1}, {"a": 2}]}, indent=1))
    (tmp_path / "array.json").write_text('[{"a": 3}]')
    (tmp_path / "loose.json").write_text('{"a": 4},\n{"a": 5}')
    (tmp_path / "single.json").write_text('{"a": 6}')
    rows = files.scan_dataset_json(spark, str(tmp_path)).select(F.get_json_object("row", "$.a").cast("int").alias("a")).collect()
    assert sorted(r.a for r in rows) == [1, 2, 3, 4, 5, 6]


def test_zip_scan(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("log.json", '{"rawLogs": [{"a": 1}, {"a": 2}]}')
    assert files.scan_zip(spark, str(tmp_path)).count() == 2
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("readme.txt", "x")
    with pytest.raises(Exception, match="No JSON file found"):
        files.scan_zip(spark, str(tmp_path)).count()


def test_archive_rows(spark):
    rows = [json.dumps({"serverTime": "2024-01-01T00:00:00Z", "updateTask": {"request": {"x": 1}, "response": {"name": "p/tasks/t1"}}}),
            json.dumps({"serverTime": "2024-01-01T00:00:01Z", "getDeliveryVehicle": {"errorResponse": {"message": "no"}}}), json.dumps({"other": {}})]
    got = files.archive_unpivot(spark.createDataFrame([(r,) for r in rows], "row string")).collect()
    assert [(r.api, r.event_time) for r in got] == [("updateTask", "2024-01-01T00:00:00Z"), ("getDeliveryVehicle", "2024-01-01T00:00:01Z")]
    assert json.loads(got[0].response) == {"name": "p/tasks/t1"} and json.loads(got[1].error) == {"message": "no"} and got[1].request is None


def test_missing_method_table_is_empty(spark):
    assert files.method_table(spark, "no_such_table", "a int").count() == 0


def test_restricted_overlay(spark):
    rows = [(1, "p", None, "UpdateVehicleLog", "own", "keep"), (2, None, "p", "XRestrictedLog", "first", None), (3, None, "p", "XRestrictedLog", "last", None),
            (4, None, "gone", "XRestrictedLog", "orphan", None), (5, "q", None, "UpdateVehicleLog", "q", "q")]
    df = spark.createDataFrame(rows, "id int, insert_id string, parent string, kind string, route string, points string")
    out = merge.restricted_merge(df, "insert_id", "parent", "kind", ["id"], ["route", "points"]).collect()
    assert sorted((r.id, r.route, r.points, r.merged) for r in out) == [(1, "last", "keep", True), (5, "q", "q", False)]


def test_retention(spark):
    now = datetime(2024, 6, 1, tzinfo=timezone.utc)
    rows = [("old", "2024-02-01"), ("old", "2024-05-30"), ("new", "2024-05-22"), ("none", None)]
    df = spark.createDataFrame(rows, "dataset_id string, d string").withColumn("t", F.to_timestamp("d"))
    got = {r.dataset_id: (str(r.expires), r.warn, r.left_text) for r in datasets.retention(df, F.col("t"), now).collect()}
    assert got["old"] == ("2024-06-01 01:00:00", True, "1 hour")
    assert got["new"] == ("2024-07-16 00:00:00", False, "45 days")
    assert got["none"] == ("2024-06-01 01:00:00", True, "1 hour")
    stored = datasets.retention(df, F.col("t"), now, F.to_timestamp(F.lit("2024-12-01"))).collect()
    assert {str(r.expires) for r in stored} == {"2024-12-01 00:00:00"}


def test_wide_round_trip(spark, tmp_path):
    rows = [("2024-01-01T00:00:00Z", "v1.CreateTripLog", ("a", [1, 2]), 5), ("2024-01-02T00:00:00Z", "v1.Unknown", (None, None), 6)]
    log = spark.createDataFrame(rows, "timestamp string, `@type` string, response struct<name:string,list:array<int>>, n int")
    datasets.export_wide(log, str(tmp_path / "w"))
    assert files.sheet_names(spark, str(tmp_path / "w")) == ["createTrip", "other"]
    header = spark.read.option("header", True).csv(str(tmp_path / "w" / "createTrip")).columns
    assert header[0] == "timestamp" and "name.response" in header
    got = {r.api: json.loads(r.row) for r in files.import_wide(spark, str(tmp_path / "w")).orderBy("timestamp").collect()}
    assert got["createTrip"] == {"timestamp": "2024-01-01T00:00:00Z", "@type": "v1.CreateTripLog", "n": 5, "response": {"list": [1, 2], "name": "a"}}
    assert got["other"] == {"timestamp": "2024-01-02T00:00:00Z", "@type": "v1.Unknown", "n": 6}
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        files.import_wide(spark, str(tmp_path / "none"))


def test_store_replaces_only_one_dataset(spark, tmp_path):
    store = datasets.DatasetStore(spark, str(tmp_path / "s"))
    log = spark.createDataFrame([("updateVehicle", 1), ("getTrip", 2)], "api string, n int")
    store.put("a", log)
    store.copy("a", "b", ["getTrip"])
    store.put("a", log.filter("n = 1"))
    assert (store.get("a").count(), store.get("b").count()) == (1, 1)
    assert store.delete("b") and spark.read.parquet(store.path).count() == 1


def test_store_takes_any_id_and_stays_below_its_table(spark, tmp_path):
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("stays")
    store = datasets.DatasetStore(spark, str(tmp_path / "s"))
    log = spark.createDataFrame([("updateVehicle", 1), ("getTrip", 2)], "api string, n int")
    ids = ["0", "7", "007", "_clipboard", "../other", "a/b", "ä=%", "x" * 300]
    for i in ids:
        store.put(i, log)
    for i in ids:
        assert [r.dataset_id for r in store.get(i).collect()] == [i, i]
    store.put("007", log.limit(0))
    assert store.get("007").count() == 0 and store.get("7").count() == 2
    assert store.delete("../other") and not store.delete("../other") and (tmp_path / "other" / "file").exists()
    store.put("7", store.get("7").filter("n = 1"))
    assert store.get("7").count() == 1


def test_prune_report(spark):
    df = spark.createDataFrame([(1, None), (None, 5), (9, 1), (None, None)], "t int, u int")
    assert tuple(datasets.prune_report(df, 1, 6, "t", "u").first()) == (2, 2)


def test_task_rows_need_a_response(spark):
    df = spark.createDataFrame([("createTask", "r"), ("updateTask", None), ("getTask", "r")], "api string, response string")
    assert task_rows(df).count() == 1


def test_streamed_sessions(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0), (1, 30), (1, 200), (2, 10), (2, 5000)], "vehicle_id long, s long").select(
        "vehicle_id", (F.col("s") * 1000).alias("event_ms"), F.timestamp_seconds("s").alias("event_time")
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = live.sessions(live.unbounded_log(spark, str(tmp_path / "in"), rows.schema), late="1 second")
    run = out.writeStream.format("memory").queryName("sessions_out").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {tuple(r) for r in spark.sql("select * from sessions_out").collect()}
    assert {(1, 0, 30_000, 2), (1, 200_000, 200_000, 1), (2, 10_000, 10_000, 1)} <= got


def streamed(spark, folder, parts, make, late="20 seconds"):
    """Rows of a live query over ``parts`` that arrive in turn, and the most rows its state held."""
    schema = "vehicle_id long, event_id long, s double, raw_lat double, raw_lng double, trip_status string"
    for part in (*parts, [(-1, -1, 1e6, 0.0, 0.0, "END")]):
        rows = spark.createDataFrame(part, schema).withColumn("event_ms", (F.col("s") * 1000).cast("long")).withColumn("event_time", F.timestamp_millis("event_ms"))
        rows.drop("s").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = make(live.unbounded_log(spark, f"{folder}/in", rows.drop("s").schema, 1), late)
    run = out.writeStream.format("memory").queryName(f"live_{uuid.uuid4().hex}").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return [tuple(r) for r in spark.table(run.name).collect()], max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress)


def mixed_log(vehicles):
    """Rows of many vehicles, one of them without a name, in four parts by arrival; ids beyond what a double holds."""
    found = []
    for n in range(vehicles * 12):
        v, second = n % vehicles, 1 + (n * 7919) % 97 + n // (vehicles * 3) * 25
        k = n // vehicles + v
        found.append((None if v == 3 else v + 2**60, 2**60 + n, float(second), None if k % 4 == 3 else float(k % 5), 1.0, ["NEW", "COMPLETE", None, "", "NEW"][k % 5]))
    found.sort(key=lambda r: (r[2] + r[1] * 13 % 7))
    found += found[-5:]  # rows that come twice
    at = [int(len(found) * k / 4) for k in range(5)]
    return [found[a:b] for a, b in zip(at, at[1:])]


def in_order(parts, keep):
    """The kept rows of each vehicle in the order of their events."""
    lines = {}
    for row in sorted((r for part in parts for r in part if keep(r)), key=lambda r: (r[2], r[1])):
        lines.setdefault(row[0], []).append(row)
    return lines.items()


def test_live_gaps_of_many_vehicles_share_few_states(spark, tmp_path):
    parts = mixed_log(1_500)
    got, states = streamed(spark, tmp_path, parts, lambda log, late: live.missing_updates(log, 5_000, late), "100 seconds")
    want = [
        (v, int(a[2] * 1000), int(b[2] * 1000), int((b[2] - a[2]) * 1000), *a[3:5], *b[3:5])
        for v, line in in_order(parts, lambda r: r[3] is not None) for a, b in zip(line, line[1:]) if b[2] - a[2] >= 5
    ]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert any(r[0] is None for r in want) and sorted((r for r in got if r[0] != -1), key=key) == sorted(want, key=key)
    assert states <= live.BUCKETS


def test_live_status_changes_of_many_vehicles_share_few_states(spark, tmp_path):
    parts = mixed_log(1_500)
    got, states = streamed(spark, tmp_path, parts, live.status_changes, "100 seconds")
    want = [
        (v, int(b[2] * 1000), b[1], b[5])
        for v, line in in_order(parts, lambda r: r[5]) for a, b in zip([None, *line], line) if a is None or a[5] != b[5]
    ]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert any(r[0] is None for r in want) and sorted((r for r in got if r[0] != -1), key=key) == sorted(want, key=key)
    assert states <= live.BUCKETS


def test_replay_has_a_file_per_part_however_many_files_the_log_has(spark, tmp_path, monkeypatch):
    from tracklane.registry import load

    seen = []
    monkeypatch.setattr(live, "unbounded_log", lambda spark, folder, *more, plain=live.unbounded_log: (seen.append(folder), plain(spark, folder, *more))[1])
    spark.range(400).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 6480).alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.lit("purchase").alias("event_type"), F.lit(1.0).alias("value"), F.concat(F.lit('{"k": '), (F.col("id") * 31 % 100).cast("string"), F.lit("}")).alias("props"),
    ).repartition(40, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    assert load()[0]["stream_status_changes"](spark, str(tmp_path)).count() > 7
    assert len(list(pathlib.Path(seen[0]).glob("*.parquet"))) == 5


@pytest.mark.parametrize("text, rows", [
    ('{"rawLogs": [{"a": 1}, {"a": 2}], "vehicle": "v"}', ['{"a": 1}', '{"a": 2}']),
    ('{"x": {"rawLogs": [1]}}', ['{"x": {"rawLogs": [1]}}']),
    (' [ {"a": "],["} , 2 ] ', ['{"a": "],["}', "2"]),
    ('{"a": 1},\n{"a": 2}', ['{"a": 1}', '{"a": 2}']),
    ('{"rawLogs": []}', []), ("[]", []), ('{"rawLogs": null}', ['{"rawLogs": null}']), ('{"rawLogs": {"a": 1}}', ['{"a": 1}']), ("{}", ["{}"]),
])
def test_row_spans(text, rows):
    assert [text[a:b] for a, b in files.row_spans(text)] == rows


@pytest.mark.parametrize("text", ["", "nonsense", '{"a": 1', '[{"a": 1}', '{"a": 1} {"a": 2}', '{"rawLogs": [1, 2', '{"a" 1}', "[1,]"])
def test_broken_texts_have_no_rows(text):
    with pytest.raises(ValueError):
        files.row_spans(text)


def test_broken_files_are_errors_and_never_null_rows(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"rawLogs": [{"a": 1}, {"a": 2}]}')
    (tmp_path / "bad.json").write_text('{"rawLogs": [{"a": 1}, ')
    with pytest.raises(Exception, match="Not a dataset"):
        files.scan_dataset_json(spark, str(tmp_path)).collect()
    rows = files.scan_dataset_json(spark, str(tmp_path), strict=False).collect()
    assert sorted(r.row for r in rows) == ['{"a": 1}', '{"a": 2}']
    assert [r.file.rsplit("/", 1)[1] for r in files.scan_errors(spark, str(tmp_path)).collect()] == ["bad.json"]


def test_a_file_of_any_size_keeps_all_rows(spark, tmp_path):
    row = '{"a": "' + "x" * 1000 + '"}'
    (tmp_path / "big.json").write_text('{"rawLogs": [' + ",".join([row] * 140_000) + "]}")
    rows = files.scan_dataset_json(spark, str(tmp_path))
    assert tuple(rows.selectExpr("count(row)", "count(distinct pos)", "min(length(row))").first()) == (140_000, 140_000, len(row))


def test_ingest_wraps_bare_rows_and_finds_the_solution(spark, tmp_path):
    call = {"@type": "type.example.com/x.v1.UpdateVehicleLog", "request": {"vehicleId": "v1"}, "response": {}}
    task = {"timestamp": "2024-01-01T00:00:02Z", "jsonPayload": {"@type": "type.example.com/x.v1.UpdateDeliveryVehicleLog", "response": {"name": "p/deliveryVehicles/d"}}}
    (tmp_path / "a.json").write_text(json.dumps([{"timestamp": "2024-01-01T00:00:01Z", **call}, {"timestamp": "2024-01-01T00:00:03Z", "jsonPayload": call}, call]))
    (tmp_path / "b.json").write_text(json.dumps({"rawLogs": [task]}))
    got = sorted((r.solution_type, r.vehicle_id, r.event_ms) for r in build.ingest(spark, str(tmp_path)).fillna(0, ["event_ms"]).collect())
    assert got == [("LMFS", "d", 1704067202000), ("ODRD", "v1", 0), ("ODRD", "v1", 1704067201000), ("ODRD", "v1", 1704067203000)]


def test_points_are_not_put_together_from_two(spark):
    rows = [(1, 1.0, None, 3.0, 4.0), (2, 1.0, 2.0, 3.0, 4.0), (3, None, 2.0, None, 4.0)]
    log = spark.createDataFrame(rows, "id int, resp_lat double, resp_lng double, raw_lat double, raw_lng double")
    got = {r.id: (r.lat, r.lng) for r in layers.located(log, raw_lat="raw_lat", raw_lng="raw_lng").collect()}
    assert got == {1: (3.0, 4.0), 2: (1.0, 2.0)}
