"""Queries that write the tables to files in the shared folder and read them back."""

from __future__ import annotations

import io
import uuid
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.registry.base import fleet, query
from tracklane.session import shared_folder
from tracklane.sinks import datasets
from tracklane.sources import build, files, ranges

ENVELOPE_ROWS = 500


def fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def log_rows(spark, sf):
    return fleet(spark, sf).select("event_id", "vehicle_id", "event_ms", "api", "raw_lat")


def envelopes(spark, sf, form):
    """Datasets of at most 500 rows each: an id range of that size can hold no more."""
    rows = log_rows(spark, sf).select((F.col("event_id") / ENVELOPE_ROWS).cast("long").alias("part"), F.to_json(F.struct("event_id", "vehicle_id", "event_ms", "api", "raw_lat")).alias("row"))
    joined = F.concat_ws(",", F.collect_list("row"))
    text = F.when(F.lit(form) == "loose", joined).when(F.lit(form) == "array", F.concat(F.lit("["), joined, F.lit("]"))).otherwise(
        F.concat(F.lit('{"solutionType":"ODRD","rawLogs":['), joined, F.lit("]}"))
    )
    return rows.groupBy("part").agg(text.alias("value"))


def parsed(rows):
    row = F.from_json("row", "event_id long, vehicle_id long, event_ms long, api string, raw_lat double")
    return rows.select(row.alias("r")).select("r.*")


ROWS_SQL = "select event_id, vehicle_id, event_ms, api, raw_lat from fleet_log"


@query("scan_dataset_json", "fleet_log", sql=ROWS_SQL)
def _(spark, sf):
    path = fresh(spark, "datasets")
    envelopes(spark, sf, "envelope").select("value").write.text(path)
    return parsed(files.scan_dataset_json(spark, path, per_line=True))


# Envelopes, arrays and loose rows; brackets and quotes inside texts; fields before and behind the rows.
FRAMES = {
    0: ('{"vehicle": "car } 0", "other": [{"rawLogs": [1, {"a": "]"}]}], "mapId": "m]\\\\", "rawLogs": [',
        '], "projectId": "p\\"[", "logSource": "BigQuery", "solutionType": "LMFS", "bounds": {"north": 3.5, "south": 1, "east": 2, "west": -4}, "retentionDate": "1970-06-01T00:00:00Z"}'),
    1: ("[", "]"), 2: (" [", "] "), 3: ('{"rawLogs": [', '], "retentionDate": "1970-01-02T00:00:00Z", "vehicle": "car 3"}'), 4: ("", ""),
}
RANGE_BYTES = 1 << 16


def big_datasets(spark, sf):
    """Five files, however large the tables: vehicles by the remainder of their number. They are read in small ranges."""
    log = fleet(spark, sf).withColumn("dataset", F.col("vehicle_id") % 5)
    point = F.when(F.col("raw_lat").isNotNull(), F.struct(F.col("raw_lat").alias("latitude"), F.col("raw_lng").alias("longitude")))
    kind = F.when((F.col("dataset") == 2) & (F.col("k") % 50 == 7), "update_delivery_vehicle").otherwise("update_vehicle")
    row = F.to_json(F.struct(
        F.date_format(F.timestamp_millis("event_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.concat(F.lit("p/logs/_"), kind).alias("logName"),
        F.struct(F.struct(F.struct(point.alias("rawLocation")).alias("lastLocation")).alias("response"), F.lit('x}"]\\').alias("note"), "event_id").alias("jsonPayload"),
    ))
    within = Window.partitionBy("dataset").orderBy("event_id")
    rows = log.select("dataset", row.alias("row"), F.row_number().over(within).alias("at"), F.lead(F.lit(1)).over(within).isNull().alias("last"))
    frame = lambda i: F.coalesce(*[F.when(F.col("dataset") == d, f[i]) for d, f in FRAMES.items()], F.lit(""))
    before = F.when(F.col("at") == 1, F.concat(frame(0), F.lit("\n"))).otherwise(",")
    text = F.concat(before, "row", F.when(F.col("last"), F.concat(F.lit("\n"), frame(1))).otherwise(""))
    path = fresh(spark, "large")
    # One file of a dataset: its rows come in order from the window they are numbered in, ends and all.
    lines = rows.select("dataset", "at", text.alias("value")).repartition("dataset").sortWithinPartitions("dataset", "at")
    lines.select("dataset", "value").write.partitionBy("dataset").text(path)
    return ranges.cut(spark, path, RANGE_BYTES)


def dataset_no():
    return F.regexp_extract("file", "dataset=([0-9]+)", 1).cast("long").alias("dataset")


@query("scan_dataset_ranges", "fleet_log", sql="""
select vehicle_id % 5 as dataset, event_id, row_number() over (partition by vehicle_id % 5 order by event_id) - 1 as pos, raw_lat from fleet_log""")
def _(spark, sf):
    rows = files.dataset_rows(big_datasets(spark, sf))
    at = lambda p: F.get_json_object("row", f"$.jsonPayload.{p}")
    return rows.select(dataset_no(), at("event_id").cast("long").alias("event_id"), "pos", at("response.lastLocation.rawLocation.latitude").cast("double").alias("raw_lat"))


@query("dataset_meta", "fleet_log", sql="""
with d as (
  select vehicle_id % 5 as dataset, count(*) as rows, min(event_ms) as oldest_ms, max(raw_lat) as north, min(raw_lat) as south, max(raw_lng) as east, min(raw_lng) as west,
    coalesce(bool_or(k % 50 = 7), false) as delivery from fleet_log group by 1
)
select dataset, case dataset when 0 then 'car } 0' when 3 then 'car 3' when 1 then '' when 2 then '' when 4 then '' end as vehicle,
  case dataset when 0 then 'p"[' when 3 then null else '' end as project_id, case dataset when 0 then 'BigQuery' when 3 then null else 'Direct Cloud Logging' end as log_source,
  case when dataset = 0 or (dataset = 2 and delivery) then 'LMFS' else 'ODRD' end as solution_type, case when dataset = 0 then 'm]' || chr(92) end as map_id,
  case dataset when 0 then 3.5 when 3 then null else north end as north, case dataset when 0 then 1.0 when 3 then null else south end as south,
  case dataset when 0 then 2.0 when 3 then null else east end as east, case dataset when 0 then -4.0 when 3 then null else west end as west, rows, oldest_ms,
  greatest(case dataset when 0 then 13046400000 else 0 end, oldest_ms + 55 * 86400000::bigint, 1209600000 + 3600000) as retention_ms
from d""")
def _(spark, sf):
    found = build.dataset_meta(big_datasets(spark, sf), F.lit("1970-01-15T00:00:00Z").cast("timestamp"))
    return found.withColumnRenamed("dataset_id", "file").select(
        dataset_no(), "vehicle", "project_id", "log_source", "solution_type", "map_id", "north", "south", "east", "west", "rows",
        F.unix_millis("oldest").alias("oldest_ms"), F.unix_millis("retention_date").alias("retention_ms"),
    )


@query("scan_loose_json", "fleet_log", sql=ROWS_SQL)
def _(spark, sf):
    path = fresh(spark, "loose")
    envelopes(spark, sf, "loose").select("value").write.text(path)
    return parsed(files.scan_dataset_json(spark, path, per_line=True))


@query("scan_zip", "fleet_log", sql=ROWS_SQL)
def _(spark, sf):
    @F.pandas_udf(T.BinaryType())
    def pack(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            box = io.BytesIO()
            with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("notes.txt", "first member is not a dataset")
                archive.writestr("log.json", t)
            out.append(box.getvalue())
        return pd.Series(out, dtype=object)

    boxes = envelopes(spark, sf, "array").select(F.col("part").cast("string").alias("path"), pack("value").alias("content"))
    return parsed(files.unzip_rows(boxes))


@query("export_json", "fleet_log", sql=ROWS_SQL)
def _(spark, sf):
    path = fresh(spark, "export")
    datasets.export_json(log_rows(spark, sf), path)
    return spark.read.schema("event_id long, vehicle_id long, event_ms long, api string, raw_lat double").json(path)


def nested(spark, sf):
    return fleet(spark, sf).select(
        F.date_format(F.timestamp_millis("event_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.concat(F.lit("v1."), F.col("api"), F.lit("Log")).alias("@type"),
        F.struct(F.struct(F.col("raw_lat").alias("latitude")).alias("location"), "event_id").alias("request"),
        F.array("k", "heading").alias("numbers"), "nav_status",
    )


@query("export_wide", "fleet_log", sql="""
select strftime(make_timestamp(event_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as timestamp, 'v1.' || api || 'Log' as "@type", coalesce(nav_status, '') as nav_status,
  '[' || k || ',' || coalesce(cast(heading as varchar), 'null') || ']' as numbers, cast(event_id as varchar) as "event_id.request",
  cast(coalesce(round(raw_lat, 2), -1) as double) as lat from fleet_log""")
def _(spark, sf):
    out = datasets.wide(nested(spark, sf))
    lat = F.coalesce(F.round(F.col("`latitude.location.request`").try_cast("double"), 2), F.lit(-1.0))
    return out.select("*", lat.alias("lat")).drop("latitude.location.request")


@query("import_wide", "fleet_log", sql="""
select api, event_id, round(raw_lat, 2) as lat, '[' || k || ',' || coalesce(cast(heading as varchar), 'null') || ']' as numbers, nav_status from fleet_log""")
def _(spark, sf):
    folder = fresh(spark, "sheets")
    datasets.export_wide(nested(spark, sf), folder)
    row = lambda p: F.get_json_object("row", p)
    return files.import_wide(spark, folder).select(
        "api", row("$.request.event_id").cast("long").alias("event_id"), F.round(row("$.request.location.latitude").cast("double"), 2).alias("lat"),
        row("$.numbers").alias("numbers"), row("$.nav_status").alias("nav_status"),
    )


@query("dataset_store", "fleet_log", sql="""
select 'a' as dataset_id, count(*) as rows from fleet_log where api <> 'getVehicle' union all select 'b', count(*) from fleet_log where api = 'updateVehicle'
union all select '0', count(*) from fleet_log where api = 'createTrip' union all select '007', count(*) from fleet_log where api = 'updateTrip'
union all select '_clipboard', count(*) from fleet_log where api = 'getVehicle' union all select 'x/../0 %=', count(*) from fleet_log""")
def _(spark, sf):
    """Ids of every kind, a replaced, an emptied and a deleted dataset."""
    store = datasets.DatasetStore(spark, fresh(spark, "store"))
    log = log_rows(spark, sf)
    store.put("a", log.filter("api = 'createTrip'"))
    store.put("a", log.filter("api <> 'getVehicle'"))
    store.copy("a", "b", ["updateVehicle"])
    store.copy("a", "c")
    store.delete("c")
    for name, api in (("0", "createTrip"), ("007", "updateTrip"), ("_clipboard", "getVehicle"), ("7", "getVehicle")):
        store.put(name, log.filter(F.col("api") == api))
    store.put("x/../0 %=", log)
    store.put("7", log.limit(0))
    names = ("a", "b", "c", "0", "007", "7", "_clipboard", "x/../0 %=")
    found = reduce(lambda x, y: x.unionByName(y), [store.get(n) for n in names])
    return found.groupBy("dataset_id").agg(F.count("*").alias("rows"))
