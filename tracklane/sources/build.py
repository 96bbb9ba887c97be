"""From raw log rows (cloud or archive form) to the typed fleet log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.functions.text import api_of, parse_time, renamed, trim_each, trim_text
from tracklane.operators.identity import Calls, resolve_vehicle
from tracklane.operators.state import location_fallback, sensor_origin
from tracklane.operators.tasks import name_tail, task_id_of
from tracklane.plans.joins import beside
from tracklane.schema import APIS, LMFS, ODRD
from tracklane.session import settle
from tracklane.sources import ranges
from tracklane.sources.files import dataset_rows, scan_dataset_json
from tracklane.sources.merge import merge_restricted_rows, solution_type
from tracklane.sources.payload import normalise_payload

POINT = "struct<latitude:double,longitude:double>"
PLACE = f"struct<point:{POINT}>"
LOCATION = (
    f"struct<location:{POINT},rawlocation:{POINT},flplocation:{POINT},heading:double,headingaccuracy:double,bearingaccuracy:double,"
    "speed:double,rawlocationaccuracy:double,locationsensor:string,locsensor:string,rawlocationsensor:string,"
    "rawlocationtime:string,servertime:string,updatetime:string>"
)
TRAFFIC = "struct<trafficrendering:struct<roadstretch:array<struct<style:string,offsetmeters:double,lengthmeters:double>>>>"
VEHICLE = (
    f"struct<lastlocation:{LOCATION},currentroutesegment:string,currentroutesegmenttraffic:{TRAFFIC},navstatus:string,"
    "etatofirstwaypoint:string,remainingdistancemeters:double>"
)
JOURNEY = f"array<struct<stop:struct<state:string,plannedlocation:{PLACE},tasks:array<struct<taskid:string>>>,path:array<{POINT}>>>"
TASK = f"struct<type:string,trackingid:string,state:string,plannedlocation:{PLACE}>"
BODY = (
    f"struct<request:struct<header:string,updatemask:string,tripid:string,taskid:string,vehicleid:string,trip:struct<name:string>,"
    f"vehicle:{VEHICLE},deliveryvehicle:{VEHICLE},task:{TASK}>,"
    f"response:struct<name:string,vehicleid:string,deliveryvehicleid:string,lastlocation:{LOCATION},currenttrips:array<string>,"
    f"state:string,vehiclestate:string,status:string,tripstatus:string,navigationstatus:string,navstatus:string,currentroutesegment:string,"
    f"supportedtrips:array<string>,supportedtriptypes:array<string>,remainingvehiclejourneysegments:{JOURNEY},"
    f"type:string,trackingid:string,plannedlocation:{PLACE},taskoutcome:string,taskoutcomelocation:{PLACE},taskoutcomelocationsource:string,"
    f"taskoutcometime:string,pickuppoint:{PLACE},dropoffpoint:{PLACE},actualpickuppoint:{PLACE},actualdropoffpoint:{PLACE}>,"
    "errorresponse:struct<message:string>>"
)


def _either(delivery: Column, request: Column, field: str) -> Column:
    """Field of the request's vehicle: ``deliveryvehicle`` for deliveries, else ``vehicle``."""
    get = lambda root: request[root] if not field else _dig(request[root], field)
    return F.when(delivery, get("deliveryvehicle")).otherwise(get("vehicle"))


def _dig(col: Column, path: str) -> Column:
    for name in path.split("."):
        col = col[name]
    return col


def _filled(*columns: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def build_log(rows: DataFrame, solution: str | Column = "ODRD", row: str = "row", dataset: str = "file", pos: str = "pos") -> DataFrame:
    """Typed log of JSON rows, one row per recognised call.

    Every dataset is one history: use ``Track(keys=("dataset_id",))`` to carry state as within one file,
    or ``vehicle_id`` where rows of many vehicles share a dataset. Rows of unknown calls are dropped, and
    ``event_id`` keeps counting them.
    """
    solution = F.lit(solution) if isinstance(solution, str) else solution
    clean = rows.select(F.col(dataset).alias("dataset_id"), F.col(pos).cast("long").alias("event_id"), solution.alias("solution_type"),
                        normalise_payload(F.col(row)).alias("payload"))
    keys = F.filter(F.json_object_keys("payload"), lambda k: k.rlike("(" + "|".join(a.lower() for a in APIS) + ")"))
    named = clean.select("*", F.get_json_object("payload", "$.jsonpayload").alias("_cloud"), F.try_element_at(keys, F.lit(1)).alias("_name"))
    typed = named.select(
        "dataset_id", "event_id", "solution_type", "payload", "_name",
        F.when(F.col("_cloud").isNotNull(), F.get_json_object("_cloud", "$['@type']")).otherwise(F.col("_name")).alias("_type"),
        F.coalesce("_cloud", F.call_function("get_json_object", F.col("payload"), F.concat(F.lit("$['"), F.col("_name"), F.lit("']")))).alias("_call"),
    )
    typed = typed.select("*", api_of(F.col("_type")).alias("api"), F.from_json("_call", BODY).alias("b")).filter("api is not null")

    req, resp, delivery = F.col("b.request"), F.col("b.response"), F.col("solution_type") == "LMFS"
    at = lambda path: F.get_json_object("payload", path)
    time = parse_time(F.coalesce(at("$.timestamp"), at("$.servertime")))
    own = _either(delivery, req, "lastlocation")
    got = resp["lastlocation"]
    xy = lambda loc, kind: (_dig(loc, f"{kind}.latitude"), _dig(loc, f"{kind}.longitude"))
    lat, lng = location_fallback(*xy(own, "location"), *xy(own, "rawlocation"))
    got_lat, got_lng = location_fallback(*xy(got, "location"), *xy(got, "rawlocation"))
    sensor = renamed(got["locsensor"], got["locationsensor"], "LOCATION_SENSOR_")
    state = F.when(delivery, resp["vehiclestate"]).otherwise(renamed(resp["state"], resp["vehiclestate"], "VEHICLE_STATE_"))
    nav = renamed(resp["navstatus"], trim_text(resp["navigationstatus"], "NAVIGATION_STATUS_"), "NAVIGATION_STATUS_")
    journey = resp["remainingvehiclejourneysegments"]
    cols = {
        "event_time": time, "event_ms": F.unix_millis(time),
        "vehicle_id": _filled(at("$.labels.vehicleid"), at("$.labels.deliveryvehicleid"), resp["vehicleid"], resp["deliveryvehicleid"],
                              req["vehicleid"], F.nullif(F.regexp_extract(resp["name"], "(?i)/(?:delivery)?vehicles/([^/]+)$", 1), F.lit(""))),
        "error": F.col("b.errorresponse.message"),
        "lat": lat, "lng": lng, "raw_lat": xy(own, "rawlocation")[0], "raw_lng": xy(own, "rawlocation")[1],
        "heading": own["heading"], "heading_accuracy": F.coalesce(own["bearingaccuracy"], own["headingaccuracy"]), "speed": own["speed"],
        "raw_sensor": own["rawlocationsensor"], "update_time": own["updatetime"],
        "resp_lat": got_lat, "resp_lng": got_lng, "resp_raw_lat": xy(got, "rawlocation")[0], "resp_raw_lng": xy(got, "rawlocation")[1],
        "flp_lat": xy(got, "flplocation")[0], "flp_lng": xy(got, "flplocation")[1],
        "resp_heading": got["heading"], "resp_speed": got["speed"], "accuracy": got["rawlocationaccuracy"],
        "sensor": sensor_origin(sensor, got.isNotNull(), req["header"].isNotNull(), F.coalesce(req["updatemask"], F.lit(""))),
        "client_ms": F.unix_millis(parse_time(got["rawlocationtime"])), "server_ms": F.unix_millis(parse_time(got["servertime"])),
        "nav_status": _filled(_either(delivery, req, "navstatus"), nav),
        "route": _either(delivery, req, "currentroutesegment"), "response_route": resp["currentroutesegment"],
        "roadstretch": _either(delivery, req, "currentroutesegmenttraffic.trafficrendering.roadstretch"),
        "eta_ms": F.unix_millis(parse_time(_either(delivery, req, "etatofirstwaypoint"))),
        "remaining_distance_m": _either(delivery, req, "remainingdistancemeters"),
        "trip_id": _filled(req["tripid"], req["trip"]["name"]), "request_trip": req["tripid"],
        "current_trips": F.array_sort(resp["currenttrips"]), "listed_trips": resp["currenttrips"], "vehicle_state": state,
        "trip_status": renamed(resp["status"], resp["tripstatus"], "TRIP_STATUS_"),
        "trip_types": F.coalesce(trim_each(resp["supportedtrips"], "_TRIP"), resp["supportedtriptypes"]),
        "journey_segments": journey,
        "remaining_tasks": F.aggregate(journey, F.lit(0), lambda n, s: n + F.greatest(F.size(F.coalesce(s["stop"]["tasks"], F.array())), F.lit(0))),
        "remaining_segments": F.when(journey.isNotNull(), F.size(journey)), "planned_path": journey[0]["path"],
        "task_id": F.coalesce(task_id_of(resp["name"]), F.when(F.col("api").endswith("Task"), _filled(req["taskid"], name_tail(resp["name"])))),
        "task_state": resp["state"], "type": F.coalesce(resp["type"], req["task"]["type"]),
        "tracking_id": F.coalesce(resp["trackingid"], req["task"]["trackingid"]),
        "outcome": resp["taskoutcome"], "outcome_source": resp["taskoutcomelocationsource"], "outcome_time": resp["taskoutcometime"],
        "has_response": resp.isNotNull(),
    }
    planned = F.coalesce(resp["plannedlocation"]["point"], req["task"]["plannedlocation"]["point"])
    for name, point in {
        "planned": planned, "outcome": resp["taskoutcomelocation"]["point"], "pickup": resp["pickuppoint"]["point"], "dropoff": resp["dropoffpoint"]["point"],
        "actual_pickup": resp["actualpickuppoint"]["point"], "actual_dropoff": resp["actualdropoffpoint"]["point"],
    }.items():
        cols[f"{name}_lat"], cols[f"{name}_lng"] = point["latitude"], point["longitude"]
    return typed.select("dataset_id", "event_id", "solution_type", "api", *[c.alias(n) for n, c in cols.items()], "payload")


def with_vehicles(log: DataFrame) -> DataFrame:
    """The typed log with the vehicles of its unnamed calls (:func:`tracklane.operators.identity.resolve_vehicle`),
    dataset by dataset. A dataset of one vehicle gives it to all of its calls."""
    named = F.flatten(F.transform("journey_segments", lambda s: F.transform(F.coalesce(s["stop"]["tasks"], F.array()), lambda t: t["taskid"])))
    calls = Calls(trips="current_trips", tasks="_tasks", keys=("dataset_id",), alone=True)
    # Every step of the lookup reads the log; settled, its JSON is cleaned and parsed once.
    return resolve_vehicle(settle(log.withColumn("_tasks", named)), calls).drop("_tasks")


def ingest(spark: SparkSession, path: str, per_line: bool = False, strict: bool = True, vehicles: bool = True) -> DataFrame:
    """Typed log of all datasets under ``path``: rows cut out, bare payloads wrapped, restricted rows laid over
    their parents, solution type found, with ``vehicles`` those of unnamed calls too.

    A bare payload is a row that names its type at the top; its time moves out with it. An envelope that states its
    solution type is believed.
    """
    found = None if per_line else ranges.cut(spark, path)
    rows = scan_dataset_json(spark, path, True, strict) if per_line else dataset_rows(found, strict)
    bare = F.get_json_object("row", "$['@type']").isNotNull() & F.get_json_object("row", "$.jsonPayload").isNull()
    stamp = F.coalesce(F.to_json(F.struct(F.get_json_object("row", "$.timestamp").alias("timestamp"))), F.lit("{}"))
    head = F.when(stamp == "{}", F.lit("{")).otherwise(F.concat(F.expr("left({0}, length({0}) - 1)".format("_stamp")), F.lit(",")))
    wrapped = rows.withColumn("_stamp", stamp).withColumn(
        "row", F.when(bare, F.concat(head, F.lit('"jsonPayload":'), F.col("row"), F.lit("}"))).otherwise(F.col("row"))
    )
    rows = settle(merge_restricted_rows(wrapped.drop("_stamp")))  # read twice from here
    # LMFS where any call of a dataset is about a delivery vehicle
    kind = solution_type(rows, F.when(F.lower("row").rlike('"[^"]*deliveryvehicle(log)?"'), F.lit("_delivery_vehicle")).otherwise(F.lit("")), ("file",))
    if found is not None:
        stated = found.around.select("file", F.get_json_object("text", "$.solutionType").alias("_stated"))
        kind = kind.join(stated, "file", "left").select("file", F.coalesce(F.nullif("_stated", F.lit("")), "solution_type").alias("solution_type"))
    log = build_log(beside(rows, kind, ["file"]), F.col("solution_type"))
    return with_vehicles(log) if vehicles else log


def dataset_meta(found: ranges.Cut, now: Column) -> DataFrame:
    """One row for each dataset file of :func:`ranges.cut`: ``dataset_id``, ``vehicle``, ``project_id``, ``log_source``, ``solution_type``,
    ``map_id``, ``north``, ``south``, ``east``, ``west``, ``rows``, ``oldest``, ``retention_date``; keys and tokens are left where they are.

    An envelope keeps its own fields; other forms get the defaults of a direct load, a solution type by their log
    names and bounds by the measured points of responses. Retention is the envelope's date, 55 days from the oldest
    row, or an hour from ``now``, whichever is last. Texts with an error raise it.
    """
    rows = dataset_rows(found).select("file", normalise_payload(F.col("row")).alias("p"))
    at = lambda *paths: F.coalesce(*[F.get_json_object("p", f"$.{x}") for x in paths])
    time = parse_time(at("timestamp", "inserttimestamp", "jsonpayload.timestamp"))
    side = lambda c: at(*[f"{root}response.lastlocation.rawlocation.{c}" for root in ("jsonpayload.", "")]).cast("double")
    point = F.struct(side("latitude").alias("lat"), side("longitude").alias("lng"))
    told = rows.select("file", time.alias("time"), at("logname").contains("_delivery_vehicle").alias("delivery"), point.alias("at"))
    both = F.col("at.lat").isNotNull() & F.col("at.lng").isNotNull()
    sums = told.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.min("time").alias("oldest"), F.coalesce(F.bool_or("delivery"), F.lit(False)).alias("delivery"),
        *[f(F.when(both, F.col(c))).alias(n) for n, f, c in (
            ("north", F.max, "at.lat"), ("south", F.min, "at.lat"), ("east", F.max, "at.lng"), ("west", F.min, "at.lng"))],
    )
    whole = found.around.join(sums, "file", "full")
    own = lambda path: F.get_json_object("text", path)
    envelope = F.coalesce(own(f"$.{ranges.ROWS}").isNotNull(), F.lit(False))
    of = lambda path, default: F.when(envelope, own(path)).otherwise(default)
    least = F.greatest(F.col("oldest") + F.make_dt_interval(F.lit(55)), now + F.make_dt_interval(hours=F.lit(1)))
    return whole.select(
        F.col("file").alias("dataset_id"), of("$.vehicle", F.lit("")).alias("vehicle"), of("$.projectId", F.lit("")).alias("project_id"),
        of("$.logSource", F.lit("Direct Cloud Logging")).alias("log_source"),
        F.coalesce(F.nullif(own("$.solutionType"), F.lit("")), F.when(F.col("delivery"), LMFS).otherwise(ODRD)).alias("solution_type"), own("$.mapId").alias("map_id"),
        *[of(f"$.bounds.{n}", F.col(n)).cast("double").alias(n) for n in ("north", "south", "east", "west")],
        F.coalesce("rows", F.lit(0)).alias("rows"), "oldest", F.greatest(parse_time(own("$.retentionDate")), least).alias("retention_date"),
    )
