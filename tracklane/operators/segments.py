"""Trip segments, their paths, trip status over time, and row-to-row navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.functions import geo
from tracklane.plans.history import Track, runs, scan, unchunked
from tracklane.schema import TRIP_STATUS_WEIGHT, UPDATE_APIS


def segment_ident(solution: Column, own: Column, filled: Column, stops: Column | None = None) -> Column:
    """``Stops Left n`` for deliveries; else the first own trip, else the first back-filled one."""
    first = lambda a: F.when(F.size(a) > 0, F.element_at(F.array_sort(a), 1))
    trip = F.coalesce(first(own), first(filled))
    if stops is None:
        return trip
    left = F.when(stops.isNotNull(), F.concat(F.lit("Stops Left "), F.size(stops).cast("string")))
    return F.when(solution == "LMFS", left).otherwise(trip)


def number_segments(log: DataFrame, ident: str, lat: str, lng: str, track: Track = Track()) -> DataFrame:
    """Update rows with their segment number and name and the point of the row before in the segment."""
    updates = log.filter(F.col("api").isin(UPDATE_APIS))
    out = runs(updates, track, ident, previous={"prev_lat": lat, "prev_lng": lng})
    return out.select(
        "*",
        F.col("run_idx").alias("segment_idx"),
        F.coalesce(F.col(ident), F.concat(F.lit("non-trip-segment-"), F.col("null_run_idx").cast("string"))).alias("segment_name"),
    ).drop("run_idx", "null_run_idx")


def trip_segments(log: DataFrame, ident: str, lat: str, lng: str, track: Track = Track()) -> DataFrame:
    """One row per segment: updates, first and last update, duration and distance of its path."""
    rows = number_segments(log, ident, lat, lng, track)
    step = geo.distance_m(F.col("prev_lat"), F.col("prev_lng"), F.col(lat), F.col(lng))
    out = rows.groupBy(*track.keys, "segment_idx", "segment_name").agg(
        F.count("*").alias("update_requests"),
        F.min(track.time).alias("first_ms"),
        F.max(track.time).alias("_end"),
        F.coalesce(F.sum(step), F.lit(0.0)).alias("distance_m"),
    )
    return out.select(
        *track.keys, "segment_idx", "segment_name", "update_requests", "first_ms",
        F.when(F.col("update_requests") > 1, F.col("_end")).alias("last_ms"),
        (F.col("_end") - F.col("first_ms")).alias("duration_ms"),
        "distance_m",
        (F.col("distance_m") / 1000).alias("distance_km"),
        (F.col("distance_m") / 1609).alias("distance_mi"),
    )


def segment_points(
    log: DataFrame, ident: str, lat: str, lng: str, track: Track = Track(), start_ms: int | None = None, end_ms: int | None = None
) -> DataFrame:
    """Path points of every segment in order, optionally clipped to a time range.

    Pass the request or the response position columns to choose the side.
    """
    rows = number_segments(log, ident, lat, lng, track).filter(F.col(lat).isNotNull())
    if start_ms is not None:
        rows = rows.filter(F.col(track.time).between(start_ms, end_ms))
    return rows.select(
        *track.keys, "segment_idx", "segment_name", track.time, *track.ties, F.col(lat).alias("lat"), F.col(lng).alias("lng")
    )


def path_as_array(points: DataFrame, keys: tuple[str, ...] = ("vehicle_id", "segment_idx", "segment_name")) -> DataFrame:
    """Points of each *bounded* segment as one array column, for display of selected segments."""
    item = F.struct("event_ms", "event_id", F.col("lat").alias("latitude"), F.col("lng").alias("longitude"))
    return points.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("path"))


def path_length(log: DataFrame, lat: str, lng: str, track: Track = Track()) -> DataFrame:
    """Travelled distance per vehicle over its located rows."""
    rows = log.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull()).select(*track.keys, track.time, *track.ties, lat, lng)
    out = scan(rows, track, prior={"_was": (F.struct(F.col(lat).alias("lat"), F.col(lng).alias("lng")), None)})
    step = geo.distance_m(F.col("_was.lat"), F.col("_was.lng"), F.col(lat), F.col(lng))
    return out.groupBy(*track.keys).agg(F.count("*").alias("points"), F.coalesce(F.sum(step), F.lit(0.0)).alias("distance_m"))


def segment_trip_logs(segments: DataFrame, log: DataFrame, keys: tuple[str, ...] = ("vehicle_id",)) -> DataFrame:
    """Create-trip and update-trip rows beside the segments of the same trip."""
    calls = log.filter(F.col("api").isin("createTrip", "updateTrip") & F.col("trip_id").isNotNull())
    calls = calls.select(*keys, F.col("trip_id").alias("segment_name"), "event_id", "api")
    return segments.select(*keys, "segment_idx", "segment_name").join(calls, [*keys, "segment_name"], "left")


def planned_paths(log: DataFrame, ident: str, path: str, track: Track = Track()) -> DataFrame:
    """Points of the planned path found on the first row of each segment, one row per point."""
    updates = log.filter(F.col("api").isin(UPDATE_APIS))
    first = runs(updates, track, ident).filter("run_start")
    point = F.posexplode(path).alias("seq", "point")
    return first.select(*track.keys, F.col("run_idx").alias("segment_idx"), point).select(
        *track.keys, "segment_idx", "seq", F.col("point.latitude").alias("lat"), F.col("point.longitude").alias("lng")
    )


def last_trip(segments: DataFrame, keys: tuple[str, ...] = ("vehicle_id",)) -> DataFrame:
    return segments.groupBy(*keys).agg(F.max_by("segment_name", "segment_idx").alias("last_trip"))


def status_changes(log: DataFrame, track: Track = Track(), by_trip: bool = False) -> DataFrame:
    """Rows where the trip status differs from the last one seen (NULLs ignored)."""
    rows = log.filter("trip_status is not null and trip_status <> ''")
    lane = track.by(keys=(*track.keys, "trip_id")) if by_trip else track
    out = scan(rows.select(*lane.keys, track.time, *track.ties, "trip_status"), lane, prior={"_was": (F.col("trip_status"), None)})
    return out.filter(~F.col("_was").eqNullSafe(F.col("trip_status"))).select(
        *lane.keys, track.time, *track.ties, F.col("trip_status").alias("new_status")
    )


def status_asof(probes: DataFrame, log: DataFrame, track: Track = Track()) -> DataFrame:
    """Trip status at each probe row: the latest one strictly before the probe's time."""
    states = log.filter("trip_status is not null and trip_status <> ''").select(
        *track.keys, track.time, *track.ties, F.col("trip_status").alias("_status"), F.lit(1).alias("_kind")
    )
    line = probes.select("*", F.lit(0).alias("_kind")).unionByName(states, allowMissingColumns=True)
    done = scan(line, track.by(ties=("_kind", *track.ties)), prior={"status": (F.col("_status"), F.col("_kind") == 1)})
    return unchunked(done.filter("_kind = 0")).drop("_kind", "_status")


def status_weight(status: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in TRIP_STATUS_WEIGHT.items() for x in kv])
    return F.coalesce(known[status], F.lit(5))


def log_neighbours(log: DataFrame, track: Track = Track()) -> DataFrame:
    """Previous, next, first and last row of each row's log (single tie column)."""
    (tie,) = track.ties
    there = scan(log.select(*track.keys, track.time, tie), track, prior={"prev_id": (F.col(tie), None)}, first={"first_id": F.col(tie)})
    back = scan(there, track, prior={"next_id": (F.col(tie), None)}, first={"last_id": F.col(tie)}, reverse=True)
    return back.select(*track.keys, tie, "prev_id", "next_id", "first_id", "last_id")


def nearest_time(probes: DataFrame, log: DataFrame, track: Track = Track()) -> DataFrame:
    """Log row nearest in time to each probe of the same vehicle; the earlier row on ties.

    The nearest row is either the last row at or before the probe or the first one after it. Rows at
    the same time as the nearest earlier one resolve to the first of them, as do rows after.
    """
    (tie,) = track.ties
    firsts = log.groupBy(*track.keys, track.time).agg(F.min(tie).alias("_row"))
    line = probes.select(*track.keys, track.time, F.col(tie).alias("probe_id"), F.lit(1).alias("_kind")).unionByName(
        firsts.select("*", F.lit(0).alias("_kind")), allowMissingColumns=True
    )
    lane = track.by(ties=("_kind", "probe_id"))
    seen = F.struct(F.col(track.time).alias("ms"), F.col("_row").alias("id"))
    there = scan(line, lane, prior={"_past": (seen, F.col("_kind") == 0)})
    both = scan(there, lane, prior={"_next": (seen, F.col("_kind") == 0)}, reverse=True).filter("_kind = 1")
    past_gap, next_gap = F.col(track.time) - F.col("_past.ms"), F.col("_next.ms") - F.col(track.time)
    take_next = F.col("_past").isNull() | (next_gap < past_gap)
    return both.select(
        *track.keys, "probe_id", F.col(track.time).alias("probe_ms"),
        F.when(take_next, F.col("_next.id")).otherwise(F.col("_past.id")).alias("nearest_id"),
        F.when(take_next, next_gap).otherwise(past_gap).alias("gap_ms"),
    )


def sessions(log: DataFrame, gap_ms: int, track: Track = Track()) -> DataFrame:
    """Stretches of rows with less than ``gap_ms`` from one to the next."""
    (tie,) = track.ties
    rows = scan(log.select(*track.keys, track.time, tie), track, prior={"_was": (F.col(track.time), None)})
    opens = (F.col("_was").isNull() | (F.col(track.time) - F.col("_was") >= gap_ms)).cast("long")
    numbered = scan(rows.withColumn("_open", opens).drop("_was"), track, running={"_session": F.col("_open")})
    return numbered.groupBy(*track.keys, "_session").agg(
        F.min(track.time).alias("first_ms"), F.max(track.time).alias("last_ms"), F.count("*").alias("updates")
    ).drop("_session")
