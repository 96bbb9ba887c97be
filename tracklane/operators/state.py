"""State carried along a vehicle's log: position, heading, route and trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.plans.history import Track, scan, unchunked
from tracklane.session import settle


def log_index(log: DataFrame, track: Track = Track()) -> DataFrame:
    """0-based position of every row in its vehicle's log, unrecognised calls included."""
    out = scan(log.select(*track.keys, track.time, *track.ties), track, running={"_n": F.lit(1)})
    return out.select(*track.ties, *track.keys, track.time, (F.col("_n") - 1).alias("idx"))


def location_fallback(lat: Column, lng: Column, raw_lat: Column, raw_lng: Column) -> tuple[Column, Column]:
    """The fused location, or the raw one where the row has no fused location."""
    known = lat.isNotNull() & lng.isNotNull()
    return F.when(known, lat).otherwise(raw_lat), F.when(known, lng).otherwise(raw_lng)


def fill_position(
    log: DataFrame, lat: str, lng: str, heading: str, out: str = "filled", track: Track = Track()
) -> DataFrame:
    """Carry the last known position and heading into rows without a position.

    A row with a position keeps its own heading, even a NULL one. A filled row takes the last heading
    seen together with a position, 0 if there was none. The position columns themselves stay as they are.
    """
    here = F.col(lat).isNotNull() & F.col(lng).isNotNull()
    done = scan(
        log, track,
        prior={
            "_place": (F.struct(F.col(lat).alias("lat"), F.col(lng).alias("lng")), here),
            "_turn": (F.col(heading).cast("double"), here & F.col(heading).isNotNull()),
        },
    )
    carried = ~here & F.col("_place").isNotNull()
    return done.select(
        *[c for c in done.columns if c not in ("_place", "_turn")],
        F.when(here, F.col(lat)).otherwise(F.col("_place.lat")).alias(f"{out}_lat"),
        F.when(here, F.col(lng)).otherwise(F.col("_place.lng")).alias(f"{out}_lng"),
        F.when(carried, F.coalesce(F.col("_turn"), F.lit(0.0))).otherwise(F.col(heading).cast("double")).alias(f"{out}_heading"),
    )


def fill_route(log: DataFrame, route: str, traffic: str | None, nav_status: str, track: Track = Track()) -> DataFrame:
    """Carry route and traffic as one unit until a status ending in NO_GUIDANCE clears them.

    Rows that clear the route and rows that bring one both *set* the state, so the state of a row is
    simply what the latest such row set.
    """
    cleared = F.coalesce(F.col(nav_status).endswith("NO_GUIDANCE"), F.lit(False))
    brings = ~cleared & F.col(route).isNotNull()
    jam = F.col(traffic) if traffic else F.lit(None).cast("string")
    unit = F.struct(F.when(brings, F.col(route)).alias("route"), F.when(brings, jam).alias("traffic"))
    done = scan(log, track, prior={"_unit": (unit, cleared | brings)})
    pick = lambda own, name: F.when(cleared, F.lit(None)).when(brings, own).otherwise(F.col(f"_unit.{name}"))
    keep = [c for c in done.columns if c != "_unit"]
    return done.select(*keep, pick(F.col(route), "route").alias("filled_route"), pick(jam, "traffic").alias("filled_traffic"))


def sensor_origin(sensor: Column, has_position: Column, has_header: Column, update_mask: Column) -> Column:
    """``API`` for a position that was set by a call rather than by a device."""
    by_call = has_position & (F.coalesce(sensor, F.lit("")) == "") & ~has_header & F.coalesce(update_mask.contains("last_location"), F.lit(False))
    return F.when(by_call, F.lit("API")).otherwise(sensor)


def trip_bounds(log: DataFrame, trips: str = "current_trips", track: Track = Track()) -> DataFrame:
    """First and last time of every trip seen in the trip lists of any call."""
    seen = log.select(*track.keys, track.time, *track.ties, F.posexplode(trips).alias("pos", "trip_id"))
    place = F.struct(track.time, *track.ties, "pos")  # trips of one row come in the order of its list
    return seen.groupBy(*track.keys, "trip_id").agg(
        F.min(track.time).alias("start_ms"), F.max(track.time).alias("end_ms"), F.min(place).alias("first_seen")
    )


def trip_backfill(log: DataFrame, trips: str = "current_trips", track: Track = Track()) -> DataFrame:
    """Give rows without a trip list the first-seen trip whose time span covers them.

    Lists must be as the log has them (``listed_trips`` of a typed log), not sorted.

    The log is in time order, so "first seen" means "earliest start": a trip can only cover the time
    after every earlier trip has ended. That leaves disjoint spans ``(latest earlier end, own end]``,
    and each row needs just the span that started last before it - no range join.
    """
    bounds = settle(trip_bounds(log, trips, track))  # one small row per trip
    spans = scan(
        bounds.select(
            *track.keys, "trip_id", F.col("start_ms").alias(track.time), "end_ms",
            *[F.col(f"first_seen.{t}").alias(t) for t in (*track.ties, "pos")],
        ),
        track.by(ties=(*track.ties, "pos")),
        prior_max={"_covered": F.col("end_ms")},
    )
    begin = F.greatest(F.col(track.time), F.col("_covered") + 1)
    spans = spans.select(*track.keys, begin.alias(track.time), "end_ms", "trip_id").filter(F.col("end_ms") >= F.col(track.time))
    empty = F.coalesce(F.size(trips), F.lit(0)) <= 0
    line = log.select("*", F.lit(1).alias("_kind")).unionByName(
        spans.select(*track.keys, track.time, F.lit(0).alias("_kind"), F.struct("trip_id", "end_ms").alias("_span")),
        allowMissingColumns=True,
    )
    done = scan(line, track.by(ties=("_kind", *track.ties)), prior={"_open": (F.col("_span"), F.col("_kind") == 0)})
    covered = empty & (F.col("_open.end_ms") >= F.col(track.time))
    return unchunked(done.filter("_kind = 1")).select(
        *log.columns, F.when(covered, F.array("_open.trip_id")).alias("current_trips_filled")
    )
