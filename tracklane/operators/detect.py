"""Detectors over consecutive fixes: missing updates, impossible jumps, ETA deltas, and their context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.functions import geo
from tracklane.plans.history import Track, key_columns, scan
from tracklane.plans.joins import beside
from tracklane.plans.quantiles import FEW, summary_by_key
from tracklane.session import settle

# Fixed values
MISSING_UPDATE_CAP_MS = 60_000
MISSING_UPDATE_MEDIANS = 10
JUMP_CAP_MPS = 68.0
JUMP_MIN_M = 1.0
MPS_TO_MPH = 2.237
ETA_WEIGHT_CAP_S = 300.0
CONTEXT_MS = 60_000


def consecutive_pairs(log: DataFrame, track: Track = Track(), extra: tuple[str, ...] = ()) -> DataFrame:
    """Each fix (row with a raw location) next to the previous fix of the vehicle."""
    fixes = log.filter(F.col("raw_lat").isNotNull() & F.col("raw_lng").isNotNull()).select(
        *track.keys, track.time, *track.ties, "raw_lat", "raw_lng", *extra
    )
    before = F.struct(track.time, "raw_lat", "raw_lng", *extra)
    out = scan(fixes, track, prior={"_before": (before, None)}).filter(F.col("_before").isNotNull())
    helpers = key_columns(track)
    return out.select(
        *track.keys,
        *track.ties,
        F.col(f"_before.{track.time}").alias("start_ms"),
        F.col(track.time).alias("end_ms"),
        (F.col(track.time) - F.col(f"_before.{track.time}")).alias("interval_ms"),
        F.col("_before.raw_lat").alias("start_lat"),
        F.col("_before.raw_lng").alias("start_lng"),
        F.col("raw_lat").alias("end_lat"),
        F.col("raw_lng").alias("end_lng"),
        *[F.col(f"_before.{c}").alias(f"start_{c}") for c in extra],
        *[F.col(c).alias(f"end_{c}") for c in extra],
        *helpers,
    )


def pairs_table(log: DataFrame, track: Track = Track(), extra: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive pairs written once, for detectors that read them several times."""
    return settle(consecutive_pairs(log, track, extra))


def _with_key_stats(pairs: DataFrame, track: Track, value: str, few: int = FEW) -> DataFrame:
    """Pairs next to their key's figures."""
    keys = key_columns(track)
    return beside(pairs, summary_by_key(pairs, keys, value, few), keys)


def interval_stats(log: DataFrame, track: Track = Track()) -> DataFrame:
    """Mean, median, smallest, largest and deviation of the time between fixes, per vehicle."""
    pairs = pairs_table(log, track)
    keys = key_columns(track)
    names = pairs.select(*keys, *track.keys).distinct()
    return summary_by_key(pairs, keys, "interval_ms").join(names, keys).select(
        *track.keys, "pairs", "mean", "median", "lowest", "highest", "spread"
    )


def state_transition(start: Column, end: Column) -> Column:
    """``A>B`` with the enum prefix removed; empty when either state is missing."""
    trim = lambda c: F.regexp_replace(c, "^VEHICLE_STATE_", "")
    text = F.concat(trim(start), F.lit(">"), trim(end))
    return F.when(start.isNull() | end.isNull() | (start == "") | (end == ""), F.lit("")).otherwise(text)


def gap_severity(ms: Column) -> Column:
    return F.when(ms <= 60_000, 2).when(ms < 600_000, 6).when(ms < 36_000_000, 10).otherwise(14)


def jump_severity(mps: Column) -> Column:
    return F.when(mps <= 100, 2).when(mps < 1000, 6).when(mps < 2000, 10).otherwise(14)


def missing_updates(log: DataFrame, track: Track = Track(), state: str | None = None, pairs: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """Pairs of fixes at least ``least(10 x median, 60 s)`` apart.

    ``pairs`` may hold a :func:`pairs_table` shared with other detectors; ``few`` is the number of pairs
    per vehicle up to which one task ranks them.
    """
    pairs = pairs or pairs_table(log, track, (state,) if state else ())
    rated = _with_key_stats(pairs, track, "interval_ms", few)
    limit = F.least(F.col("median") * MISSING_UPDATE_MEDIANS, F.lit(float(MISSING_UPDATE_CAP_MS)))
    move = state_transition(F.col(f"start_{state}"), F.col(f"end_{state}")) if state else F.lit("")
    return rated.select("*", limit.alias("threshold_ms")).filter("interval_ms >= threshold_ms").select(
        *track.keys, "start_ms", "end_ms", "interval_ms", "start_lat", "start_lng", "end_lat", "end_lng",
        move.alias("state_transition"), gap_severity(F.col("interval_ms")).alias("severity"), "threshold_ms",
    )


def velocity_jumps(
    log: DataFrame, track: Track = Track(), radius: float = geo.EARTH_RADIUS_M, pairs: DataFrame | None = None,
    few: int = FEW,
) -> DataFrame:
    """Pairs whose speed is above ``least(median + 2 deviations, 68 m/s)`` over more than a metre.

    ``pairs`` may hold a :func:`pairs_table` shared with other detectors; ``few`` is the number of pairs
    per vehicle up to which one task ranks them.
    """
    pairs = (pairs or pairs_table(log, track)).filter("interval_ms > 0")
    metres = geo.distance_m(*[F.col(c) for c in ("start_lat", "start_lng", "end_lat", "end_lng")], radius)
    pairs = pairs.select("*", metres.alias("distance_m"))
    pairs = pairs.select("*", (F.col("distance_m") / (F.col("interval_ms") / 1000.0)).alias("velocity_mps"))
    rated = _with_key_stats(pairs, track, "velocity_mps", few)
    limit = F.least(F.col("median") + F.col("spread") * 2, F.lit(JUMP_CAP_MPS))
    return (
        rated.select("*", limit.alias("threshold_mps"))
        .filter((F.col("velocity_mps") > F.col("threshold_mps")) & (F.col("distance_m") > JUMP_MIN_M))
        .select(
            *track.keys, *track.ties, "start_ms", "end_ms", "interval_ms", "start_lat", "start_lng", "end_lat", "end_lng",
            "distance_m", "velocity_mps", (F.col("velocity_mps") * MPS_TO_MPH).alias("velocity_mph"),
            jump_severity(F.col("velocity_mps")).alias("severity"), "threshold_mps",
        )
    )


def eta_deltas(log: DataFrame, track: Track = Track()) -> DataFrame:
    """Time between consecutive rows that carry both an ETA and a raw fix."""
    rows = log.filter(F.col("eta_ms").isNotNull() & F.col("raw_lat").isNotNull()).select(
        *track.keys, track.time, *track.ties, "raw_lat", "raw_lng", "eta_ms"
    )
    out = scan(rows, track, prior={"_before": (F.struct(track.time, "eta_ms"), None)})
    seconds = (F.col(track.time) - F.col(f"_before.{track.time}")) / 1000.0
    return out.filter(F.col("_before").isNotNull()).select(
        *track.keys, *track.ties, F.col(track.time), seconds.alias("delta_seconds"),
        ((F.col("eta_ms") - F.col("_before.eta_ms")) / 1000.0).alias("eta_change_seconds"),
        F.least(seconds, F.lit(ETA_WEIGHT_CAP_S)).alias("weight"), "raw_lat", "raw_lng",
    )


def heading_of_pairs(pairs: DataFrame) -> DataFrame:
    """Heading along each pair and the heading of its side marker, with the marker's outline points."""
    start, end = (F.col("start_lat"), F.col("start_lng")), (F.col("end_lat"), F.col("end_lng"))
    out = pairs.select("*", geo.heading_deg(*start, *end).alias("heading_deg"))
    out = out.select("*", geo.side_heading_deg(F.col("heading_deg")).alias("side_heading_deg"))
    side = F.col("side_heading_deg")
    points = {
        "start_far": geo.destination(*start, 1000, side),
        "start_near": geo.destination(*start, 900, side),
        "end_near": geo.destination(*end, 900, side),
        "end_far": geo.destination(*end, 1000, side),
    }
    return out.select("*", *[c.alias(f"{n}_{a}") for n, p in points.items() for c, a in zip(p, ("lat", "lng"))])


def anomaly_context(log: DataFrame, anomalies: DataFrame, track: Track = Track(), margin_ms: int = CONTEXT_MS) -> DataFrame:
    """Log rows inside ``[start - margin, end + margin]`` of an anomaly, with the number of such windows.

    Each window is an opening and a closing mark on the time line, so a running sum gives the number
    of open windows at every row: linear in the input however the windows overlap.
    """
    keys, ties = track.keys, track.ties
    anomalies = settle(anomalies.select(*keys, "start_ms", "end_ms"))
    rows = log.select(*keys, track.time, F.lit(1).alias("_kind"), *ties, F.lit(0).alias("_step"))
    no_tie = [F.lit(None).cast(log.schema[t].dataType).alias(t) for t in ties]
    opens = anomalies.select(*keys, (F.col("start_ms") - margin_ms).alias(track.time), F.lit(0).alias("_kind"), *no_tie, F.lit(1).alias("_step"))
    closes = anomalies.select(*keys, (F.col("end_ms") + margin_ms).alias(track.time), F.lit(2).alias("_kind"), *no_tie, F.lit(-1).alias("_step"))
    line = rows.unionByName(opens).unionByName(closes)
    out = scan(line, track.by(ties=("_kind", *ties)), running={"windows": F.col("_step")})
    return out.filter("_kind = 1 and windows > 0").select(*keys, track.time, *ties, "windows")


def log_with_anomalies(
    log: DataFrame, jumps: DataFrame, gaps: DataFrame, start_ms: int | None = None, end_ms: int | None = None,
    keys: tuple[str, ...] = ("vehicle_id",),
) -> DataFrame:
    """Log rows, jump rows and missing-update rows in one table, placed at the start of the anomaly.

    A jump is kept or dropped by its end time, a missing update by its start time. The log's columns stay;
    anomalies bring ``jump_speed``, or ``gap_ms`` and ``state_transition``.
    """
    inside = lambda c: F.lit(True) if start_ms is None else F.col(c).between(start_ms, end_ms)
    return (
        log.filter(inside("event_ms"))
        .unionByName(jumps.filter(inside("end_ms")).select(
            *keys, F.col("start_ms").alias("event_ms"), F.lit("Jump").alias("api"), F.col("velocity_mps").alias("jump_speed")),
            allowMissingColumns=True)
        .unionByName(gaps.filter(inside("start_ms")).select(
            *keys, F.col("start_ms").alias("event_ms"), F.lit("Missing Updates").alias("api"),
            F.col("interval_ms").alias("gap_ms"), F.col("state_transition")),
            allowMissingColumns=True)
    )
