"""Delivery tasks: versions, state as of a time, outcomes, remaining work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.functions import geo
from tracklane.plans.history import Track, scan

# Fixed value: planned and actual place further apart than this are off plan
OFF_PLAN_M = 50.0
TASK_TRACK = Track(keys=("task_id",))


def task_id_of(name: Column) -> Column:
    """Id at the end of ``.../tasks/<id>``; NULL for other names."""
    found = F.regexp_extract(name, "(?i)/tasks/(.*)$", 1)
    return F.when(found != "", found)


def name_tail(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)


def task_versions(tasks: DataFrame, track: Track = TASK_TRACK) -> DataFrame:
    """Every version of every task with its number and the task's first and last update time."""
    there = scan(tasks, track, running={"version": F.lit(1)}, first={"first_update": F.col(track.time)})
    return scan(there, track, first={"last_update": F.col(track.time)}, reverse=True).select(
        *tasks.columns, "version", "first_update", "last_update"
    )


def first_known(*columns: Column) -> Column:
    """Response value, else the request's (creates and updates differ in where they carry it)."""
    return F.coalesce(*columns)


def tasks_as_of(
    tasks: DataFrame, until=None, order: tuple[str, ...] = ("event_ms",), key: str = "task_id", radius: float = geo.EARTH_RADIUS_M
) -> DataFrame:
    """One row per task with its latest version up to ``until`` (all NULL before its first version)."""
    facts = [
        c for c in ("state", "outcome", "outcome_source", "outcome_time", "type", "tracking_id",
                    "planned_lat", "planned_lng", "outcome_lat", "outcome_lng") if c in tasks.columns
    ]
    known = F.lit(True) if until is None else F.col(order[0]) <= until
    newest = F.max(F.when(known, F.struct(*order, *facts)))
    out = tasks.groupBy(key).agg(newest.alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in facts])
    complete = F.col("outcome_source").isNotNull() & F.col("planned_lat").isNotNull() & F.col("outcome_lat").isNotNull()
    metres = geo.distance_m(*[F.col(c) for c in ("planned_lat", "planned_lng", "outcome_lat", "outcome_lng")], radius)
    return out.select("*", F.when(complete, metres).alias("planned_vs_actual_m"))


def task_outcomes(states: DataFrame) -> DataFrame:
    """Outcome class and off-plan flag of tasks that have a planned place."""
    text = F.coalesce(F.col("outcome"), F.lit("unknown"))
    kind = F.when(text.contains("SUCCEEDED"), "succeeded").when(text.contains("FAIL"), "failed").otherwise("other")
    return states.filter("planned_lat is not null").select(
        "*", kind.alias("outcome_class"), F.coalesce(F.col("planned_vs_actual_m") > OFF_PLAN_M, F.lit(False)).alias("off_plan")
    )


def task_latest_log(tasks: DataFrame, order: tuple[str, ...], keep: tuple[str, ...], key: str = "task_id") -> DataFrame:
    """The newest log row of each task."""
    return tasks.groupBy(key).agg(F.max(F.struct(*order, *keep)).alias("_v")).select(
        key, *[F.col(f"_v.{c}").alias(c) for c in (*order, *keep)]
    )


def remaining_tasks(segments: Column) -> Column:
    """Tasks over all remaining journey segments."""
    return F.aggregate(segments, F.lit(0), lambda n, s: n + F.greatest(F.size(F.coalesce(s["stop"]["tasks"], F.array())), F.lit(0)))


def remaining_segments(segments: Column) -> Column:
    return F.when(segments.isNotNull(), F.size(segments))
