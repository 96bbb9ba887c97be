"""Row filters of the log."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.schema import SEARCH_LOG_NAMES, STORE_LOG_NAMES

DELIVERY_LABELS = ("delivery_vehicle_id", "task_id")


def time_range(log: DataFrame, start, end, time: str = "event_ms") -> DataFrame:
    """Both ends inclusive; an end left as None is open."""
    out = log if start is None else log.filter(F.col(time) >= start)
    return out if end is None else out.filter(F.col(time) <= end)


def open_interval(log: DataFrame, start, end, time: str = "event_ms") -> DataFrame:
    return log.filter((F.col(time) > start) & (F.col(time) < end))


def type_filter(log: DataFrame, apis: list[str], solution: str | Column = "ODRD") -> DataFrame:
    """Keep the chosen calls; delivery rows are never filtered by call."""
    solution = F.lit(solution) if isinstance(solution, str) else solution
    return log.filter((solution != "ODRD") | F.col("api").isin(apis))


def trip_filter(log: DataFrame, text: str, request_trip: str, own: str, filled: str | None = None) -> DataFrame:
    """Rows whose requested trip, or any current trip, contains the text (trimmed; blank keeps all).

    Back-filled trips count only for rows without a trip list of their own (an empty list is a list).
    """
    text = text.strip()
    if not text:
        return log
    trips = F.coalesce(F.col(own), F.col(filled)) if filled else F.col(own)
    hit = F.coalesce(F.col(request_trip).contains(text), F.lit(False)) | F.coalesce(
        F.exists(trips, lambda t: t.contains(text)), F.lit(False)
    )
    return log.filter(hit)


def trip_ids(text: str | None) -> list[str]:
    return [t.strip() for t in (text or "").split(",") if t.strip()]


def entity_filter(
    logs: DataFrame, vehicle_id: str | None = None, ids: str | None = None,
    start=None, end=None, labels: dict[str, str] | None = None, log_names: list[str] | None = SEARCH_LOG_NAMES,
) -> DataFrame:
    """Rows of a vehicle or of any of the (comma separated) trip or task ids, in an inclusive time range.

    One id must match exactly; several are matched anywhere in the label. ``labels`` maps the four
    label names to columns.
    """
    vehicle_id, ids = (vehicle_id or "").strip(), trip_ids(ids)
    if not vehicle_id and not ids:
        raise ValueError("Either a vehicle id or at least one trip id must be given")
    col = labels or {n: n for n in ("vehicle_id", "delivery_vehicle_id", "trip_id", "task_id")}
    match = lambda name, test: F.coalesce(test(F.col(col[name])), F.lit(False)) if name in col else F.lit(False)
    wanted = F.lit(False)
    if vehicle_id:
        same = lambda c: c.cast("string") == vehicle_id
        wanted = wanted | match("vehicle_id", same) | match("delivery_vehicle_id", same)
    if ids:
        pattern = "(" + "|".join(re.escape(i) for i in ids) + ")"
        one = (lambda c: c == ids[0]) if len(ids) == 1 else (lambda c: c.rlike(pattern))
        wanted = wanted | match("trip_id", one) | match("task_id", one)
    out = time_range(logs, start, end, "timestamp" if "timestamp" in logs.columns else "event_ms").filter(wanted)
    if log_names and "log_name" in logs.columns:
        out = out.filter(F.col("log_name").rlike("(" + "|".join(log_names) + ")"))
    return out


def store_scan(
    logs: DataFrame, label: str, values: list[str], now: datetime, days_ago: float = 2, extra: Column | None = None
) -> DataFrame:
    """Rows of the wanted label values of the last days, of the fixed log names, newest first."""
    since = F.lit(now).cast("timestamp") - F.expr(f"make_dt_interval(0, 0, 0, {days_ago * 86400})")
    kind = "DeliveryFleet" if label in DELIVERY_LABELS else "Fleet"
    out = logs.filter(F.col(label).isin(values) & (F.col("timestamp") >= since))
    if "event_date" in logs.columns:  # partition column of a stored log
        out = out.filter(F.col("event_date") >= F.to_date(since))
    if "resource_type" in logs.columns:
        out = out.filter(F.col("resource_type").endswith("/" + kind))
    if "log_name" in logs.columns:
        out = out.filter(F.regexp_extract("log_name", "([a-z_]+)$", 1).isin(STORE_LOG_NAMES) & ~F.col("log_name").endswith("get_trip"))
    if extra is not None:
        out = out.filter(extra)
    return out.orderBy(F.desc("timestamp"))


def modifying_calls(log: DataFrame, start, end, time: str = "event_ms") -> DataFrame:
    """Calls inside the time window that change something."""
    return time_range(log, start, end, time).filter(~F.lower(F.col("api")).startswith("get"))


def limited(log: DataFrame, wanted: int | None, order: list[Column]) -> DataFrame:
    """At most ``wanted`` rows (1,000 when not given, never more than 10,000), in the given order."""
    return log.orderBy(*order).limit(min(wanted or 1000, 10_000))


def has_position(lat: Column, lng: Column) -> Column:
    """Both coordinates are numbers (0 is a valid coordinate)."""
    return lat.try_cast("double").isNotNull() & lng.try_cast("double").isNotNull()


def error_rows(log: DataFrame) -> DataFrame:
    return log.filter(F.col("error").isNotNull())


def task_rows(log: DataFrame) -> DataFrame:
    """Create and update calls of tasks that got a response."""
    return log.filter(F.col("api").isin("createTask", "updateTask") & F.col("response").isNotNull())
