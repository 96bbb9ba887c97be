"""The log as a table: standard columns, columns by path, and column categories."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.functions import text


def log_view(log: DataFrame, solution: str = "ODRD") -> DataFrame:
    """Standard display columns of an ODRD or LMFS log; columns the log lacks come out NULL."""
    has = set(log.columns)
    col = lambda c, t="string": F.col(c) if c in has else F.lit(None).cast(t)
    time = F.timestamp_millis(F.col("event_ms"))
    speed = col("speed", "double")
    cols = [
        F.col("event_id"), F.col("vehicle_id"),
        text.day_time(time).alias("day_time"),
        F.regexp_replace("api", "^.*[./]", "").alias("method"),  # a full type name loses its path
        F.when(speed != 0, F.floor(speed * 3.6 + 0.5)).cast("long").alias("kmph"),
        text.trim_text(col("raw_sensor"), "LOCATION_SENSOR_").alias("sensor"),
        text.trim_text(col("sensor"), "_LOCATION_PROVIDER").alias("location"),
    ]
    if solution == "ODRD":
        cols += [
            F.right(F.when(F.size("current_trips") > 0, F.element_at("current_trips", 1)), F.lit(12)).alias("current_trip12")
            if "current_trips" in has else F.right(col("trip_id"), F.lit(12)).alias("current_trip12"),
            text.trim_text(col("vehicle_state"), "VEHICLE_STATE_").alias("vehicle_state"),
            text.trim_text(col("trip_status"), "TRIP_STATUS_").alias("trip_status"),
        ]
    else:
        cols += [
            text.trim_text(col("task_state"), "TASK_STATE_").alias("task_state"),
            col("remaining_tasks", "int").alias("remaining_tasks"),
            col("remaining_distance_m", "double").alias("remaining_distance"),
            col("remaining_segments", "int").alias("remaining_segments"),
        ]
    cols.append(text.trim_text(col("nav_status"), "NAVIGATION_STATUS_").alias("nav_status"))
    return log.select(*cols)


def chronological(log: DataFrame, newest_first: bool = False) -> DataFrame:
    order = [F.col("event_ms"), F.col("event_id")]
    return log.orderBy(*[c.desc() if newest_first else c.asc() for c in order])


def dynamic_column(payload: Column, path: str, kind: str = "string") -> Column:
    """Value at a dotted path of a JSON text payload, NULL when absent."""
    return F.try_variant_get(F.try_parse_json(payload), "$." + path, kind)


def path_column(log: DataFrame, path: str) -> Column:
    """Column at a dotted path of the table; ``.error`` names the row's error."""
    return F.col("error") if path == ".error" else F.col(path)


def numeric_text(value: str | None) -> bool:
    try:
        float(value)
        return True
    except (TypeError, ValueError):
        return False


def time_text(value: str) -> bool:
    try:
        datetime.fromisoformat(value.strip())
        return True
    except ValueError:
        return False


def category_of(name: str, sample: str | None, is_text: bool = True) -> str | None:
    """``timestamp``, ``duration``, ``distance`` or None, from the column's name and a sample."""
    low = name.lower()
    if name == "formattedDate" or low == "daytime" or sample is None:
        return None
    timely = any(w in low for w in ("time", "version", "date"))  # "timestamp" contains "time"
    if is_text and time_text(sample) and (timely or re.match(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d", sample)):
        return "timestamp"
    if numeric_text(sample):
        if any(w in low for w in ("seconds", "duration", "remainingtime")):
            return "duration"
        if any(w in low for w in ("meters", "distance")):
            return "distance"
    return None


def column_category(table: DataFrame, order: list[str]) -> DataFrame:
    """Category of every column from its first known value in ``order``, in one pass over the table.

    The pass returns one row of samples, whatever the table's size.
    """
    names = [c for c in table.columns if c not in order]
    first = [F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"v{i}") for i, c in enumerate(names)]
    row = table.agg(*first).first()
    texts = (T.StringType, T.TimestampType, T.TimestampNTZType)
    out = [(c, category_of(c, row[i], isinstance(table.schema[c].dataType, texts))) for i, c in enumerate(names)]
    return table.sparkSession.createDataFrame(out, "column_name string, category string")


def api_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("api").agg(F.count("*").alias("rows"))


def dataset_span(log: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return log.groupBy(*keys).agg(F.min("event_ms").alias("min_ms"), F.max("event_ms").alias("max_ms"))
