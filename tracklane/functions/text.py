"""Text forms of times, durations and distances, enum trimming, and API names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklane.schema import APIS

# Fixed values
METRES_TO_MILES = 0.000621371
METRES_TO_FEET = 3.28084


def api_of(type_text: Column, otherwise: str | None = None) -> Column:
    """First API name contained in the text, ignoring case; NULL (or ``otherwise``) if none is."""
    text = F.lower(type_text)
    found = F.lit(otherwise).cast("string")
    for name in reversed(APIS):
        found = F.when(text.contains(name.lower()), F.lit(name)).otherwise(found)
    return found


def trim_text(value: Column, text: str) -> Column:
    """Remove the first occurrence of ``text``; empty and NULL values stay."""
    at = F.locate(text, value)
    cut = F.concat(F.substring(value, F.lit(1), at - 1), F.substring(value, at + len(text), F.length(value)))
    return F.when(at > 0, cut).otherwise(value)


def trim_each(values: Column, text: str) -> Column:
    return F.transform(values, lambda v: trim_text(v, text))


def renamed(old: Column, new: Column, text: str = "") -> Column:
    """Value of a renamed field: the old name wins where it is filled, with its prefix trimmed."""
    old_value = trim_text(old, text) if text else old
    return F.when(old.isNotNull() & (old.cast("string") != ""), old_value).otherwise(new)


def parse_time(text: Column) -> Column:
    """Timestamp of an ISO text: trimmed, UTC when it has no offset, NULL when invalid."""
    return F.try_to_timestamp(F.when(F.trim(text) != "", F.trim(text)))


def pad_time(text: Column) -> Column:
    """Complete ``<date>T<h[:m[:s]]>`` to three time parts; text without a date and a T stays."""
    pieces = F.split(text, "T")
    parts = F.filter(F.split(F.element_at(pieces, 2), ":"), lambda p: p != "")
    missing = F.greatest(F.lit(3) - F.size(parts), F.lit(0))
    padded = F.concat_ws(":", F.concat(parts, F.array_repeat(F.lit("00"), missing)))
    fits = (F.size(pieces) > 1) & (F.element_at(pieces, 1) != "")
    return F.when(fits, F.concat(F.element_at(pieces, 1), F.lit("T"), padded)).otherwise(text)


def day_time(ts: Column) -> Column:
    return F.date_format(ts, "MM-dd HH:mm:ss")


def day_time_of_text(iso: Column) -> Column:
    return F.concat(F.substring(iso, 6, 5), F.lit(" "), F.substring(iso, 12, 8))


def long_duration(ms: Column) -> Column:
    """``h hours m minutes s seconds`` without zero parts (the blank after a part stays)."""
    s = F.floor(ms / 1000.0)
    hours, minutes, seconds = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise(F.lit(""))
    return F.concat(part(hours, " hours "), part(minutes, " minutes "), part(seconds, " seconds"))


def short_duration(seconds: Column) -> Column:
    """``45s``, ``12m 21s``, ``-12m 21s``."""
    size = F.abs(seconds)
    minutes = F.floor(size / 60)
    rest = F.floor(size - minutes * 60 + 0.5)
    sign = F.when(seconds < 0, "-").otherwise("")
    body = F.concat(rest.cast("string"), F.lit("s"))
    return F.concat(sign, F.when(minutes == 0, body).otherwise(F.concat(minutes.cast("string"), F.lit("m "), body)))


def time_left(ms: Column) -> Column:
    """Remaining time in its largest unit, rounded up."""
    def unit(size_ms: int, name: str) -> Column:
        n = F.ceil(ms / float(size_ms))
        return F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n > 1, "s").otherwise(""))

    seconds = F.ceil(ms / 1000.0)
    return (
        F.when(ms >= 86_400_000, unit(86_400_000, "day"))
        .when(ms >= 3_600_000, unit(3_600_000, "hour"))
        .when(ms >= 60_000, unit(60_000, "minute"))
        .otherwise(F.concat(seconds.cast("string"), F.lit(" second"), F.when(seconds != 1, "s").otherwise("")))
    )


def kilometres(metres: Column) -> Column:
    return F.format_string("%.2f km", metres / 1000.0)


def miles(metres: Column) -> Column:
    return F.format_string("%.2f mi", metres * METRES_TO_MILES)


def distance_metric(metres: Column) -> Column:
    return F.when(metres < 1000, F.format_string("%.0f m", metres)).otherwise(kilometres(metres))


def distance_imperial(metres: Column) -> Column:
    feet = metres * METRES_TO_FEET
    return F.when(feet < 5280, F.format_string("%.0f ft", feet)).otherwise(miles(metres))


def seconds_of(duration: Column) -> Column:
    """Seconds of a duration text such as ``1851.311279s``."""
    return F.regexp_replace(duration, "s$", "").try_cast("double")


def clock_after(base: Column, seconds: Column) -> Column:
    """Clock text of ``base`` plus a number of seconds."""
    return day_time(F.timestamp_millis(F.unix_millis(base) + F.round(seconds * 1000).cast("long")))


def duration_base(request_update: Column, request_raw: Column, row_time: Column) -> Column:
    """Time a duration counts from: the position's update time, its raw time, else the row's time."""
    return F.coalesce(parse_time(request_update), parse_time(request_raw), row_time)
