"""Text forms of times, durations and distances; API names and enums."""

import pytest
from pyspark.sql import functions as F

from tracklane.functions import text
from tracklane.operators.view import category_of


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize("seconds,want", [(45, "45s"), (741, "12m 21s"), (60, "1m 0s"), (-741, "-12m 21s")])
def test_short_duration(spark, seconds, want):
    assert one(spark, text.short_duration(F.lit(seconds))) == want


@pytest.mark.parametrize("ms,want", [(0, ""), (61_000, "1 minutes 1 seconds"), (3_600_000, "1 hours "), (7_384_999, "2 hours 3 minutes 4 seconds")])
def test_long_duration(spark, ms, want):
    assert one(spark, text.long_duration(F.lit(ms))) == want


@pytest.mark.parametrize("ms,want", [(90_000_000, "2 days"), (86_400_000, "1 day"), (5_400_000, "2 hours"), (60_000, "1 minute"), (1_000, "1 second"), (0, "0 seconds")])
def test_time_left(spark, ms, want):
    assert one(spark, text.time_left(F.lit(ms))) == want


@pytest.mark.parametrize("m,metric,imperial", [(500.0, "500 m", "1640 ft"), (2500.0, "2.50 km", "1.55 mi"), (15420.0, "15.42 km", "9.58 mi")])
def test_distance(spark, m, metric, imperial):
    assert one(spark, text.distance_metric(F.lit(m))) == metric
    assert one(spark, text.distance_imperial(F.lit(m))) == imperial
    assert one(spark, text.kilometres(F.lit(15420.0))) == "15.42 km" and one(spark, text.miles(F.lit(15420.0))) == "9.58 mi"


@pytest.mark.parametrize("given,want", [
    ("2024-04-30T06:50:35.123456789Z", "04-30 06:50:35"), (" 2024-01-05T03:04:09 ", "01-05 03:04:09"),
    ("2024-01-05T03:04:09+02:00", "01-05 01:04:09"), ("nonsense", None), ("", None),
])
def test_parse_and_show_time(spark, given, want):
    assert one(spark, text.day_time(text.parse_time(F.lit(given)))) == want


def test_eta_clock(spark):
    base = text.parse_time(F.lit("2024-04-30T06:33:40Z"))
    assert one(spark, text.clock_after(base, F.lit(741))) == "04-30 06:46:01"
    assert one(spark, text.clock_after(base, text.seconds_of(F.lit("741.0s")))) == "04-30 06:46:01"


def test_duration_base_order(spark):
    none = F.lit(None).cast("string")
    row = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    assert one(spark, text.day_time(text.duration_base(F.lit("2024-01-02T00:00:00Z"), F.lit("2024-01-03T00:00:00Z"), row))) == "01-02 00:00:00"
    assert one(spark, text.day_time(text.duration_base(none, F.lit("2024-01-03T00:00:00Z"), row))) == "01-03 00:00:00"
    assert one(spark, text.day_time(text.duration_base(none, F.lit("bad"), row))) == "01-01 00:00:00"


@pytest.mark.parametrize("given,want", [("2024-01-01T", "2024-01-01T00:00:00"), ("2024-01-01T05", "2024-01-01T05:00:00"), ("2024-01-01", "2024-01-01"), ("T05", "T05")])
def test_pad_time(spark, given, want):
    assert one(spark, text.pad_time(F.lit(given))) == want


def test_api_names(spark):
    assert one(spark, text.api_of(F.lit("type/UPDATEDeliveryVehicleLog"))) == "updateDeliveryVehicle"
    assert one(spark, text.api_of(F.lit("type/CreateTaskLog"))) == "createTask"
    assert one(spark, text.api_of(F.lit("listVehicles"))) is None
    assert one(spark, text.api_of(F.lit("listVehicles"), "other")) == "other"


def test_trim_first_occurrence_only(spark):
    assert one(spark, text.trim_text(F.lit("A_TRIP_TRIP"), "_TRIP")) == "A_TRIP"
    assert one(spark, text.trim_text(F.lit("NEW"), "TRIP_STATUS_")) == "NEW"
    assert one(spark, text.renamed(F.lit("VEHICLE_STATE_ONLINE"), F.lit("old"), "VEHICLE_STATE_")) == "ONLINE"
    assert one(spark, text.renamed(F.lit(""), F.lit("kept"), "X")) == "kept"


@pytest.mark.parametrize("name,sample,want", [
    ("response.createtime", "2024-01-01T00:00:00Z", "timestamp"), ("formattedDate", "2024-01-01T00:00:00Z", None),
    ("seen", "2024-01-01T00:00:00Z", "timestamp"), ("version", "not a time", None), ("remainingseconds", "741", "duration"),
    ("remainingdistancemeters", "15", "distance"), ("state", "ON", None), ("x", None, None),
])
def test_category(name, sample, want):
    assert category_of(name, sample) == want
