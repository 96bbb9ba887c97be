"""Named queries over the benchmark tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.plans.history import Track
from tracklane.views import read_view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Times in the fleet view are compressed a thousandfold, so ten minutes there are a week of log.
TRACK = Track(slot=600_000)


def query(name: str, *views: str, sql: str | None = None):
    """Register a query; ``sql`` is run over the named views."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return add


def r3(column: str | Column, name: str | None = None, digits: int = 3) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits).alias(name or column)


def fleet(spark: SparkSession, sf: str) -> DataFrame:
    return read_view(spark, sf, "fleet_log")


def fleet_trips(spark: SparkSession, sf: str) -> DataFrame:
    """Fleet rows with their trip list; rows without a trip have none."""
    return fleet(spark, sf).withColumn("current_trips", F.when(F.col("trip_id").isNotNull(), F.array("trip_id")))
