"""A log store over one table, with the lookups a user starts from: one vehicle or one trip."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.operators.filters import open_interval
from tracklane.operators.trips import label_ids, segment_task_ids
from tracklane.schema import LMFS, ODRD


@dataclass
class LogTable:
    """Rows with label columns ``vehicle_id, delivery_vehicle_id, trip_id, task_id`` (text; ``trip_id`` may
    list several ids), ``timestamp``, ``api``, and optionally ``current_trips`` and ``journey_segments``.

    All lookups are filters and semi-joins on the table: no id lists pass through the driver.
    """

    logs: DataFrame
    start: object | None = None
    end: object | None = None

    def __post_init__(self):
        if self.start is not None:
            self.logs = open_interval(self.logs, self.start, self.end, "timestamp")

    def _named(self, rows: DataFrame, ids: Column, label: str) -> DataFrame:
        return rows.select(F.explode(ids).alias(label)).filter(F.col(label).isNotNull() & (F.col(label) != "")).distinct()

    def _trip_rows(self) -> DataFrame:
        return self.logs.filter(F.col("api").isin("createTrip", "updateTrip"))

    def vehicle_and_trip_logs(self, vehicle_id: str | None = None, trip_id: str | None = None) -> DataFrame:
        """A vehicle's rows and the create and update rows of its trips, or a trip's rows and those of its
        vehicles' rows that list the trip."""
        if vehicle_id:
            own = self.logs.filter(F.col("vehicle_id") == vehicle_id)
            listed = F.col("current_trips") if "current_trips" in own.columns else F.lit(None).cast("array<string>")
            ids = F.array_union(F.coalesce(label_ids(F.col("trip_id")), F.array()), F.coalesce(listed, F.array()))
            named = self._named(own, ids, "trip_id")
            others = self._trip_rows().filter(F.col("vehicle_id").isNull() | (F.col("vehicle_id") != vehicle_id))
            return own.unionByName(others.join(named, "trip_id", "left_semi"))
        trip = F.array_contains(F.coalesce(label_ids(F.col("trip_id")), F.array()), trip_id)
        own = self.logs.filter(trip)
        vehicles = own.select("vehicle_id").filter("vehicle_id is not null").distinct()
        seen = self.logs.filter(~F.coalesce(trip, F.lit(False)) & F.coalesce(F.array_contains("current_trips", trip_id), F.lit(False)))
        return own.unionByName(seen.join(vehicles, "vehicle_id", "left_semi"))

    def delivery_vehicle_logs(self, vehicle_id: str) -> DataFrame:
        """Delivery rows of the vehicle, none if it has regular rows."""
        regular = self.logs.filter(F.col("vehicle_id") == vehicle_id).select(F.col("vehicle_id").alias("delivery_vehicle_id")).distinct()
        return self.logs.filter(F.col("delivery_vehicle_id") == vehicle_id).join(regular, "delivery_vehicle_id", "left_anti").select(*self.logs.columns)

    def task_logs(self, vehicle_id: str) -> DataFrame:
        """Rows of every task named in the vehicle's journeys or labelled with it."""
        own = self.logs.filter(F.col("delivery_vehicle_id") == vehicle_id)
        named = self._named(own, segment_task_ids(F.col("journey_segments")), "task_id")
        labelled = own.filter("api = 'updateTask' and task_id is not null").select("task_id")
        tasks = self.logs.filter(F.col("api").isin("createTask", "updateTask"))
        return tasks.join(named.union(labelled).distinct(), "task_id", "left_semi").select(*self.logs.columns)

    def bundle(self, vehicle_id: str | None = None, trip_id: str | None = None) -> DataFrame:
        """Everything about a vehicle or trip, newest first."""
        rows = self.vehicle_and_trip_logs(vehicle_id, trip_id)
        if vehicle_id:
            tasks = self.task_logs(vehicle_id).filter(F.col("delivery_vehicle_id").isNull() | (F.col("delivery_vehicle_id") != vehicle_id))
            rows = rows.unionByName(self.delivery_vehicle_logs(vehicle_id)).unionByName(tasks)
        return rows.orderBy(F.desc("timestamp"))

    def solution_type(self, vehicle_id: str | None = None, trip_id: str | None = None) -> str:
        return LMFS if self.vehicle_and_trip_logs(vehicle_id, trip_id).isEmpty() else ODRD
