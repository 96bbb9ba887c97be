"""Position layers: one classified row per located log row, and their registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.functions import geo
from tracklane.schema import LMFS, NAV_STATUS_WEIGHT, ODRD, SENSORS

# Fixed values
HEADING_MARK_M = 20.0
SAME_PLACE_DEG = 1e-5


def located(log: DataFrame, lat: str = "resp_lat", lng: str = "resp_lng", raw_lat: str | None = None, raw_lng: str | None = None) -> DataFrame:
    """Rows with a response position (else raw position), as ``lat``/``lng``."""
    own = F.col(lat).isNotNull() & F.col(lng).isNotNull()  # a point comes whole from one of the two
    a = F.when(own, F.col(lat)).otherwise(F.col(raw_lat)) if raw_lat else F.col(lat)
    o = F.when(own, F.col(lng)).otherwise(F.col(raw_lng)) if raw_lng else F.col(lng)
    kept = [c for c in log.columns if c not in ("lat", "lng")]
    return log.select(*kept, a.cast("double").alias("lat"), o.cast("double").alias("lng")).filter("lat is not null and lng is not null")


def layer(log: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a custom layer function to the located rows; a log with carried response points is placed by them."""
    carried = {"filled_resp_lat", "filled_resp_lng"} <= set(log.columns)
    return (located(log, "filled_resp_lat", "filled_resp_lng") if carried else located(log)).transform(make)


def gps_accuracy(rows: DataFrame) -> DataFrame:
    """Sensor class and accuracy radius where the radius is known and not zero."""
    kind = F.when(F.col("sensor").isin(SENSORS), F.col("sensor")).otherwise("OTHER")
    return rows.filter("accuracy is not null and accuracy <> 0").select("*", kind.alias("sensor_class"))


def clock_skew(rows: DataFrame, client: str = "client_ms", server: str = "server_ms") -> DataFrame:
    """Device clock against the response's server time."""
    both = rows.filter(F.col(client).isNotNull() & F.col(server).isNotNull())
    gap = F.abs(F.col(client) - F.col(server)) / 1000.0
    return both.select("*", gap.alias("delta_seconds"), (F.col(client) > F.col(server)).alias("client_ahead"))


def heading_vectors(rows: DataFrame, metres: float = HEADING_MARK_M) -> DataFrame:
    """A short line along the heading of rows that know heading and its accuracy."""
    known = rows.filter("heading is not null and heading_accuracy is not null")
    lat, lng = geo.destination(F.col("lat"), F.col("lng"), metres, F.col("heading"))
    return known.select("*", lat.alias("to_lat"), lng.alias("to_lng"))


def speed_points(rows: DataFrame, speed: str = "resp_speed") -> DataFrame:
    """Sign and size of the response's speed."""
    known = rows.filter(F.col(speed).isNotNull())
    return known.select("*", F.when(F.col(speed) < 0, "negative").otherwise("positive").alias("speed_sign"), F.abs(speed).alias("magnitude"))


def nav_status_points(rows: DataFrame) -> DataFrame:
    weights = F.create_map(*[F.lit(x) for kv in NAV_STATUS_WEIGHT.items() for x in kv])
    known = F.col("nav_status").isin(list(NAV_STATUS_WEIGHT))
    return rows.filter("nav_status is not null").select(
        "*", F.when(known, F.col("nav_status")).otherwise("OTHER").alias("nav_class"),
        F.coalesce(weights[F.col("nav_status")], F.lit(5)).alias("weight"),
    )


def same_place(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Raw and fused position agree to about a metre."""
    known = lat1.isNotNull() & lng1.isNotNull() & lat2.isNotNull() & lng2.isNotNull()
    return known & (F.abs(lat1 - lat2) < SAME_PLACE_DEG) & (F.abs(lng1 - lng2) < SAME_PLACE_DEG)


EDGES = ("north", "south", "east", "west")


def geo_bounds(log: DataFrame, lat: str, lng: str, keys: tuple[str, ...] = (), paths: DataFrame | None = None) -> DataFrame:
    """North, south, east and west edge of the points; NULL where there are none.

    ``paths`` holds points (``keys``, ``lat``, ``lng``) whose bounds stand in where the log has no point.
    """
    a, o = F.when(F.col(lng).isNotNull(), F.col(lat)), F.when(F.col(lat).isNotNull(), F.col(lng))
    own = log.groupBy(*keys).agg(F.max(a).alias("north"), F.min(a).alias("south"), F.max(o).alias("east"), F.min(o).alias("west"))
    if paths is None:
        return own
    other = geo_bounds(paths, "lat", "lng", keys).withColumnsRenamed({e: f"_{e}" for e in EDGES})
    both = own.join(other, list(keys), "full") if keys else own.withColumn("_one", F.lit(1)).join(other.withColumn("_one", F.lit(1)), "_one", "full")
    return both.select(*keys, *[F.when(F.col("north").isNotNull(), F.col(e)).otherwise(F.col(f"_{e}")).alias(e) for e in EDGES])


@dataclass(frozen=True)
class Layer:
    """A named layer: its function, the log columns it adds to the table view, where it applies.

    ``whole_log`` functions take the log itself, the others its located rows.
    """

    make: Callable[[DataFrame], DataFrame]
    columns: tuple[str, ...] = ()
    solutions: tuple[str, ...] = (ODRD, LMFS)
    whole_log: bool = False


@dataclass
class LayerRegistry:
    layers: dict[str, Layer] = field(default_factory=dict)

    def add(self, name: str, item: Layer) -> None:
        self.layers[name] = item

    def names(self, solution: str) -> list[str]:
        return [n for n, item in self.layers.items() if solution in item.solutions]

    def run(self, name: str, log: DataFrame) -> DataFrame:
        item = self.layers[name]
        return item.make(log) if item.whole_log else layer(log, item.make)


def default_layers() -> LayerRegistry:
    """The layers every log has. Planned paths and tasks need their own columns, so callers add them."""
    from tracklane.operators import detect, dwell, segments

    reg = LayerRegistry()
    reg.add("gps_accuracy", Layer(gps_accuracy, ("sensor", "accuracy")))
    reg.add("heading", Layer(heading_vectors, ("heading", "heading_accuracy")))
    reg.add("speed", Layer(speed_points))
    reg.add("trip_status", Layer(lambda log: segments.status_asof(located(log), log), (), (ODRD,), True))
    reg.add("nav_status", Layer(nav_status_points))
    reg.add("dwell_locations", Layer(dwell.dwell_locations, whole_log=True))
    reg.add("velocity_jumps", Layer(detect.velocity_jumps, whole_log=True))
    reg.add("missing_updates", Layer(detect.missing_updates, ("gap_ms",), whole_log=True))
    reg.add("clock_skew", Layer(clock_skew))
    reg.add("eta_deltas", Layer(detect.eta_deltas, ("eta_ms",), (ODRD,), True))
    return reg
