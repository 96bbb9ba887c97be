"""Trips: pick-up and drop-off points, and lookups between vehicles, trips and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklane.functions import geo
from tracklane.operators.dwell import around, cell_columns
from tracklane.plans.history import Track, key_columns, keyed
from tracklane.plans.joins import beside
from tracklane.session import settle

# Fixed values
NEAR_M = 250.0
TOP_TRIP_ROWS = 10
FIRST_TASKS = 20
FINER = 5  # cells of the next level along each edge


def label_ids(label: Column) -> Column:
    """Ids of a comma separated label, blanks dropped."""
    return F.filter(F.transform(F.split(label, ","), lambda t: F.trim(t)), lambda t: t != "")


def distinct_ids(log: DataFrame, ids: Column, name: str, keys: tuple[str, ...] = ("vehicle_id",)) -> DataFrame:
    """Distinct non-empty ids found in an array column, per vehicle."""
    return log.select(*keys, F.explode(ids).alias(name)).filter(F.col(name).isNotNull() & (F.col(name) != "")).distinct()


def segment_task_ids(segments: Column) -> Column:
    """Task ids of nested journey segments, flattened (stops without tasks add none)."""
    ids = lambda s: F.coalesce(s["stop"]["tasks"]["taskId"], F.array())
    return F.flatten(F.transform(segments, ids))


def point_value(point: Column, order: Column, latest: bool) -> Column:
    """Latest (planned points) or earliest (actual points) known value."""
    place = F.when(point.isNotNull(), order)
    return F.max_by(point, place) if latest else F.min_by(point, place)


def pickup_dropoff(trips: DataFrame, order: tuple[str, ...], sides: tuple[str, ...] = ("pickup",), radius: float = geo.EARTH_RADIUS_M) -> DataFrame:
    """Planned (latest known) and actual (earliest known) points of each trip, with their distance."""
    at = F.struct(*order)

    def known(side, latest):
        lat, lng = F.col(f"{side}_lat"), F.col(f"{side}_lng")
        point = F.struct(at.alias("o"), lat.alias("lat"), lng.alias("lng"))
        pick = F.max if latest else F.min
        return pick(F.when(lat.isNotNull() & lng.isNotNull(), point))

    out = trips.groupBy("trip_id").agg(
        *[known(s, True).alias(f"_{s}") for s in sides], *[known(f"actual_{s}", False).alias(f"_actual_{s}") for s in sides]
    )
    cols = [F.col("trip_id")]
    for s in sides:
        plan, real = (F.col(f"_{s}.lat"), F.col(f"_{s}.lng")), (F.col(f"_actual_{s}.lat"), F.col(f"_actual_{s}.lng"))
        cols += [c.alias(n) for c, n in zip((*plan, *real), (f"{s}_lat", f"{s}_lng", f"actual_{s}_lat", f"actual_{s}_lng"))]
        cols.append(geo.distance_m(*plan, *real, radius).alias(f"{s}_delta_m"))
    return out.select(*cols)


def vehicle_trip_logs(vehicle_rows: DataFrame, trip_rows: DataFrame, ids: Column, keep: tuple[str, ...]) -> DataFrame:
    """Create- and update-trip rows of every trip a vehicle's rows name."""
    pairs = distinct_ids(vehicle_rows, ids, "trip_id")
    return pairs.join(trip_rows.select("trip_id", *keep), "trip_id").select("vehicle_id", "trip_id", *keep)


def vehicle_task_logs(
    vehicle_rows: DataFrame, task_rows: DataFrame, segments: Column, keep: tuple[str, ...],
    labelled: DataFrame | None = None, first_only: bool = False, seen: Column | None = None,
) -> DataFrame:
    """Task rows of every task named in a vehicle's journey segments or labelled with the vehicle.

    ``first_only`` keeps the first 20 distinct ids per vehicle, as the log-store form does; ``seen``
    orders the vehicle rows for that.
    """
    if first_only:
        ids = vehicle_rows.select("vehicle_id", seen.alias("_seen"), F.posexplode(segment_task_ids(segments)).alias("_pos", "task_id"))
        ids = ids.filter("task_id is not null and task_id <> ''")
        first = ids.groupBy("vehicle_id", "task_id").agg(F.min(F.struct("_seen", "_pos")).alias("_at"))
        w = Window.partitionBy("vehicle_id").orderBy("_at")
        # a rank bound lets Spark cut each vehicle's ids before the shuffle
        pairs = first.select("*", F.row_number().over(w).alias("_rn")).filter(F.col("_rn") <= FIRST_TASKS).select("vehicle_id", "task_id")
    else:
        pairs = vehicle_rows.select("vehicle_id", F.explode(F.array_distinct(segment_task_ids(segments))).alias("task_id"))
        pairs = pairs.filter(F.col("task_id").isNotNull() & (F.col("task_id") != ""))
        if labelled is not None:
            pairs = pairs.union(labelled.select("vehicle_id", "task_id"))
        pairs = pairs.distinct()
    return pairs.join(task_rows.select("task_id", *keep), "task_id").select("vehicle_id", "task_id", *keep)


def trip_vehicle_logs(trip_rows: DataFrame, vehicle_rows: DataFrame, trips: str, keep: tuple[str, ...]) -> DataFrame:
    """Rows of a trip's vehicles that list the trip as current."""
    pairs = trip_rows.select("trip_id", "vehicle_id").filter("vehicle_id is not null").distinct()
    listed = vehicle_rows.select("vehicle_id", *keep, F.explode(F.array_distinct(trips)).alias("trip_id"))
    return beside(listed, pairs, ["vehicle_id", "trip_id"], "left_semi").select("trip_id", "vehicle_id", *keep)


def delivery_fallback(regular: DataFrame, delivery: DataFrame) -> DataFrame:
    """Regular rows, plus delivery rows of vehicles that have no regular ones."""
    known = regular.select("vehicle_id").distinct()
    return regular.unionByName(beside(delivery, known, ["vehicle_id"], "left_anti"))


def latest_per_trip(trips: DataFrame, order: list[Column], per: tuple[str, ...] = ("trip_id", "api"), n: int = TOP_TRIP_ROWS) -> DataFrame:
    """Newest rows of each trip and call (Spark trims each group before the shuffle)."""
    w = Window.partitionBy(*per).orderBy(*order)
    return trips.select("*", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= n)


def newest(log: DataFrame, order: list[Column], n: int = 5000) -> DataFrame:
    return log.orderBy(*order).limit(n)


def vehicle_log_bundle(vehicle: DataFrame, trips: DataFrame, delivery: DataFrame, tasks: DataFrame) -> DataFrame:
    """All rows about vehicles: own rows, their trips, delivery fall-back, tasks. Order on write or read."""
    own = delivery_fallback(vehicle, delivery)
    return own.unionByName(trips, allowMissingColumns=True).unionByName(tasks, allowMissingColumns=True)


def _cells_down_to(spots: DataFrame, keys: list[str], finest: float, levels: int, radius: float) -> list[DataFrame]:
    """Occupied cells (keys, cx, cy, cz) with a point of each (``rep``), from the coarsest to the finest. Each is ``FINER``
    cells of the next one wide."""
    cell, rep = ["cx", "cy", "cz"], F.min("rep").alias("rep")
    point = F.struct(F.col("_lat").alias("lat"), F.col("_lng").alias("lng")).alias("rep")
    out = [spots.select(*keys, *cell_columns(F.col("_lat"), F.col("_lng"), finest, radius), point).groupBy(*keys, *cell).agg(rep)]
    out[0] = settle(out[0])
    for _ in range(levels):
        up = [F.floor(F.col(c) / FINER).alias(c) for c in cell]
        out.append(out[-1].select(*keys, *up, "rep").groupBy(*keys, *cell).agg(rep))
    return out[::-1]


def near_points(
    probes: DataFrame, log: DataFrame, lat: str, lng: str, track: Track = Track(),
    within_m: float = NEAR_M, radius: float = geo.EARTH_RADIUS_M, levels: int = 4,
) -> DataFrame:
    """Points (key columns, ``probe_lat``, ``probe_lng``, ``distance_m``, ``_row``) among which is the nearest to each probe.

    Equal points keep only their first row. A probe goes down a pyramid of occupied cells, from those of ``within_m``
    around it to the finest: of each it knows a point, so a cell that is farther away than the nearest known point is
    left out. Points are looked at in the few finest cells that remain, so the work grows with probes and with points,
    not with their product, however close together they lie.
    """
    keys, cell = key_columns(track), ["cx", "cy", "cz"]
    first = F.struct(track.time, *track.ties)
    spots = keyed(log, track).filter(F.col(lat).isNotNull() & F.col(lng).isNotNull()).groupBy(
        *keys, F.col(lat).alias("_lat"), F.col(lng).alias("_lng")
    ).agg(F.min(first).alias("_row"))
    spots = settle(spots)  # read for cells and for their points
    finest = within_m / FINER**levels
    pyramid = _cells_down_to(spots, keys, finest, levels, radius)
    probe = [*keys, "probe_lat", "probe_lng"]
    # equal probes of a vehicle share one search
    asked = keyed(probes, track).select(*probe).distinct().select("*", *cell_columns(F.col("probe_lat"), F.col("probe_lng"), within_m, radius))
    kept = around(asked, probe).withColumn("_bound", F.lit(within_m))
    to_rep = geo.distance_m(F.col("probe_lat"), F.col("probe_lng"), F.col("rep.lat"), F.col("rep.lng"), radius)
    flat = F.cos(F.radians("probe_lat"))
    place = dict(zip(cell, (flat * F.cos(F.radians("probe_lng")), flat * F.sin(F.radians("probe_lng")), F.sin(F.radians("probe_lat")))))
    for level in range(levels + 1):
        size = within_m / FINER**level
        cells = pyramid[level]
        if level:  # occupied cells inside those that were kept
            up = [F.floor(F.col(c) / FINER).alias(f"_{c}") for c in cell]
            kept = kept.select(*probe, "_bound", *[F.col(c).alias(f"_{c}") for c in cell])
            found = kept.join(cells.select("*", *up), [*keys, *[f"_{c}" for c in cell]])
        else:
            found = kept.join(cells, [*keys, *cell])
        # No point of the cell is nearer than its cube is, measured straight.
        apart = lambda c: F.greatest(F.lit(0.0), F.col(c) * size - place[c] * radius, place[c] * radius - (F.col(c) + 1) * size)
        found = found.select(*probe, *cell, "_bound", to_rep.alias("_rep"), F.sqrt(sum(apart(c) * apart(c) for c in cell)).alias("_cube"))
        best = F.least(F.min("_rep").over(Window.partitionBy(*probe)), F.col("_bound"))
        found = found.withColumn("_bound", best).filter(F.col("_cube") <= F.col("_bound") + 1e-6).select(*probe, *cell, "_bound")
        kept = found
    metres = geo.distance_m(F.col("probe_lat"), F.col("probe_lng"), F.col("_lat"), F.col("_lng"), radius)
    placed = spots.select("*", *cell_columns(F.col("_lat"), F.col("_lng"), finest, radius))
    return kept.join(placed, [*keys, *cell]).select(*probe, metres.alias("distance_m"), "_row")


def nearest_place(
    probes: DataFrame, log: DataFrame, lat: str, lng: str, track: Track = Track(),
    within_m: float = NEAR_M, radius: float = geo.EARTH_RADIUS_M, levels: int = 4,
) -> DataFrame:
    """Log row of the same vehicle nearest to each probe point, strictly within the radius, first on ties."""
    probe = [*key_columns(track), "probe_lat", "probe_lng"]
    near = near_points(probes, log, lat, lng, track, within_m, radius, levels)
    best = near.filter(F.col("distance_m") < within_m).groupBy(*probe).agg(F.min(F.struct("distance_m", "_row")).alias("_best"))
    return beside(keyed(probes, track), best, probe).select(
        *probes.columns, F.col("_best.distance_m").alias("distance_m"),
        *[F.col(f"_best._row.{t}").alias(f"nearest_{t}") for t in track.ties],
    )
