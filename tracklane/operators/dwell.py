"""Dwell places: leader clustering of fixes, in time order, per vehicle.

A fix joins the first-created cluster whose leader is within the radius, else it leads a new one. So the leaders are
the first maximal independent set, in time order, of the graph of close fixes: a fix leads if no earlier one that
is close leads.

* Identical coordinates collapse to one candidate (a repeat can never lead).
* A candidate earlier than all others in its cell and those around leads for certain, whatever the others are. What
  is close to it is covered and goes, by aggregates and joins alone: a parked vehicle's fixes leave in parallel.
* What is left is decided in tiles of many cells, each in time order in a stream. A candidate whose earlier
  neighbours are all decided is decided; one that hangs on an undecided candidate of another tile waits. Only
  tiles with waiting candidates go on; the earliest one is decided every time.
* Every coordinate then joins its earliest leader through a grid of cells, and counts are summed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.functions import geo
from tracklane.plans.history import Track, key_columns, keyed
from tracklane.session import settle

# Fixed values
DWELL_RADIUS_M = 20.0
DWELL_MIN_UPDATES = 12
DWELL_WEIGHT = 3

TILE_CELLS = 64


def cell_columns(lat: Column, lng: Column, size_m: float, radius: float = geo.EARTH_RADIUS_M) -> list[Column]:
    """Cube of edge ``size_m`` that holds the point on the sphere (no seams at poles or date line)."""
    scale = radius / size_m
    flat = F.cos(F.radians(lat)) * scale
    return [
        F.floor(flat * F.cos(F.radians(lng))).alias("cx"),
        F.floor(flat * F.sin(F.radians(lng))).alias("cy"),
        F.floor(F.sin(F.radians(lat)) * scale).alias("cz"),
    ]


def around(df: DataFrame, keep: list[str]) -> DataFrame:
    """Repeat rows into their own cell and the 26 cells around it."""
    shift = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    out = df.select(*keep, F.explode(F.transform(shift, lambda i: i + F.col("cx"))).alias("cx"), "cy", "cz")
    out = out.select(*keep, "cx", F.explode(F.transform(shift, lambda i: i + F.col("cy"))).alias("cy"), "cz")
    return out.select(*keep, "cx", "cy", F.explode(F.transform(shift, lambda i: i + F.col("cz"))).alias("cz"))


def shuffled(df: DataFrame) -> DataFrame:
    """A side that grows with the table and is not to be broadcast: Spark takes it for as small as its Parquet files, which
    hold repeated keys in a few bytes, and repeated rows (:func:`around`) for no more than it began with."""
    return df.hint("merge")


WAITING, LEADER, FOREIGN = 0, 1, 2


def _decided(batches: Iterator[pd.DataFrame], group: list[str], metres: float, radius: float) -> Iterator[pd.DataFrame]:
    """Candidates of sorted partitions that lead (``state`` LEADER) or still wait; covered ones go. Held of the current
    group are its leaders and what waits.

    Rows given as LEADER are known ones, FOREIGN rows wait in another tile: both count, but are not given out."""
    leaders: dict[tuple, list] = {}
    waiting: dict[tuple, list] = {}
    current = None
    reach = 2 * math.sin(metres / (2 * radius))  # chord length of the radius on the unit sphere

    def near(held: dict[tuple, list], cell: tuple, p: list[float]) -> bool:
        x, y, z = cell
        return any(
            math.dist(p, q) <= reach
            for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)
            for q in held.get((x + dx, y + dy, z + dz), ())
        )

    for batch in batches:
        lat, lng = np.radians(batch["lat"].to_numpy()), np.radians(batch["lng"].to_numpy())
        points = np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], axis=1)
        cells = list(map(tuple, np.floor(points * (radius / metres)).astype(np.int64).tolist()))
        given, out = batch["state"].tolist(), np.full(len(batch), -1)
        names = list(zip(*[batch[g].tolist() for g in group]))
        for i, (name, cell, p) in enumerate(zip(names, cells, points.tolist())):
            if name != current:
                leaders, waiting, current = {}, {}, name
            if given[i] == LEADER:
                leaders.setdefault(cell, []).append(p)
            elif given[i] == FOREIGN:
                waiting.setdefault(cell, []).append(p)
            elif not near(leaders, cell, p):
                out[i] = WAITING if near(waiting, cell, p) else LEADER
                (leaders if out[i] else waiting).setdefault(cell, []).append(p)
        kept = batch[out >= 0]
        yield kept.assign(state=out[out >= 0].astype(np.int32))


def _certain(candidates: DataFrame, keys: list[str], order: list[str], metres: float, radius: float) -> tuple[DataFrame, DataFrame]:
    """Candidates that are the first of their cell and of those around it, and the others that are not close to one."""
    cell = ["cx", "cy", "cz"]
    place = F.struct(*order, "lat", "lng").alias("place")
    placed = candidates.select("*", *cell_columns(F.col("lat"), F.col("lng"), metres, radius))
    firsts = settle(placed.groupBy(*keys, *cell).agg(F.min(place).alias("place")))
    best = around(firsts, [*keys, "place"]).groupBy(*keys, *cell).agg(F.min("place").alias("best"))
    lead = settle(firsts.join(shuffled(best), [*keys, *cell]).filter("place = best").select(*keys, *cell, "place"))
    close = shuffled(around(lead, [*keys, "place"])).join(placed.withColumnsRenamed({"lat": "_lat", "lng": "_lng"}), [*keys, *cell])
    met = close.filter(geo.distance_m(F.col("place.lat"), F.col("place.lng"), F.col("_lat"), F.col("_lng"), radius) <= metres + 1e-6)
    covered = met.select(*keys, *[F.col(c) for c in order]).distinct()  # leaders too; distance to themselves is nothing
    rest = settle(candidates.join(shuffled(covered), [*keys, *order], "left_anti"))
    return lead.select(*keys, *[F.col(f"place.{c}").alias(c) for c in (*order, "lat", "lng")]), rest


def _find_leaders(candidates: DataFrame, track: Track, metres: float, radius: float, tile_cells: int = TILE_CELLS) -> DataFrame:
    """Leaders among ``candidates`` (keys, time, ties, lat, lng)."""
    keys, order = key_columns(track), [track.time, *track.ties]
    columns = [*keys, *order, "lat", "lng"]
    leaders, left = _certain(candidates.select(*columns), keys, order, metres, radius)
    found, tile = [leaders], ["tx", "ty", "tz"]
    cell = cell_columns(F.col("lat"), F.col("lng"), metres, radius)
    tiles = [F.expr(f"floor(c{a} / {tile_cells})").alias(f"t{a}") for a in "xyz"]
    while not left.isEmpty():
        waiting = left.select(*columns, *cell).select("*", *tiles)
        # A tile hears of leaders and of waiting candidates up to a cell outside of it.
        wanted = shuffled(waiting.select(*keys, *tile).distinct())
        told = lambda df, state: around(df.select(*columns, *cell), columns).select(*columns, *tiles).distinct().withColumn("state", F.lit(state))
        known = told(reduce(DataFrame.unionByName, found), LEADER).join(wanted, [*keys, *tile], "left_semi")
        foreign = told(left, FOREIGN).join(shuffled(waiting.select(*keys, *order, *tile)), [*keys, *order, *tile], "left_anti").join(wanted, [*keys, *tile], "left_semi")
        rows = waiting.select(*columns, *tile, F.lit(WAITING).alias("state")).unionByName(known).unionByName(foreign)
        group = [*keys, *tile]
        ordered = rows.repartition(*group).sortWithinPartitions(*group, *order)
        decided = settle(ordered.mapInPandas(lambda it: _decided(it, group, metres, radius), rows.schema))
        found.append(decided.filter(F.col("state") == LEADER).select(*columns))
        left = decided.filter(F.col("state") == WAITING).select(*columns)
    return reduce(DataFrame.unionByName, found)


def dwell_locations(
    log: DataFrame, track: Track = Track(), start_ms: int | None = None, end_ms: int | None = None,
    metres: float = DWELL_RADIUS_M, min_updates: int = DWELL_MIN_UPDATES, radius: float = geo.EARTH_RADIUS_M,
    tile_cells: int = TILE_CELLS,
) -> DataFrame:
    """Clusters with at least ``min_updates`` fixes: leader point, start, end, duration, updates, weight."""
    keys = key_columns(track)
    fixes = log.filter(F.col("raw_lat").isNotNull() & F.col("raw_lng").isNotNull())
    if start_ms is not None:
        fixes = fixes.filter(F.col(track.time).between(start_ms, end_ms))
    spots = settle(
        keyed(fixes, track).groupBy(*track.keys, *keys, F.col("raw_lat").alias("lat"), F.col("raw_lng").alias("lng")).agg(
            F.count("*").alias("updates"), F.max(track.time).alias("_end"), F.min(F.struct(track.time, *track.ties)).alias("_at")
        )
    )
    candidates = spots.select(*keys, "lat", "lng", *[F.col(f"_at.{c}").alias(c) for c in (track.time, *track.ties)])
    leaders = _find_leaders(candidates, track, metres, radius, tile_cells)
    cell = cell_columns(F.col("lat"), F.col("lng"), metres, radius)
    mark = F.struct(track.time, *track.ties, F.col("lat").alias("lead_lat"), F.col("lng").alias("lead_lng")).alias("_lead")
    lead_cells = around(leaders.select(*keys, mark, *cell), [*keys, "_lead"])
    near = spots.select("*", *cell).join(shuffled(lead_cells), [*keys, "cx", "cy", "cz"])
    close = geo.distance_m(F.col("_lead.lead_lat"), F.col("_lead.lead_lng"), F.col("lat"), F.col("lng"), radius) <= metres + 1e-6  # a micrometre, so no fix falls between two roundings
    joined = near.filter(close).groupBy(*track.keys, "lat", "lng", "updates", "_end").agg(F.min("_lead").alias("_lead"))
    out = joined.groupBy(*track.keys, "_lead").agg(F.sum("updates").alias("updates"), F.max("_end").alias("end_ms"))
    return out.filter(F.col("updates") >= min_updates).select(
        *track.keys, F.col("_lead.lead_lat").alias("lat"), F.col("_lead.lead_lng").alias("lng"),
        F.col(f"_lead.{track.time}").alias("start_ms"), "end_ms",
        (F.col("end_ms") - F.col(f"_lead.{track.time}")).alias("duration_ms"),
        "updates", (F.col("updates") * DWELL_WEIGHT).alias("weight"),
    )
