"""Dataset-level ingest: restricted-log overlay, solution type, identity, and the connector protocol."""

from __future__ import annotations

import json
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.schema import LMFS, ODRD, RESTRICTED_ATTRIBUTES
from tracklane.sources.payload import without_empty_objects


def restricted_merge(
    rows: DataFrame, insert_id: str, parent_id: str, log_type: str, order: list[str], fields: list[str]
) -> DataFrame:
    """Overlay restricted rows on the rows they belong to and drop the restricted rows.

    A restricted value replaces the parent's where it is not NULL; the last restricted row wins.
    """
    restricted = F.coalesce(F.col(log_type).contains("Restricted"), F.lit(False))
    over = rows.filter(restricted).groupBy(F.col(parent_id).alias("_parent")).agg(
        F.max(F.struct(*order, *[F.col(f).alias(f"_{f}") for f in fields])).alias("_over")
    )
    # rows without an id have no overlay; a key from their content keeps them from meeting in one task
    spread = F.concat(F.lit("\x00"), F.xxhash64(*order).cast("string"))
    parents = rows.filter(~restricted).withColumn("_id", F.coalesce(F.col(insert_id), spread))
    merged = parents.join(over, F.col("_id") == F.col("_parent"), "left")
    keep = [c for c in rows.columns if c not in fields]
    return merged.select(
        *keep, *[F.coalesce(F.col(f"_over._{f}"), F.col(f)).alias(f) for f in fields], F.col("_parent").isNotNull().alias("merged")
    )


def _overlaid(parent: str, restricted: str) -> str:
    """The parent row with the restricted attributes of each section that both rows have, on the section itself
    and on its vehicle and trip."""
    row, over = json.loads(parent), without_empty_objects(json.loads(restricted).get("jsonPayload") or {})
    body = row.get("jsonPayload") or {}
    for section in ("request", "response"):
        base, given = body.get(section), over.get(section)
        if not isinstance(base, dict) or not isinstance(given, dict):
            continue
        for part in ("", "vehicle", "trip"):
            source = given.get(part) if part else given
            picked = {a: source[a] for a in RESTRICTED_ATTRIBUTES if a in source} if isinstance(source, dict) else {}
            if picked and part:
                base[part] = {**(base.get(part) or {}), **picked}
            elif picked:
                base.update(picked)
    return json.dumps(row, ensure_ascii=False)


def merge_restricted_rows(rows: DataFrame, keys: tuple[str, ...] = ("file",), pos: str = "pos", row: str = "row") -> DataFrame:
    """JSON rows with the restricted rows of their dataset laid over them; restricted rows go.

    Of several restricted rows for one parent the last wins. Rows that none belongs to are not touched.
    """
    field = lambda path: F.get_json_object(row, path)
    restricted = F.coalesce(field("$.jsonPayload['@type']").contains("Restricted"), F.lit(False))
    marked = rows.withColumn("_restricted", restricted)
    over = marked.filter("_restricted").select(*keys, field("$.jsonPayload.parentInsertId").alias("_id"), pos, row).groupBy(*keys, "_id").agg(
        F.max_by(row, pos).alias("_over")
    )
    # rows without an id have no overlay; a key from their place keeps them from meeting in one task
    own = F.coalesce(field("$.insertId"), F.concat(F.lit("\x00"), F.xxhash64(*keys, pos).cast("string")))

    @F.pandas_udf("string")
    def laid(parents: pd.Series, overs: pd.Series) -> pd.Series:
        return pd.Series([p if o is None else _overlaid(p, o) for p, o in zip(parents, overs)], dtype=object)

    found = marked.filter("not _restricted").withColumn("_id", own).join(over, [*keys, "_id"], "left")
    merged = F.when(F.col("_over").isNull(), F.col(row)).otherwise(laid(F.col(row), F.col("_over")))
    return found.select(*[merged.alias(row) if c == row else F.col(c) for c in rows.columns])


def solution_type(rows: DataFrame, log_name: Column, keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """LMFS for datasets with any delivery-vehicle log, else ODRD."""
    delivery = F.coalesce(F.max(log_name.contains("_delivery_vehicle")), F.lit(False))
    return rows.groupBy(*keys).agg(F.when(delivery, LMFS).otherwise(ODRD).alias("solution_type"))


def dataset_identity(rows: DataFrame, vehicle: Column, order: list[str], times: list[Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """First vehicle id, oldest time (first known of several fields per row) and its date."""
    oldest = F.min(F.coalesce(*times))
    first = F.min_by(vehicle, F.when(vehicle.isNotNull() & (vehicle != ""), F.struct(*order)))
    return rows.groupBy(*keys).agg(F.coalesce(first, F.lit("unknown")).alias("first_vehicle"), oldest.alias("oldest")).select(
        "*", F.date_format("oldest", "yyyy-MM-dd").alias("first_date")
    )


def _leaf_paths(text: str | None) -> list[str] | None:
    """Dotted paths to everything in a JSON object that is not an object itself; None for other texts."""
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    found, open_ = [], [("", value)]
    while open_:
        path, node = open_.pop()
        for key, item in node.items():
            if isinstance(item, dict):
                open_.append((f"{path}{key}.", item))
            else:
                found.append(path + key)
    return found


def key_inventory(rows: DataFrame, payload: Column, nested: bool = False) -> DataFrame:
    """Every key of the JSON payloads with its row count, ``timestamp`` first when sorted by ``rank``; with
    ``nested`` the dotted paths of all that is no object."""

    @F.pandas_udf("array<string>")
    def paths(texts: pd.Series) -> pd.Series:
        return texts.map(_leaf_paths, na_action=None)

    keys = rows.select(F.explode(paths(payload) if nested else F.json_object_keys(payload)).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("rows")).select("*", F.when(F.col("key") == "timestamp", 0).otherwise(1).alias("rank"))


def payload_schema(rows: DataFrame, payload: Column) -> DataFrame:
    """One row with the merged type of all payloads."""
    return rows.agg(F.schema_of_variant_agg(F.try_parse_json(payload)).alias("schema"))


class FleetSource(Protocol):
    """What a log store offers; every method returns a lazy DataFrame of log rows."""

    def vehicle_and_trip_logs(self, vehicle_id: str | None, trip_id: str | None) -> DataFrame: ...

    def delivery_vehicle_logs(self, vehicle_id: str) -> DataFrame: ...

    def task_logs(self, vehicle_id: str) -> DataFrame: ...
