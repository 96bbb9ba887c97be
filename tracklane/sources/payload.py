"""Clean-up of raw JSON payloads: key normalisation, canonical order, empty objects."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean(value):
    """Keys lower-cased without ``_``, NULLs and empty objects dropped, ``{value: x}`` unwrapped."""
    if isinstance(value, list):
        return [clean(v) for v in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for key, item in value.items():
        if isinstance(item, dict) and list(item) == ["value"]:
            item = item["value"]
        if item is None:
            continue
        item = clean(item)
        if isinstance(item, dict) and not item:
            continue
        out[key.replace("_", "").lower()] = item
    return out


def without_empty_objects(value):
    """Empty nested objects and arrays removed; a parent that becomes empty by that stays."""
    if isinstance(value, dict):
        return {k: without_empty_objects(v) for k, v in value.items() if not (isinstance(v, (dict, list)) and not v)}
    if isinstance(value, list):
        return [without_empty_objects(v) for v in value if not (isinstance(v, (dict, list)) and not v)]
    return value


def _load(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return json.loads(f"[{text}]")


def _canonical(text: str | None, change) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(change(_load(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


def _changed(payload: Column, change) -> Column:
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_canonical(t, change) for t in texts], dtype=object)

    return run(payload)


def normalise_payload(payload: Column) -> Column:
    """Normalised JSON text with sorted keys; NULL when the text is not JSON.

    Text that holds several JSON values separated by commas becomes an array.
    """
    return _changed(payload, clean)


def remove_empty(payload: Column) -> Column:
    return _changed(payload, without_empty_objects)


def payload_hash(payload: Column) -> Column:
    """Stable hash of a payload, independent of key order."""
    return F.sha2(normalise_payload(payload), 256)


def wrap_payload(rows: DataFrame, payload: str = "payload", time: str = "timestamp") -> DataFrame:
    """Bare payload rows become ``{json_payload, timestamp}``; full rows stay. Decided per row."""
    full = F.get_json_object(payload, "$.jsonPayload").isNotNull() | F.get_json_object(payload, "$.jsonpayload").isNotNull()
    bare = F.concat(F.lit('{"jsonPayload":'), F.col(payload), F.lit("}"))
    stamp = F.get_json_object(payload, "$.timestamp")
    return rows.select(
        *[c for c in rows.columns if c not in (payload, time)],
        F.when(full, F.col(payload)).otherwise(bare).alias(payload), stamp.alias(time),
    )


def normalise_rows(rows: DataFrame, payload: str) -> DataFrame:
    """The same clean-up as one Arrow pass over partitions, for whole-table ingest jobs."""
    at = rows.columns.index(payload)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b.isetitem(at, [_canonical(t, clean) for t in b[payload]])
            yield b

    return rows.mapInPandas(run, rows.schema)
