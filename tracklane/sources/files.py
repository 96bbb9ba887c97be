"""Readers of log datasets: JSON files, ZIP archives, archive exports, wide sheets, method tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.functions.text import api_of
from tracklane.plans.joins import beside
from tracklane.schema import APIS
from tracklane.session import settle
from tracklane.sources import ranges
from tracklane.sources.jsontext import row_spans

ROWS_AT_ONCE = 1000


def _split(texts: DataFrame) -> DataFrame:
    """``(file, pos, row, error)``: the rows of each text, a bounded number at a time, or its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, text in zip(batch["file"], batch["value"]):
                try:
                    spans = row_spans(text)
                except ValueError as e:
                    yield pd.DataFrame({"file": [file], "pos": [None], "row": [None], "error": [str(e)]})
                    continue
                for at in range(0, len(spans), ROWS_AT_ONCE):
                    some = spans[at : at + ROWS_AT_ONCE]
                    yield pd.DataFrame({"file": file, "pos": range(at, at + len(some)), "row": [text[a:b] for a, b in some], "error": None})

    return texts.mapInPandas(run, "file string, pos int, row string, error string")


def scan_dataset_json(spark: SparkSession, path: str, per_line: bool = False, strict: bool = True) -> DataFrame:
    """``(file, pos, row)``: one row per log row of every dataset under ``path``.

    A dataset is a whole file, read by a task per byte range, whatever its size (finding the ranges runs jobs right
    here); or it is a line with ``per_line`` (large stores pack many datasets per file), read in a stream. A text that
    is no dataset raises an error; without ``strict`` it is left out here and listed by :func:`scan_errors`.
    """
    if per_line:
        return _exploded(_lines(spark, path), strict)
    return dataset_rows(ranges.cut(spark, path), strict)


def dataset_rows(found: ranges.Cut, strict: bool = True) -> DataFrame:
    """``(file, pos, row)`` of datasets that were cut; all rows of a text with an error go, or raise it."""
    if strict:
        return _raising(found.rows)
    rows = settle(found.rows)
    bad = rows.filter("error is not null").select("file").distinct()
    return beside(rows.filter("error is null"), bad, ["file"], "left_anti").select("file", "pos", "row")


def scan_errors(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """``(file, error)`` of every text under ``path`` that is no dataset."""
    if per_line:
        return _split(_lines(spark, path)).filter("error is not null").select("file", "error")
    return ranges.cut(spark, path).rows.filter("error is not null").groupBy("file").agg(F.min("error").alias("error"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.input_file_name().alias("file"), "value")


def _raising(rows: DataFrame) -> DataFrame:
    broken = F.raise_error(F.concat(F.lit("Not a dataset: "), F.col("file"), F.lit(": "), F.col("error")))
    return rows.select("file", "pos", F.when(F.col("error").isNotNull(), broken.cast("string")).otherwise(F.col("row")).alias("row"))


def _exploded(texts: DataFrame, strict: bool = True) -> DataFrame:
    rows = _split(texts)
    return _raising(rows) if strict else rows.filter("error is null").select("file", "pos", "row")


def scan_dataset_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log rows stored one per line, for volume (files split across tasks)."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("row"))


def unzip_rows(files: DataFrame) -> DataFrame:
    """Log rows of the first ``.json`` member of each archive in ``(path, content)`` rows."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    member = next((m for m in archive.namelist() if m.endswith(".json")), None)
                    if member is None:
                        raise ValueError(f"No JSON file found in {name}")
                    texts.append(archive.read(member).decode("utf-8"))
            yield pd.DataFrame({"file": batch["path"], "value": texts})

    return _exploded(files.select("path", "content").mapInPandas(unpack, "file string, value string"))


def scan_zip(spark: SparkSession, path: str) -> DataFrame:
    """Log rows of every archive under ``path``, many archives at a time."""
    return unzip_rows(spark.read.format("binaryFile").load(path))


def archive_unpivot(rows: DataFrame, row: str = "row") -> DataFrame:
    """Archive rows keyed by their API name become ``(api, request, response, error, event_time)``."""
    keys = F.json_object_keys(row)
    named = F.filter(keys, lambda k: F.lower(k).rlike("(" + "|".join(a.lower() for a in APIS) + ")"))
    keep = [c for c in rows.columns if c != row]
    # the name is used many times below, so it is a column of its own
    calls = rows.select(*keep, row, F.try_element_at(named, F.lit(1)).alias("_name")).filter("_name is not null")
    part = lambda n: F.call_function("get_json_object", F.col(row), F.concat(F.lit("$['"), F.col("_name"), F.lit(f"'].{n}")))
    return calls.select(
        *keep, api_of(F.col("_name")).alias("api"), part("request").alias("request"), part("response").alias("response"),
        F.coalesce(part("errorResponse"), part("errorresponse")).alias("error"),
        F.coalesce(*[F.get_json_object(row, f"$.{n}") for n in ("serverTime", "servertime", "timestamp")]).alias("event_time"),
    )


def union_method_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """One stream of rows from per-method tables, each tagged with its API."""
    parts = [df.select(F.lit(api).alias("api"), "*") for api, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def method_table(spark: SparkSession, name: str, schema: T.StructType | str) -> DataFrame:
    """A catalog table, or an empty one where the project never wrote it."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


# --- wide sheets --------------------------------------------------------------------------------


def turn_path(path: str) -> str:
    return ".".join(reversed(path.split(".")))


def _nest(cells: dict[str, Column]) -> list[Column]:
    """Struct columns built from dotted paths."""
    tree: dict = {}
    for path, col in cells.items():
        *front, leaf = path.split(".")
        node = tree
        for p in front:
            node = node.setdefault(p, {})
        node[leaf] = col

    def build(node) -> Column:
        return node if isinstance(node, Column) else F.struct(*[build(v).alias(k) for k, v in node.items()])

    return [build(v).alias(k) for k, v in tree.items()]


def sheet_names(spark: SparkSession, folder: str) -> list[str]:
    """Sub-folders of a wide export (one per API type, so a dozen at most)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(path) if s.isDirectory()]
    return sorted(n for n in names if not n.startswith((".", "_")))


def import_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every sheet of a wide export as ``(api, timestamp, row)``, row being nested JSON text.

    Blank cells are absent; cells starting with ``[`` or ``{`` are parsed; numeric text becomes a number.
    Sort by timestamp when reading in order.
    """
    parts = []
    for sheet in sheet_names(spark, folder):
        table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/{sheet}")
        paths = {turn_path(n): F.col(f"`{n}`") for n in table.columns}
        text = F.to_json(F.struct(*_nest({p: _json_cell(c) for p, c in paths.items()})))
        stamp = paths.get("timestamp", F.lit(None).cast("string"))
        parts.append(table.select(F.lit(sheet).alias("api"), stamp.alias("timestamp"), text.alias("row")))
    if not parts:
        raise ValueError("No log data found in the sheets")
    return reduce(lambda a, b: a.unionByName(b), parts)


def _json_cell(c: Column) -> Column:
    """Cell as VARIANT: parsed JSON, number or text; NULL when blank."""
    listed = c.startswith("[") | c.startswith("{")
    number = F.when(c.try_cast("double").isNotNull(), F.try_parse_json(F.trim(c)))
    as_text = F.parse_json(F.to_json(F.array(c)))
    return F.when(c.isNull() | (c == ""), F.lit(None)).otherwise(
        F.coalesce(F.when(listed, F.try_parse_json(c)).otherwise(number), F.variant_get(as_text, "$[0]", "variant"))
    )

