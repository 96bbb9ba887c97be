"""Writers and dataset upkeep: JSON and wide exports, copies, pruning, retention, anonymising."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklane.functions.text import api_of, time_left
from tracklane.session import settle
from tracklane.sources.files import turn_path

# Fixed values
KEEP_DAYS = 55
GRACE_HOURS = 1
WARN_DAYS = 10


def export_name(vehicle: str, first_date: str, label: str = "Fleet log") -> str:
    return f"{label} - {vehicle} - {first_date}"


def export_json(log: DataFrame, path: str) -> None:
    """Rows as JSON lines, one file per task."""
    log.write.mode("overwrite").json(path)


def write_log(log: DataFrame, path: str, time: str = "event_time") -> None:
    """The log as a Parquet table partitioned by day; busy days are spread over several tasks and files."""
    dated = log.withColumn("event_date", F.to_date(time)).hint("rebalance", "event_date")
    dated.write.mode("overwrite").partitionBy("event_date").parquet(path)


def flat_columns(schema: T.StructType, prefix: str = "") -> dict[str, Column]:
    """Dotted path to column for every leaf; arrays and maps as JSON text."""
    out: dict[str, Column] = {}
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        col = F.col(".".join(f"`{p}`" for p in path.split(".")))
        if isinstance(f.dataType, T.StructType):
            out.update(flat_columns(f.dataType, path + "."))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.VariantType)):
            out[path] = F.to_json(col)
        else:
            out[path] = col.cast("string")
    return out


def wide(log: DataFrame) -> DataFrame:
    """Leaves as columns named by their reversed path, ``timestamp`` first, then sorted; NULL is empty."""
    flat = flat_columns(log.schema)
    names = sorted(flat, key=lambda n: (n != "timestamp", n))
    return log.select(*[F.coalesce(flat[n], F.lit("")).alias(turn_path(n)) for n in names])


def export_wide(log: DataFrame, folder: str, type_column: str = "@type") -> None:
    """One CSV folder per API type (at most a dozen and ``other``), only the columns its rows fill."""
    typed = log.withColumn("_api", api_of(F.col(f"`{type_column}`"), "other"))
    flat = flat_columns(log.schema)
    filled = typed.groupBy("_api").agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(flat.values())])
    for row in filled.collect():
        names = [n for i, n in enumerate(flat) if row[f"n{i}"]]
        names.sort(key=lambda n: (n != "timestamp", n))
        sheet = typed.filter(F.col("_api") == row["_api"]).select(
            *[F.coalesce(flat[n], F.lit("")).alias(turn_path(n)) for n in names]
        )
        sheet.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(f"{folder}/{row['_api']}")


def copy_filtered(log: DataFrame, dataset_id: str, apis: list[str] | None = None) -> DataFrame:
    """Rows of a copy of the dataset, optionally only of some API types."""
    out = log if apis is None else log.filter(F.col("api").isin(apis))
    return out.withColumn("dataset_id", F.lit(dataset_id))


def prune_time(log: DataFrame, start, end, *times: str) -> DataFrame:
    """Keep rows inside the range by the first known of ``times``."""
    return log.filter(F.coalesce(*[F.col(t) for t in times]).between(start, end))


def prune_report(log: DataFrame, start, end, *times: str) -> DataFrame:
    at = F.coalesce(*[F.col(t) for t in times])
    inside = F.coalesce(at.between(start, end), F.lit(False))
    return log.agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("removed"))


def retention(rows: DataFrame, time: Column, now: datetime, stored: Column | None = None, keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Expiry per dataset: 55 days after the oldest row, an hour from now at least, never before the stored date."""
    at = F.lit(now).cast("timestamp")
    oldest = rows.groupBy(*keys).agg(F.min(time).alias("oldest"), *([F.max(stored).alias("_stored")] if stored is not None else []))
    expires = F.greatest(
        F.col("oldest") + F.expr(f"interval {KEEP_DAYS} days"), at + F.expr(f"interval {GRACE_HOURS} hours"),
        *([F.col("_stored")] if stored is not None else []),
    )
    left = F.unix_millis(F.col("expires")) - F.unix_millis(at)
    return oldest.select(*keys, "oldest", expires.alias("expires")).select(
        "*", left.alias("left_ms"), time_left(left).alias("left_text"),
        (left <= WARN_DAYS * 86_400_000).alias("warn"), (left < 0).alias("expired"),
    )


def anonymise(payload: Column, project: str | Column, vehicle: str | Column, user: str | None = None) -> Column:
    """Project, vehicle and user replaced; task ids lose what follows ``tid_<n>_<n>``; keys and tokens dropped."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.replace(payload, as_col(project), F.lit("sample-project-id"))
    out = F.replace(out, as_col(vehicle), F.lit("sample-vehicle-id"))
    out = F.regexp_replace(out, '(tid_\\d+_\\d+)([^"]+)', "$1sample-task")
    return F.replace(out, F.lit(user), F.lit("user")) if user else out


def drop_secrets(meta: DataFrame) -> DataFrame:
    return meta.drop("APIKEY", "jwt")


class DatasetStore:
    """Datasets as partitions of one Parquet table, addressed by ``dataset_id``.

    The partition of a dataset is named by the hexadecimal form of its id (its hash, for a long one), so any text
    is an id of its own and no id reaches outside the table.
    """

    PART = "_dataset"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def _part(dataset_id: str) -> str:
        name = dataset_id.encode()
        return f"d{name.hex()}" if len(name) <= 100 else f"h{hashlib.sha256(name).hexdigest()}"

    def put(self, dataset_id: str, log: DataFrame) -> None:
        """Replace one dataset, by nothing if ``log`` is empty, and leave the others alone."""
        named = log.drop("dataset_id", self.PART).withColumns({"dataset_id": F.lit(dataset_id), self.PART: F.lit(self._part(dataset_id))})
        stored = settle(named)  # the log may be read from the very partition that is replaced
        if stored.isEmpty():  # an empty frame writes no partition, so the old one would stay
            self.delete(dataset_id)
        else:
            stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.PART).parquet(self.path)

    def get(self, dataset_id: str) -> DataFrame:
        """Rows of one dataset; only its partition is read."""
        return self.spark.read.parquet(self.path).filter(F.col(self.PART) == self._part(dataset_id)).drop(self.PART)

    def copy(self, source: str, target: str, apis: list[str] | None = None) -> None:
        self.put(target, copy_filtered(self.get(source), target, apis))

    def delete(self, dataset_id: str) -> bool:
        """Drop one dataset's partition; false if there is none."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.PART}={self._part(dataset_id)}")
        system = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return system.delete(hadoop, True)
