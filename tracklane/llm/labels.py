"""Labelled rows for the classifiers: a bounded sample for fitting, the rest held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id: str = "doc_id") -> Column:
    """Rows that no fit sees; ids are taken as text, a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``text``, ``label`` 0 or 1, ``order``) of at most ``rows`` rows that are not held out, half of them of
    each class where there are so many: of the ids that both tables have, those whose hash comes first. Whole texts.

    An id is one row for each of its labels, however often it is repeated; of its texts the one with the smallest
    hash is taken."""
    there = docs.where(F.col(id).isNotNull() & ~held_out(id)).select(id).distinct()
    usable = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id)).select(
        id, F.col(label).cast("int").alias("label"), F.xxhash64(F.col(id)).alias("order")
    ).distinct().join(there, id, "left_semi")
    chosen = None
    for value in (0, 1):
        part = usable.where(F.col("label") == value).orderBy("order", id).limit(rows // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = docs.select(id, F.col(text).alias("text")).join(F.broadcast(chosen), id)
    one = found.groupBy(id, "label", "order").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select("text", "label", "order")
