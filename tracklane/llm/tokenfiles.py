"""Token ids as Parquet list columns, with controlled encodings, row groups and pages.

Files hold documents in ascending order; each row has its ids and the number of ids before it in its part of the
order. Metadata reads (``spans``) touch the count columns only, token reads the row groups and pages that the
page index leaves for the wanted documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklane.llm.bpe import int_lists, small
from tracklane.llm.vocab import library_encoder


@dataclass(frozen=True)
class Layout:
    """``encoding`` of the ids: "dictionary", or "delta" for binary-packed differences."""

    encoding: str = "dictionary"
    row_group_bytes: int = 16 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 1000
    compression: str = "zstd"

    def options(self) -> dict[str, str]:
        if self.encoding not in ("dictionary", "delta"):
            raise ValueError(f"unknown encoding {self.encoding}")
        return {
            "parquet.enable.dictionary": str(self.encoding == "dictionary").lower(),
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows),
            "compression": self.compression,
        }


def write(
    docs: DataFrame, path: str, folder: str, end_id: int = 0, layout: Layout = Layout(), text: str = "text", id: str = "doc_id",
    added: bool = False,
) -> None:
    """Encode ``docs`` and write them to ``folder`` in ascending order of ``id`` (null first, then by text hash).

    A null or empty text is its end id alone; repeated rows are written one by one. The order's hash spreads an
    id that very many rows share. ``added`` tokens of the vocabulary are found in texts, or else taken as ordinary
    text.
    """
    kind = docs.schema[id].dataType.simpleString()
    order = [F.col(id).asc_nulls_first(), F.xxhash64(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = library_encoder(path, added), np.array([end_id], "<u4").tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in small(batch):
                ids = [np.frombuffer(encoder.encode(t) + end, "<i4") for t in rows.column(1).to_pylist()]
                counts = np.array([len(x) for x in ids], np.int64)
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.record_batch(
                    [pa.array(np.full(len(ids), part, np.int32)), rows.column(0), pa.array(starts), pa.array(counts), int_lists(ids)],
                    names=["part", id, "part_start", "n_tokens", "tokens"],
                )

    schema = f"part int, `{id}` {kind}, part_start bigint, n_tokens bigint, tokens array<int>"
    encoded = docs.select(id, text).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)
    encoded.write.options(**layout.options()).parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All columns; filters on the id and on counts are pushed down to row groups and pages."""
    return spark.read.parquet(folder)


def part_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Ids before each part, from the count columns alone; one row per written part."""
    sizes = read(spark, folder).groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = F.sum("size").over(Window.orderBy("part")) - F.col("size")  # one short row per part
    return sizes.select("part", before.alias("ids_before"))


def checksums(spark: SparkSession, folder: str, id: str = "doc_id") -> DataFrame:
    """Per document, read back from the files: ``id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    import zlib

    stored = read(spark, folder).select(id, "part", "part_start", "n_tokens", "tokens")
    kind = stored.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(4)
            values, ends = np.asarray(tokens.values).astype("<u4", copy=False), np.asarray(tokens.offsets)
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.record_batch([*batch.columns[:4], pa.array(sums, pa.int64())], names=[id, "part", "part_start", "n_tokens", "ids_crc32"])

    sums = stored.mapInArrow(run, f"`{id}` {kind}, part int, part_start bigint, n_tokens bigint, ids_crc32 bigint")
    return sums.join(part_starts(spark, folder), "part").select(
        id, (F.col("ids_before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )
