"""The corpus pipeline: documents pass five stages, each over all that its predecessor kept.

Low quality and toxic documents go, one document of each group of near copies stays, secrets are masked, and what is
left is packed into sequences. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane.llm import minhash, packing, quality, secrets, toxicity
from tracklane.llm.vocab import public_file
from tracklane.session import settle, shared_folder

QUALITY_AT_LEAST = 0.3
TOXICITY_BELOW = 0.5


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _scored(docs: DataFrame, module, labels: DataFrame, keep) -> DataFrame:
    """Rows of ``docs`` whose score is to be kept; a column of the score's name is left alone."""
    name = "score_" + uuid.uuid4().hex
    return module.score(docs, module.train(docs, labels), name=name).where(keep(F.col(name))).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of fair quality. Null and empty texts are judged like others."""
    return _scored(docs, quality, _labels(spark, sf_dir), lambda s: s >= QUALITY_AT_LEAST)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    return _scored(docs, toxicity, _labels(spark, sf_dir), lambda s: s < TOXICITY_BELOW)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 80 %): that with the smallest id, null ids last, the
    first row of those that share it. Documents without words are no copies and stay.

    Rows are compared under a number of their own, written with them once, so ids may be repeated or null."""
    row = "row_" + uuid.uuid4().hex
    numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = minhash.near_copies(numbered, id=row).select(row, "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    first = groups.join(numbered.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(order).alias("first"))
    kept = first.select(F.col("first")[row].alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by a mark; ``n_chars`` follows the text where it did before."""
    name, base, found = (f"{n}_{uuid.uuid4().hex}" for n in ("masked", "base", "found"))
    masked = secrets.scan(docs, base=base, found=found).withColumn(name, secrets.redact(F.col("text"), F.col(found)))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col(name).alias("text"))
        elif c == "n_chars":
            changed = F.char_length(name).cast(docs.schema[c].dataType)
            columns.append(F.when(F.col("n_chars") == F.char_length("text"), changed).otherwise(F.col("n_chars")).alias(c))
        else:
            columns.append(F.col(c))
    return masked.select(*columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of token ids in sequences of at most 2048."""
    return packing.pack(docs, public_file("byte_bpe_50k.json"), added=True)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_copies", near_copies_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

# Trained models and tokenizers are beyond SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
