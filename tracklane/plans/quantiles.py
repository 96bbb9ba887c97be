"""Exact median and spread per key, without holding a large key's values in one task.

Keys with few values use Spark's exact percentile, which keeps a key's distinct values in memory. Keys
with many are counted in narrow slots instead (each 0.4 % wide, so a few thousand per key at most).
The counts say which slot holds the middle ranks; only the values of that slot are then ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SLOTS_PER_E_FOLD = 256
_LOWEST = -(2**30)
# Values per key that one task may hold
FEW = 200_000


def summary_by_key(df: DataFrame, keys: list[str], value: str, few: int = FEW) -> DataFrame:
    """``keys, pairs, mean, median, lowest, highest, spread`` (population deviation) of a value >= 0.

    ``df`` is read more than once, so it should be a table.
    """
    many = df.groupBy(*keys).agg(F.count(value).alias("_n")).filter(F.col("_n") > few).select(*keys)
    if many.isEmpty():
        return _by_percentile(df, keys, value)
    return _by_percentile(df.join(many, keys, "left_anti"), keys, value).unionByName(
        _by_slots(df.join(many, keys, "left_semi"), keys, value)
    )


def _by_percentile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.avg(v).alias("mean"), F.median(v).alias("median"),
        F.min(v).alias("lowest"), F.max(v).alias("highest"), F.stddev_pop(v).alias("spread"),
    )


def _by_slots(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col("_v")
    slot = F.when(v > 0, F.floor(F.ln(v) * _SLOTS_PER_E_FOLD)).otherwise(F.lit(_LOWEST)).cast("long")
    values = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(v.isNotNull())
    values = values.select("*", slot.alias("_slot"))

    slots = values.groupBy(*keys, "_slot").agg(
        F.count("*").alias("_n"),
        F.avg("_v").alias("_a"),
        F.var_pop("_v").alias("_var"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
    )
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = slots.select(
        "*",
        F.sum("_n").over(upto).alias("_cum"),
        F.sum("_n").over(whole).alias("pairs"),
        (F.sum(F.col("_n") * F.col("_a")).over(whole) / F.sum("_n").over(whole)).alias("mean"),
        F.min("_lo").over(whole).alias("lowest"),
        F.max("_hi").over(whole).alias("highest"),
    )
    gap = F.col("_a") - F.col("mean")
    slots = slots.select(
        "*",
        F.sqrt(F.sum(F.col("_n") * (F.col("_var") + gap * gap)).over(whole) / F.col("pairs")).alias("spread"),
        F.expr("(pairs + 1) div 2").alias("_r1"),
        F.expr("(pairs + 2) div 2").alias("_r2"),
        (F.col("_cum") - F.col("_n")).alias("_below"),
    )
    middle = slots.filter((F.col("_below") < F.col("_r2")) & (F.col("_cum") >= F.col("_r1"))).select(
        *keys, "_slot", "_below", "_r1", "_r2", "pairs", "mean", "lowest", "highest", "spread"
    )
    facts = ["_below", "_r1", "_r2", "pairs", "mean", "lowest", "highest", "spread"]
    counted = values.groupBy(*keys, "_slot", "_v").agg(F.count("*").alias("_c"))
    ranked = counted.join(middle, [*keys, "_slot"]).select(
        *keys,
        *facts,
        "_v",
        "_c",
        (
            F.col("_below")
            + F.sum("_c").over(
                Window.partitionBy(*keys, "_slot").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
            )
        ).alias("_to"),
    )
    # a value fills the ranks (_to - _c, _to]; the median is the mean of ranks _r1 and _r2
    holds1 = (F.col("_to") - F.col("_c") < F.col("_r1")) & (F.col("_to") >= F.col("_r1"))
    holds2 = (F.col("_to") - F.col("_c") < F.col("_r2")) & (F.col("_to") >= F.col("_r2"))
    return ranked.filter(holds1 | holds2).groupBy(*keys).agg(
        F.first("pairs").alias("pairs"),
        F.first("mean").alias("mean"),
        ((F.max(F.when(holds1, F.col("_v"))) + F.max(F.when(holds2, F.col("_v")))) / 2).alias("median"),
        F.first("lowest").alias("lowest"),
        F.first("highest").alias("highest"),
        F.first("spread").alias("spread"),
    )
