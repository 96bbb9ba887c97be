"""Joins of a large table with a reduced one (one row per key), safe for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracklane.session import settle


def beside(big: DataFrame, reduced: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``big`` with the result of an aggregation over its keys.

    Straight after an aggregation Spark would reuse that shuffle, and adaptive execution cannot split a
    hot key of the large side then. Written once, the reduced side has a known size: Spark broadcasts it
    if it is small, and otherwise shuffles both sides in the form that skewed keys are split from.
    """
    return big.join(settle(reduced), keys, how)
