"""Dense numbering inside a key without sorting a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_by(df: DataFrame, keys: list[str], chunk: Column, order: list, out: str) -> DataFrame:
    """``out`` = 1, 2, ... per ``keys`` in ``order``; ``chunk`` is non-decreasing along it.

    The rank inside ``(keys, chunk)`` plus the number of rows of the key in
    earlier chunks (a running sum over one row per chunk), so a key holding a
    third of all rows is spread over its chunks.
    """
    staged = df.withColumn("_c", chunk)
    counts = staged.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_c").orderBy(*order)
    return (staged.join(counts, [*keys, "_c"])
            .withColumn(out, (F.col("_before") + F.row_number().over(inside)).cast("int"))
            .drop("_c", "_before"))


def number_within(df: DataFrame, key: str, order: str, out: str = "r", chunk: int = 1 << 16) -> DataFrame:
    """``row_number() OVER (PARTITION BY key ORDER BY order)`` for an integral, unique order."""
    return number_by(df, [key], F.floor(F.col(order) / F.lit(chunk)), [order], out)
