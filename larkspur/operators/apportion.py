"""Exact percentages by largest remainders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest_remainder(df: DataFrame, count: str, tie: Column, within: list[str] | None = None, out: str = "percent") -> DataFrame:
    """Whole percentages that add up to 100 in each group (0 each if the group's total is 0).

    Shares are rounded down, and what is missing goes to the largest fractions (ties: ``tie``, ascending), integers
    throughout.
    """
    keys = within or []
    whole = Window.partitionBy(*keys)
    down = df.withColumn("_total", F.sum(count).over(whole)).withColumn("_base", F.when(F.col("_total") > 0, F.floor(F.col(count) * 100 / F.col("_total"))).otherwise(0))
    down = down.withColumn("_rest", F.when(F.col("_total") > 0, (F.col(count) * 100) % F.col("_total")).otherwise(0)).withColumn("_missing", F.when(F.col("_total") > 0, 100 - F.sum("_base").over(whole)).otherwise(0))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_rest").desc(), tie))
    return down.withColumn(out, (F.col("_base") + (place <= F.col("_missing")).cast("int")).cast("long")).drop("_total", "_base", "_rest", "_missing")
