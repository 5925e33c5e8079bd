"""Unions, merges and choices by key: which row wins, in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_later_wins(first: DataFrame, later: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where keys meet, the later table's."""
    return later.unionByName(first.join(later.select(*keys).distinct(), keys, "left_anti"))


def append_first_seen(have: DataFrame, more: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``have`` and the rows of ``more`` that it lacks by key, which come after it: places go on from its last one.

    Of rows of ``more`` with equal keys the first by ``order`` is taken.
    """
    fresh = first_by(more.join(have.select(*keys), keys, "left_anti"), keys, F.col(order))
    last = have.agg(F.coalesce(F.max(order) + 1, F.lit(0)).alias("_last"))
    return have.unionByName(fresh.join(F.broadcast(last)).withColumn(order, F.col(order) + F.col("_last")).drop("_last"))


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; counted up before the shuffle where the planner can (a rank limit)."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def ordered_union(a: Column, b: Column) -> Column:
    """Values of a in order, then those of b that a lacks; nulls count as empty."""
    empty = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    return F.array_distinct(F.concat(empty(a), empty(b)))


def same_days(a: Column, b: Column) -> Column:
    """Whether two lists hold the same days, order and repeats aside."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def merge_priced(rows: DataFrame, key: str, product: str, price: str, place: str) -> DataFrame:
    """(key, product, price): each product once in the order it is first seen, with its first price that is not null."""
    kept = F.min(F.when(F.col(price).isNotNull(), F.struct(place, price)))[price]  # of one place, the least
    return rows.groupBy(key, product).agg(kept.alias(price), F.min(place).alias(place))


def smallest_mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value of each key, the least of those that are equally common."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col(value))).alias(value))


def gap_clusters(rows: DataFrame, keys: list[str], at: str, gap: float, out: str = "cluster") -> DataFrame:
    """Numbers, from 0, the runs of rows whose next place is at most ``gap`` away, in each key."""
    w = Window.partitionBy(*keys).orderBy(at)
    far = (F.col(at) - F.lag(at).over(w) > gap).cast("int")
    return rows.withColumn("_far", F.coalesce(far, F.lit(0))).withColumn(out, F.sum("_far").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_far")


def duplicate_mapping(rows: DataFrame, keys: list[str], row_id: str, *better: Column) -> DataFrame:
    """(row_id, keeper) of rows that share their keys with others: the keeper is the best row, then the least id."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_n", F.count(F.lit(1)).over(w)).filter("_n > 1")
    return ranked.withColumn("keeper", F.first(row_id).over(w.orderBy(*better, F.col(row_id)))).select(row_id, "keeper")


def nearest_of_name(rows: DataFrame, others: DataFrame, name: str, km: Column, most_km: float, row_id: str) -> DataFrame:
    """For each row the closest of the others with its name, within ``most_km``; ``km`` is over both tables' columns."""
    near = rows.join(others, name).withColumn("km", km).filter(F.col("km") <= most_km)
    return first_by(near, [row_id], F.col("km"), F.col("other_id"))
