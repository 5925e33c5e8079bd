"""Incremental synchronisation as next states: keyed upserts, orphans, watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored


def watermark(runs: DataFrame, by: str = "started_at") -> Column | None:
    """The last finished run's start, None without one: everything is read then. Rows that change during a run are read
    again by the next one, not lost."""
    last = runs.filter("finished_at is not null").agg(F.max(by)).first()[0]
    return None if last is None else F.lit(last)


def changed_since(rows: DataFrame, updated: str, mark: Column | None) -> DataFrame:
    return rows if mark is None else rows.filter(F.col(updated) > mark)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], surrogate: str, keep_if_null: tuple[str, ...] = (), set_if_empty: tuple[str, ...] = ()) -> DataFrame:
    """The next state of ``current``: rows that match on ``keys`` (null equals null) take the incoming values and keep
    their surrogate id; new rows get ids after the largest one, in the order of their keys; columns in ``keep_if_null``
    are never emptied, those in ``set_if_empty`` only take a value where they have none (null or blank).

    Ids of new rows are row numbers within ranges of keys plus the sizes of the ranges before, so no task numbers all.
    """
    values = [c for c in current.columns if c not in (*keys, surrogate)]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"i.{k}"))
    joined = current.withColumn("_c", F.lit(1)).alias("c").join(incoming.withColumn("_i", F.lit(1)).alias("i"), same, "full_outer")

    def pick(c: str) -> Column:
        new, old = F.col(f"i.{c}"), F.col(f"c.{c}")
        if c in set_if_empty:
            return F.when(F.trim(old.cast("string")) == "", new).otherwise(F.coalesce(old, new)).alias(c)
        return (F.coalesce(new, old) if c in keep_if_null else F.when(F.col("i._i") == 1, new).otherwise(old)).alias(c)

    merged = joined.select(F.col(f"c.{surrogate}").alias(surrogate), *[F.when(F.col("c._c") == 1, F.col(f"c.{k}")).otherwise(F.col(f"i.{k}")).alias(k) for k in keys], *[pick(c) for c in values])
    fresh = merged.filter(F.col(surrogate).isNull())
    top = current.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("top"))
    ranked = numbered(fresh.drop(surrogate), keys, surrogate).join(F.broadcast(top)).withColumn(surrogate, F.col(surrogate) + F.col("top")).drop("top")
    return merged.filter(F.col(surrogate).isNotNull()).unionByName(ranked)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers rows from 1 in order: ranges are sorted apart, and each starts after the rows of those before.

    The ranges are stored, so that counting and numbering see the same ones even if an executor is lost in between.
    """
    ranged = stored(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_p", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return ranged.withColumn("_r", within).join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn(name, (F.col("_r") + F.col("_b")).cast("long")).drop("_p", "_q", "_b", "_r")


def prune_orphans(published: DataFrame, active: DataFrame, key: str, source: str = "creation_source") -> DataFrame:
    """Rows that users made always stay; scraped ones stay while their source key is active."""
    mine = published.filter(~F.col(source).eqNullSafe("scraper"))
    return mine.unionByName(published.filter((F.col(source) == "scraper") & F.col(key).isNotNull()).join(active.select(key).distinct(), key, "left_semi").select(*published.columns))


def replace_children(children: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children of parents that come in are replaced, others stay."""
    return children.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def insert_new(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"))


def in_season(start: Column, end: Column, today: Column) -> Column:
    """Not before its start and not after its end, both inclusive; null ends are open."""
    return (start.isNull() | (start <= today)) & (end.isNull() | (end >= today))


def prune_childless(parents: DataFrame, children: DataFrame, key: str, live: Column) -> DataFrame:
    """Parents that are live or have a child."""
    return parents.filter(F.coalesce(live, F.lit(False))).unionByName(parents.filter(~F.coalesce(live, F.lit(False))).join(children.select(key).distinct(), key, "left_semi").select(*parents.columns))


def touched(parents: DataFrame, children: DataFrame, key: str, updated: str = "last_update") -> DataFrame:
    """Parents whose time of change is that of their newest child if that is later."""
    newest = children.groupBy(key).agg(F.max(updated).alias("_u"))
    return parents.join(newest, key, "left").withColumn(updated, F.greatest(updated, "_u")).drop("_u").select(*parents.columns)


def valid_schedule(day: Column, start: Column, end: Column) -> Column:
    """Days 1 to 7, starts within the day, ends up to the end of the next one."""
    return F.coalesce(day.between(1, 7) & start.between(0, 1439) & end.between(1, 2880), F.lit(False))
