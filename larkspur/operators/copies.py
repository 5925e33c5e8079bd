"""Near copies by vector: of pictures that look alike the best one stays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored
from .near import earliest, having_earlier, usable
from .sync import numbered

#: Two vectors are near at this distance. Fixed value.
NEAR = 0.35
#: Rows that chance alone should put into one bucket, and the share of pairs at the threshold that may meet in none.
PER_BUCKET, MISSED = 1 / 16, 0.02


def tables_for(n: int, near: float = NEAR) -> tuple[int, int]:
    """(bits of a bucket, tables) for n unit vectors: a pair at the threshold agrees in a bit with 1 - angle / pi."""
    bits = max(4, math.ceil(math.log2(max(1, n) / PER_BUCKET)))
    agree = 1 - 2 * math.asin(min(1.0, near / 2)) / math.pi
    return bits, math.ceil(math.log(MISSED) / math.log(1 - agree**bits))


def buckets(rows: DataFrame, vector: str, bits: int, tables: int) -> DataFrame:
    """Rows with ``buckets``: for each table a number made of it and the sides of ``bits`` random planes."""
    kept = rows.schema

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column(vector)
            width = column.value_lengths().to_numpy(zero_copy_only=False)
            out = np.zeros((len(batch), tables), np.int64)
            for w in np.unique(width):
                if w not in planes:
                    planes[w] = np.random.default_rng(int(w)).normal(size=(w, bits * tables))
                at = np.flatnonzero(width == w)
                x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), w)
                on = (x @ planes[w] > 0).reshape(len(at), tables, bits)
                out[at] = (on * (1 << np.arange(bits))).sum(2) * tables + np.arange(tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * tables), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "buckets"])

    return rows.mapInArrow(sides, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept)}, buckets array<long>")


def best_copies(rows: DataFrame, near: float = NEAR) -> DataFrame:
    """(id, keeper) of rows (id, area, vector): a row's keeper is the first kept one that it is near, itself if it is kept.

    Rows come by falling area, then by id, and are kept if no kept one before them is near. Vectors are of one length or
    several; null ones are kept. Equal vectors are compared once. All others are compared exactly, in blocks.

    In rounds: a row that has no undecided one before it within ``near`` is kept, and rows near it go. So a group of copies
    costs a row each in a round, not all of its pairs, and the first row of all is always settled. Rounds are stored tables.
    """
    order = F.struct("area", (-F.col("id")).alias("id"))
    given = stored(rows.select("id", F.col("area").cast("double").alias("area"), F.col("vector").cast("array<double>").alias("vector")), "copies-rows")
    some = given.filter(F.col("vector").isNotNull())
    # of equal vectors the first stands for all; places in the order are numbers
    firsts = some.groupBy("vector").agg(F.max(order).alias("first")).select((-F.col("first.id")).alias("id"), "first.area", "vector")
    sorted_ = firsts.select("id", "vector", F.col("area").isNull().alias("_none"), (~F.isnan("area")).alias("_number"), (-F.col("area")).alias("_area"))
    placed = stored(numbered(sorted_, ["_none", "_number", "_area", "id"], "place").select("place", "id", "vector"), "copies-firsts")
    every = placed.filter(usable(F.col("vector"))).select(F.col("place").alias("id"), "vector")
    undecided, gone = every, None
    while not undecided.isEmpty():
        blocked = stored(having_earlier(undecided, near), "copies-blocked")
        kept = undecided.join(blocked, "id", "left_anti")
        # rows that went before may be near a kept one that comes earlier than theirs
        rest = undecided.join(blocked, "id", "left_semi")
        asked = rest if gone is None else rest.unionByName(every.join(gone.select("id"), "id", "left_semi"))
        found = earliest(asked, kept, near)
        if gone is not None:
            found = found.unionByName(gone).groupBy("id").agg(F.min("leader").alias("leader"))
        gone = stored(found, "copies-gone")
        undecided = stored(rest.join(gone.select("id"), "id", "left_anti"), "copies-left")
    if gone is None:
        gone = every.select("id", F.col("id").alias("leader"))
    leaders = placed.select(F.col("place").alias("leader"), F.col("id").alias("keeper"))
    named = placed.select(F.col("place").alias("_place"), "id", "vector").join(gone.withColumnRenamed("id", "_place"), "_place", "left")
    named = named.join(leaders, "leader", "left").select("vector", F.coalesce("keeper", "id").alias("keeper"))
    return given.join(named, "vector", "left").select("id", F.coalesce("keeper", "id").alias("keeper"))
