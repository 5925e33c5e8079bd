"""Vectors within a distance of each other, exactly: blocks of vectors meet blocks, and a task holds two of them."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import tasks

#: Components of a block: from LEAST, so that small tables are no crowd of tasks, to MOST, which bounds a task's memory.
LEAST, MOST = 1 << 17, 1 << 22
#: Components of one side times those of the other that are worth a task.
WORK = 1 << 31
#: Rows of the two sides of a piece whose distances are held at once, and rows of a batch that goes out.
HIGH, WIDE, ROWS = 64, 2048, 1 << 16
#: Executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def usable(vector: Column) -> Column:
    """Whether a vector can be near another one: it is there, and all of its components are there and finite."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def blocks_for(components: int, most: int = MOST) -> int:
    return max(1, math.ceil(components / min(most, max(LEAST, components // 8))))


def grid(asked: int, others: int, wanted: int, most: int = MOST) -> tuple[int, int]:
    """Parts of both sides, by their components: of all that are at most ``most`` long and make ``wanted`` tasks, if there is
    work for them, those for which the least is dealt out, as each part of the one side goes to each of the other."""
    least, wanted = max(1, math.ceil(asked / most)), max(1, min(wanted, asked * others // WORK))
    parts = [(p, max(1, math.ceil(others / most), math.ceil(wanted / p))) for p in range(least, least + wanted)]
    return min(parts, key=lambda x: asked * x[1] + others * x[0])


def _sides(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors) of the rows that ask and of the others, for each kind and length; those that ask twice if there are no others."""
    ids, asks = table["id"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
    column = table["vector"].combine_chunks()
    width = column.value_lengths().to_numpy(zero_copy_only=False)
    kind = table["kind"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    by = np.lexsort((asks, width, kind))
    edges = np.flatnonzero(np.diff(kind[by]) | np.diff(width[by])) + 1
    alone = asks.all()
    for rows in np.split(by, edges):
        mine, other = rows[asks[rows]], rows if alone else rows[~asks[rows]]
        if len(mine) and len(other):
            w = width[rows[0]]
            read = lambda at: column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), w)  # noqa: E731, B023
            x = read(mine)
            yield ids[mine], x, ids[other], x if alone else read(other)


def _prepared(x: np.ndarray, other: bool) -> np.ndarray:
    """Rows whose products are minus half of the square of the distance."""
    norm = -np.einsum("ij,ij->i", x, x)[:, None] / 2
    one = np.ones_like(norm)
    return np.concatenate((x, one, norm) if other else (x, norm, one), 1).astype(np.float32)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squares of the distances of rows of x to columns of y, added from left to right in double precision."""
    total, gap = np.zeros((len(x), y.shape[1])), np.empty((len(x), y.shape[1]))
    for c in range(x.shape[1]):
        np.subtract(x[:, c, None], y[c], out=gap)
        np.multiply(gap, gap, out=gap)
        total += gap
    return total


def near(x: np.ndarray, y: np.ndarray, most: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, distances) of the pairs at most ``most`` apart, piece by piece.

    Products in single precision leave out only what is farther by more than their error; the rest is measured in double.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        small, large = _prepared(x, False), _prepared(y, True)
        error = 4 * (x.shape[1] + 4) * 2.0**-23 * (np.abs(small[:, -2]).max() + np.abs(large[:, -1]).max())
    least = -most * most / 2 - error
    for b in range(0, len(y), WIDE):
        columns = np.ascontiguousarray(y[b : b + WIDE].T)
        for a in range(0, len(x), 16 * HIGH):
            with np.errstate(over="ignore", invalid="ignore"):
                # what overflows is no number and stays
                maybe = ~(small[a : a + 16 * HIGH] @ large[b : b + WIDE].T < least)
            met = np.count_nonzero(maybe)
            if not met:
                continue
            if met * 16 < maybe.size:
                i, j = np.nonzero(maybe)
                d = np.zeros(len(i))
                for c in range(x.shape[1]):
                    d += (x[a + i, c] - columns[c, j]) ** 2
                d = np.sqrt(d)
                close = d <= most
                yield a + i[close], b + j[close], d[close]
                continue
            for r in range(a, min(a + 16 * HIGH, len(x)), HIGH):
                d = np.sqrt(squares(x[r : r + HIGH], columns))
                # runs of one row of y with the same few of x, which Parquet keeps in few bytes
                j, i = np.nonzero((d <= most).T)
                yield r + i, b + j, d[i, j]


def _batches(parts: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns of any length as batches of about ROWS rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)


def dealt(asked: DataFrame, others: DataFrame, most: int = MOST) -> DataFrame:
    """Rows (id, vector, kind) of both with ``asks`` and ``task``: each block of asked ones meets each block of the others."""
    spark = asked.sparkSession
    long = lambda rows: rows.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0]
    parts, wide = grid(long(asked), long(others), 4 * spark.sparkContext.defaultParallelism, most)
    place = lambda n: F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    columns = ["id", "vector", "kind"]
    mine = asked.select(*columns, F.lit(True).alias("asks"), place(parts).alias("_part"), every(wide).alias("_other"))
    rest = others.select(*columns, F.lit(False).alias("asks"), every(parts).alias("_part"), place(wide).alias("_other"))
    both = mine.unionByName(rest).withColumn("task", F.col("_part") * wide + F.col("_other")).drop("_part", "_other")
    return both.repartition(max(tasks(spark), 4 * parts * wide), "task")  # so that few of them meet in one partition


def pairs_within(asked: DataFrame, others: DataFrame, most: float, block: int = MOST) -> DataFrame:
    """(id, other_id, distance): rows (id, vector, kind) of ``asked`` with all of ``others`` of their kind and length within ``most``.

    Null kinds meet none. Vectors that are not ``usable`` meet none. A row of both sides meets itself. Pairs go out as they are
    found, so a task holds two blocks, however many pairs they have; work grows with the product of both sides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if table["asks"].to_numpy(zero_copy_only=False).all():
            return
        found = ([ids[i], other[j], d] for ids, x, other, y in _sides(table) for i, j, d in near(x, y, most))
        yield from _batches(found, ["id", "other_id", "distance"])

    fit = lambda rows: rows.filter(F.col("kind").isNotNull() & F.col("id").isNotNull() & usable(F.col("vector")))
    return dealt(fit(asked), fit(others), block).groupBy("task").applyInArrow(run, "id long, other_id long, distance double")


def having_earlier(rows: DataFrame, most: float) -> DataFrame:
    """(id) of the rows (id, vector) within ``most`` of a row of a smaller id. Each pair of blocks meets once."""
    n = blocks_for(rows.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0])
    own, other = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = rows.select("id", "vector", F.lit(0).alias("kind"), own.alias("_own"), other.alias("_other"))
    task = F.least("_own", "_other").cast("long") * n + F.greatest("_own", "_other")
    spread = spread.select("id", "vector", "kind", (F.col("_own") <= F.col("_other")).alias("asks"), task.alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, other, y in _sides(pa.Table.from_batches(batches)):
            later, late = np.zeros(len(ids), bool), np.zeros(len(other), bool)
            for i, j, _ in near(x, y, most):
                later[i[ids[i] > other[j]]] = True
                late[j[ids[i] < other[j]]] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.union1d(ids[later], other[late]))], ["id"])

    return spread.groupBy("task").applyInArrow(run, "id long").distinct()


def earliest(asked: DataFrame, others: DataFrame, most: float) -> DataFrame:
    """(id, leader): for rows (id, vector) of ``asked`` the smallest smaller id of ``others`` within ``most``; none without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if table["asks"].to_numpy(zero_copy_only=False).all():
            return
        for ids, x, other, y in _sides(table):
            least = ids.copy()
            for i, j, _ in near(x, y, most):
                np.minimum.at(least, i, other[j])
            some = least < ids
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(least[some])], ["id", "leader"])

    both = [rows.select("id", "vector", F.lit(0).alias("kind")) for rows in (asked, others)]
    return dealt(*both).groupBy("task").applyInArrow(run, "id long, leader long").groupBy("id").agg(F.min("leader").alias("leader"))
