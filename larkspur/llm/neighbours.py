"""Approximate nearest neighbours: a navigable small-world graph for each shard, results of the shards merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hnsw
from .common import stored
from .vectors import all_finite, lengths, matrix

#: Neighbours of a query, and the ids of which it is a multiple.
NEIGHBOURS, EVERY = 20, 20
#: Vector components of a shard and of a block of queries, on average: 8,192 and 4,096 vectors of 64.
SHARD, BLOCK = 1 << 19, 1 << 18


def taking_part(vectors: DataFrame) -> DataFrame:
    """The different rows (vec_id, embedding) with the number of their copies; null, zero and non-finite vectors go."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.filter(all_finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    return kept.groupBy("vec_id", "embedding").agg(F.count("*").alias("copies"))


def _pieces(rows: DataFrame, components: int) -> int:
    """In how many pieces of so many components the rows go."""
    return max(1, -(-(rows.select(F.sum(F.size("embedding").cast("long"))).first()[0] or 0) // components))


_INDEX = "shard int, width int, ids array<long>, firsts array<int>, vectors binary, shrink double, radius double, points binary, layer_rows array<int>, layer_links array<int>, links array<int>"


def _ids_in_order(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The order by ids, null last, and the ids in it."""
    order = pa.compute.sort_indices(column, null_placement="at_end")
    return order.to_numpy(), column.take(order).combine_chunks()


def _graphs(table: pa.Table, k: int) -> pa.Table:
    """The graphs of one shard, one for each length and octave of norms, as a row each.

    The largest inner product is the least distance once each vector gets one more component that makes all norms
    equal. Norms within one octave keep that component from drowning the others. Equal vectors are one node with its
    rows in ascending ids; more than ``k`` + 1 of them can't come into any result.
    """
    order, ids = _ids_in_order(table["vec_id"])
    column = table["embedding"].combine_chunks()
    copies = table["copies"].to_numpy()[order]
    widths = lengths(column)[order]
    shard, out = table["shard"][0].as_py(), []
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        x = matrix(column, order[rows], width)
        largest = np.abs(x).max(1)
        octaves = np.floor(np.log2(largest) + np.log2(np.linalg.norm(x / largest[:, None], axis=1)) + 0.5)
        for octave in np.unique(octaves):
            mine = octaves == octave
            own, node = np.unique(x[mine], axis=0, return_inverse=True)
            times = np.minimum(copies[rows[mine]], k + 1)
            node, at = np.repeat(node.ravel(), times), np.repeat(rows[mine], times)
            by = np.argsort(node, kind="stable")  # ids stay in order within a node
            node, at = node[by], at[by]
            place = np.arange(len(node)) - np.searchsorted(node, node)
            node, at = node[place <= k], at[place <= k]
            shrink = float(np.abs(own).max())
            small = own / shrink
            norms = np.einsum("ij,ij->i", small, small)
            radius = float(np.sqrt(norms.max()))
            graph = hnsw.build(np.concatenate((small, np.sqrt(np.maximum(0, radius * radius - norms))[:, None]), 1))
            firsts = np.append(0, np.cumsum(np.bincount(node, minlength=len(own))))
            out.append((
                shard, int(width), ids.take(pa.array(at)).to_pylist(), firsts, own.tobytes(), shrink, radius, graph.points.tobytes(),
                [len(a) for a in graph.layers], [a.shape[1] for a in graph.layers], np.concatenate([a.ravel() for a in graph.layers]),
            ))
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = [f.split()[0] for f in _INDEX.split(", ")]
    return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)


def build_index(rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The stored graphs of ``taking_part`` rows, dealt to shards of about SHARD components by a hash of id and vector."""
    shards = _pieces(rows, SHARD)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("shard").applyInArrow(lambda table: _graphs(table, k), _INDEX), "neighbours-index")


_BLOCKS = "block int, width int, query_ids array<long>, copies array<long>, vectors binary"


def _block(table: pa.Table) -> pa.Table:
    """One block's queries, a row for each length."""
    column = table["embedding"].combine_chunks()
    widths, out = lengths(column), []
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        ids, copies = (table[c].to_numpy()[rows] for c in ("vec_id", "copies"))
        out.append((table["block"][0].as_py(), int(width), ids, copies, matrix(column, rows, width).tobytes()))
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], [f.split()[0] for f in _BLOCKS.split(", ")])


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, added from left to right: equal vectors give equal products."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


_FOUND = "block int, width int, query int, query_id long, copies long, vec_id long, score double"


def _merge_ready(row: dict, k: int) -> pa.RecordBatch:
    """The best ``k`` rows that one graph has for each query of a block, the query's own row left out."""
    width = row["width"]
    queries = np.frombuffer(row["queries"], np.float64).reshape(-1, width)
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, width)
    firsts, layers, start = np.array(row["firsts"]), [], 0
    links = np.array(row["links"], np.int64)
    for n, m in zip(row["layer_rows"].to_pylist(), row["layer_links"].to_pylist(), strict=True):
        layers.append(links[start : start + n * m].reshape(n, m))
        start += n * m
    graph = hnsw.Graph(np.frombuffer(row["points"], np.float32).reshape(len(vectors), width + 1), layers)
    largest = np.abs(queries).max(1)[:, None]
    unit = queries / largest
    unit *= row["radius"] / np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
    found = hnsw.search(graph, np.concatenate((unit, np.zeros((len(unit), 1))), 1), k + 1)
    q, node = np.nonzero(found >= 0)[0], found[found >= 0]
    score = inner(queries[q], vectors[node])
    rows = firsts[node + 1] - firsts[node]
    at = np.repeat(firsts[node], rows) + np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
    q, node, score = np.repeat(q, rows), np.repeat(node, rows), np.repeat(score, rows)
    ids = row["ids"]
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy()
    asked = np.array(row["query_ids"])
    own = known[at] & (number[at] == asked[q])
    own[own] = (vectors[node[own]] == queries[q[own]]).all(1)
    mine = np.flatnonzero(own)
    stay = np.ones(len(q), bool)
    stay[mine[np.unique(q[mine], return_index=True)[1]]] = False  # of copies of the query's row, one is its own
    q, at, score = q[stay], at[stay], score[stay]
    by = np.lexsort((number[at], ~known[at], -score, q))
    q, at, score = q[by], at[by], score[by]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    q, at, score = q[first], at[first], score[first]
    copies = np.array(row["copies"])
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(q), row["block"], np.int32)), pa.array(np.full(len(q), width, np.int32)), pa.array(q.astype(np.int32)), pa.array(asked[q]), pa.array(copies[q]), ids.take(pa.array(at)), pa.array(score),
    ], ["block", "width", "query", "query_id", "copies", "vec_id", "score"])


def search_index(index: DataFrame, rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows of all shards for each of ``rows``, with copies repeated.

    Queries go to every shard in blocks, and each shard's best ``k`` are merged; a task holds one graph and one block.
    """
    blocks = _pieces(rows, BLOCK)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("embedding", "vec_id"), F.lit(blocks)).cast("int"))
    asked = stored(dealt.groupBy("block").applyInArrow(_block, _BLOCKS), "neighbours-queries").withColumnRenamed("vectors", "queries")
    shards = index.select("shard", "width").distinct()  # a row for each shard and length, without the graphs
    pairs = index.join(asked.join(shards, "width").hint("merge"), ["shard", "width"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                cells = {name: batch.column(name)[i] for name in batch.schema.names}
                yield _merge_ready({name: x.values if isinstance(x, pa.ListScalar) else x.as_py() for name, x in cells.items()}, k)

    found = pairs.mapInArrow(searched, _FOUND)
    best = Window.partitionBy("block", "width", "query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), "copies")), "rank", "vec_id", "score").drop("col")


def nearest_neighbours(vectors: DataFrame, every: int = EVERY, k: int = NEIGHBOURS) -> DataFrame:
    """The ``k`` nearest found for each row whose id is a multiple of ``every``, by inner product, among all other rows.

    Null and zero vectors, and those with null or non-finite components, take no part. Vectors meet those of their
    length. Repeated rows are rows: each has its result, with the other copies in it. A null id is no query, and comes
    after others in ties. Fewer than ``k`` other rows are all given. Other columns are not read. An empty table gives
    an empty result.
    """
    rows = stored(taking_part(vectors), "neighbours-rows")
    return search_index(build_index(rows, k), rows.filter(F.col("vec_id") % every == 0), k)


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th id of embeddings; edge cases as in ``nearest_neighbours``."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op11_nearest_neighbours": op11_nearest_neighbours}
#: The graphs decide which neighbours are found, which SQL can't express.
SQL: dict[str, str] = {}
