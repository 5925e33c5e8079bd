"""Vector code compression: a codebook for each part of the vectors, searched by partial distances in integers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .vectors import all_finite, lengths, matrix

#: Components are multiplied by SCALE and floored; PARTS parts of a vector have a codebook of ENTRIES entries each.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Entries whose distances grow side by side before the best complete distance is renewed.
GROUP = 4
#: Integers below this are safe in 64 bits, others are Python's.
SAFE = 1 << 62


def part_bounds(width: int) -> list[int]:
    """Where the parts begin and the last one ends; equal if PARTS divides ``width``, else as equal as can be."""
    return [k * width // PARTS for k in range(PARTS + 1)]


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit where all fit far enough, else Python's integers."""
    if not x.size or np.abs(x).max() < 2.0**40 / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    out = np.empty(x.shape, object)
    out[...] = [[math.floor(Fraction(v) * SCALE) for v in row] for row in x.tolist()]
    return out


def narrow(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as 64-bit integers if squared distances between their rows fit, else as Python's."""
    most = sum(max((abs(int(a.max())), abs(int(a.min())))) if a.size else 0 for a in arrays)
    kind = np.int64 if most * most * max(1, arrays[0].shape[1]) < SAFE else object
    return [a.astype(kind) for a in arrays]


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry (ties to the lower index) and the squared distance, by partial-distance search.

    Dimensions are taken in descending variance of the codebook. Each row starts with the complete distance to the entry
    that is nearest in the first one. Entries then come in groups: their distances grow dimension by dimension, and a
    pair of row and entry is dropped once its sum strictly exceeds the row's best complete distance, so ties survive.
    """
    block, book = narrow(block, book)
    if not block.shape[1]:
        return np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
    variance = len(book) * (book.astype(object) ** 2).sum(0) - book.astype(object).sum(0) ** 2
    order = sorted(range(len(variance)), key=lambda j: -variance[j])
    first = order[0]
    arg = np.abs(block[:, first, None] - book[:, first]).argmin(1)
    best = ((block - book[arg]) ** 2).sum(1)
    for start in range(0, len(book), GROUP):
        entries = book[start : start + GROUP]
        ahead = (block[:, first, None] - entries[:, first]) ** 2
        rows, ks = np.nonzero(ahead <= best[:, None])
        ahead = ahead[rows, ks]
        for j in order[1:]:
            ahead = ahead + (block[rows, j] - entries[ks, j]) ** 2
            alive = ahead <= best[rows]
            rows, ks, ahead = rows[alive], ks[alive], ahead[alive]
        for k in range(len(entries)):
            r, d = rows[ks == k], ahead[ks == k]
            better = (d < best[r]) | ((d == best[r]) & (start + k < arg[r]))
            best[r[better]], arg[r[better]] = d[better], start + k
    return arg, best


def _blocks(column: pa.Array, width: int) -> np.ndarray:
    return integers(matrix(column, np.arange(len(column)), width))


_SUMS = "part int, entry int, rows string, sums array<string>"


def _totals(batches: Iterator[pa.RecordBatch], width: int, books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """For each part and entry, the number and the sums of the rows that are assigned to it in this task."""
    at, rows = part_bounds(width), np.zeros((PARTS, ENTRIES), object)
    sums = [np.zeros(b.shape, object) for b in books]
    for batch in batches:
        whole = _blocks(batch.column(0), width)
        for p in range(PARTS):
            block = whole[:, at[p] : at[p + 1]]
            arg, _ = nearest(block, books[p])
            for k in np.unique(arg):
                chosen = block[arg == k]  # under 2^40 each where they are of 64 bits
                rows[p, k] += len(chosen)
                sums[p][k] += chosen.sum(0).astype(object)
    found = [(p, k, str(rows[p, k]), list(map(str, sums[p][k]))) for p in range(PARTS) for k in range(len(books[p])) if rows[p, k]]
    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())))], ["part", "entry", "rows", "sums"])


def _merged(table: pa.Table) -> pa.Table:
    """One part's entry over all tasks."""
    each = [list(map(int, s)) for s in table["sums"].to_pylist()]
    total = [str(sum(column)) for column in zip(*each, strict=True)]
    rows = str(sum(map(int, table["rows"].to_pylist())))
    return pa.table([pa.array([v], f.type) for v, f in zip((table["part"][0].as_py(), table["entry"][0].as_py(), rows, total), table.schema, strict=True)], table.schema.names)


def least_vectors(kept: DataFrame, n: int) -> list:
    """Rows (vec_id, embedding) of the ``n`` smallest ids, null last; of a repeated id, its least vector."""
    ids = kept.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(n)
    chosen = kept.join(F.broadcast(ids.withColumnRenamed("vec_id", "chosen")), F.col("vec_id").eqNullSafe(F.col("chosen")))
    return chosen.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy(F.col("vec_id").asc_nulls_last()).collect()


def first_books(kept: DataFrame, width: int) -> list[np.ndarray]:
    """The parts of the vectors of the ENTRIES smallest ids."""
    rows = least_vectors(kept, ENTRIES)
    whole, at = integers(np.array([r.embedding for r in rows], np.float64).reshape(len(rows), width)), part_bounds(width)
    return [whole[:, at[p] : at[p + 1]] for p in range(PARTS)]


def train_books(kept: DataFrame, width: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after so many rounds over all vectors.

    Only ENTRIES x width integers go to the tasks and, summed by part and entry, come back; vectors are not shuffled.
    """
    books = first_books(kept, width)
    for _ in range(rounds):
        now = books
        sums = kept.select("embedding").mapInArrow(lambda batches, now=now: _totals(batches, width, now), _SUMS).groupBy("part", "entry").applyInArrow(_merged, _SUMS)
        books = [b.astype(object) for b in books]
        for r in sums.collect():
            books[r.part][r.entry] = [int(s) // int(r.rows) for s in r.sums]
    return books


_CODES = "vec_id long, label int, code string, error long"


def encode(kept: DataFrame, width: int, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error); vectors of another length than ``width`` have neither code nor error."""
    at = part_bounds(width)
    label = kept.schema["label"].dataType.simpleString()

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = np.flatnonzero(lengths(batch.column("embedding")) == width)
            whole = integers(matrix(batch.column("embedding"), fits, width))
            found = [nearest(whole[:, at[p] : at[p + 1]], books[p]) for p in range(PARTS)]
            text, error = [None] * len(batch), [None] * len(batch)
            for row, *index in zip(fits.tolist(), *(arg.tolist() for arg, _ in found), strict=True):
                text[row] = "".join(f"{k:02x}" for k in index)
            for row, *d in zip(fits.tolist(), *(best.tolist() for _, best in found), strict=True):
                total = sum(d)
                error[row] = total if total < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "embedding", "label").mapInArrow(codes, _CODES.replace("label int", f"label {label}"))


def compress(vectors: DataFrame) -> DataFrame:
    """The codes of the vectors, their errors and the errors of their labels, and the codebooks' hash.

    Rows whose vector is null or holds null or non-finite components go. The least id's vector sets the length; vectors
    of another one are kept without code and error. Repeated rows are coded alike; rows of one id and different vectors
    each have their code; null ids come last among the starts, null labels are one label. Fewer than ENTRIES ids make
    smaller codebooks; an empty vector has zeros for a code. An error that a long can't hold is null, as is such a sum.
    Other columns are not read. An empty table gives an empty result.
    """
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").filter(all_finite(F.col("embedding")))
    least = least_vectors(kept, 1)
    width = len(least[0].embedding) if least else 0
    books = train_books(kept.filter(F.size("embedding") == width), width) if least else []
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book.tolist() for x in entry).encode()).hexdigest()
    coded = stored(encode(kept, width, books), "vector-codes") if least else kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    # the sums are few beside the rows; beyond the planner's size for broadcasts it splits a label of many rows
    found = coded.join(stored(sums, "vector-labels"), F.col("label").eqNullSafe(F.col("of")), "left")
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors of embeddings; edge cases as in ``compress``."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The rounds as a chain of common table expressions."""
    nearest_ = """a{k} AS MATERIALIZED (
  SELECT r, part, min(d * 16 + entry) % 16 AS entry, min(d * 16 + entry) // 16 AS d
  FROM (SELECT r, v.part, entry, sum((x - c) * (x - c)) AS d FROM v JOIN b{k} b ON b.part = v.part AND b.pos = v.pos GROUP BY ALL) GROUP BY ALL
)"""
    renewed = """b{n} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (
    SELECT part, entry, pos, (s - ((s % n) + n) % n) // n AS c FROM (SELECT v.part, entry, v.pos, sum(x) AS s, count(*) AS n FROM v JOIN a{k} a ON a.r = v.r AND a.part = v.part GROUP BY ALL)
  ) m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos
)"""
    rounds = ",\n".join(f"{nearest_.format(k=k)},\n{renewed.format(k=k, n=k + 1)}" for k in range(ROUNDS))
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT r, i // (w // 8) AS part, i % (w // 8) AS pos, floor(4096 * x::DOUBLE)::HUGEINT AS x
  FROM (SELECT r, len(embedding) AS w, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM kept)
), b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x AS c FROM v WHERE r <= 16),
{rounds},
{nearest_.format(k=ROUNDS)},
books AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS}),
coded AS (SELECT r, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded ON coded.r = kept.r, books"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
SQL = {"op12_vector_codes": _sql()}
