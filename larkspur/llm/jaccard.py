"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesarr import column_bytes, mix, row_chunks, words
from .common import id_text, stored
from .components import components

#: Words of a shingle; a shorter text with words is one shingle.
SHINGLE = 5
#: The threshold as a fraction.
THRESHOLD = (4, 5)
#: MinHash values; they are compared so many at a time, and make bands of ROWS values each. A pair at 0.8 shares a
#: band with probability 1 - (1 - 0.8^5)^25 = 0.99995.
HASHES, STEP, ROWS = 128, 16, 5
BANDS = HASHES // ROWS
#: A pair is dropped once the posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-7
#: Sketches of one part of a band's bucket in a task.
PART = 2048
#: Texts of one piece of a class, and their bytes; a longer text is a piece of its own.
PIECE_ROWS, PIECE_BYTES = 2048, 2 << 20
#: Pairs that are compared at once.
PAIRS = 1 << 17

_RNG = np.random.default_rng(7)
_MULTIPLY = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_PLACE = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row, and how many each row has."""
    buf, offsets = column_bytes(column)
    hashes, rows, per_row = words(buf, offsets)
    last = len(hashes) - SHINGLE + 1
    if last > 0:
        h = sum((hashes[k : last + k] * _PLACE[k] for k in range(SHINGLE)), np.zeros(last, np.uint64))
        whole = rows[:last] == rows[SHINGLE - 1 :]
        h, at = mix(h[whole]), rows[:last][whole]
    else:
        h, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((per_row > 0) & (per_row < SHINGLE))
    if len(few):
        start = np.cumsum(per_row) - per_row
        one = np.array([mix(np.array([(hashes[start[r] : start[r] + per_row[r]] * _PLACE[: per_row[r]]).sum(dtype=np.uint64) + np.uint64(per_row[r])]))[0] for r in few], np.uint64)
        h, at = np.append(h, one), np.append(at, few)
    by = np.lexsort((h, at))
    h, at = h[by], at[by]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    return h[fresh], np.bincount(at[fresh], minlength=len(per_row))


def signatures(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MinHash values (rows x HASHES, uint32) of the non-empty rows."""
    full = sizes[sizes > 0]
    out = np.empty((len(full), HASHES), np.uint32)
    if len(full):
        start = np.cumsum(full) - full
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(((h * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), start)
    return out


SKETCH = "key long, name long, n_bytes long, bands array<long>, sig binary"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("t")
        offsets = column_bytes(column)[1]
        for first, last in row_chunks(offsets):
            h, sizes = shingle_sets(column[first:last])
            full = sizes > 0
            sig = signatures(h, sizes)
            start = (np.cumsum(sizes) - sizes)[full]
            name = np.zeros(len(sizes), np.int64)
            if full.any():
                name[full] = mix(np.add.reduceat(mix(h ^ np.uint64(0x5BD1E995)), start) + sizes[full].astype(np.uint64)).view(np.int64)
            bands = np.empty((len(sig), BANDS), np.uint64)
            for b in range(BANDS):
                key = np.full(len(sig), b, np.uint64)
                for k in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + k])
                bands[:, b] = key
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(full * BANDS)), pa.int32()), pa.array(bands.ravel().view(np.int64)))
            sigs = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(full * (4 * HASHES))).astype(np.int32)), pa.py_buffer(sig.tobytes())])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id")[first:last], batch.column("key")[first:last], pa.array(name, mask=~full), pa.array(np.diff(offsets[first : last + 1])), lists, sigs,
            ], ["doc_id", "key", "name", "n_bytes", "bands", "sig"])


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures from a column of them."""
    return column_bytes(column)[0].view(np.uint32).reshape(-1, HASHES)


def least_matches() -> list[int]:
    """By steps of STEP values: the fewest equal ones with which a pair stays.

    With a uniform prior, P(J >= t | m of n equal) is the chance that a binomial of n + 1 trials at t gives m or fewer.
    """
    t, out = THRESHOLD[0] / THRESHOLD[1], []
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 2):
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= TOLERANCE:
                break
        out.append(m)
    return out


_LEAST = least_matches()


def survivors(one: np.ndarray, two: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The places of the pairs (one[left[k]], two[right[k]]) that stay: values are compared STEP at a time, and after each
    step pairs go whose chance of reaching the threshold is below TOLERANCE."""
    kept = []
    for first in range(0, len(left), PAIRS):
        at = np.arange(first, min(first + PAIRS, len(left)))
        equal = np.zeros(len(at), np.int64)
        for step, least in enumerate(_LEAST):
            part = slice(step * STEP, (step + 1) * STEP)
            equal += (one[left[at], part] == two[right[at], part]).sum(1)
            stay = equal >= least
            at, equal = at[stay], equal[stay]
        kept.append(at)
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _linked(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (left[k], right[k]) whose sets reach the threshold."""
    stay = survivors(sig, sig, left, right)
    left, right = left[stay], right[stay]
    if not len(left):
        return left, right
    sizes = np.array([len(s) for s in sets])
    if len(left) > 4 * len(sets):
        # many pairs: shared shingles of all of them at once, some columns of the incidence matrix at a time
        every, which = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        both = np.zeros((len(sets), len(sets)), np.float32)
        by = np.argsort(which, kind="stable")
        which, owner = which[by], owner[by]
        width = max(256, (1 << 22) // len(sets))
        for first in range(0, len(every), width):
            a, b = np.searchsorted(which, (first, first + width))
            grid = np.zeros((len(sets), min(width, len(every) - first)), np.float32)
            grid[owner[a:b], which[a:b] - first] = 1
            both += grid @ grid.T
        shared = both[left, right].astype(np.int64)
    else:
        shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)])
    reach = shared * THRESHOLD[1] >= (sizes[left] + sizes[right] - shared) * THRESHOLD[0]
    return left[reach], right[reach]


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, left, root[right])
        np.minimum.at(low, right, root[left])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _cuts(*keys: np.ndarray) -> Iterator[np.ndarray]:
    """The places of the rows of each group of equal keys."""
    by = np.lexsort(keys)
    if len(by):
        sorted_ = np.stack([k[by] for k in keys])
        yield from np.split(by, np.flatnonzero((sorted_[:, 1:] != sorted_[:, :-1]).any(0)) + 1)


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each text stays with the least one of a bucket."""
    for batch in batches:
        one, two = _matrix(batch.column("sig")), _matrix(batch.column("least_sig"))
        same = np.arange(batch.num_rows)
        stays = np.zeros(batch.num_rows, bool)
        stays[survivors(one, two, same, same)] = True
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("least"), pa.array(stays)], ["name", "least", "stays"])


def _across(table: pa.Table) -> pa.Table:
    """In each block of a bucket: texts that were dropped against the least one, with all others. Gives edges (a, b) that
    connect what stays, no more than there are texts."""
    name, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("name", "asks"))
    sig = _matrix(table.column("sig"))
    found = []
    for members in _cuts(*(table.column(c).to_numpy() for c in ("band", "part", "other"))):
        ask, rest = members[asks[members]], members[~asks[members]]
        for k in range(0, len(ask), max(1, PAIRS // max(1, len(rest)))):
            some = ask[k : k + max(1, PAIRS // max(1, len(rest)))]
            left, right = np.repeat(some, len(rest)), np.tile(rest, len(some))
            stay = survivors(sig, sig, left, right)
            left, right = left[stay], right[stay]
            texts, at = np.unique(name[np.concatenate([left, right])], return_inverse=True)
            found.append(np.stack([texts, texts[_roots(len(texts), at[: len(left)], at[len(left) :])]]))
    a, b = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    return pa.table({"a": a[a != b], "b": b[a != b]})


def _compare(table: pa.Table) -> pa.Table:
    """Verified links of one task: (a, b, links); b is the least text linked to a here, directly or not."""
    group, one, two, piece = (table.column(c).to_numpy() for c in ("label", "one", "two", "piece"))
    name, copies = table.column("name").to_numpy(), table.column("copies").to_numpy()
    column = table.column("t").combine_chunks()
    h, sizes = shingle_sets(column)
    sets = np.split(h, np.cumsum(sizes)[:-1])
    sig = signatures(h, sizes)
    links, root = np.zeros(len(name), np.int64), np.arange(len(name))
    for members in _cuts(two, one, group):
        members = members[np.unique(name[members], return_index=True)[1]]  # repeated rows bring a text twice
        a, b = np.triu_indices(len(members), 1)
        if one[members[0]] != two[members[0]]:
            across = piece[members][a] != piece[members][b]
            a, b = a[across], b[across]
        a, b = _linked(sig[members], [sets[k] for k in members], a, b)
        np.add.at(links, members[a], copies[members[b]])
        np.add.at(links, members[b], copies[members[a]])
        root[members] = members[_roots(len(members), a, b)]
    some = links > 0
    return pa.table({"a": name[some], "b": name[root[some]], "links": links[some]})


def candidate_edges(sets: DataFrame) -> DataFrame:
    """(a, b): edges that connect all texts of (name, bands, sig) that share a band and stay under Bayesian pruning.

    Every text of a band's bucket is compared with the bucket's least one. Only texts that this drops are compared with
    the bucket's others, in blocks of PART sketches; what comes out of a block is a forest over its texts, not its pairs.
    """
    banded = sets.select("name", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("least")).filter("n > 1")
    buckets = stored(banded.join(shared.hint("merge"), "band").filter("name <> least").select("band", "name", "least", "n"), "jaccard-buckets")
    star = buckets.select("name", "least").distinct().join(sets.select("name", "sig").hint("merge"), "name")
    least = sets.select(F.col("name").alias("least"), F.col("sig").alias("least_sig"))
    judged = stored(star.join(least.hint("merge"), "least").mapInArrow(_pruned, "name long, least long, stays boolean"), "jaccard-stars")
    # buckets of three and more in which the least text has dropped others
    wide = buckets.filter("n > 2").join(judged.hint("merge"), ["name", "least"])
    mixed = wide.groupBy("band").agg(F.count_if(~F.col("stays")).alias("asking"), F.count(F.lit(1)).alias("members")).filter("asking > 0")
    wide = wide.select("band", "name", "stays").join(mixed.hint("merge"), "band").join(sets.select("name", "sig").hint("merge"), "name")
    parts, others = (F.ceil(F.col(c) / PART).cast("int") for c in ("asking", "members"))
    place = lambda n: F.pmod(F.xxhash64("name"), n).cast("int")
    rest = wide.select("band", "name", "sig", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), place(others).alias("other"))
    asks = wide.filter(~F.col("stays")).select("band", "name", "sig", F.lit(True).alias("asks"), place(parts).alias("part"), F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    blocks = stored(rest.unionByName(asks), "jaccard-blocks")
    tasks = max(1, math.ceil(blocks.count() / PART))
    dealt = blocks.withColumn("task", F.pmod(F.xxhash64("band", "part", "other"), F.lit(tasks)).cast("int"))
    return judged.filter("stays").select(F.col("name").alias("a"), F.col("least").alias("b")).unionByName(dealt.groupBy("task").applyInArrow(_across, "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, class_id, n_links, class_docs, keeper of each document.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles (words of anything but ASCII
    white space) is 0.8 or more. class_id is the least id among the documents that links connect; n_links counts the
    other documents linked directly. keeper marks the document with the least id of each class (ties, as repeated rows:
    the least hash of id and text). Documents with one set count as copies and are compared once.

    Texts that share a MinHash band are candidates; their values are compared step by step with Bayesian pruning, and
    what stays connects texts to groups. All pairs of a group go through the pruning again and the rest is verified on
    whole sets. Groups of many texts are compared in pairs of pieces, each in a task of its own; only counts and the
    pieces' own components leave a task. A group of m different texts that are all near copies needs m^2 / 2 comparisons,
    as each text's links are counted; they stay inside tasks, but each text goes to m / PIECE_ROWS of them.

    A text that is null or without words is in no link and a class of its own; so is, with a null class_id, a document
    without id. Long texts are taken whole; a task holds a few pieces, and one longer text needs about 30 bytes for each
    of its words. Repeated rows are copies of each other. Other columns are ignored; an empty table gives an empty
    result.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(id_text(F.col(doc_id)), F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("t"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    sketched = stored(slim.mapInArrow(_sketches, f"doc_id {kind}, {SKETCH}"), "jaccard-sketches")
    first = [F.first(c).alias(c) for c in ("n_bytes", "bands", "sig")]
    sets = stored(sketched.filter("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("key"), *first), "jaccard-sets")
    groups = components(candidate_edges(sets))
    member = groups.join(sets.drop("bands", "sig").hint("merge"), groups["node"] == sets["name"]).drop("node")
    sizes = member.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PIECE_ROWS), F.ceil(F.sum("n_bytes") / PIECE_BYTES)).cast("int").alias("pieces"))
    member = member.join(sizes.hint("merge"), "label").withColumn("piece", F.pmod(F.xxhash64("name"), F.col("pieces")).cast("int"))
    member = stored(member, "jaccard-members")
    load = member.agg(F.coalesce(F.sum(F.greatest(F.col("n_bytes"), F.lit(PIECE_BYTES // PIECE_ROWS)) * F.col("pieces")), F.lit(0))).first()[0]
    tasks = max(1, math.ceil(load / PIECE_BYTES))
    texts = slim.select("key", "t").join(member.hint("merge"), "key")  # texts are dealt by key at every size
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    dealt = texts.select("label", "name", "copies", "t", "piece", other.alias("other")).select("label", "name", "copies", "t", "piece", F.least("piece", "other").alias("one"), F.greatest("piece", "other").alias("two"))
    found = stored(dealt.withColumn("task", F.pmod(F.xxhash64("label", "one", "two"), F.lit(tasks)).cast("int")).groupBy("task").applyInArrow(_compare, "a long, b long, links long"), "jaccard-links")
    classes = components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("name")).agg(F.sum("links").alias("links"))
    known = sets.select("name", "copies").join(links.hint("merge"), "name", "left").join(classes.withColumnRenamed("node", "name").hint("merge"), "name", "left").select("name", F.coalesce("label", "name").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    placed = sketched.drop("bands", "sig", "n_bytes").join(stored(known, "jaccard-classes"), "name", "left")
    named = stored(placed.filter("class is not null").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"), F.count(F.lit(1)).alias("class_docs")), "jaccard-names")
    return placed.join(named, "class", "left").select(
        "doc_id", "key", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_docs", F.lit(1)).cast("long").alias("class_docs"), (F.col("class").isNull() | (F.col("key") == F.col("best.key"))).alias("keeper"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")


SQL: dict[str, str] = {}  # too slow in SQL on whole tables; tested against brute force
QUERIES = {"op7_jaccard_join": op7_jaccard_join}
