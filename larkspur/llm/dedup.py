"""Removal of repeated passages by suffix arrays over shards that content picks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesarr import BASE, BASE_INVERSE, BYTE_CODE, _powers, column_bytes, mix, row_chunks
from .common import id_text, stored
from .suffixes import GRAM, anchors, kasai, suffix_array

#: Bytes of a passage that counts as repeated.
LENGTH = 200
#: Starts that are looked at together; the LENGTH - PIECE + 1 bytes in the middle are common to all their passages.
PIECE = 64
CORE = LENGTH - PIECE + 1
#: Pieces of one suffix array.
SHARD_PIECES = 1024
#: A core that more different pieces share is spread over several shards.
SPREAD = 4096
#: Bytes that are scanned for anchors at once.
SCAN = 1 << 18
#: Stands for the core in a piece's data, so that a passage is PIECE bytes there; UTF-8 has no byte 254.
CORE_MARK = b"\xfe"

REF = "core long, piece long, th long, start int, n int, before int"


class PieceHash:
    """Hashes of any stretch of a byte array, from prefix sums."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.inverse = _powers(BASE_INVERSE, n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODE[buf] * _powers(BASE, n + 1)[:n], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, th, pos, place) of each anchor; place is a hash of th and pos."""
    for batch in batches:
        buf, offsets = column_bytes(batch.column("t"))
        th = batch.column("th").to_numpy()
        for first, last in row_chunks(offsets, SCAN):
            a, b = offsets[first], offsets[last]
            at, h, _ = anchors(buf[a:b], offsets[first : last + 1] - a, LENGTH)
            row = np.searchsorted(offsets, at + a, side="right") - 1
            pos = at + a - offsets[row]
            place = mix(th[row].view(np.uint64) + pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(th[row]), pa.array(pos.astype(np.int32)), pa.array(place.view(np.int64))], ["h", "th", "pos", "place"])


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece of starts whose anchor is given: the hash of what they have in common and of the whole.

    ``before`` counts the piece's bytes before its core; pieces that differ in it are different.
    """
    for batch in batches:
        buf, offsets = column_bytes(batch.column("t"))
        th = batch.column("th").to_numpy()
        lists = batch.column("at")
        for first, last in row_chunks(offsets, SCAN):
            a, b = offsets[first], offsets[last]
            places, hashes, lows = anchors(buf[a:b], offsets[first : last + 1] - a, LENGTH)
            part = lists[first:last]
            row = np.repeat(np.arange(first, last), pa.compute.list_value_length(part).to_numpy())
            at = part.flatten().to_numpy().astype(np.int64) + offsets[row] - a
            mine = hashes[np.searchsorted(places, at)]
            begin, stop = offsets[row] - a, offsets[row + 1] - a
            hash_of = PieceHash(buf[a:b])
            found = []
            # starts lie up to LENGTH - GRAM before the anchor, in pieces at fixed distances from it
            for k in range(-(-(LENGTH - GRAM + 1) // PIECE)):
                low = at - (k + 1) * PIECE + 1
                starts = low[:, None] + np.arange(PIECE)
                within = (starts >= begin[:, None]) & (starts + LENGTH <= stop[:, None])
                used = (within & (lows[np.clip(starts, 0, len(lows) - 1)] == mine[:, None])).any(1)
                lo, hi = np.maximum(low, begin)[used], np.minimum(low + PIECE + LENGTH - 1, stop)[used]
                found.append(np.stack([row[used], lo, hi, low[used]]))
            row, lo, hi, low = np.unique(np.concatenate(found, 1), axis=1)
            before = low + PIECE - 1 - lo
            piece = mix(hash_of(lo, hi) + before.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([
                pa.array(hash_of(low + PIECE - 1, low + LENGTH).view(np.int64)), pa.array(piece.view(np.int64)), pa.array(th[row]),
                pa.array((lo + a - offsets[row]).astype(np.int32)), pa.array((hi - lo).astype(np.int32)), pa.array(before.astype(np.int32)),
            ], ["core", "piece", "th", "start", "n", "before"])


BYTES = "core long, piece long, th long, start int, kinds long, copies long, data binary"


def _piece_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of pieces, with CORE_MARK in place of their cores."""
    for batch in batches:
        buf, offsets = column_bytes(batch.column("t"))
        whole = buf.tobytes()
        refs = batch.column("refs")
        row = np.repeat(np.arange(len(refs)), pa.compute.list_value_length(refs).fill_null(0).to_numpy())
        flat = refs.flatten()
        core, piece, start, n, before, kinds, copies = (flat.field(c).to_numpy() for c in ("core", "piece", "start", "n", "before", "kinds", "copies"))
        at = offsets[row] + start
        middle = at + before
        data = [whole[x:y] + CORE_MARK + whole[y + CORE : z] for x, y, z in zip(at.tolist(), middle.tolist(), (at + n).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(piece), pa.array(batch.column("th").to_numpy()[row]), pa.array(start), pa.array(kinds), pa.array(copies), pa.array(data, pa.binary())], ["core", "piece", "th", "start", "kinds", "copies", "data"])


def passage_classes(data: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From one suffix array over all pieces: piece, place and class of every start of a passage.

    A passage is PIECE bytes of its piece's data, as CORE_MARK stands for its core. Two starts are in one class if these
    are equal, which makes equal passages of starts with one core; classes are numbered in the order of these bytes.
    """
    buf, offsets = column_bytes(data)
    n = np.diff(offsets)
    symbols = np.zeros(len(buf) + len(n), np.uint8)  # a zero after each piece, which no byte equals
    starts = offsets[:-1] + np.arange(len(n))
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(buf)) + row
    symbols[at] = buf + np.uint8(1)  # UTF-8 has no byte 255
    order = suffix_array(symbols, 2 * PIECE)  # as long as any piece with the zero after it
    common = kasai(symbols, order, starts, starts + n - PIECE + 1, PIECE)  # shorter suffixes hold no passage
    rank = np.empty(len(symbols), np.int32)
    rank[order] = np.cumsum(common[order] < PIECE)
    place = at - starts[row]
    whole = place + PIECE <= n[row]
    return row[whole], place[whole], rank[at[whole]]


def repeated(group: np.ndarray, core: np.ndarray, th: np.ndarray, at: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Which starts have others in their class and core, one and the same place in a text counting once."""
    by = np.lexsort((at, th, core, group))
    same = np.zeros(len(by), bool)
    g, c, t, a = group[by], core[by], th[by], at[by]
    same[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
    place = same.copy()
    place[1:] &= (t[1:] == t[:-1]) & (a[1:] == a[:-1])
    number = np.cumsum(~same)
    total = np.bincount(number, copies[by] - place, len(by) + 2)
    out = np.zeros(len(by), bool)
    out[by] = total[number] > 1
    return out


def _ranges(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive places: (owner, first, last)."""
    by = np.lexsort((place, owner))
    owner, place = owner[by], place[by]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
    last = np.append(new[1:], True)
    return owner[new], place[new], place[last]


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _shard(table: pa.Table) -> pa.Table:
    """Repeated starts of one shard's pieces: (core, piece, lo, hi) as places within the piece."""
    core, piece, th, start, copies = _columns(table, "core", "piece", "th", "start", "copies")
    owner, place, group = passage_classes(table.column("data").combine_chunks())
    twice = repeated(group, core[owner], th[owner], start[owner] + place, copies[owner])
    owner, lo, hi = _ranges(owner[twice], place[twice])
    return pa.table({"core": core[owner], "piece": piece[owner], "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32())})


RUN = "passage long, run long, core long, piece long, place int, th long, at int, copies long"


def _sorted_run(table: pa.Table) -> pa.Table:
    """The starts of one part of a widely shared core, in the order of its suffix array."""
    core, piece, th, start, copies, run = _columns(table, "core", "piece", "th", "start", "copies", "run")
    column = table.column("data").combine_chunks()
    owner, place, group = passage_classes(column)
    by = np.argsort(group, kind="stable")
    owner, place = owner[by], place[by]
    buf, offsets = column_bytes(column)
    at = offsets[owner] + place
    return pa.table({
        "passage": PieceHash(buf)(at, at + PIECE).view(np.int64), "run": run[owner], "core": core[owner], "piece": piece[owner],
        "place": pa.array(place, pa.int32()), "th": th[owner], "at": pa.array(start[owner] + place, pa.int32()), "copies": copies[owner],
    })


def _merge_runs(table: pa.Table) -> pa.Table:
    """Passages of a core that stand at two places or more, in one run or, by binary search, in several.

    A run gives one row for each of its passages, with the first and last place in it.
    """
    passage, run, core, copies = _columns(table, "passage", "run", "core", "copies")
    every = np.unique(passage)
    group = np.empty(len(passage), np.int64)
    for one in np.unique(run):
        mine = run == one
        group[mine] = np.searchsorted(every, passage[mine])
    first, last = table.column("first").combine_chunks(), table.column("last").combine_chunks()
    th, at = (np.concatenate([x.field(c).to_numpy() for x in (first, last)]).astype(np.int64) for c in ("th", "at"))
    twice = repeated(np.tile(group, 2), np.tile(core, 2), th, at, np.tile(copies, 2))
    twice = twice[: len(passage)] | twice[len(passage) :]
    return pa.table({"core": core[twice], "passage": passage[twice]})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = column_bytes(batch.column("t"))
        spans = batch.column("spans")
        removed, runs, kept = [], [], []
        for k in range(len(spans)):
            mine = buf[offsets[k] : offsets[k + 1]]
            lo, hi = (spans[k].values.field(c).to_numpy() for c in ("lo", "hi"))
            step = np.zeros(len(mine) + 1, np.int32)
            np.add.at(step, lo, 1)
            np.add.at(step, hi, -1)
            cover = np.cumsum(step[:-1]) > 0
            removed.append(int(cover.sum()))
            runs.append(int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum()))
            kept.append(hashlib.sha256(mine[~cover].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("th"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())], ["th", "removed", "runs", "kept"])


def candidate_texts(texts: DataFrame) -> DataFrame:
    """(th, t, at): the texts, each once, with anchors that stand at two places or more, and where these are.

    Content picks an anchor in every passage, so equal passages have equal anchors, and a passage whose anchor stands at
    one place alone is not repeated. Rows of one text count as one.
    """
    found = texts.mapInArrow(_anchor_rows, "h long, th long, pos int, place long")
    twice = found.groupBy("h").agg(F.min("place").alias("a"), F.max("place").alias("b")).filter("a <> b").select("h")
    twice = stored(twice, "dedup-anchors")  # so that the join deals both sides and a frequent anchor's rows can be split
    near = found.drop("place").join(twice.hint("merge"), "h").groupBy("th").agg(F.collect_set("pos").alias("at"))
    return texts.groupBy("th").agg(F.first("t").alias("t")).join(near.hint("merge"), "th")


def repeated_spans(candidates: DataFrame) -> DataFrame:
    """(th, spans): stretches (lo, hi) of bytes, by rows of candidate_texts(), that repeated passages cover; they may
    overlap. A piece has one row for each place where it stands.

    Around the anchors, starts are put into pieces at fixed distances. A passage can only repeat if its piece's core
    does, and equal pieces repeat as a whole. Different pieces with one core are sorted into suffix arrays, shard by
    shard, with one byte for the core: all places of a passage have the same anchors, and so the same cores at the same
    places. A core with very many different pieces goes to several shards, whose sorted runs are merged by binary search.
    """
    refs = stored(candidates.mapInArrow(_piece_rows, REF), "dedup-pieces")
    pieces = stored(refs.groupBy("core", "piece").agg(F.count(F.lit(1)).alias("copies"), F.min("th").alias("th")), "dedup-distinct")
    shared = pieces.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("copies") == 1).alias("single")).filter("kinds > 1 and single > 0")
    unsure = pieces.join(shared.hint("merge"), "core").select("core", "piece", "kinds", "copies", "th")
    # one place of each: the first one in its text
    at = refs.join(unsure.hint("merge"), ["core", "piece", "th"]).groupBy("core", "piece", "th", "kinds", "copies").agg(F.min("start").alias("start"), F.max("n").alias("n"), F.max("before").alias("before"))
    unsure = stored(at, "dedup-unsure")
    wanted = unsure.groupBy("th").agg(F.collect_list(F.struct("core", "piece", "start", "n", "before", "kinds", "copies")).alias("refs"))
    data = stored(candidates.select("th", "t").join(wanted.hint("merge"), "th").select("th", "t", "refs").mapInArrow(_piece_bytes, BYTES), "dedup-bytes")
    shards = max(1, math.ceil(unsure.count() / SHARD_PIECES))
    few = data.filter(F.col("kinds") <= SPREAD).withColumn("shard", F.pmod(F.xxhash64("core"), F.lit(shards))).groupBy("shard").applyInArrow(_shard, "core long, piece long, lo int, hi int")
    parts = F.pmod(F.xxhash64("piece"), F.ceil(F.col("kinds") / SPREAD))
    many = data.filter(F.col("kinds") > SPREAD).withColumn("run", F.xxhash64("core", parts)).groupBy("run").applyInArrow(_sorted_run, RUN)
    many = stored(many, "dedup-runs")
    place = F.struct("th", "at")
    kinds = many.groupBy("run", "core", "passage").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("copies").alias("copies"))
    twice = kinds.groupBy(F.pmod(F.col("passage"), F.lit(shards)).cast("int")).applyInArrow(_merge_runs, "core long, passage long").distinct()
    merged = many.join(stored(twice, "dedup-merged").hint("merge"), ["core", "passage"]).select("core", "piece", F.col("place").alias("lo"), F.col("place").alias("hi"))
    part = few.unionByName(merged).groupBy("core", "piece").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))  # PIECE at most
    whole = pieces.filter("copies > 1").select("core", "piece", F.array(F.struct(F.lit(0).alias("lo"), F.lit(-1).alias("hi"))).alias("parts"))
    found = stored(whole.unionByName(part).groupBy("core", "piece").agg(F.flatten(F.collect_list("parts")).alias("parts")), "dedup-ranges")
    last = lambda x: F.when(x["hi"] < 0, F.col("n")).otherwise(x["hi"] + LENGTH)
    return refs.join(found.hint("merge"), ["core", "piece"]).select("th", F.transform("parts", lambda x: F.struct((F.col("start") + x["lo"]).alias("lo"), (F.col("start") + last(x)).alias("hi"))).alias("spans"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document.

    Removes each byte covered by a LENGTH-byte string that starts anywhere else too, in the same document or another.
    Texts that occur several times are looked at once; such documents lose everything if they are long enough. A null
    text counts as empty; a text under LENGTH bytes keeps all. Repeated rows are copies. All places of a passage go alike,
    so there are no ties to break. A long text is taken whole: it needs about 60 bytes for each of its bytes in the task
    that scans it, and its pieces go to suffix arrays of their own. Other columns are ignored; an empty table gives an
    empty result.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t", F.octet_length("t")))
    candidates = stored(candidate_texts(slim.filter(F.octet_length("t") >= LENGTH).select("th", "t")), "dedup-texts")
    spans = repeated_spans(candidates).groupBy("th").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    cut = stored(candidates.select("th", "t").join(spans.hint("merge"), "th").select("th", "t", "spans").mapInArrow(_cut, "th long, removed long, runs long, kept string"), "dedup-cut")
    whole = slim.select("doc_id", "th", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("sha"))
    copies = slim.groupBy("th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = whole.join(copies, "th", "left").join(cut, "th", "left")
    gone = F.col("n").isNotNull() & (F.col("n_bytes") >= LENGTH)
    return joined.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"), F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}  # too slow in SQL; tested against brute force
QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
