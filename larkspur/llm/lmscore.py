"""Language-model scores: exact token counts over all documents, and a weighted backoff automaton."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff
from .bytesarr import BASE, column_bytes, mix, words
from .common import id_text, stored

#: Bytes of text of the documents that are counted together.
BLOCK_BYTES = 6 << 20
#: Words of the longest n-grams.
ORDER = 2
#: Weight of the shorter n-gram's estimate, in tokens: a state seen n times passes PRIOR / (n + PRIOR) to its failure arc.
PRIOR = 4.0
#: Stands for the end of a text.
END = np.uint64(0)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words with END after the last, and the row of each token."""
    buf, offsets = column_bytes(column)
    hashes, rows, per_row = words(buf, offsets, lower=True)
    hashes = np.where(hashes == END, np.uint64(1), hashes)
    at = np.cumsum(per_row)
    return np.insert(hashes, at, END), np.insert(rows, at, np.arange(len(per_row)))


def _grams(hashes: np.ndarray, rows: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each number of words from 2: the tokens that end such an n-gram, the n-grams' hashes and those of their contexts.

    A text begins as after an END, so its first token ends a pair, its second one a triple.
    """
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    out, shorter = [], hashes
    for k in range(2, order + 1):
        context = np.append(END, shorter[:-1])[: len(shorter)]
        context[place == 0] = END
        at = np.flatnonzero(place >= k - 2)
        shorter = mix((context + np.uint64(k)) * BASE ^ hashes)
        out.append((at, shorter[at], context[at]))
    return out


def _counted(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the first place of each, which one each value is, and their summed weights."""
    types, first, which = np.unique(values, return_index=True, return_inverse=True)
    return types, first, which, np.bincount(which, weights=weights, minlength=len(types)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Eight-byte numbers byte plane by byte plane, so that planes of zeros compress to nothing."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _all_grams(hashes: np.ndarray, rows: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As _grams, from single tokens on, whose context is of no use."""
    yield np.arange(len(hashes)), hashes, hashes
    yield from _grams(hashes, rows, order)


COUNTS = "block int, words int, part int, grams binary, n binary"


def _block_counts(table: pa.Table, order: int, bits: int) -> pa.Table:
    """Every distinct n-gram of a block and how often its training documents have it, in 2^bits parts by the n-gram's
    first bits. A part's n-grams are in order and given by their differences."""
    train = table.column("train").to_numpy(zero_copy_only=False)
    hashes, rows = _tokens(table.column("t").combine_chunks())
    block = table.column("block")[0].as_py()
    out = []
    for k, (at, grams, _) in enumerate(_all_grams(hashes, rows, order), 1):
        types, _, _, n = _counted(grams, train[rows[at]])
        cuts = np.searchsorted(types >> np.uint64(64 - bits), np.arange(1, 2**bits, dtype=np.uint64))
        for part, (mine, times) in enumerate(zip(np.split(types, cuts), np.split(n, cuts), strict=True)):
            if len(mine):
                out.append((block, k, part, pack(np.diff(mine, prepend=np.uint64(0))), pack(times)))
    return pa.table(list(zip(*out, strict=True)), names=["block", "words", "part", "grams", "n"]).cast(pa.schema([("block", pa.int32()), ("words", pa.int32()), ("part", pa.int32()), ("grams", pa.binary()), ("n", pa.binary())]))


TOTALS = "block int, words int, part int, totals binary, types long, tokens long"


def _merge_counts(table: pa.Table) -> pa.Table:
    """Sums the counts of one part of the n-grams of one length. Each block gets the totals of its n-grams, in their order;
    a row of block -1 has how many types the training documents have there, and how many tokens."""
    lists = [np.cumsum(unpack(x.as_py())) for x in table.column("grams")]
    types, which = np.unique(np.concatenate(lists), return_inverse=True)
    sizes = np.cumsum([len(x) for x in lists])[:-1]
    del lists
    n = np.concatenate([unpack(x.as_py()) for x in table.column("n")])
    total = np.bincount(which, weights=n, minlength=len(types)).astype(np.int64)
    back = [pack(x) for x in np.split(total[which], sizes)]
    zero = [0] * len(back)
    return pa.table({
        "block": pa.array([*table.column("block").to_pylist(), -1], pa.int32()), "words": pa.array([*table.column("words").to_pylist(), table.column("words")[0].as_py()], pa.int32()),
        "part": pa.array([*table.column("part").to_pylist(), 0], pa.int32()), "totals": pa.array([*back, None], pa.binary()),
        "types": pa.array([*zero, int((total > 0).sum())], pa.int64()), "tokens": pa.array([*zero, int(total.sum())], pa.int64()),
    })


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document.

    Documents whose crc32(id) mod 5 is not 1 are the training part. Tokens are words of anything but ASCII white space,
    A-Z lower-cased, and an end; they and all n-grams of up to ``order`` of them are counted exactly over all training
    documents, none is dropped. Documents are dealt to blocks by a hash. Each block counts its n-grams; counts are summed
    by n-gram, in parts by its hash; and each block gets the totals of its n-grams back, in the order in which it has
    them. N-grams are told apart by 64-bit hashes. A part's task holds one entry of a common n-gram for each block, so
    ``block_bytes`` should grow with the corpus (64 MB for 100 TB makes 1.6 million entries); a block takes about 100
    bytes of memory for each of its words, as does a single longer text.

    score is the walk of a weighted backoff automaton (see ``backoff``): its states are the block's n-grams that training
    has, with an arc for each word after them that training has, and a failure arc to the state without the first word.
    The walk goes from left to right and carries its state. Scores don't depend on how rows are dealt.

    A null or empty text has the end alone. Without training documents every count is 0. Repeated rows are scored each
    (and counted each); there are no ties to break; other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), (F.crc32(id_text(F.col(doc_id))) % 5 != 1).alias("train"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    bits = max(1, math.ceil(math.log2(blocks)) - 1)
    dealt = source.withColumn("block", F.pmod(F.xxhash64(id_text(F.col("doc_id")), F.coalesce("t", F.lit(""))), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy("block").applyInArrow(lambda table: _block_counts(table, order, bits), COUNTS)
    merged = stored(counts.groupBy("words", "part").applyInArrow(_merge_counts, TOTALS), "lm-counts")
    row = merged.filter("block = -1 and words = 1").agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    types, total = int(row[0]), int(row[1])
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(texts: pa.Table, totals: pa.Table) -> pa.Table:
        hashes, rows = _tokens(texts.column("t").combine_chunks())
        length, part = (totals.column(c).to_numpy() for c in ("words", "part"))
        n_rows = texts.num_rows
        add = lambda x: np.bincount(rows, weights=x, minlength=n_rows)
        tables: list[backoff.Grams] = []
        for k, (at, grams, context) in enumerate(_all_grams(hashes, rows, order), 1):
            mine = np.flatnonzero(length == k)
            count = np.concatenate([np.zeros(0, np.uint64), *(unpack(totals.column("totals")[int(x)].as_py()) for x in mine[np.argsort(part[mine])])]).astype(np.float64)
            now, first, which = np.unique(grams, return_index=True, return_inverse=True)
            if k == 1:
                token = which
                tables.append(backoff.Grams(count, np.zeros(0, int), np.zeros(0, int), np.arange(len(now))))
            else:
                # the context is an n-gram of the block too, one word shorter, and so is the ending, at the same place
                tables.append(backoff.Grams(count, np.searchsorted(known, context[first]), before[at[first]], token[at[first]]))
            known, before = now, np.zeros(len(hashes), int)
            before[at] = which
        root = (tables[0].count + 0.5) / (total + 0.5 * (types + 1))
        seen, unigram = add(tables[0].count[token] > 0), add(np.log10(root)[token])
        # END is the least hash and ends every text
        machine = backoff.build(tables, root, PRIOR, 0)
        scores = backoff.walk(machine, token, np.bincount(rows, minlength=n_rows), order)
        train = texts.column("train").to_numpy(zero_copy_only=False)
        return pa.table([
            texts.column("doc_id"), pa.array(~train.astype(bool), pa.bool_()), pa.array(np.bincount(rows, minlength=n_rows), pa.int64()), pa.array(seen.astype(np.int64)),
            pa.array(np.full(n_rows, total), pa.int64()), pa.array(unigram), pa.array(scores),
        ], names=names)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(merged.filter("block >= 0").groupBy("block")).applyInArrow(score, schema)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}  # the automaton can't be expressed in SQL; both scores are tested against brute force
QUERIES = {"op5_lm_score": op5_lm_score}
