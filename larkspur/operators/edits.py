"""Edit distances of names, exactly: a name meets many at once, in the bits of words that each of them has of its own."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

#: Names of both sides that meet at once, and rows of a batch that goes out: ROWS at least, but for a last one, and less than twice as many.
HIGH, WIDE, ROWS = 32, 1 << 13, 1 << 16
#: Executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def distances_to(names: list[str]) -> Callable[[str, int], np.ndarray]:
    """A function of a name and a place: the name's edit distances, by code points, to ``names`` from this place on.

    A letter of the name takes the steps up and down in each column of the plain table to the next one; they are bits
    of a word for each of ``names``, or of several words for long ones (Myers 1999, Hyyro 2003).
    """
    sizes = np.array([len(x) for x in names])
    width = max(int(sizes.max()), 1)
    word = next((t for t in (np.uint8, np.uint16, np.uint32) if width <= np.iinfo(t).bits), np.uint64)
    bits = np.iinfo(word).bits
    codes = np.array(names, f"U{width}").view(np.uint32).reshape(len(names), width)
    there = np.arange(width) < sizes[:, None]

    def packed(which: np.ndarray) -> list[np.ndarray]:
        places = np.left_shift(word(1), np.arange(bits).astype(word))
        return [np.bitwise_or.reduce(np.where(which[:, at : at + bits], places[: width - at], word(0)), axis=1) for at in range(0, width, bits)]

    own, letters = packed(there), {}

    def to(name: str, start: int) -> np.ndarray:
        n = len(names) - start
        up, down = [np.full(n, np.iinfo(word).max, word) for _ in own], [np.zeros(n, word) for _ in own]
        a, b = np.empty(n, word), np.empty(n, word)
        for c in name:
            if c not in letters:
                letters[c] = packed(there & (codes == ord(c)))
            carry, rise, fall = None, word(1), None
            for w, same in enumerate(letters[c]):
                same, p, m = same[start:], up[w], down[w]
                np.bitwise_and(same, p, out=a)
                np.add(a, p, out=a)
                if len(own) > 1:
                    over = a < p
                    if carry is not None:
                        np.add(a, carry, out=a)
                        over |= a < carry
                    carry = over.astype(word)
                np.bitwise_xor(a, p, out=a)
                np.bitwise_or(a, same, out=a)
                np.bitwise_or(a, m, out=a)
                np.bitwise_or(a, p, out=b)
                np.invert(b, out=b)
                np.bitwise_or(b, m, out=b)
                np.bitwise_and(p, a, out=p)
                if len(own) > 1:
                    risen, fallen = b >> (bits - 1), p >> (bits - 1)
                np.left_shift(b, 1, out=b)
                np.bitwise_or(b, rise, out=b)
                np.left_shift(p, 1, out=p)
                if fall is not None:
                    np.bitwise_or(p, fall, out=p)
                np.bitwise_and(b, a, out=m)
                np.bitwise_or(a, b, out=a)
                np.invert(a, out=a)
                np.bitwise_or(p, a, out=p)
                if len(own) > 1:
                    rise, fall = risen, fallen
        total = np.full(n, len(name), np.int32)
        for o, p, m in zip(own, up, down):
            total += np.bitwise_count(p & o[start:])
            total -= np.bitwise_count(m & o[start:])
        return total

    return to


def _sides(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows that ask and of the others, by their ids, for each kind and at most WIDE others."""
    asks, ids = (table[c].to_numpy(zero_copy_only=False) for c in ("asks", "id"))
    kind = table["kind"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    by = np.lexsort((ids, kind))
    for rows in np.split(by, np.flatnonzero(np.diff(kind[by])) + 1):
        mine, other = rows[asks[rows]], rows[~asks[rows]]
        if len(mine):
            yield from ((mine, other[at : at + WIDE]) for at in range(0, len(other), WIDE))


def _similar(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, other ids, similarities, which are no number where a name is missing) of names with later ones of their kind.

    HIGH names at once, so that runs have one other id and the same few ids, which Parquet keeps in few bytes.
    """
    ids, size, names = table["id"].to_numpy(), table["size"].to_numpy(), table["name"].to_pylist()
    for mine, other in _sides(table):
        to, later = distances_to([names[k] or "" for k in other]), ids[other]
        lengths = np.array([np.nan if names[k] is None else size[k] for k in other], np.float64)
        starts = np.searchsorted(later, ids[mine], side="right")
        for rows, begin in ((mine[at : at + HIGH], starts[at : at + HIGH]) for at in range(0, len(mine), HIGH)):
            first, whole = int(begin[0]), int(begin[-1])  # names go by their ids, and from the last one's place on all have pairs
            found = np.empty((len(rows), len(later) - first))
            for k, similarity in zip(rows.tolist(), found):
                if names[k] is None:
                    similarity[:] = np.nan
                else:
                    longest = np.maximum(lengths[first:], max(float(size[k]), 1.0))  # empty names are equal: 0 of 1
                    np.divide(to(names[k], first), longest, out=longest)
                    np.subtract(1.0, longest, out=similarity)
            j, i = np.nonzero((begin[:, None] <= np.arange(first, whole)).T)
            yield ids[rows][i], later[first + j], found[i, j]
            yield np.tile(ids[rows], len(later) - whole), np.repeat(later[whole:], len(rows)), found[:, whole - first :].T.ravel()


def later_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, other_id, similarity) of rows (id, name, size, kind, asks) that ask with later ones of their kind that don't.

    Names may lack what all have in common at their beginning; ``size`` is that of the whole name. Pairs go out as they are made.
    """
    table = pa.Table.from_batches(batches)
    missing = table["name"].null_count > 0
    batch = lambda parts: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), from_pandas=missing) for c in zip(*parts)], ["id", "other_id", "similarity"])
    held, n = [], 0
    for part in _similar(table):
        for at in range(0, len(part[0]), ROWS):
            held.append([c[at : at + ROWS] for c in part])
            n += len(held[-1][0])
            if n >= ROWS:
                yield batch(held)
                held, n = [], 0
    if n:
        yield batch(held)
