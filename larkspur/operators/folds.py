"""Folds over the rows of a key in their order, for rules in which what a row meets depends on the rows before it."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Row = dict[str, Any]
#: Rows of a batch that goes out.
ROWS = 2000


class FirstFit:
    """Items in the order in which they came; a row goes into the first one that shares a key with it, else it is one.

    ``keys`` gives those that an item has now, ``wanted`` those that a row looks for. An item may gain and lose keys as
    it grows, so a key's items are a heap whose stale tops go when they are met.
    """

    def __init__(self, keys: Callable[[Row], set[Hashable]], wanted: Callable[[Row], set[Hashable]], merge: Callable[[Row, Row], Row]):
        self.items: list[Row] = []
        self._keys, self._wanted, self._merge = keys, wanted, merge
        self._now: list[set[Hashable]] = []
        self._heaps: dict[Hashable, list[int]] = {}

    def _first(self, key: Hashable) -> int | None:
        heap = self._heaps.get(key, [])
        while heap and key not in self._now[heap[0]]:
            heapq.heappop(heap)
        return heap[0] if heap else None

    def add(self, row: Row) -> None:
        wanted = self._wanted(row)
        at = min((k for k in map(self._first, wanted) if k is not None), default=None)
        if at is None:
            at = len(self.items)
            self.items.append(row)
            self._now.append(set())
            has = wanted if self._keys is self._wanted else self._keys(row)
        else:
            self.items[at] = self._merge(self.items[at], row)
            has = self._keys(self.items[at])
        for key in has - self._now[at]:
            heapq.heappush(self._heaps.setdefault(key, []), at)
        self._now[at] = has


def first_fit(rows: DataFrame, group: list[str], order: list[str], fold: Callable[[], FirstFit], schema: StructType) -> DataFrame:
    """What is left of each group's rows, taken in ``order``, after a first-fit merge; rows have the columns of ``schema``.

    Groups are dealt by their key and streamed in order, so a task holds one group's merged items and not its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, at, now, out = to_arrow_schema(schema), None, None, []
        for row in (row for batch in batches for row in batch.to_pylist()):
            key = tuple(row[c] for c in group)
            if now is None or key != at:
                out += now.items if now else []
                at, now = key, fold()
            now.add(row)
            while len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist(out[:ROWS], schema=arrow)
                del out[:ROWS]
        yield pa.RecordBatch.from_pylist(out + (now.items if now else []), schema=arrow)

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def merged(*lists: Iterable | None) -> list:
    """Values of the lists in order, each once."""
    return list(dict.fromkeys(x for values in lists for x in values or ()))
