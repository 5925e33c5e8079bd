"""What the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def all_finite(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def matrix(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """The given rows of a column of lists, all of ``width``, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)


def lengths(column: pa.Array) -> np.ndarray:
    """The length of each list."""
    return pc.list_value_length(column).to_numpy(zero_copy_only=False)
