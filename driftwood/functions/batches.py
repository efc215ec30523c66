"""Arrow batches cut by the bytes they hold, so that what Python makes of one does not follow the length of its texts."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# The function travels to the executors by value, so that they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What is made of a slice at once; a longer row is a slice of its own.
SLICE_BYTES = 500_000
SLICE_ROWS = 2_000


def _is_text(kind: pa.DataType) -> bool:
    return pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind)


def slices(columns: list[pa.Array], size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Begin and length of stretches of rows that hold about ``size`` bytes of text in all ``columns``, or one row of more."""
    rows = len(columns[0])
    held = np.zeros(rows, dtype=np.int64)
    for column in columns:
        if _is_text(column.type):
            held += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, begin = np.cumsum(held), 0
    while begin < rows:
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
        end = min(end, begin + SLICE_ROWS)
        yield begin, end - begin
        begin = end
