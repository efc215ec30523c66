"""Character similarity of two texts."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.functions.batches import slices

# The function travels to the executors by value, so that they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# So many characters are counted at once; longer texts are counted by stretches.
STRETCH = 500_000


def _counted(texts: list[str], row: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a stretch of texts, the first of which is number ``row``."""
    characters = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(row, row + len(texts), dtype=np.int64), [len(t) for t in texts])
    return np.unique(rows << 21 | characters, return_counts=True)


def _character_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of row and character, and how often the character stands in the row."""
    if sum(map(len, texts)) <= STRETCH:
        return _counted(texts, 0)
    parts = [
        _counted([text[begin:begin + STRETCH]], row) for row, text in enumerate(texts) for begin in range(0, len(text), STRETCH)
    ]
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros(len(keys), dtype=np.int64)
    np.add.at(counts, place, np.concatenate([c for _, c in parts]))
    return keys, counts


def shared_characters(a: list[str], b: list[str]) -> np.ndarray:
    """Characters that two texts have in common, counted with repetition, for all rows at once."""
    (keys_a, counts_a), (keys_b, counts_b) = _character_counts(a), _character_counts(b)
    keys, at_a, at_b = np.intersect1d(keys_a, keys_b, assume_unique=True, return_indices=True)
    return np.bincount(keys >> 21, weights=np.minimum(counts_a[at_a], counts_b[at_b]), minlength=len(a))


@F.arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of characters two texts have in common, counted with repetition; 1 for two empty texts.

    An Arrow function over slices of batches: native array functions take ten times as long, and of a whole batch the keys
    of its characters would take many times its texts.
    """
    parts = [_similarity(a.slice(*part), b.slice(*part)) for part in slices([a, b])]
    return pa.concat_arrays(parts) if parts else pa.array([], type=pa.float64())


def _similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    missing = np.array([not (x and y) for x, y in zip(a.is_valid().to_pylist(), b.is_valid().to_pylist())], dtype=bool)
    left, right = ([t or "" for t in column.to_pylist()] for column in (a, b))
    total = np.array([len(x) + len(y) for x, y in zip(left, right)], dtype=np.float64)
    ratio = np.divide(2.0 * shared_characters(left, right), total, out=np.ones(len(total)), where=total > 0)
    return pa.array(ratio, type=pa.float64(), mask=missing)
