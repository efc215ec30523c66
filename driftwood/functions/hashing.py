"""Salted hash order: the engine's only source of randomness.

A row's place depends on the seed and its key alone, so samples do not change with the partitioning,
a lost executor or a rerun.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_of(seed: int | str, *key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[part.cast("string") for part in key]))


def hash_fraction(digest: Column) -> Column:
    """The first 8 hex digits as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def entity_id(parent: Column, *natural_key: Column) -> Column:
    return F.md5(F.concat_ws("|", parent, *[part.cast("string") for part in natural_key]))
