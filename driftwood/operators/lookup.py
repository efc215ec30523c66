"""Joins with a table of keys that occur with very different frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.session import materialise

# A key of more than one row in so many is looked up from a broadcast table, which so has at most this many rows.
HEAVY = 65_536


def split_by_frequency(table: DataFrame, frequency: str, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """The rows of ``table`` whose ``frequency`` is above one in ``heavy`` of all, and the others.

    The frequent ones are fewer than ``heavy`` however large the table is; they are written, so that they are found once.
    """
    total = table.agg(F.sum(frequency).alias("t")).select(F.col("t").cast("double"))
    often = F.col(frequency) * F.lit(float(heavy)) > F.coalesce(total.scalar(), F.lit(0.0))
    return materialise(table.filter(often), "frequent-keys"), table.filter(~often)


def lookup_join(rows: DataFrame, table: DataFrame, key: str, frequency: str, heavy: int = HEAVY) -> DataFrame:
    """``rows`` with the other columns of ``table``, one row per key, found by ``key``; null where there is none.

    ``frequency`` says how often a key occurs in ``rows``, at least roughly. Rows of frequent keys meet these in a
    broadcast hash join where they lie; only the others are shuffled, and no key of theirs is large. ``rows`` are
    worked out once for either part. ``frequency`` itself is not added.
    """
    frequent, others = split_by_frequency(table, frequency, heavy)
    added = [c for c in table.columns if c not in (key, frequency)]
    marked = frequent.select(key, *added, F.lit(True).alias("_frequent"))
    met = rows.join(F.broadcast(marked), key, "left")
    head = met.filter(F.col("_frequent")).drop("_frequent")
    tail = met.filter(F.col("_frequent").isNull()).drop("_frequent", *added)
    # Spark takes exploded rows for far fewer than they are, so the side to hash is named.
    tail = tail.join(others.select(key, *added).hint("shuffle_hash"), key, "left")
    return head.unionByName(tail)
