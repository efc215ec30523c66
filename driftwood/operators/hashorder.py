"""Positions, samples and splits in salted hash order.

Every operator counts rows per hash prefix first. That table has at most 16 to the power of its digits rows
whatever the input size, so it may be broadcast and summed up in one task; the rows themselves are only
ever ordered inside one prefix, and a hash prefix cannot be skewed by the data. Fewer digits mean fewer
rows per map task in the counting shuffle, more digits mean smaller prefixes to sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwood.functions.hashing import hash_fraction, hash_of
from driftwood.session import materialise

INDEX_DIGITS = 4     # 65,536 stretches of whole rows to number
SAMPLE_DIGITS = 3    # 4,096 stretches of hashes, of which one is sorted
GROUP_DIGITS = 2     # 256 stretches of hashes per group, of which one is sorted
ABOVE_ALL = "g"      # sorts behind every hex digest


def _prefix(digest: Column, digits: int) -> Column:
    return F.substring(digest, 1, digits)


def _running(counts: DataFrame) -> DataFrame:
    """Adds to prefix counts the number of rows in all earlier prefixes."""
    earlier = W.orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def dense_index(df: DataFrame, key: list[str], seed: int, name: str = "idx") -> DataFrame:
    """Numbers the rows 0, 1, 2, … in hash order of a unique key."""
    hashed = df.withColumn("_hash", hash_of(seed, *[F.col(k) for k in key])).withColumn("_prefix", _prefix(F.col("_hash"), INDEX_DIGITS))
    offsets = _running(hashed.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n"))).drop("_n")
    place = F.row_number().over(W.partitionBy("_prefix").orderBy("_hash", *key))
    return (
        hashed.join(F.broadcast(offsets), "_prefix")
        .withColumn(name, F.col("_before") + place - 1)
        .drop("_hash", "_prefix", "_before")
    )


def hash_cut(df: DataFrame, key: list[str], seed: int, n: int | None = None, fraction: float | None = None) -> DataFrame:
    """One row with ``cut``: the hash of the ``n``-th row in hash order; null if there is no such row.

    ``fraction`` asks for row number ``round(fraction * rows)`` instead. Reads the key columns only. Just the rows of the one prefix that holds the ``n``-th row are sorted.
    """
    hashed = df.select(hash_of(seed, *[F.col(k) for k in key]).alias("_hash")).withColumn("_prefix", _prefix(F.col("_hash"), SAMPLE_DIGITS))
    counts = _running(hashed.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n")))
    rows = F.sum("_n").over(W.partitionBy())
    want = F.lit(n) if fraction is None else F.round(F.lit(float(fraction)) * rows).cast("long")
    holder = counts.withColumn("_want", want).filter((F.col("_before") < F.col("_want")) & (F.col("_want") <= F.col("_before") + F.col("_n")))
    place = F.row_number().over(W.partitionBy("_prefix").orderBy("_hash"))
    return (
        hashed.join(F.broadcast(holder), "_prefix")
        .withColumn("_place", place)
        .filter(F.col("_place") == F.col("_want") - F.col("_before"))
        .agg(F.max("_hash").alias("cut"))
    )


def sample_rows(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """Simple random sample of ``min(n, rows)`` rows: a filter on the hash, no shuffle of whole rows."""
    if n < 0:
        raise ValueError("n must not be negative")
    if n == 0:
        return df.limit(0)
    cut = hash_cut(df, key, seed, n)
    return df.filter(hash_of(seed, *[F.col(k) for k in key]) <= F.coalesce(cut.scalar(), F.lit(ABOVE_ALL)))


def split_by_hash(df: DataFrame, key: list[str], fraction: float, seed: int = 42, exact: bool = False):
    """Train and test part, disjoint and complete.

    Each row decides for itself, so the fraction holds approximately; ``exact`` makes the first part hold
    ``round(fraction * rows)`` rows by cutting the hash order there.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be in [0, 1]")
    digest = hash_of(seed, *[F.col(k) for k in key])
    if exact:
        cut = hash_cut(df, key, seed, fraction=fraction)
        chosen = digest <= F.coalesce(cut.scalar(), F.lit(""))
    else:
        chosen = hash_fraction(digest) < F.lit(float(fraction))
    return df.filter(chosen), df.filter(~chosen)


def shuffled(df: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    return df.orderBy(hash_of(seed, *[F.col(k) for k in key]), *key)


def fill_level(sizes: DataFrame, n: int) -> tuple[int, int]:
    """Water-filling of ``n`` rows over groups: rows per group, and how many groups give one more.

    Works on the number of groups per distinct size. Over ``rows`` rows there are at most
    ``sqrt(2 * rows)`` distinct sizes, so that table is summed up in one task.
    """
    by_size = sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("_groups"))
    smaller = W.orderBy("_size").rowsBetween(W.unboundedPreceding, -1)
    larger = W.orderBy("_size").rowsBetween(W.currentRow, W.unboundedFollowing)
    steps = (
        by_size.withColumn("_below", F.coalesce(F.sum(F.col("_size") * F.col("_groups")).over(smaller), F.lit(0)))
        .withColumn("_open", F.sum("_groups").over(larger))
        .filter(F.col("_below") + F.col("_size") * F.col("_open") >= n)
    )
    step = steps.agg(F.min_by(F.struct("_below", "_open"), "_size").alias("s")).first()["s"]
    if step is None:
        raise ValueError(f"cannot draw {n} rows: the input has fewer")
    return divmod(n - step["_below"], step["_open"])


def balanced_cuts(
    df: DataFrame, group: str, key: list[str], n: int, seed: int = 42, max_broadcast_groups: int = 200_000, sizes: DataFrame | None = None,
) -> DataFrame:
    """The last hash, ``_cut``, that each group gives to a balanced sample of ``n`` rows; groups that give none are left out.

    A row is drawn if its hash is not above the cut of its group. ``sizes`` are the rows per group where they are known.
    The result is marked for broadcasting unless the groups are many.
    """
    if n <= 0:
        if n < 0:
            raise ValueError("n must not be negative")
        return df.limit(0).select(group, F.lit(ABOVE_ALL).alias("_cut"))
    hashed = df.select(F.col(group), hash_of(seed, *[F.col(k) for k in key]).alias("_hash"))
    if sizes is None:
        sizes = _group_sizes(df, group)
    level, extra = fill_level(sizes, n)
    last = sizes.filter(F.col("_size") > level).select(group).orderBy(group).limit(extra).agg(F.max(group).alias("last"))
    quota = F.lit(level) if extra == 0 else F.when(F.col(group) <= last.scalar(), F.lit(level + 1)).otherwise(F.lit(level))
    quotas = sizes.withColumn("_quota", quota)

    # Groups that give all rows need no cut; those that give none are left out.
    few = sizes.limit(max_broadcast_groups + 1).count() <= max_broadcast_groups
    counted = (
        hashed.withColumn("_prefix", _prefix(F.col("_hash"), GROUP_DIGITS))
        .groupBy(group, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    )
    earlier = W.partitionBy(group).orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    holders = (
        counted.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .join(quotas.filter((F.col("_quota") > 0) & (F.col("_quota") < F.col("_size"))), group)
        .filter((F.col("_before") < F.col("_quota")) & (F.col("_quota") <= F.col("_before") + F.col("_n")))
        .select(group, "_prefix", (F.col("_quota") - F.col("_before")).alias("_want"))
    )
    place = F.row_number().over(W.partitionBy(group, "_prefix").orderBy("_hash"))
    cuts = (
        hashed.withColumn("_prefix", _prefix(F.col("_hash"), GROUP_DIGITS))
        .join(F.broadcast(holders) if few else holders, [group, "_prefix"])
        .withColumn("_place", place)
        .filter(F.col("_place") == F.col("_want"))
        .select(group, F.col("_hash").alias("_cut"))
    )
    whole = quotas.filter(F.col("_quota") >= F.col("_size")).select(group, F.lit(ABOVE_ALL).alias("_cut"))
    limits = cuts.unionByName(whole)
    return F.broadcast(limits) if few else limits


def _group_sizes(df: DataFrame, group: str) -> DataFrame:
    """One row per group, read several times."""
    return materialise(df.groupBy(group).agg(F.count(F.lit(1)).alias("_size")), "group-sizes")


def balanced_sample(
    df: DataFrame, group: str, key: list[str], n: int, seed: int = 42, at_most: bool = False,
    max_broadcast_groups: int = 200_000, replace: bool = False,
) -> DataFrame:
    """Exactly ``n`` rows, spread over the groups as evenly as their sizes allow.

    Every group gives the same number of rows or all it has; what is missing is taken one row each from the
    first groups in key order. Inside a group the rows come in hash order. A group of any size works: its
    rows are counted per hash prefix, and only the prefix holding the last row to take is sorted. Too large
    an ``n`` is an error, or with ``at_most`` gives all rows; with ``replace`` all rows and as many draws from them with
    replacement as are missing.
    """
    if n <= 0:
        if n < 0:
            raise ValueError("n must not be negative")
        return df.limit(0)
    sizes = _group_sizes(df, group)
    if at_most or replace:
        rows = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("n")).first()["n"]
        if rows <= n and (at_most or rows in (0, n)):
            return df
        if rows < n:
            again = draws_with_replacement(df, key, n - rows, seed)
            copies = again.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
            return df.unionByName(copies.select(*df.columns))
    limits = balanced_cuts(df, group, key, n, seed, max_broadcast_groups, sizes)
    return (
        df.join(limits, group)
        .filter(hash_of(seed, *[F.col(k) for k in key]) <= F.col("_cut"))
        .select(*df.columns)
    )


def draws_with_replacement(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """``copies`` of the rows that ``n`` independent draws hit; rows never hit are left out, an empty table gives none.

    Draw ``i`` hits the row at the hash of ``i`` in hash order, so the draws add up exactly and a rerun repeats them.
    They are counted per place before they meet the rows; places are spread evenly whatever the data.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    indexed = dense_index(df, key, seed, "_idx")
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    number = F.conv(F.substring(hash_of(seed + 1, F.col("id")), 1, 15), 16, 10).cast("long")
    hits = df.sparkSession.range(n).select(F.pmod(number, F.greatest(rows.scalar(), F.lit(1))).alias("_idx"))
    return indexed.join(hits.groupBy("_idx").agg(F.count(F.lit(1)).alias("copies")), "_idx").drop("_idx")


def mismatched_pairs(df: DataFrame, key: list[str], column: str, seed: int = 42) -> DataFrame:
    """Each row with ``column`` of the next row in hash order, the last with the first: no row keeps its own.

    ``_same`` marks rows whose new value equals the old one because two rows held equal values.
    """
    indexed = dense_index(df, key, seed, "_idx")
    rows = df.agg(F.count(F.lit(1)).alias("n"))
    donors = indexed.select(
        F.pmod(F.col("_idx") - 1, F.greatest(rows.scalar(), F.lit(1))).alias("_idx"), F.col(column).alias("_donated")
    )
    return (
        indexed.join(donors, "_idx")
        .withColumn("_same", F.col(column).eqNullSafe(F.col("_donated")))
        .withColumn(column, F.col("_donated"))
        .select(*df.columns, "_same")
    )


def with_negatives(df: DataFrame, key: list[str], column: str, seed: int = 42, keep_equal: bool = False) -> DataFrame:
    """Positives (label true) and their mismatches (label false).

    A mismatch that got a text equal to its own would be a false negative: it gets the first or last of all texts
    instead, whichever is another. So there are as many negatives as positives wherever there are two different
    texts; where there is only one there are none, or with ``keep_equal`` the equal ones.
    """
    negatives = mismatched_pairs(df, key, column, seed)
    if not keep_equal:
        ends = df.agg(F.min(column).alias("first"), F.max(column).alias("last"))
        first, last = ends.select("first").scalar(), ends.select("last").scalar()
        other = F.when(F.col(column) == first, last).otherwise(first)
        negatives = negatives.withColumn(column, F.when(F.col("_same"), other).otherwise(F.col(column))).filter(~F.col("_same") | (first != last))
    negatives = negatives.drop("_same")
    return df.withColumn("label", F.lit(True)).unionByName(negatives.withColumn("label", F.lit(False)))


def batches(df: DataFrame, key: list[str], size: int, seed: int = 42) -> DataFrame:
    """Fixed-size batches in hash order: ``batch`` and the place inside it."""
    if size < 1:
        raise ValueError("size must be positive")
    return (
        dense_index(df, key, seed, "_idx")
        .withColumn("batch", F.floor(F.col("_idx") / size))
        .withColumn("slot", F.col("_idx") % size)
        .drop("_idx")
    )
