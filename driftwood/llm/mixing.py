"""Mixing sources to target weights by fitting subset sums of document lengths."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwood.llm.common import WORD
from driftwood.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = (5, 2, 1)
SHARE = 1.5          # of all words
LIMIT = 2            # times that a document may be taken
CAPACITY = 1 << 17   # words that the knapsack fits exactly; the lengths before that are taken in proportion
STRETCH_BITS = 10    # of hashes; documents of one length are only sorted within one of so many stretches


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """Adds ``target`` to one row per source with its ``source`` and ``source_size``.

    Sources by code point, null last, weigh ``weights`` in turn. ``share`` of all words is dealt out by weight; no
    target goes above ``limit`` times its source's size, and what is above goes to the others by weight. Sources in
    the order of size by weight are those that reach their limit first, so one sort finds the level at which the rest
    share. Windows run over the sources' totals, not over documents.
    """
    turn = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("most", F.col("source_size") * float(limit))
    by_level = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, later = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()) * float(share)
    level = (total - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    # The level at the first source that stays below its limit; none does where everything is taken to the limit.
    leveled = weighed.withColumn("_level", level)
    fits = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("r"), F.col("_level").alias("level")))).over(W.partitionBy())
    return leveled.withColumn("_fit", fits["level"]).select(
        "source", "source_size", F.least(F.coalesce(F.col("_fit") * F.col("weight"), F.col("most")), F.col("most")).alias("target")
    )


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, target: float, limit: int = LIMIT, capacity: int = CAPACITY) -> np.ndarray:
    """How many documents of each length to take, a document up to ``limit`` times, so that their lengths sum up to
    ``target``, or to the nearest sum there is; of two equally near the smaller.

    All documents are taken as often as the target allows. All but ``capacity`` words of what is left, with room for the
    longest document, are taken in proportion to the counts, longest first. A bounded knapsack over what may still be taken
    of each length, first copies before further ones, fits the rest. Where that is not exact, and the whole target is
    within the capacity, the knapsack starts from nothing too: then no choice comes nearer.
    """
    whole = int((lengths * counts).sum())
    passes = min(limit, int(target // whole)) if whole else limit
    if passes == limit:
        return counts * (limit if whole else 0)
    take = _fit_behind(lengths, counts, target, passes, limit, capacity)
    if passes and target <= capacity and abs(int((take * lengths).sum()) - target) > 0.5:
        other = _fit_behind(lengths, counts, target, 0, limit, capacity)
        if abs(int((other * lengths).sum()) - target) < abs(int((take * lengths).sum()) - target):
            return other
    return take


def _fit_behind(lengths: np.ndarray, counts: np.ndarray, target: float, passes: int, limit: int, capacity: int) -> np.ndarray:
    """``fit_lengths`` with all documents taken ``passes`` times beforehand."""
    whole = int((lengths * counts).sum())
    take = passes * counts.astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    left = target - passes * whole
    if left > capacity:
        part = np.floor(counts * ((left - capacity) / whole)).astype(np.int64)
        take += part
        left -= int((part * lengths).sum())
        for i in order:
            # Rounding down may leave many words of long documents.
            if left <= capacity:
                break
            if 0 < lengths[i] <= left:
                more = int(min((passes + 1) * counts[i] - take[i], (left - capacity // 2) // lengths[i])) if left > capacity // 2 else 0
                more = max(more, 0)
                take[i] += more
                left -= more * int(lengths[i])
    # A sum above twice what is left is further away than taking nothing.
    room = 2 * int(left) + 1
    reached = np.zeros(room + 1, dtype=bool)
    reached[0] = True
    via = np.full(room + 1, -1, dtype=np.int32)
    items: list[tuple[int, int]] = []
    exact = math.ceil(left - 0.5)   # no sum is nearer than this one
    for copies in range(passes + 1, limit + 1):
        for i in order:
            length = int(lengths[i])
            spare, size = int(counts[i]), 1
            if copies == passes + 1:
                spare = int(copies * counts[i] - take[i])
            if not 0 < length <= room:
                continue
            spare = min(spare, room // length)
            while spare > 0:
                # Powers of two of one length make up every number of it.
                n = min(size, spare)
                step = n * length
                new = reached[:-step] & ~reached[step:]
                via[step:][new] = len(items)
                reached[step:] |= new
                items.append((i, n))
                spare -= n
                size *= 2
            if reached[exact]:
                break
        if reached[exact]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - left))])
    while at:
        i, n = items[via[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def _fit(group: pd.DataFrame, limit: int) -> pd.DataFrame:
    group = group.sort_values("size")
    lengths, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    take = fit_lengths(lengths, counts, float(group["target"].iloc[0]), limit)
    # Documents without words are taken as often as the source as a whole.
    whole = int((lengths * counts).sum())
    take[lengths == 0] = counts[lengths == 0] * (min(limit, int(group["target"].iloc[0] // whole)) if whole else 0)
    return group.assign(passes=(take // counts).astype(np.int32), extra=take % counts)[["key", "no_source", "size", "passes", "extra"]]


def mix(docs: DataFrame, key: str = "doc_id", weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: int = 1) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_copies`` and ``mix_taken``.

    A document's size is its number of words; null texts have none. A source is taken as often as a whole as its
    target allows, and the rest of the target is fitted from its counts of documents by exact length, to the nearest sum
    that up to ``limit`` copies make; of each length the documents first in the seeded hash order of their ids are taken
    once more than the others. ``mix_copies`` says how often a
    document is in the mix and ``mix_taken`` how many words that makes. Documents without words are taken as often as
    their source as a whole. Rows with equal ids stand side by side in that order, and either may be the last.

    Documents meet by source, length and stretch of hashes only, so a source or a length that holds a third of all
    rows lies in many tasks; one task fits a source's lengths, of which there are far fewer than documents.
    """
    stretch = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 64 - STRETCH_BITS)
    rows = docs.withColumns({
        "_key": F.coalesce("source", F.lit("")), "_no_source": F.col("source").isNull(),
        "mix_size": F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"),
        "_stretch": stretch.cast("int"), "_hash": F.xxhash64(F.lit(seed), F.col(key)),
    })
    by = ["_key", "_no_source", "mix_size"]
    held = materialise(rows.groupBy(*by, "_stretch").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    lengths = held.groupBy(*by).agg(F.sum("n").alias("n"))
    lengths = materialise(lengths.select(F.col("_key").alias("key"), F.col("_no_source").alias("no_source"), F.col("mix_size").alias("size"), "n"), "mix-lengths")
    sources = lengths.groupBy("key", "no_source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = sources.withColumn("source", F.when(~F.col("no_source"), F.col("key")))
    targets = source_targets(sources.select("source", "source_size"), weights, share, limit)
    targets = materialise(targets.select(F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("no_source"), "source_size", "target"), "mix-targets")
    plan = (
        lengths.join(targets, ["key", "no_source"]).groupBy("key", "no_source")
        .applyInPandas(lambda group: _fit(group, limit), "key string, no_source boolean, size long, passes int, extra long")
        .join(targets, ["key", "no_source"])
        .select(F.col("key").alias("_key"), F.col("no_source").alias("_no_source"), F.col("size").alias("mix_size"),
                "passes", "extra", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    )
    plan = materialise(plan, "mix-plan")
    before = F.sum("n").over(W.partitionBy(*by).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1))
    quotas = (
        held.withColumn("_before", F.coalesce(before, F.lit(0))).join(plan, by)
        .withColumn("_quota", F.least(F.greatest(F.col("extra") - F.col("_before"), F.lit(0)), F.col("n")))
        .drop("n", "_before", "extra")
    )
    quotas = materialise(quotas, "mix-quotas")
    place = F.row_number().over(W.partitionBy(*by, "_stretch").orderBy("_hash", key))
    copies = F.col("passes") + (place <= F.col("_quota")).cast("int")
    return (
        rows.join(quotas, [*by, "_stretch"]).withColumn("mix_copies", copies)
        .withColumn("mix_taken", F.col("mix_copies") * F.col("mix_size"))
        .select(*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken")
    )
