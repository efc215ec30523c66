"""Scores on confusion counts, score ratios and the threshold grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grid of thresholds.
GRID_END = 3.0
GRID_SIZE = 200
GRID_STEP = GRID_END / (GRID_SIZE - 1)


def ieee_ratio(numerator: Column, denominator: Column) -> Column:
    """Division as IEEE 754 defines it, where Spark in ANSI mode would raise."""
    by_zero = (
        F.when(F.isnan(numerator) | (numerator == 0), F.lit(float("nan")))
        .when(numerator > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
    return F.when(denominator == 0, by_zero).otherwise(numerator / F.nullif(denominator, F.lit(0.0)))


def at_most(ratio: Column, threshold: Column) -> Column:
    """``ratio <= threshold``, false for NaN, which Spark would order above every number."""
    return ~F.isnan(ratio) & (ratio <= threshold)


def p4_score(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    tp, tn, fp, fn = (c.cast("double") for c in (tp, tn, fp, fn))
    product = F.lit(4.0) * tp * tn
    return product / F.nullif(product + (tp + tn) * (fp + fn), F.lit(0.0))


def matthews_correlation(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    tp, tn, fp, fn = (c.cast("double") for c in (tp, tn, fp, fn))
    margins = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return (tp * tn - fp * fn) / F.nullif(F.sqrt(margins), F.lit(0.0))


def grid_value(index: Column) -> Column:
    return index.cast("double") * F.lit(GRID_STEP)


def grid_index(ratio: Column) -> Column:
    """Index of the first grid threshold that is at least ``ratio``; null where there is none.

    The division gives the index up to rounding; comparing with the grid values next to it settles it.
    """
    inside = ~F.isnan(ratio) & (ratio <= F.lit(GRID_END) + F.lit(GRID_STEP))
    bounded = F.when(inside, F.greatest(ratio, F.lit(0.0)))
    guess = F.ceil(bounded / F.lit(GRID_STEP)).cast("int")
    settled = (
        F.when((guess > 0) & (grid_value(guess - 1) >= bounded), guess - 1)
        .when(grid_value(guess) >= bounded, guess)
        .otherwise(guess + 1)
    )
    return F.when(settled < GRID_SIZE, settled)


def grid_column() -> Column:
    return F.sequence(F.lit(0), F.lit(GRID_SIZE - 1))
