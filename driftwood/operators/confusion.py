"""Confusion counts over thresholds and the best threshold of a setting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwood.functions.metrics import (
    at_most, grid_column, grid_index, grid_value, matthews_correlation, p4_score,
)

SETTING = ["mid", "distance_function", "normalize", "sample_many"]


def confusion(df: DataFrame, by: list[str], threshold: Column, ratio: str = "ratio", label: str = "l") -> DataFrame:
    """True and false positives and negatives at a threshold; a ratio up to it says the docstring fits.

    Rows without a ratio count nowhere, here as in ``threshold_curve``.
    """
    fits = at_most(F.col(ratio), threshold)
    truth = F.col(label)
    df = df.filter(F.col(ratio).isNotNull())
    return df.groupBy(*by).agg(
        F.count_if(truth & fits).alias("tp"), F.count_if(~truth & ~fits).alias("tn"),
        F.count_if(~truth & fits).alias("fp"), F.count_if(truth & ~fits).alias("fn"),
    )


def with_scores(counts: DataFrame) -> DataFrame:
    cells = [F.col(c) for c in ("tp", "tn", "fp", "fn")]
    return counts.withColumn("p4", p4_score(*cells)).withColumn("mcc", matthews_correlation(*cells))


def threshold_curve(ratios: DataFrame, by: list[str] = SETTING, ratio: str = "ratio", label: str = "l") -> DataFrame:
    """Confusion counts at every grid threshold, from one pass over the ratios.

    Each ratio is mapped to the first threshold it does not exceed. Counted per threshold and label that
    leaves at most 201 cells per setting, and the counts of all 200 thresholds are sums over these.
    """
    cells = (
        ratios.filter(F.col(ratio).isNotNull()).withColumn("grid_idx", grid_index(F.col(ratio)))
        .groupBy(*by, "grid_idx")
        .agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    )
    gathered = cells.groupBy(*by).agg(
        F.collect_list(F.struct("grid_idx", "pos", "neg")).alias("_cells"),
        F.sum("pos").alias("_all_pos"), F.sum("neg").alias("_all_neg"),
    )

    def up_to(index: Column, field: str) -> Column:
        reached = F.filter("_cells", lambda cell: cell["grid_idx"] <= index)
        return F.aggregate(reached, F.lit(0).cast("long"), lambda total, cell: total + cell[field])

    return (
        gathered.withColumn("grid_idx", F.explode(grid_column()))
        .withColumn("tp", up_to(F.col("grid_idx"), "pos"))
        .withColumn("fp", up_to(F.col("grid_idx"), "neg"))
        .withColumn("tn", F.col("_all_neg") - F.col("fp"))
        .withColumn("fn", F.col("_all_pos") - F.col("tp"))
        .withColumn("test_threshold", grid_value(F.col("grid_idx")))
        .select(*by, "grid_idx", "test_threshold", "tp", "tn", "fp", "fn")
    )


def threshold_curve_direct(ratios: DataFrame, by: list[str] = SETTING, ratio: str = "ratio", label: str = "l") -> DataFrame:
    """The same curve by comparing every ratio with all 200 thresholds; for checks on small inputs."""
    compared = ratios.withColumn("grid_idx", F.explode(grid_column())).withColumn("test_threshold", grid_value(F.col("grid_idx")))
    return confusion(compared, [*by, "grid_idx", "test_threshold"], F.col("test_threshold"), ratio, label)


def best_thresholds(curve: DataFrame, by: list[str] = SETTING) -> DataFrame:
    """Per setting the threshold with the highest p4, the lowest one on ties (200 rows per setting)."""
    rank = W.partitionBy(*by).orderBy(F.desc_nulls_last("p4"), "test_threshold")
    return curve.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") == 1).drop("_rank")


def best_setting(curve: DataFrame, by: list[str] = SETTING) -> DataFrame:
    return curve.orderBy(F.desc_nulls_last("p4"), *by, "test_threshold").limit(1)


def marked_curve(curve: DataFrame, by: list[str] = SETTING) -> DataFrame:
    """Curve rows with the setting's best and the overall best p4 marked; 200 rows per setting."""
    best = best_thresholds(curve, by).select(*by, F.col("test_threshold").alias("_at"), F.col("p4").alias("_p4"))
    top = best_setting(curve, by).select("p4")
    return (
        curve.join(F.broadcast(best), by)
        .withColumn("is_local_best", F.col("test_threshold") == F.col("_at"))
        .withColumn("is_global_best", F.col("is_local_best") & (F.col("_p4") == top.scalar()))
        .drop("_at", "_p4")
    )


