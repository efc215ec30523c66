"""Corpus profile job: densities of repository and version statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.operators.hashorder import sample_rows
from driftwood.operators.profile import (
    REPOSITORY_METRICS, VERSION_METRICS, density, long_metrics, pair_density, profiled_columns,
    repository_statistics, version_statistics,
)
from driftwood.operators.relations import wide_table
from driftwood.session import materialise


def _statistics(wide: DataFrame) -> list[tuple[str, DataFrame, list[str]]]:
    # One row per repository, read for ranges and for bins; counting distinct values is the dear part.
    repositories = materialise(repository_statistics(wide), "repository-statistics")
    return [
        ("repositories", repositories, list(REPOSITORY_METRICS)),
        ("versions", version_statistics(wide), list(VERSION_METRICS)),
    ]


def profiled_table(
    versions: DataFrame, functions: DataFrame, files: DataFrame, repositories: DataFrame,
    n: int | None = None, seed: int = 42,
) -> DataFrame:
    """What is profiled of the wide table, as a stage table without texts: ranges and densities read it several times.

    All versions unless a sample of ``n`` is asked for; a version makes one wide row, so then only the sample is
    joined and cleaned.
    """
    sampled = versions if n is None else sample_rows(versions, ["id"], n, seed)
    return materialise(profiled_columns(wide_table(sampled, functions, files, repositories)), "profiled")


def densities(wide: DataFrame) -> DataFrame:
    parts = [density(long_metrics(df, names)).withColumn("level", F.lit(level)) for level, df, names in _statistics(wide)]
    return parts[0].unionByName(parts[1])


def pair_densities(wide: DataFrame) -> DataFrame:
    parts = [pair_density(df, names).withColumn("level", F.lit(level)) for level, df, names in _statistics(wide)]
    return parts[0].unionByName(parts[1])
