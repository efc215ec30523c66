"""Joins that build and cut the wide sample table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood import schemas
from driftwood.functions.text import body_begin, clean_code
from driftwood.session import materialise


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose parent is missing."""
    return child.join(parent.select(F.col(parent_key).alias(foreign_key)), foreign_key, "left_anti")


def denormalise(
    versions: DataFrame, functions: DataFrame, files: DataFrame, repositories: DataFrame, check: bool = True
) -> DataFrame:
    """Version to function to file to repository as one table.

    Functions, files and repositories are joined first, as they hold no texts; versions meet them once, by function.
    With ``check`` a missing parent raises while the rows are read: the joins are left joins, and a filter on what
    they found, which no choice of columns takes out, calls ``raise_error``. That spares a second pass for the check.
    """
    how = "left" if check else "inner"
    f = functions.select(F.col("id").alias("function"), F.col("name").alias("function_name"), "file")
    p = files.select(F.col("id").alias("file"), F.col("path").alias("filename"), "repo")
    metrics = ["size", "open_issues", "watchers", "contributors", "forks", "contributions", "stars"]
    r = repositories.select(F.col("id").alias("repo"), F.col("full_name").alias("repo_name"), *metrics)
    found = f.join(p, "file", how).join(r.withColumn("_found", F.lit(True)), "repo", how)
    wide = versions.join(found, "function", how)
    if check:
        missing = F.raise_error(F.concat(F.lit("no parent for version "), F.col("id").cast("string"))).cast("boolean")
        wide = wide.filter(F.when(F.col("_found").isNull(), missing).otherwise(F.lit(True)))
    return wide.drop("_found")


def wide_table(
    versions: DataFrame, functions: DataFrame, files: DataFrame, repositories: DataFrame, complete_only: bool = False
) -> DataFrame:
    """The sample table: cleaned code, body offset, and everything known about function, file and repository.

    ``complete_only`` drops rows with a null before their code is cleaned, and before the joins where it can.
    """
    if complete_only:
        versions = complete_rows(versions)
    joined = denormalise(versions, functions, files, repositories)
    if complete_only:
        joined = complete_rows(joined)
    return (
        joined
        .withColumn("code", clean_code(F.col("code")))
        .withColumn("body_begin", body_begin(F.col("code")))
        .select(*schemas.WIDE_COLUMNS)
    )


def sample_keys(versions: DataFrame, functions: DataFrame, files: DataFrame, repositories: DataFrame) -> DataFrame:
    """``id`` and ``repo_name`` of the versions whose rows of the wide table have no null.

    Texts are looked at where they are read and not carried along. A missing parent is an error.
    """
    code = clean_code(F.col("code"))
    whole = complete_rows(versions.withColumn("code", code).withColumn("body_begin", body_begin(F.col("code"))))
    return complete_rows(denormalise(whole.select("id", "function"), functions, files, repositories)).select("id", "repo_name")


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without a null in ``columns``, by default those of the wide table that ``df`` has.

    Removes the first version of every chain. Columns that the wide table does not have may be null.
    """
    return df.dropna("any", subset=[c for c in schemas.WIDE_COLUMNS if c in df.columns] if columns is None else columns)


def hold_out(df: DataFrame, group: str, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the held-out groups, and all others.

    The names are written first: both parts read them, and from the file's size Spark knows whether they
    are few enough to broadcast.
    """
    names = materialise(held.select(group).distinct(), "held-out")
    return df.join(names, group, "left_semi"), df.join(names, group, "left_anti")


def attach_generations(items: DataFrame, generations: DataFrame) -> DataFrame:
    """Items with the texts generated for them, one row per model, item and sample; an item without one is an error."""
    missing = F.raise_error(F.concat(F.lit("no text generated for item "), F.col("item_idx").cast("string"))).cast("boolean")
    joined = items.join(generations, "item_idx", "left")
    return joined.filter(F.when(F.col("mid").isNull(), missing).otherwise(F.lit(True)))


def fan_out(items: DataFrame, models: list[str], samples: int) -> DataFrame:
    """Work list of models by samples by items; the small lists are literals inside each row."""
    return (
        items.withColumn("mid", F.explode(F.array(*[F.lit(m) for m in models])))
        .withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    )


def replicate(df: DataFrame, n: int, name: str = "sample_idx") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Row count of each named stage."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), "rows") for name, df in stages.items()]
    result = counts[0]
    for part in counts[1:]:
        result = result.unionByName(part)
    return result


def sum_of_optional(df: DataFrame, by: list[str], counter: Column, name: str = "total") -> DataFrame:
    """Sum of a counter that some rows lack, and how many have it."""
    return df.groupBy(*by).agg(F.sum(counter).alias(name), F.count(counter).alias("counted"))
