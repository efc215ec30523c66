"""File versions: the history of every source file, one row per commit that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood import schemas
from driftwood.functions.text import has_min_newlines, normalise_source


def read_file_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FILE_VERSION).parquet(path)


def read_source_tree(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """A plain folder of sources as the newest and only version of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(path)
    return files.select(
        F.lit(repo).alias("repo"), F.col("path"), F.lit("working-tree").alias("commit"),
        F.col("modificationTime").alias("committed_at"), F.lit(0).cast("long").alias("seq"), F.col("content"),
    )


def python_files(df: DataFrame, path: str = "path") -> DataFrame:
    return df.filter(F.col(path).endswith(".py"))


def decode_sources(df: DataFrame, content: str = "content", name: str = "source", min_newlines: int = 3) -> DataFrame:
    """Decoded text of files with enough lines; files that are not UTF-8 are left out."""
    text = F.col(content).cast("string")
    return (
        df.filter(has_min_newlines(text, min_newlines) & F.is_valid_utf8(text))
        .withColumn(name, normalise_source(text))
        .drop(content)
    )


def iso_date(seconds):
    """Epoch seconds as an ISO date in the session's time zone (UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")
