"""Corpus rewrite job: new docstrings into their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.functions.text import docstring_block
from driftwood.operators.rewrite import renumber, rewrite_files


def docstring_edits(located: DataFrame, updated: DataFrame, key: list[str], path: str = "path") -> DataFrame:
    """Spans to replace: documented functions that have a new docstring."""
    return (
        located.filter(F.col("docstring_end_line").isNotNull())
        .join(updated.select(*key, "updated_docstring"), key)
        .select(
            path, F.col("docstring_start_line").alias("first_line"), F.col("docstring_end_line").alias("last_line"),
            docstring_block(F.col("updated_docstring")).alias("block"),
        )
    )


def rewrite_corpus(files: DataFrame, located: DataFrame, updated: DataFrame, key: list[str], path: str = "path"):
    """Rewritten files, and all functions with their new line numbers."""
    edits = docstring_edits(located, updated, key, path)
    return rewrite_files(files, edits, path), renumber(located, edits, path)
