"""Version-history job: from file versions to the four entity tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.functions.hashing import entity_id
from driftwood.functions.text import short_label
from driftwood.operators.chains import collapse_unchanged, flag_changes, link_versions
from driftwood.operators.extract import documented_functions, extract_functions
from driftwood.session import materialise
from driftwood.sources.history import decode_sources, python_files


@dataclass(frozen=True)
class Entities:
    files: DataFrame
    functions: DataFrame
    versions: DataFrame


def mine_functions(file_versions: DataFrame, newest_first: bool = True) -> DataFrame:
    """Documented functions of all changed file versions.

    Native filters and the collapse of equal contents come first, so that only what changed is parsed.
    """
    sources, chain = python_files(file_versions), ["repo", "path"]
    changed = collapse_unchanged(sources, chain, ["seq"], "content", newest_first)
    return documented_functions(extract_functions(decode_sources(changed)))


def version_history(file_versions: DataFrame, newest_first: bool = True, staged: bool = True) -> Entities:
    """Files, functions and versions; equal names in one file share a chain.

    ``repo`` in the input is a repository's full name, whose digest is the repository's id.

    The mined functions are written as a stage table: three outputs read them, and parsing is the
    expensive step.
    """
    mined = mine_functions(file_versions, newest_first)
    if staged:
        mined = materialise(mined, "mined")
    chain = ["repo", "path", "name"]
    order = ["seq", "node"]
    flagged = flag_changes(mined, chain, order, newest_first=newest_first)
    # The splitters of the next step are sampled, and the similarities need not be worked out twice for that.
    flagged = materialise(flagged, "flagged")
    file_id = entity_id(F.col("repo"), F.col("path"))
    identified = (
        flagged.withColumn("file", file_id)
        .withColumn("function", entity_id(F.col("file"), F.col("name")))
        .withColumn("id", entity_id(F.col("function"), F.col("seq"), F.col("node")))
    )
    linked = link_versions(identified, chain, order, newest_first=newest_first)
    versions = linked.select(
        "id", short_label(F.col("commit")).alias("commit"), F.col("committed_at").alias("date"), "code", "docstring",
        "code_updated", "docstring_updated", "code_similarity", "docstring_similarity", "function", "last_version",
    )
    paths = python_files(file_versions).select("repo", "path").distinct()
    files = paths.select(file_id.alias("id"), "path", F.md5("repo").alias("repo"))
    functions = mined.select("repo", "path", "name").distinct().select(
        entity_id(file_id, F.col("name")).alias("id"), "name", file_id.alias("file")
    )
    return Entities(files, functions, versions)
