"""Registration of queries, and rounding that both engines share."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.sources.tables import read_table


class Entry(NamedTuple):
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(build, sql)
        return build
    return add


# Tables whose rows cost much work, with the key to spread them by where they come in few splits.
SPREAD = {"documents": "doc_id", "embeddings": "vec_id", "lineitem": "l_orderkey"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet", SPREAD.get(name))


def r6(column: Column | str) -> Column:
    """Six digits: engines may sum doubles in different orders."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6)
