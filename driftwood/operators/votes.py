"""Tally of judge answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.functions.text import VERDICT_MARKS, verdict


def tally(ratings: DataFrame, answer: str = "answer") -> DataFrame:
    """Answers per judge and verdict, 0 included, and the judge's total under verdict ``total``.

    An answer that names no verdict is not counted.
    """
    marks = F.col("verdict")
    counted = (
        ratings.withColumn("verdict", verdict(F.col(answer)))
        .groupBy("judge")
        .agg(*[F.count_if(marks == m).alias(m) for m in VERDICT_MARKS], F.count(marks).alias("total"))
    )
    cells = F.array(*[F.struct(F.lit(m).alias("verdict"), F.col(f"`{m}`").alias("votes")) for m in (*VERDICT_MARKS, "total")])
    return counted.select("judge", F.explode(cells).alias("_c")).select("judge", "_c.verdict", "_c.votes")


def side_by_side(votes: DataFrame, judges: list[str]) -> DataFrame:
    """One row per verdict, one column per judge."""
    return votes.groupBy("verdict").pivot("judge", judges).agg(F.sum("votes"))
