"""Model comparison job: stale samples in batches, and the judges' votes side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.operators.hashorder import batches, sample_rows
from driftwood.operators.votes import side_by_side, tally
from driftwood.session import materialise


def stale_batches(samples: DataFrame, key: list[str], n: int, size: int, seed: int = 42) -> DataFrame:
    stale = samples.filter(~F.col("l"))
    return batches(sample_rows(stale, key, n, seed), key, size, seed)


def compare(ratings: DataFrame, judged: DataFrame, key: list[str], judges: list[str]) -> DataFrame:
    """Votes of each judge on the judged rows.

    The judged keys are written first, so that Spark knows from their size whether to broadcast them.
    """
    keys = materialise(judged.select(*key), "judged")
    return side_by_side(tally(ratings.join(keys, key, "left_semi")), judges)
