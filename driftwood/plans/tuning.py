"""Threshold tuning and its confirmation on a second sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.operators.confusion import SETTING, best_thresholds, confusion, threshold_curve, with_scores
from driftwood.operators.hashorder import sample_rows
from driftwood.plans.scoring import setting_ratios
from driftwood.session import materialise


def labelled_ratios(embeddings: DataFrame, labels: DataFrame, settings: list[tuple[str, bool, bool]] | None = None) -> DataFrame:
    return setting_ratios(embeddings, settings, labels.select("item_idx", "l"))


def tune(embeddings: DataFrame, labels: DataFrame) -> DataFrame:
    """Scored confusion counts of all thresholds and settings."""
    return with_scores(threshold_curve(labelled_ratios(embeddings, labels)))


def best(embeddings: DataFrame, labels: DataFrame) -> DataFrame:
    return best_thresholds(tune(embeddings, labels), SETTING)


def confirm(
    embeddings: DataFrame, labels: DataFrame, threshold: float, distance_function: str, normalize: bool,
    sample_many: bool, sample_size: int, seed: int = 1337,
) -> DataFrame:
    """Scores of a fixed threshold on a sample of items drawn with another seed; items are met by key.

    The sample is written first, so that Spark knows from its size whether to broadcast it.
    """
    drawn = materialise(sample_rows(labels, ["item_idx"], sample_size, seed), "drawn")
    items = embeddings.join(drawn.select("item_idx"), "item_idx", "left_semi")
    chosen = labelled_ratios(items, drawn, [(distance_function, normalize, sample_many)])
    return with_scores(confusion(chosen, SETTING, F.lit(float(threshold))))
