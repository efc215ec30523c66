"""Scoring jobs: three ways to judge a docstring, one result schema.

A scorer is a function from a DataFrame of items and parameters to rows with ``item_idx``, ``mid`` and the
result fields. Generated texts, embeddings and token probabilities are input tables; nothing here runs a
model. ``fits`` and ``out_of_date`` read the same comparison in opposite ways and are separate columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood import schemas
from driftwood.functions.metrics import at_most, ieee_ratio
from driftwood.functions.text import clean_generation
from driftwood.functions.vectors import cosine, euclidean, norm, unit_euclidean
from driftwood.operators.tokens import geometric_means, token_weights

RESULT_COLUMNS = ("mid", "item_idx", *schemas.RESULT.names)


@dataclass(frozen=True)
class Parameters:
    """Parameters every method has."""

    test_threshold: float = 1.0

    def __post_init__(self):
        if self.test_threshold < 0:
            raise ValueError("test_threshold must be at least 0")


@dataclass(frozen=True)
class DistanceParameters(Parameters):
    distance_function: str = "cosine"
    normalize: bool = False
    sample_many: bool = True
    invert: bool = False

    def __post_init__(self):
        super().__post_init__()
        if self.distance_function not in schemas.DISTANCE_FUNCTIONS:
            raise ValueError(f"distance_function must be one of {schemas.DISTANCE_FUNCTIONS}")


@dataclass(frozen=True)
class PredictionParameters(Parameters):
    weight_decay: float = 0.5
    frequency_importance: float = 0.5

    def __post_init__(self):
        super().__post_init__()
        for name in ("weight_decay", "frequency_importance"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be in [0, 1]")


def pair_similarities(embeddings: DataFrame) -> DataFrame:
    """Similarity of each docstring and generated text to its item's code, for both distances and forms.

    One row per ``(mid, item_idx, role, sample_idx)``; the code vector is met once per text by an equi-join
    on the item. A text of an item without a code vector is an error.
    """
    codes = embeddings.filter(F.col("role") == "code").select(
        "item_idx", F.col("embedding").alias("_code"), norm(F.col("embedding")).alias("_code_norm")
    )
    texts = embeddings.filter(F.col("role") != "code").withColumn("_norm", norm(F.col("embedding")))
    a, b, norm_a, norm_b = F.col("_code"), F.col("embedding"), F.col("_code_norm"), F.col("_norm")
    return (
        texts.join(codes, "item_idx", "left").filter(_present(F.col("_code_norm"), "code vector"))
        .withColumn("cosine", cosine(a, b, norm_a, norm_b))
        .withColumn("euclidean", euclidean(a, b))
        .withColumn("euclidean_unit", unit_euclidean(a, b, norm_a, norm_b))
        .drop("_code", "embedding", "_code_norm", "_norm")
    )


def _present(value: Column, what: str) -> Column:
    """True; an item without the value is an error. As a filter it stays whatever columns are selected."""
    missing = F.raise_error(F.concat(F.lit(f"no {what} for item "), F.col("item_idx").cast("string"))).cast("boolean")
    return F.when(value.isNull(), missing).otherwise(F.lit(True))


# Measure of each distance function and normalisation; the cosine does not depend on the lengths.
_MEASURES = (("cosine", False, "cosine"), ("cosine", True, "cosine"),
             ("euclidean", False, "euclidean"), ("euclidean", True, "euclidean_unit"))


def lower_median(column: str):
    """The lower of the two middle values where their number is even."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}`)")


def score_pairs(pairs: DataFrame, settings: list[tuple[str, bool, bool]] | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Docstring and generation scores per item, model and setting.

    ``settings`` lists the wanted ones as distance function, normalisation and whether many samples count, by default
    all; no other is computed. ``labels`` are joined by item before an item's row is spread over models and settings.
    An item without a docstring vector is an error.

    The generations of an item and model are few, so their median is an aggregate over a handful of rows;
    with one sample the score is that of sample 0. Everything is grouped by the item, by which the pairs
    already lie together after their join, so no further shuffle is needed.
    """
    wanted = [(name, unit, m, many) for name, unit, m in _MEASURES for many in (False, True) if settings is None or (name, unit, many) in settings]
    if not wanted:
        raise ValueError("settings names no setting")
    columns = sorted({m for _, _, m, _ in wanted})
    first = F.col("sample_idx") == 0
    per_text = pairs.groupBy("item_idx", "role", "mid").agg(
        F.struct(*[(lower_median(m) if any(w[3] for w in wanted) else F.lit(None).cast("double")).alias(m) for m in columns]).alias("many"),
        F.struct(*[F.max(F.when(first, F.col(m))).alias(m) for m in columns]).alias("one"),
    )
    is_generated = F.col("role") == "gen"
    per_item = per_text.groupBy("item_idx").agg(
        F.max(F.when(~is_generated, F.col("one"))).alias("_doc"),
        F.collect_list(F.when(is_generated, F.struct("mid", "many", "one"))).alias("_models"),
    )
    spread = F.array(*[
        F.struct(
            F.lit(name).alias("distance_function"), F.lit(unit).alias("normalize"), F.lit(many).alias("sample_many"),
            F.col(f"_doc.{m}").alias("docstring_score"),
            F.col(f"_model.{'many' if many else 'one'}.{m}").alias("updated_docstring_score"),
        )
        for name, unit, m, many in wanted
    ])
    kept = [] if labels is None else [c for c in labels.columns if c != "item_idx"]
    items = per_item.filter(_present(F.col("_doc"), "docstring vector"))
    if labels is not None:
        items = items.join(labels, "item_idx")
    return (
        items.select("item_idx", *kept, "_doc", F.explode("_models").alias("_model"))
        .select(F.col("_model.mid").alias("mid"), "item_idx", *kept, F.explode(spread).alias("_s")).select("mid", "item_idx", *kept, "_s.*")
        .withColumn("ratio", ieee_ratio(F.col("docstring_score"), F.col("updated_docstring_score")))
    )


def setting_ratios(embeddings: DataFrame, settings: list[tuple[str, bool, bool]] | None = None, labels: DataFrame | None = None) -> DataFrame:
    return score_pairs(pair_similarities(embeddings), settings, labels)


def score_by_distance(embeddings: DataFrame, generations: DataFrame, parameters: DistanceParameters) -> DataFrame:
    """The ``distance`` method: embedding similarity of old and generated docstring to the code."""
    scored = setting_ratios(embeddings, [(parameters.distance_function, parameters.normalize, parameters.sample_many)])
    if parameters.invert:
        scored = scored.withColumn("ratio", ieee_ratio(F.col("updated_docstring_score"), F.col("docstring_score")))
    return _results(scored, generations, parameters.test_threshold)


def score_by_probability(
    probabilities: DataFrame, weights: DataFrame, generations: DataFrame, parameters: PredictionParameters
) -> DataFrame:
    """The ``prediction`` method: weighted mean token probability of old and generated docstring."""
    weighted = token_weights(
        probabilities, weights, ["mid", "item_idx", "role"], parameters.weight_decay, parameters.frequency_importance
    )
    scores = geometric_means(weighted, ["mid", "item_idx", "role"])
    both = scores.groupBy("mid", "item_idx").agg(
        F.max(F.when(F.col("role") == "doc", F.col("score"))).alias("docstring_score"),
        F.max(F.when(F.col("role") == "gen", F.col("score"))).alias("updated_docstring_score"),
    )
    both = both.withColumn("ratio", ieee_ratio(F.col("docstring_score"), F.col("updated_docstring_score")))
    return _results(both, generations, parameters.test_threshold)


def update_only(generations: DataFrame) -> DataFrame:
    """The ``update`` method: the generated text without scores or a decision."""
    return generations.filter(F.col("sample_idx") == 0).select(
        "mid", "item_idx", F.lit(None).cast("boolean").alias("out_of_date"),
        clean_generation(F.col("text")).alias("updated_docstring"),
        F.lit(None).cast("double").alias("docstring_score"), F.lit(None).cast("double").alias("updated_docstring_score"),
    )


def _results(scored: DataFrame, generations: DataFrame, threshold: float) -> DataFrame:
    first = generations.filter(F.col("sample_idx") == 0).select(
        "mid", "item_idx", clean_generation(F.col("text")).alias("updated_docstring")
    )
    return (
        scored.join(first.withColumn("_found", F.lit(True)), ["mid", "item_idx"], "left")
        .filter(_present(F.col("_found"), "generated text"))
        .withColumn("out_of_date", at_most(F.col("ratio"), F.lit(float(threshold))))
        .select(*RESULT_COLUMNS)
    )


Scorer = Callable[..., DataFrame]
SCORERS: dict[str, Scorer] = {
    "distance": score_by_distance, "prediction": score_by_probability, "update": update_only,
}


def scorer(test_method: str) -> Scorer:
    if test_method not in SCORERS:
        raise ValueError(f"test_method must be one of {tuple(SCORERS)}")
    return SCORERS[test_method]
