"""Token frequencies, token weights and weighted probability means."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwood.operators.hashorder import dense_index
from driftwood.operators.lookup import lookup_join
from driftwood.session import materialise

# Fixed value: keeps the decay away from the poles of the tangent.
EPSILON = 1e-16
# A text is joined with its sums in stretches of this many tokens.
STRETCH = 65_536


def words(text: Column) -> Column:
    """The default tokens: lower-case words."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def explode_tokens(df: DataFrame, keep: list[str], tokens: Column) -> DataFrame:
    """One row per token with its position and the number of tokens in its text.

    The outer form with a filter behind it gives the same rows as ``posexplode``, for which Spark would
    add a filter on the array before it and so compute the tokens twice.
    """
    return (
        df.withColumn("_tokens", tokens)
        .select(*keep, F.size("_tokens").alias("n_tokens"), F.posexplode_outer("_tokens").alias("pos", "token"))
        .filter(F.col("pos").isNotNull())
    )


def count_tokens(tokens: DataFrame) -> DataFrame:
    """Occurrences per token, as a stage table: it is read several times, and far smaller than the texts."""
    return materialise(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_n")), "token-counts")


def vocabulary(counted: DataFrame, seed: int = 42) -> DataFrame:
    """Distinct tokens, numbered in hash order so that no task sees them all."""
    return dense_index(counted.select("token"), ["token"], seed, "token_id")


def token_frequencies(counted: DataFrame, vocab: DataFrame) -> DataFrame:
    """How often each token of the vocabulary occurs, 0 included."""
    return vocab.join(counted, "token", "left").select("token_id", "token", F.coalesce("_n", F.lit(0)).alias("frequency"))


def inverse_log_frequency(frequencies: DataFrame) -> DataFrame:
    """Weight of each token: 0 for the most frequent one, rising as tokens get rarer."""
    log_frequency = F.log(F.col("frequency").cast("double") + 1 + EPSILON)
    largest = frequencies.agg(F.max("frequency").alias("m")).select(F.log(F.col("m").cast("double") + 1 + EPSILON))
    # The logarithm is monotone, so the largest relative value is that of the largest frequency: 1.
    return frequencies.withColumn("weight", F.lit(1.0) - log_frequency / F.nullif(largest.scalar(), F.lit(0.0)))


def decay_exponent(weight_decay: float) -> float:
    inside = max(min(weight_decay, 1.0 - EPSILON), EPSILON)
    return math.tan((1.0 - inside) * math.pi / 2)


def position_weight(pos: Column, n: Column, weight_decay: float) -> Column:
    """``1 - x ** k``: 1 for the first token, 0 for the last of several."""
    x = pos.cast("double") / F.greatest(n - 1, F.lit(1))
    return F.lit(1.0) - F.pow(x, F.lit(decay_exponent(weight_decay)))


def frequency_weight(weight: Column, importance: float) -> Column:
    return F.lit(1.0) + F.lit(float(importance)) * (weight - F.lit(1.0))


def with_text_totals(tokens: DataFrame, text: list[str], totals: list[Column], length: Column) -> DataFrame:
    """Adds per-text aggregates to each token.

    The sums are copied once per stretch of positions and joined on it too, so a text with a huge number
    of tokens spreads over tasks. Spark estimates exploded tokens far too small, hence the hint against
    broadcasting them.
    """
    sums = (
        tokens.groupBy(*text).agg(*totals, length.alias("_len"))
        .withColumn("_stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_len") - 1) / STRETCH))))
        .drop("_len")
    )
    return tokens.withColumn("_stretch", F.floor(F.col("pos") / STRETCH)).join(sums.hint("merge"), [*text, "_stretch"]).drop("_stretch")


def token_weights(
    probabilities: DataFrame, weights: DataFrame | None, text: list[str], weight_decay: float, frequency_importance: float
) -> DataFrame:
    """Adds ``raw_weight``: position weight times frequency weight. A token without a weight is an error.

    ``n_tokens`` is taken from the input where it has it, and counted otherwise. Probabilities that met their weights where
    their tokens were numbered carry them, and need no ``weights``. Where ``weights`` have the ``frequency``
    they were made from, frequent tokens are looked up where they lie and only rare ones are shuffled.
    """
    if "n_tokens" not in probabilities.columns:
        size = F.max("pos") + 1
        probabilities = with_text_totals(probabilities, text, [size.alias("n_tokens")], size)
    unknown = F.raise_error(F.concat(F.lit("no weight for token "), F.col("token_id").cast("string")))
    found = F.when(F.col("weight").isNull(), unknown).otherwise(F.col("weight"))
    if "weight" in probabilities.columns:
        met = probabilities
    elif "frequency" in weights.columns:
        met = lookup_join(probabilities, weights.select("token_id", "weight", "frequency"), "token_id", "frequency")
    else:
        met = probabilities.join(weights.select("token_id", "weight"), "token_id", "left")
    return (
        met.withColumn("weight", found)
        .withColumn("position_weight", position_weight(F.col("pos"), F.col("n_tokens"), weight_decay))
        .withColumn("raw_weight", F.col("position_weight") * frequency_weight(F.col("weight"), frequency_importance))
    )


def texts_together(probabilities: DataFrame, text: list[str]) -> DataFrame:
    """Tokens dealt out by their texts before their weights are multiplied, for a window over a text's tokens.

    Numbers and weights of tokens repeat, so a shuffle packs them well; their products with the weights of positions do not.
    """
    return probabilities.repartition(*text)


def normalised_weights(weighted: DataFrame, text: list[str]) -> DataFrame:
    """Adds ``norm_weight``, the weights of each text summing to 1.

    The tokens of a text came from one cell, so a window holds them; it spills where that cell is very large.
    """
    total = F.sum("raw_weight").over(W.partitionBy(*text))
    return weighted.withColumn("norm_weight", F.col("raw_weight") / F.nullif(total, F.lit(0.0)))


def geometric_means(weighted: DataFrame, text: list[str], name: str = "score") -> DataFrame:
    """Weighted geometric mean of the token probabilities of each text.

    The common factor of normalised weights cancels out, so one aggregate does. A probability of 0 counts
    as minus infinity, and as NaN under a weight of 0.
    """
    log_prob = F.when(F.col("prob") == 0, F.lit(float("-inf"))).otherwise(F.log(F.nullif(F.col("prob"), F.lit(0.0))))
    total = F.sum("raw_weight")
    # A text of one token of weight 0 has no mean.
    return weighted.groupBy(*text).agg(
        F.exp(F.sum(F.col("raw_weight") * log_prob) / F.nullif(total, F.lit(0.0))).alias(name)
    )
