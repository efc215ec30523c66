"""Token jobs: token weights of a corpus, and blocks of training tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.operators.hashorder import split_by_hash
from driftwood.operators.packing import assign_blocks, fill_blocks
from driftwood.operators.tokens import (
    count_tokens, explode_tokens, inverse_log_frequency, token_frequencies, vocabulary, words,
)

# Seed and test share of the split before packing.
SPLIT_SEED = 421337
TEST_FRACTION = 0.1


def token_weight_table(samples: DataFrame, vocab: DataFrame | None = None, text: str = "d") -> DataFrame:
    """Weights of all tokens of the vocabulary, by default that of the texts themselves."""
    counted = count_tokens(explode_tokens(samples, [], words(F.col(text))))
    return inverse_log_frequency(token_frequencies(counted, vocabulary(counted) if vocab is None else vocab))


def training_blocks(
    sequences: DataFrame, key: list[str], eos: int, tokens: str = "input_ids", overflow: str = "carry", **sizes
) -> DataFrame:
    """Train and test blocks: each sequence ended by ``eos``, split 90 to 10, packed within its part."""
    ended = sequences.withColumn(tokens, F.concat(F.col(tokens), F.array(F.lit(eos))))
    test, train = split_by_hash(ended, key, TEST_FRACTION, SPLIT_SEED)
    parts = [
        fill_blocks(assign_blocks(part, key, tokens, overflow=overflow, **sizes), tokens, eos).withColumn("part", F.lit(name))
        for name, part in (("train", train), ("test", test))
    ]
    return parts[0].unionByName(parts[1])
