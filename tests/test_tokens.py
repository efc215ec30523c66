"""Token weights, weighted means and packing."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftwood.operators import packing, tokens
from driftwood.plans.training_blocks import training_blocks


def table(spark, probabilities):
    rows = [(t, i, i % 3, p) for t, ps in probabilities.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "text string, pos int, token_id int, prob double")


def weights(spark):
    return spark.createDataFrame([(0, 0.0), (1, 0.5), (2, 1.0)], "token_id int, weight double")


def expected(ps, decay, importance):
    k, n = tokens.decay_exponent(decay), len(ps)
    ws = [(1 - (i / max(n - 1, 1)) ** k) * (1 + importance * ((i % 3) * 0.5 - 1)) for i in range(n)]
    logs = [w * (math.log(p) if p else -math.inf) for w, p in zip(ws, ps)]
    return math.exp(sum(logs) / sum(ws))


@pytest.mark.parametrize("stretch", [2, 65_536])
@pytest.mark.parametrize("decay, importance", [(0.5, 0.0), (0.2, 0.7), (0.9, 0.3)])
def test_weighted_means(spark, monkeypatch, stretch, decay, importance):
    monkeypatch.setattr(tokens, "STRETCH", stretch)
    rng = random.Random(5)
    texts = {f"t{n}": [rng.uniform(0.01, 1) for _ in range(n)] for n in (1, 2, 3, 7, 20)}
    weighted = tokens.token_weights(table(spark, texts), weights(spark), ["text"], decay, importance)
    got = {r["text"]: r["score"] for r in tokens.geometric_means(weighted, ["text"]).collect()}
    assert got == pytest.approx({t: expected(ps, decay, importance) for t, ps in texts.items()})
    sums = tokens.normalised_weights(weighted, ["text"]).groupBy("text").agg(F.sum("norm_weight").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums) and len(sums) == len(texts)


def test_weights_from_a_table_with_frequencies_or_carried_along(spark):
    """A lookup that knows frequencies, and probabilities that have their weights, give what a plain join gives."""
    rows = table(spark, {"a": [0.5, 0.25, 0.125, 0.3], "b": [0.1]})
    plain = tokens.token_weights(rows, weights(spark), ["text"], 0.3, 0.7)
    counted = weights(spark).withColumn("frequency", F.lit(10) - F.col("token_id"))
    wanted = sorted(map(tuple, plain.select("text", "pos", "raw_weight").collect()))
    carried = rows.join(weights(spark), "token_id")
    for found in (tokens.token_weights(rows, counted, ["text"], 0.3, 0.7), tokens.token_weights(carried, None, ["text"], 0.3, 0.7)):
        assert sorted(map(tuple, found.select("text", "pos", "raw_weight").collect())) == wanted
    few = counted.filter("token_id < 2")
    with pytest.raises(PySparkException, match="no weight for token 2"):
        tokens.token_weights(rows, few, ["text"], 0.3, 0.7).collect()


def test_impossible_tokens(spark):
    """A probability of 0 makes the mean 0, or NaN where its weight is 0."""
    texts = {"first": [0.0, 0.5, 0.5], "last": [0.5, 0.5, 0.0]}
    weighted = tokens.token_weights(table(spark, texts), weights(spark), ["text"], 0.5, 0.0)
    got = {r["text"]: r["score"] for r in tokens.geometric_means(weighted, ["text"]).collect()}
    assert got["first"] == 0.0 and math.isnan(got["last"])


def test_token_without_weight_is_an_error(spark):
    few = weights(spark).filter("token_id < 2")
    with pytest.raises(PySparkException, match="no weight for token 2"):
        tokens.token_weights(table(spark, {"t": [0.5] * 3}), few, ["text"], 0.5, 0.5).collect()


def test_extreme_decay(spark):
    for decay in (0.0, 1.0):
        weighted = tokens.token_weights(table(spark, {"t": [0.5] * 3}), weights(spark), ["text"], decay, 0.0)
        assert all(r["position_weight"] == pytest.approx(0.0 if decay == 1.0 and r["pos"] else float(r["pos"] < 2)) for r in weighted.collect())


def test_frequencies_over_a_larger_vocabulary(spark):
    rows = spark.createDataFrame([("a b a",), ("",)], "t string")
    vocab = tokens.vocabulary(spark.createDataFrame([("a",), ("b",), ("c",)], "token string"))
    counted = tokens.count_tokens(tokens.explode_tokens(rows, [], tokens.words(F.col("t"))))
    got = {r["token"]: (r["frequency"], r["weight"]) for r in tokens.inverse_log_frequency(tokens.token_frequencies(counted, vocab)).collect()}
    assert {t: f for t, (f, _) in got.items()} == {"a": 2, "b": 1, "c": 0}
    assert got["a"][1] == 0.0 and got["c"][1] == 1.0


def next_fit(lengths, size, carry):
    """Block of each length, None where it is dropped."""
    block, used, placed = 0, 0, []
    for n in lengths:
        if used + n <= size:
            used += n
            placed.append(block)
        else:
            block += 1
            used = n if carry else 0
            placed.append(block if carry else None)
    return placed


@pytest.mark.parametrize("overflow", ["carry", "drop"])
def test_packing(spark, overflow):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, [i] * rng.randrange(0, 30)) for i in range(300)], "id long, input_ids array<int>")
    assigned = packing.assign_blocks(rows, ["id"], block_size=24, bucket_rows=40, overflow=overflow, long="drop")
    everything = packing.assign_blocks(rows, ["id"], block_size=24, bucket_rows=40, long="drop").collect()
    by_bucket = {}
    for r in sorted(everything, key=lambda r: (r["bucket"], r["slot"])):
        by_bucket.setdefault(r["bucket"], []).append(r)
    want = {r["id"]: b for rs in by_bucket.values() for r, b in zip(rs, next_fit([len(r["input_ids"]) for r in rs], 24, overflow == "carry")) if b is not None}
    got = assigned.collect()
    assert {r["id"]: r["block"] for r in got} == want
    blocks = packing.fill_blocks(assigned, "input_ids", -1, 24).collect()
    assert all(len(b["input_ids"]) == 24 and b["labels"] == b["input_ids"] for b in blocks)
    assert sorted(t for b in blocks for t in b["input_ids"] if t >= 0) == sorted(t for r in got for t in r["input_ids"])


def test_training_blocks_keep_every_token(spark):
    rows = spark.createDataFrame([(i, [i] * (i % 9)) for i in range(200)], "id long, input_ids array<int>")
    blocks = training_blocks(rows, ["id"], -1, block_size=16, bucket_rows=20).collect()
    assert {b["part"] for b in blocks} == {"train", "test"}
    assert sorted(t for b in blocks for t in b["input_ids"] if t >= 0) == sorted(i for i in range(200) for _ in range(i % 9))


def test_unknown_overflow(spark):
    with pytest.raises(ValueError):
        packing.assign_blocks(spark.createDataFrame([(1, [1])], "id long, input_ids array<int>"), ["id"], overflow="split")
