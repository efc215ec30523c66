"""Samples, splits and pairings in hash order."""

import hashlib
import random
from collections import Counter

import pytest

from driftwood.operators import hashorder as h


def digest(seed, key):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    """One group holds a third of the rows, the others are small."""
    rng = random.Random(1)
    data = [(i, "hot" if i % 3 == 0 else f"g{int(rng.paretovariate(1)) % 40}", f"text {i % 50}") for i in range(1500)]
    return spark.createDataFrame(data, "id long, grp string, text string").repartition(5).cache()


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_dense_index_is_the_hash_order(rows):
    got = {r["id"]: r["idx"] for r in h.dense_index(rows, ["id"], 42).collect()}
    assert got == {key: i for i, key in enumerate(sorted(got, key=lambda k: digest(42, k)))}


@pytest.mark.parametrize("n", [0, 1, 7, 512, 1500, 9999])
def test_sample_size_and_rows(rows, n):
    assert ids(h.sample_rows(rows, ["id"], n, 5)) == sorted(sorted(range(1500), key=lambda k: digest(5, k))[:n])


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.8, 1.0])
@pytest.mark.parametrize("exact", [False, True])
def test_split_is_disjoint_and_complete(rows, fraction, exact):
    train, test = (ids(part) for part in h.split_by_hash(rows, ["id"], fraction, 9, exact))
    assert sorted(train + test) == list(range(1500))
    assert len(train) == round(fraction * 1500) if exact else abs(len(train) - fraction * 1500) < 100


def water_filled(sizes, n):
    """One row more per group and round, in key order, until n are taken."""
    taken = Counter()
    while sum(taken.values()) < n:
        for group in sorted(sizes):
            if taken[group] < sizes[group] and sum(taken.values()) < n:
                taken[group] += 1
    return {g: c for g, c in taken.items() if c}


@pytest.mark.parametrize("n", [1, 5, 39, 100, 333, 1000, 1499, 1500])
def test_balanced_sample_quotas(rows, n):
    sizes = {r["grp"]: r["count"] for r in rows.groupBy("grp").count().collect()}
    sample = h.balanced_sample(rows, "grp", ["id"], n).collect()
    assert dict(Counter(r["grp"] for r in sample)) == water_filled(sizes, n)
    assert len({r["id"] for r in sample}) == n


def test_balanced_sample_without_broadcast(rows):
    assert ids(h.balanced_sample(rows, "grp", ["id"], 200, max_broadcast_groups=0)) == ids(h.balanced_sample(rows, "grp", ["id"], 200))


def test_balanced_sample_too_large(rows):
    with pytest.raises(ValueError):
        h.balanced_sample(rows, "grp", ["id"], 1501)
    assert h.balanced_sample(rows, "grp", ["id"], 1501, at_most=True).count() == 1500


def test_no_row_keeps_its_own_text(rows):
    pairs = h.mismatched_pairs(rows, ["id"], "text", 42).collect()
    order = sorted(range(1500), key=lambda k: digest(42, k))
    donor = {key: order[(i + 1) % 1500] for i, key in enumerate(order)}
    assert {r["id"]: r["text"] for r in pairs} == {key: f"text {donor[key] % 50}" for key in order}
    labelled = h.with_negatives(rows, ["id"], "text")
    assert labelled.filter("label").count() == 1500
    negatives = labelled.filter("not label").collect()
    assert len(negatives) == 1500 and all(r["text"] != f"text {r['id'] % 50}" for r in negatives)
    assert h.with_negatives(rows, ["id"], "text", keep_equal=True).filter("not label").count() == 1500


def test_single_row_has_no_mismatch(spark):
    one = spark.createDataFrame([(1, "a")], "id long, text string")
    assert [r["label"] for r in h.with_negatives(one, ["id"], "text").collect()] == [True]


def test_batches(rows):
    got = Counter(r["batch"] for r in h.batches(rows, ["id"], 32).collect())
    assert got == Counter({**{b: 32 for b in range(46)}, 46: 28})


def test_bad_arguments(rows):
    for call in (lambda: h.sample_rows(rows, ["id"], -1), lambda: h.split_by_hash(rows, ["id"], 1.5), lambda: h.batches(rows, ["id"], 0)):
        with pytest.raises(ValueError):
            call()
