import math

import numpy as np
import pytest

from driftwood.llm.iterative_quantisation import bucket_keys, fit_rotations, linked_vectors, sampled_plan, table_plan
from driftwood.llm.queries import QUERIES


def by_force(ids, vectors, threshold=0.9):
    """n_links and component of each row by all cosines."""
    good = [i for i, v in enumerate(vectors) if v and None not in v and all(map(math.isfinite, v)) and any(v)]
    x = np.array([vectors[i] for i in good], dtype=np.float64)
    x = x / abs(x).max(axis=1, keepdims=True) if len(x) else x
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= threshold) & ~np.eye(len(good), dtype=bool)
    label = np.array([ids[i] for i in good])
    while True:
        new = np.minimum(label, np.where(linked, label[None], label.max(initial=0)).min(axis=1)) if len(label) else label
        if (new == label).all():
            break
        label = new
    found = {ids[i]: (0, ids[i]) for i in range(len(ids))}
    return found | {ids[i]: (int(linked[n].sum()), int(label[n])) for n, i in enumerate(good)}


def clusters(seed, centres, copies, spread, width=64):
    g = np.random.default_rng(seed)
    base = g.normal(size=(centres, width))
    rows = np.concatenate([b + spread * g.normal(size=(copies, width)) for b in base] + [g.normal(size=(200, width))])
    return [[float(v) for v in r] for r in rows.astype(np.float32)]


def result(frame):
    return {r["id"]: (r["n_links"], r["component_id"]) for r in frame.collect()}


@pytest.mark.parametrize("spread, least", [(0.1, 1.0), (0.3, 0.9), (0.33, 0.9)])
def test_recall(spark, spread, least):
    vectors = clusters(1, 12, 25, spread)
    ids = list(range(5, 5 + len(vectors)))
    got = result(linked_vectors(spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<float>")))
    wanted = by_force(ids, vectors)
    assert all(got[i][0] <= wanted[i][0] for i in ids)
    assert sum(got[i][0] for i in ids) >= least * sum(wanted[i][0] for i in ids)


def test_a_large_cluster_is_compared_in_blocks(spark):
    vectors = clusters(2, 1, 1500, 0.05)
    ids = list(range(len(vectors)))
    got = result(linked_vectors(spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<float>")))
    assert got == by_force(ids, vectors)


def test_odd_vectors(spark):
    one = [1.0, 0.0, 0.5]
    vectors = [one, one, [2.0, 0.0, 1.0], None, [], [0.0, 0.0, 0.0], [1.0, None, 0.5], [float("nan"), 0.0, 0.5], [float("inf"), 0.0, 0.5], [1e-200, 0.0, 0.0], [-1.0, 0.0, -0.5], one]
    ids = list(range(20, 20 + len(vectors)))
    frame = spark.createDataFrame([(i, v, "clash", 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, id string, n int")
    assert result(linked_vectors(frame)) == by_force(ids, vectors)


def test_other_lengths_and_missing_ids_link_with_nothing(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert result(linked_vectors(frame)) == {1: (1, 1), 2: (1, 1), 3: (0, 3), None: (0, None)}
    assert all(r["kept"] for r in linked_vectors(frame).filter("id is null").collect())


def test_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert linked_vectors(spark.createDataFrame([], schema)).count() == 0
    assert result(linked_vectors(spark.createDataFrame([(1, None)], schema))) == {1: (0, 1)}


def test_rotations_balance_their_bits():
    g = np.random.default_rng(3)
    sample = g.normal(size=(3000, 32)) * np.linspace(3, 0.3, 32)
    mean, (projection, other) = fit_rotations(sample, 2)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    ones = ((unit - mean) @ projection >= 0).mean(axis=0)
    assert (abs(ones - 0.5) < 0.1).all() and not np.allclose(projection, other)
    assert np.allclose(projection.T @ projection, np.eye(32), atol=1e-8)


def test_tables_grow_with_the_rows():
    assert table_plan(10, 64, 0.9)[0] == 12 and table_plan(10**9, 64, 0.9)[0] == 27
    assert table_plan(10**9, 64, 0.9)[1] > table_plan(10**4, 64, 0.9)[1]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    wanted = by_force([r["vec_id"] for r in rows], [r["embedding"] for r in rows])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES["op10_itq_embedding_dedup"](spark, sf).collect()}
    assert got == wanted


def with_partners(seed, rows, common, low=0.92, high=0.97, width=64):
    """Unit vectors whose mean pairwise cosine is ``common``, and a partner of each at a cosine from ``low`` to ``high``."""
    g = np.random.default_rng(seed)
    shared = np.eye(width)[0]

    def around(n):
        x = g.normal(size=(n, width)) * (np.arange(width) > 0)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    own, other = around(rows), around(rows)
    other -= (other * own).sum(axis=1, keepdims=True) * own
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    inner = (g.uniform(low, high, (rows, 1)) - common) / (1 - common)
    partner = inner * own + np.sqrt(1 - inner**2) * other
    return [np.sqrt(common) * shared + np.sqrt(1 - common) * x for x in (own, partner)]


@pytest.mark.parametrize("rows, common", [(12_000, 0.0), (12_000, 0.5), (12_000, 0.8), (12_000, 0.87), (10**6, 0.5)])
def test_tables_keep_the_recall_of_vectors_that_share_a_direction(rows, common):
    one, two = with_partners(4, 3000, common, 0.9001, 0.9002)
    plan = sampled_plan(np.concatenate([one, two]), rows, 0.9)
    met = (bucket_keys(one, *plan) == bucket_keys(two, *plan)).any(axis=1)
    assert met.mean() >= 0.93, plan[:2]


def test_links_of_vectors_that_share_a_direction(spark):
    vectors = np.concatenate(with_partners(5, 1500, 0.8)).tolist()
    ids = list(range(len(vectors)))
    got = result(linked_vectors(spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>")))
    wanted = by_force(ids, vectors)
    assert all(got[i][0] <= wanted[i][0] for i in ids)
    assert sum(got[i][0] for i in ids) >= 0.95 * sum(wanted[i][0] for i in ids)


def test_every_length_finds_its_links(spark):
    small = [v[:32] for v in clusters(7, 4, 25, 0.05)]
    vectors = clusters(6, 12, 25, 0.05) + small + [[1.0, 2.0], [2.0, 4.0], [1.0, 2.1], [3.0]]
    ids = list(range(len(vectors)))
    got = result(linked_vectors(spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>")))
    wanted = {}
    for width in {len(v) for v in vectors}:
        own = [i for i in ids if len(vectors[i]) == width]
        wanted |= by_force(own, [vectors[i] for i in own])
    assert got == wanted
