import collections
import random

import numpy as np
import pytest
from cases import empty, odd, rows, words

from driftwood.llm.minhash import dart_minhash, near_duplicates, shingles, weighted_elements
from driftwood.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def classes_by_force(texts, weights="set", threshold=0.8):
    """Classes of (id, text) pairs by comparing all shingle multisets."""
    sets = {}
    for i, t in texts:
        w = (t or "").encode().split()
        k = min(5, len(w))
        runs = collections.Counter(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if k else collections.Counter()
        sets.setdefault(i, []).append(runs if weights == "counts" else collections.Counter(set(runs)))
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            for a in sets[i]:
                for b in sets[j]:
                    both, either = sum((a & b).values()), sum((a | b).values())
                    if a == b or (either and both >= threshold * either):
                        x, y = find(i), find(j)
                        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def result(frame):
    return {r["id"]: r["class_id"] for r in frame.collect() if r["id"] is not None}


def test_signatures_agree_as_often_as_weighted_jaccard():
    g = np.random.default_rng(3)
    items = g.integers(0, 2**63, 300).astype(np.uint64)
    a, b = g.integers(1, 6, 300).astype(float), g.integers(1, 6, 300).astype(float)
    a[:60] = 0
    b[240:] = 0
    expected = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    owner = np.repeat([0, 1], 300)
    both = dart_minhash(np.tile(items, 2)[np.r_[a, b] > 0], np.r_[a, b][np.r_[a, b] > 0], owner[np.r_[a, b] > 0], 2, 4000, 1)
    assert abs((both[0] == both[1]).mean() - expected) < 0.04


def test_signature_does_not_depend_on_the_company():
    items = np.arange(1, 50, dtype=np.uint64)
    alone = dart_minhash(items, np.ones(49), np.zeros(49, int), 1, 125, 1)
    other = np.arange(1000, 3000, dtype=np.uint64)
    joint = dart_minhash(np.r_[items, other], np.ones(2049), np.r_[np.zeros(49, int), np.ones(2000, int)], 2, 125, 1)
    assert (alone[0] == joint[0]).all()


def test_short_texts_are_one_run():
    assert len(shingles([b"a", b"b"], 5, {})) == 1 and len(shingles([], 5, {})) == 0
    assert len(weighted_elements("a b a b a b a b", 2, "counts", {})[0]) == 2


@pytest.mark.parametrize("weights", ["set", "counts"])
def test_equals_brute_force_on_near_copies(spark, weights):
    g = random.Random(1)
    made = []
    for _ in range(8):
        base = words(g, 150).split()
        for _ in range(12):
            copy = list(base)
            for _ in range(g.randint(0, 8)):
                copy[g.randrange(len(copy))] = "w%d" % g.randrange(10**6)
            made.append((len(made), " ".join(copy + copy[:30] * g.randint(0, 2))))
    made.append((len(made), None))
    found = result(near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), weights=weights))
    assert found == classes_by_force(made, weights)


def test_a_chain_of_copies_is_one_class(spark):
    g = random.Random(2)
    text, made = words(g, 200).split(), []
    for i in range(60):
        made.append((100 - i, " ".join(text)))
        text[(i * 7) % 200] = f"new{i}"
    found = result(near_duplicates(spark.createDataFrame(made, "doc_id long, text string")))
    assert found == classes_by_force(made) and set(found.values()) == {41}


def test_odd_rows(spark):
    frame = near_duplicates(odd(spark))
    got = frame.collect()
    assert len(got) == len(rows()) and sum(r["id"] is None for r in got) == 2
    assert all(r["kept"] == (r["id"] is None or r["id"] == r["class_id"]) for r in got)
    assert result(frame) == classes_by_force([r[:2] for r in rows() if r[0] is not None])


def test_an_id_on_two_texts_joins_their_classes(spark):
    g = random.Random(3)
    a, b = words(g, 50), words(g, 50)
    found = result(near_duplicates(spark.createDataFrame([(5, a), (5, b), (7, a), (8, b), (9, words(g, 50))], "doc_id long, text string")))
    assert found == {5: 5, 7: 5, 8: 5, 9: 9}


def test_empty(spark):
    assert near_duplicates(empty(spark)).count() == 0


def test_query_equals_brute_force(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op1_minhash_near_dedup"](spark, SF)
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == classes_by_force(texts)
