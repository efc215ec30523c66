import re

import numpy as np
import pytest
from cases import empty, odd, rows

from driftwood.llm.mixing import fit_lengths, mix, source_targets
from driftwood.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def targets_by_force(sizes):
    """Deals out by weight, takes back what is above, and deals that out again until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), list(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - 2 * sizes[s]) for s in free)
        for s in free:
            target[s] = min(target[s], 2.0 * sizes[s])
        free = [s for s in free if target[s] < 2 * sizes[s]]
    return target


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def nearest_by_force(sizes, target, limit=2):
    """How near to the target any choice of up to ``limit`` copies of each document comes."""
    sums = 1
    for size in sizes:
        for _ in range(limit):
            sums |= sums << size
    return min((abs(s - target) for s in range(sums.bit_length()) if sums >> s & 1), default=0)


@pytest.mark.parametrize("seed", range(6))
def test_lengths_fit_the_target(seed):
    g = np.random.default_rng(seed)
    lengths = np.unique(g.integers(1, 4000, 60))
    counts = g.integers(1, 50, len(lengths))
    whole = int((lengths * counts).sum())
    for target in (0, 1, 7777, whole // 3, whole - 5, whole * 1.3, 1.99 * whole, 2.0 * whole):
        take = fit_lengths(lengths, counts, target, capacity=1 << 14)
        assert (take >= 0).all() and (take <= 2 * counts).all()
        assert abs(int((take * lengths).sum()) - target) <= (0.5 if target > 10 else lengths.min())


def test_small_targets_are_fitted_as_well_as_any_choice_could():
    lengths, counts = np.array([0, 6, 10, 15]), np.array([3, 2, 1, 2])
    for target in [x / 2 for x in range(220)]:
        take = fit_lengths(lengths, counts, target)
        assert (take <= 2 * counts).all()
        assert abs(int((take * lengths).sum()) - target) == nearest_by_force([6, 6, 10, 15, 15], target)


def test_further_copies_and_sums_above_are_used():
    sizes = [2, 16, 47, 71, 275, 350, 636, 665, 2770]
    take = fit_lengths(np.array(sizes), np.ones(9, dtype=np.int64), 2330.0)
    assert int((take * np.array(sizes)).sum()) == 2330 and take.max() <= 2
    assert fit_lengths(np.array([100]), np.array([1]), 60.0).tolist() == [1]
    assert fit_lengths(np.array([100]), np.array([1]), 50.0).tolist() == [0]


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 7, None: 50}, {"z": 0, "é": 0}, {"a": 10}, {"b": 0, "a": 9, "c": 1000, "d": 3}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(frame).collect()}
    assert got == pytest.approx(targets_by_force(sizes))


def check(got, made):
    sizes = {}
    for source, text in made:
        sizes[source] = sizes.get(source, 0) + size_of(text)
    target, taken = targets_by_force(sizes), dict.fromkeys(sizes, 0)
    assert len(got) == len(made)
    for r in got:
        assert (r["mix_size"], r["mix_source_size"]) == (size_of(r["text"]), sizes[r["source"]])
        assert r["mix_target"] == pytest.approx(target[r["source"]])
        assert r["mix_taken"] == r["mix_copies"] * r["mix_size"] and 0 <= r["mix_copies"] <= 2
        taken[r["source"]] += r["mix_taken"]
    return target, taken


def test_odd_rows(spark):
    frame = mix(odd(spark))
    got = frame.collect()
    check(got, [(r[3], r[1]) for r in rows()])
    assert frame.columns[:9] == odd(spark).columns
    assert sorted(map(str, got)) == sorted(map(str, mix(odd(spark).repartition(5)).collect()))


def test_copies_of_one_length_are_taken_in_part(spark):
    made = [(i, "a b c", "s") for i in range(900)] + [(1000 + i, "x " * 40, "t") for i in range(300)]
    got = mix(spark.createDataFrame(made, "doc_id long, text string, source string")).collect()
    target, taken = check(got, [(r[2], r[1]) for r in made])
    assert all(abs(taken[s] - target[s]) <= 40 for s in taken)
    assert {r["mix_copies"] for r in got if r["source"] == "s"} == {2} and {r["mix_copies"] for r in got if r["source"] == "t"} == {1, 2}


def test_empty(spark):
    assert mix(empty(spark)).count() == 0


def test_query_comes_near_its_targets_and_repeats(spark):
    query = QUERIES["op4_subset_sum_mixing"]
    got = query(spark, SF).collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    target, taken = {}, {}
    for r in got:
        target[source[r["doc_id"]]] = r["target"]
        taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sorted(map(tuple, got)) == sorted(map(tuple, query(spark, SF).collect()))
