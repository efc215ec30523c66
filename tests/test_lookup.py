"""Joins on keys of very different frequency."""

import random

import pytest
from pyspark.sql import functions as F

from driftwood.operators import lookup


@pytest.fixture(scope="module")
def occurrences(spark):
    """One key has a tenth of all rows, the others follow a steep curve; some rows have a key that is not in the table."""
    g = random.Random(1)
    keys = [0] * 2000 + [int(g.paretovariate(0.7)) % 3000 + 1 for _ in range(18_000)]
    return spark.createDataFrame([(i, k) for i, k in enumerate(keys)] + [(-1, None), (-2, 99_999)], "id long, key long").repartition(6).cache()


@pytest.fixture(scope="module")
def table(occurrences):
    counts = occurrences.filter("id >= 0").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("name", F.concat(F.lit("k"), F.col("key").cast("string"))).cache()


@pytest.mark.parametrize("heavy", [1, 20, 4096, 10**9])
def test_equals_a_plain_left_join(occurrences, table, heavy):
    wanted = sorted(map(tuple, occurrences.join(table.drop("n"), "key", "left").select("id", "key", "name").collect()), key=str)
    got = lookup.lookup_join(occurrences, table, "key", "n", heavy)
    assert got.columns == ["key", "id", "name"]
    assert sorted(map(tuple, got.select("id", "key", "name").collect()), key=str) == wanted


def test_frequent_keys_are_few_and_not_shuffled(spark, occurrences, table):
    frequent, others = lookup.split_by_frequency(table, "n", 20)
    assert 0 < frequent.count() <= 20 and frequent.count() + others.count() == table.count()
    n = occurrences.count()
    left = occurrences.join(frequent.select("key"), "key", "left_anti").groupBy("key").count().agg(F.max("count")).first()[0]
    assert left <= n / 20
    plan = lookup.lookup_join(occurrences, table, "key", "n", 20)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan or "broadcast" in plan.lower()


def test_no_task_reads_much_more_than_the_median(spark, occurrences, table):
    """A tenth of all rows has one key; the shuffled part knows nothing of it."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tail = occurrences.join(lookup.split_by_frequency(table, "n", 200)[0].select("key"), "key", "left_anti")
        sizes = sorted(r["count"] for r in tail.repartition(8, "key").groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_empty_sides(spark, occurrences, table):
    assert lookup.lookup_join(occurrences.limit(0), table, "key", "n").count() == 0
    assert lookup.lookup_join(occurrences, table.limit(0), "key", "n").filter("name is not null").count() == 0
