"""Version chains: partitions joined at their seams give what a plain window gives."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwood.operators import chains


@pytest.fixture(scope="module")
def versions(spark):
    """A third of all rows lies in one chain; equal neighbours and ties in the first order column occur."""
    rng = random.Random(3)
    rows = []
    for n in range(900):
        key = "hot" if n % 3 == 0 else f"k{rng.randrange(60)}"
        rows.append((key, rng.randrange(120), n, rng.choice("ab"), rng.choice("xy")))
    return spark.createDataFrame(rows, "key string, seq long, node int, code string, docstring string").repartition(7).cache()


def as_rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def by_window(df, keys, order, values, descending=False):
    """What one plain window over each chain gives."""
    lead = F.col(order[0])
    window = W.partitionBy(*keys).orderBy(lead.desc() if descending else lead.asc(), *order[1:])
    return df.withColumns({**{f"_prev_{v}": F.lag(v).over(window) for v in values}, "_has_prev": F.row_number().over(window) > 1})


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("partitions", [1, 5, 16, 300])
def test_seams_equal_plain_window(versions, descending, partitions):
    arguments = (versions, ["key"], ["seq", "node"], ["code", "node"], descending)
    assert as_rows(chains.with_previous(*arguments, partitions=partitions)) == as_rows(by_window(*arguments))


@pytest.mark.parametrize("size", [1, 3])
def test_chain_of_equal_first_order_values(spark, size):
    """Only the second order column tells the rows of the one chain apart."""
    rows = spark.createDataFrame([("k", 7, i, f"v{i}") for i in range(600)] + [(None, 7, i, "n") for i in range(3)], "key string, seq int, node int, v string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        linked = chains.with_previous(rows.repartition(5), ["key"], ["seq", "node"], ["v"], partitions=8)
        sizes = linked.groupBy(F.spark_partition_id()).count().collect()
        got = {(r["key"], r["node"]): (r["_prev_v"], r["_has_prev"]) for r in linked.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(k, i): (((f"v{i - 1}" if k else "n") if i else None), i > 0) for k, n in (("k", 600), (None, 3)) for i in range(n)}
    assert sizes


def test_no_partition_holds_a_long_chain(spark, monkeypatch):
    written, write = [], chains.materialise
    monkeypatch.setattr(chains, "materialise", lambda df, label: written.append(write(df, label)) or written[-1])
    rows = spark.range(4000).select(F.lit("k").alias("key"), F.lit(1).alias("seq"), F.col("id").alias("node"))
    chains.with_previous(rows, ["key"], ["seq", "node"], ["node"], partitions=8)
    sizes = [r["count"] for r in written[0].groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 4000 / 8


def test_empty_table(versions):
    assert chains.with_previous(versions.limit(0), ["key"], ["seq"], ["code"]).count() == 0


def test_kept_versions_differ_from_their_neighbours(versions):
    kept = chains.flag_changes(versions, ["key"], ["seq", "node"]).collect()
    by_key = {}
    for r in sorted(kept, key=lambda r: (r["key"], r["seq"], r["node"])):
        before = by_key.get(r["key"])
        if before is None:
            assert r["code_updated"] is None and r["code_similarity"] is None
        else:
            assert (before["code"], before["docstring"]) != (r["code"], r["docstring"])
            assert r["code_updated"] == (before["code"] != r["code"])
        by_key[r["key"]] = r


def test_oldest_first_reverses_time_but_not_the_order_within_a_file(spark):
    rows = spark.createDataFrame([("k", 0, 0, "n0"), ("k", 0, 1, "n1"), ("k", 1, 0, "o0")], "key string, seq int, node int, id string")
    linked = chains.link_versions(rows, ["key"], ["seq", "node"], newest_first=False)
    assert {r["id"]: r["last_version"] for r in linked.collect()} == {"o0": None, "n0": "o0", "n1": "n0"}


def test_neighbour_columns(spark):
    rows = spark.createDataFrame([("k", 0, "a", 1.0), ("k", 1, "b", 2.0)], "key string, seq int, id string, value double")
    linked = chains.link_versions(rows, ["key"], ["seq"])
    got = chains.with_last_version(linked, "id", ["value"]).orderBy("seq").select("id", F.col("last_value")).collect()
    assert [tuple(r) for r in got] == [("a", None), ("b", 1.0)]
