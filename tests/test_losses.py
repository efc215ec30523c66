"""What used to be lost without a word is an error, or stays."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftwood import schemas, session
from driftwood.operators import chains, confusion, packing, relations
from driftwood.plans import scoring
from driftwood.sources import entities, samples


def entity_tables(spark, versions):
    wide = "id string, commit string, date date, code string, docstring string, code_updated boolean, docstring_updated boolean, " \
        "code_similarity double, docstring_similarity double, function string, last_version string"
    return (
        spark.createDataFrame(versions, wide), spark.createDataFrame([("f", "name", "file")], schemas.FUNCTION),
        spark.createDataFrame([("file", "p.py", "repo")], schemas.FILE),
        spark.createDataFrame([("repo", "a/b", 1, 1, 1, 1, 1, 1, 1)], schemas.REPOSITORY),
    )


def version(name, function="f", commit=None, code="def f():\n    pass"):
    return (name, commit, None, code, "doc", True, False, 0.5, 0.5, function, "before")


def test_a_version_without_commit_and_date_is_complete(spark):
    tables = entity_tables(spark, [version("v"), version("w", commit="c"), version("x", code=None)])
    assert {r["id"] for r in relations.wide_table(*tables, complete_only=True).collect()} == {"v", "w"}


def test_an_orphan_raises_whatever_is_selected(spark):
    wide = relations.denormalise(*entity_tables(spark, [version("v"), version("w", function="gone")]))
    for columns in (["id"], ["code", "docstring"], ["repo_name"]):
        with pytest.raises(PySparkException, match="no parent for version w"):
            wide.select(*columns).collect()


def test_versions_are_exchanged_once(spark):
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = relations.denormalise(*entity_tables(spark, [version("v")]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 6 and sum("function#" in line for line in exchanges) == 2


def test_a_stage_cut_short_is_built_again(spark):
    parameters = {"run": session.fresh_path(spark, "x")}
    rows = spark.range(100).repartition(4)

    def fails():
        return rows.withColumn("y", F.when(F.col("id") == 99, F.raise_error(F.lit("stop"))).otherwise(F.lit("")))

    with pytest.raises(Exception, match="stop"):
        entities.stage(spark, "cut", parameters, fails)
    assert entities.stage(spark, "cut", parameters, lambda: rows).count() == 100


def test_indented_caches_and_broken_ones(spark, tmp_path):
    data = {"m": [["a0", "b0"], ["a1", "b1"]]}
    for name, text in (("flat", json.dumps(data)), ("indented", json.dumps(data, indent=2))):
        (tmp_path / name).write_text(text)
        assert samples.explode_predictions(samples.read_prediction_cache(spark, str(tmp_path / name))).count() == 4
    (tmp_path / "broken").write_text('{"m": [["a0"')
    with pytest.raises(Exception, match="(?i)not JSON|malformed"):
        samples.read_prediction_cache(spark, str(tmp_path / "broken")).collect()
    (tmp_path / "lines").write_text('{"first_item": 4, "data": {"m": [["a"]]}}\n\nno\n')
    with pytest.raises(Exception, match="(?i)not JSON|malformed"):
        samples.read_prediction_lines(spark, str(tmp_path / "lines")).collect()


def test_ratings_with_leading_commas_and_broken_lines(spark, tmp_path):
    (tmp_path / "leading").write_text('[ "one"\n, "two, [x]"\n , "three"\n, null\n,"four" ]\n')
    assert sorted(r["answer"] for r in samples.read_ratings(spark, str(tmp_path / "leading")).collect()) == ["four", "one", "three", "two, [x]"]
    (tmp_path / "broken").write_text('[\n"one",\ntwo,\n"three"]')
    with pytest.raises(Exception, match="no part of a JSON array"):
        samples.read_ratings(spark, str(tmp_path / "broken")).collect()


EMBEDDED = [(1, None, "code", 0, [1.0, 0.0]), (1, None, "doc", 0, [1.0, 1.0]), (1, "m", "gen", 0, [0.0, 1.0])]
GENERATED = [("m", 0, 1, "text")]


@pytest.mark.parametrize("more, generated, message", [
    ([(2, None, "doc", 0, [1.0, 1.0])], GENERATED, "no code vector for item 2"),
    ([(2, None, "code", 0, [1.0, 1.0]), (2, "m", "gen", 0, [1.0, 1.0])], GENERATED, "no docstring vector for item 2"),
    ([], [], "no generated text for item 1"),
])
def test_scoring_loses_no_item(spark, more, generated, message):
    vectors = spark.createDataFrame(EMBEDDED + more, schemas.TEXT_EMBEDDING)
    texts = spark.createDataFrame(generated, "mid string, sample_idx int, item_idx long, text string")
    with pytest.raises(PySparkException, match=message):
        scoring.score_by_distance(vectors, texts, scoring.DistanceParameters()).select("item_idx").collect()


def test_items_without_generated_text(spark):
    items = spark.createDataFrame([(1,), (2,)], "item_idx long")
    texts = spark.createDataFrame(GENERATED, "mid string, sample_idx int, item_idx long, text string")
    with pytest.raises(PySparkException, match="no text generated for item 2"):
        relations.attach_generations(items, texts).collect()


def test_null_ratios_count_nowhere(spark):
    rows = spark.createDataFrame([("s", None, True), ("s", 0.5, True), ("s", None, False)], "mid string, ratio double, l boolean")
    one = confusion.confusion(rows, ["mid"], F.lit(1.0)).first()
    curve = confusion.threshold_curve(rows, ["mid"]).filter("test_threshold >= 1").orderBy("grid_idx").first()
    assert [one[c] for c in ("tp", "tn", "fp", "fn")] == [curve[c] for c in ("tp", "tn", "fp", "fn")] == [1, 0, 0, 0]


def test_long_sequences_keep_every_token(spark):
    rows = spark.createDataFrame([(i, list(range(n))) for i, n in enumerate([0, 3, 10, 11, 25, 40])], "id long, input_ids array<int>")
    kept = packing.assign_blocks(rows, ["id"], block_size=10).collect()
    whole = {}
    for r in sorted(kept, key=lambda r: r["piece"]):
        whole.setdefault(r["id"], []).extend(r["input_ids"])
    assert whole == {i: list(range(n)) for i, n in enumerate([0, 3, 10, 11, 25, 40])}
    assert {r["id"] for r in packing.assign_blocks(rows, ["id"], block_size=10, long="drop").collect()} == {0, 1, 2}
    assert tuple(packing.count_long(rows, block_size=10).first()) == (3, 76)


def test_a_text_column_orders_a_long_chain(spark):
    rows = spark.createDataFrame([("k", f"{i:05d}", i) for i in range(500)] + [("l", "a", 1)], "key string, at string, v int")
    got = chains.with_previous(rows, ["key"], ["at"], ["v"], partitions=8).collect()
    assert {(r["v"], r["_prev_v"]) for r in got if r["key"] == "k"} == {(i, i - 1 if i else None) for i in range(500)}
    assert [r["_has_prev"] for r in got if r["key"] == "l"] == [False]
