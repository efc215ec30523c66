"""Readers, writers, requests, joins and tallies."""

import json

import pytest
from pyspark.errors import PySparkException

from driftwood import schemas, session
from driftwood.operators import relations
from driftwood.operators.profile import density, long_metrics
from driftwood.operators.votes import side_by_side, tally
from driftwood.sources import entities, samples


def test_metadata_file(spark, tmp_path):
    path = tmp_path / "repositories.json"
    path.write_text(json.dumps([
        {"full_name": "a/b", "size": 3, "open_issues": 1, "watchers": 2, "forks": 4, "stargazers_count": 5, "other": {"x": 1},
         "contributors": [{"contributions": 7, "login": "p"}, {"contributions": 8}]},
        {"full_name": "c/d", "size": 1, "open_issues": 0, "watchers": 0, "forks": 0, "stargazers_count": 9},
    ], indent=2))
    rows = entities.repositories_from_metadata(entities.read_repository_metadata(spark, str(path))).orderBy("full_name").collect()
    assert [(r["contributors"], r["contributions"], r["stars"]) for r in rows] == [(2, 15, 5), (0, 0, 9)]


def test_entity_round_trip(spark, tmp_path):
    files = spark.createDataFrame([(f"id{i}", f"p{i}.py", "r") for i in range(100)], schemas.FILE)
    for file_format in ("json", "parquet"):
        path = str(tmp_path / file_format)
        entities.write_entity(files, path, "files", file_format)
        assert sorted(entities.read_entity(spark, path, schemas.FILE, file_format).collect()) == sorted(files.collect())


def test_stage_is_computed_once_per_parameters(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    run = session.fresh_path(spark, "x")
    assert [entities.stage(spark, "t", {"run": run, "n": n}, build).count() for n in (1, 1, 2)] == [1, 1, 2]


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or session.shared_dir(spark) == configured.rstrip("/")


def test_ratings_indented_or_not(spark, tmp_path):
    answers = ['plain', 'with "quotes", [brackets] and\nbreaks', "ends with ]", "[starts", ""]
    for name, text in (("indented", json.dumps(answers, indent=4)), ("flat", json.dumps(answers))):
        (tmp_path / name).write_text(text)
        assert sorted(r["answer"] for r in samples.read_ratings(spark, str(tmp_path / name)).collect()) == sorted(answers)


ANSWERS = ['plain', 'with "quotes", [brackets] and\nbreaks', "ends with ]", "[starts", "", "back\\", 'a\\"b', '"', '\\\\"', "é😀 null", ", , ["]


@pytest.mark.parametrize("size", ["64b", "1k", "128m"])
def test_string_arrays_split_anywhere(spark, tmp_path, size):
    """Whatever the splits, marks that are escaped or stand at a border are told apart."""
    answers = ANSWERS * 40
    (tmp_path / "flat").write_text(json.dumps(answers))
    (tmp_path / "indented").write_text(json.dumps(answers, indent=4, ensure_ascii=False))
    (tmp_path / "empty").write_text("[]")
    (tmp_path / "nulls").write_text('[null, "x",null]')
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        frame = samples.read_string_arrays(spark, str(tmp_path))
        tasks = spark.read.option("lineSep", '"').text(str(tmp_path)).rdd.getNumPartitions()
        got = {}
        for r in frame.collect():
            got.setdefault(r["path"].rsplit("/", 1)[1], {})[r["place"]] = r["text"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {name: [found[i] for i in range(len(found))] for name, found in got.items()} == {"flat": answers, "indented": answers, "nulls": ["x"]}
    assert size != "64b" or tasks > 50


@pytest.mark.parametrize("text", ['["a", 7]', '["a", "b', '["a"] x', '["bad \\x escape"]'])
def test_what_is_no_string_array_is_an_error(spark, tmp_path, text):
    (tmp_path / "bad").write_text(text)
    with pytest.raises(PySparkException):
        samples.read_string_arrays(spark, str(tmp_path)).collect()


def test_prediction_cache(spark, tmp_path):
    (tmp_path / "cache.json").write_text(json.dumps({"m": [["a0", "b0"], ["a1", "b1"]], "n": [["c0"]]}))
    rows = samples.explode_predictions(samples.read_prediction_cache(spark, str(tmp_path / "cache.json")))
    got = {(r["mid"], r["item_idx"]): r["texts"] for r in samples.predictions_by_item(rows).collect()}
    assert got == {("m", 0): ["a0", "a1"], ("m", 1): ["b0", "b1"], ("n", 0): ["c0"]}


def test_requests(spark):
    good = spark.createDataFrame([("m", ["c1", "c2"], ["d1", "d2"], "update"), ("m", [], [], "update")], schemas.REQUEST)
    assert [tuple(r) for r in samples.unpack_requests(good, ["mid"]).collect()] == [("m", 0, "c1", "d1"), ("m", 1, "c2", "d2")]
    bad = spark.createDataFrame([("m", ["c1", "c2"], ["d1"], "update")], schemas.REQUEST)
    with pytest.raises(PySparkException, match="one docstring for each code"):
        samples.unpack_requests(bad, ["mid"]).collect()


def test_missing_parent(spark):
    versions = spark.createDataFrame([("v", "f"), ("w", "gone")], "id string, function string")
    functions = spark.createDataFrame([("f", "name", "file")], schemas.FUNCTION)
    files = spark.createDataFrame([("file", "p.py", "repo")], schemas.FILE)
    repositories = spark.createDataFrame([("repo", "a/b", 1, 1, 1, 1, 1, 1, 1)], schemas.REPOSITORY)
    with pytest.raises(PySparkException, match="no parent for version w"):
        relations.denormalise(versions, functions, files, repositories).collect()
    assert relations.denormalise(versions, functions, files, repositories, check=False).count() == 1
    assert [r["id"] for r in relations.orphans(versions, "function", functions).collect()] == ["w"]


def test_tally(spark):
    ratings = spark.createDataFrame([("j", "none_fit docstring-0_better"), ("j", "docstring-2_better"), ("j", "?"), ("k", "none_fit")], schemas.RATING)
    votes = side_by_side(tally(ratings), ["j", "k"]).collect()
    assert {r["verdict"]: (r["j"], r["k"]) for r in votes} == {
        "docstring-0_better": (1, 0), "docstring-1_better": (0, 0), "docstring-2_better": (1, 0), "none_fit": (0, 1), "total": (2, 1)}


def test_density_integrates_to_one_and_skips_constants(spark):
    rows = spark.createDataFrame([(float(i % 37), 1.0) for i in range(500)], "a double, b double")
    curve = density(long_metrics(rows, ["a", "b"])).orderBy("grid_idx").collect()
    assert {r["metric"] for r in curve} == {"a"} and len(curve) == 200
    step = curve[1]["x"] - curve[0]["x"]
    assert sum(r["density"] for r in curve) * step == pytest.approx(1.0, abs=0.01)


def test_repository_picks(spark):
    rows = spark.createDataFrame([("a", "Python", 5), ("b", "python", 9), ("c", "Go", 99), ("d", "python", 1)], "id string, language string, stars int")
    assert [r["id"] for r in entities.pick_repositories(rows, 2, "python").collect()] == ["b", "a"]
    assert [r["id"] for r in entities.pick_repositories(rows, 2, cap=1).collect()] == ["c"]
    assert [r["id"] for r in entities.first_repositories(rows, 2, "id").collect()] == ["a", "b"]


def test_last_row_per_id(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 5), ("b", 3, 1)], "id string, v int, at int")
    assert sorted((r["id"], r["v"]) for r in entities.last_per_id(rows, "at").collect()) == [("a", 2), ("b", 3)]
