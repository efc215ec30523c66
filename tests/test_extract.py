"""Function extraction, history and rewriting on small sources, one rule each."""

import datetime

import pytest
from pyspark.sql import functions as F

from driftwood import schemas
from driftwood.operators import extract
from driftwood.operators.rewrite import rewrite_files
from driftwood.plans.version_history import version_history
from driftwood.sources.history import decode_sources, read_source_tree


def found(spark, source, mined=False):
    rows = extract.extract_functions(spark.createDataFrame([(1, source)], "id int, source string"))
    rows = extract.documented_functions(rows) if mined else rows
    return rows.orderBy("node").collect()


@pytest.mark.parametrize("body, trivial", [
    ('"""D."""\n    pass', True), ('"""D."""\n    ...', True), ("pass", True), ('"""D."""', False), ('"""D."""\n    return 1', False),
    ("...\n    pass", False), ("'x'\n    'y'", False),
])
def test_trivial(spark, body, trivial):
    assert [r["trivial"] for r in found(spark, f"def f():\n    {body}\n")] == [trivial]


def test_breadth_first_without_async_and_decorators(spark):
    source = "class A:\n    def m(self):\n        def deep(): pass\n\nasync def no(): pass\n\n@wrap\ndef top():\n    def inner(): pass\n"
    rows = found(spark, source)
    assert [r["name"] for r in rows] == ["top", "m", "inner", "deep"] or [r["name"] for r in rows] == ["top", "m", "deep", "inner"]
    assert rows[0]["code"].startswith("def top") and rows[0]["start_line"] == 8


@pytest.mark.parametrize("source", ["def f(:\n  x\n", "def f():\n\tif x:\n        y\n", "x = '\x00'\n", "(" * 5000])
def test_unparsable_sources_give_no_rows(spark, source):
    assert found(spark, source) == []


def test_null_source(spark):
    assert found(spark, None) == []


def test_half_a_surrogate_counts_as_undocumented(spark):
    assert [r["docstring"] for r in found(spark, 'def f():\n    "\\ud800"\n    return 1\n')] == [None]


def test_mined_code(spark):
    source = 'class A:\n    def m(self):\n        """One\n\n        two.\n        """\n        return 1\n\n    def n(self):\n        "no triple quotes"\n        return 2\n'
    rows = found(spark, source, mined=True)
    assert [(r["name"], r["docstring"], r["code"]) for r in rows] == [("m", "One\n\ntwo.", "    def m(self):\n        \n        return 1")]


def test_decoding(spark):
    rows = spark.createDataFrame([(1, bytearray(b"a\r\n\tb\rc\n")), (2, bytearray(b"a\n\n\n\xff")), (3, bytearray(b"a\nb\n")), (4, bytearray(b"\r\n\r\n\r\n\xc3\xa9"))], "id int, content binary")
    assert {r["id"]: r["source"] for r in decode_sources(rows).collect()} == {4: "\n\n\né"}
    assert decode_sources(rows, min_newlines=2).filter("id = 1").first()["source"] == "a\n    b\nc\n"


def test_source_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("def f():\n    '''D.'''\n\n    return 1\n")
    (tmp_path / "a" / "x.txt").write_text("no")
    tree = read_source_tree(spark, str(tmp_path), "here")
    assert [f.name for f in tree.schema] == schemas.FILE_VERSION.names
    assert tree.count() == 1


def test_located_functions(spark):
    source = 'def f():\n    """A\n    b"""\n    return 1\n\ndef g():\n    return 2\n'
    rows = extract.located_functions(extract.extract_functions(spark.createDataFrame([(1, source)], "id int, source string"))).orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"], r["docstring_start_line"], r["docstring_end_line"], r["docstring"], r["has_docstring"], r["code"]) for r in rows] == [
        (1, 4, 2, 3, "A\nb", True, "def f():\n    \n    return 1"), (6, 7, None, None, "", False, "def g():\n    return 2")]


def test_history_of_names_that_occur_twice(spark):
    """Two methods of one name share a chain; the older commit changes one of them."""
    def source(second):
        return f'class A:\n    def m(self):\n        """D."""\n        return 1\nclass B:\n    def m(self):\n        """D."""\n        return {second}\n'

    at = datetime.datetime(2024, 1, 1)
    rows = [("r", "a.py", "c0 x", at, 0, bytearray(source(2).encode())), ("r", "a.py", "c1 x", at, 1, bytearray(source(2).encode())),
            ("r", "a.py", "c2 x", at, 2, bytearray(source(3).encode())), ("r", "b.txt", "c0 x", at, 0, bytearray(b"\n\n\n"))]
    made = version_history(spark.createDataFrame(rows, schemas.FILE_VERSION))
    assert made.files.count() == 1 and made.functions.count() == 1
    versions = {r["id"]: r for r in made.versions.collect()}
    heads = [r for r in versions.values() if r["last_version"] is None]
    assert len(heads) == 1 and heads[0]["code_updated"] is None
    chain, following = [heads[0]], {r["last_version"]: r for r in versions.values()}
    while chain[-1]["id"] in following:
        chain.append(following[chain[-1]["id"]])
    assert [(r["commit"], r["code"][-1]) for r in chain] == [("c0", "1"), ("c0", "2"), ("c2", "1"), ("c2", "3")]
    assert all(r["docstring_updated"] is False and r["docstring_similarity"] == 1.0 for r in chain[1:])


def test_rewrite_at_the_edges(spark):
    files = spark.createDataFrame([("a", "1\n2\n3"), ("b", "x")], "path string, source string")
    edits = spark.createDataFrame([("a", 1, 1, "A\nB\n"), ("a", 3, 3, "C")], "path string, first_line int, last_line int, block string")
    got = {r["path"]: (r["source"], r["edits"]) for r in rewrite_files(files, edits).collect()}
    assert got == {"a": ("A\nB\n2\nC", 2), "b": ("x", 0)}


def test_scattered_results(spark):
    functions = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    scored = spark.createDataFrame([(1, True), (2, False)], "id int, out_of_date boolean")
    assert {r["id"]: r["up_to_date"] for r in extract.scatter_results(functions, scored, ["id"]).select("id", F.col("up_to_date")).collect()} == {1: False, 2: True, 3: False}
