"""Parts that are built to hold at scale: publishing by marker, sweeps, draws before joins, one-pass histograms, sketches."""

import math
import random
import threading
import time
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftwood import schemas
from driftwood.operators import hashorder, profile, relations
from driftwood.operators.rewrite import renumber
from driftwood.plans import dataset
from driftwood.sources import entities


def test_two_writers_publish_one_table(spark):
    parameters, meet, tables = {"run": uuid.uuid4().hex}, threading.Barrier(2), {}

    def writer(n):
        def build():
            meet.wait(30)   # neither has published when either builds
            return spark.range(10).select(F.lit(n).alias("writer"), "id")
        tables[n] = entities.stage(spark, "race", parameters, build)

    threads = [threading.Thread(target=writer, args=(n,)) for n in (1, 2)]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    rows = [sorted(map(tuple, tables[n].collect())) for n in (1, 2)]
    assert rows[0] == rows[1] and len(rows[0]) == 10 and len({w for w, _ in rows[0]}) == 1
    assert entities.stage(spark, "race", parameters, lambda: 1 / 0).count() == 10


def test_marker_without_a_line_is_an_error(spark, tmp_path):
    (tmp_path / "t.complete").write_text("")
    with pytest.raises(RuntimeError, match="cut short"):
        entities._read_marker(spark, str(tmp_path / "t.complete"), patience=0.1)
    assert entities._read_marker(spark, str(tmp_path / "none.complete")) is None


def line_after(line, inclusive, edits):
    return None if line is None else line + sum(d for last, d in edits if (last <= line if inclusive else last < line))


def test_renumbering_equals_brute_force(spark):
    g = random.Random(3)
    functions, edits, deltas = [], [], {}
    for path in ("a", "b", "c", None):
        lines = sorted(g.sample(range(1, 400), 60))
        for n, (first, last) in enumerate(zip(lines[::2], lines[1::2])):
            functions.append((path, f"f{n}", first, g.choice([None, first]), last if n % 3 else None, last + g.randint(0, 5)))
            if path in ("a", "b") and n % 2:
                block = "\n".join("x" * g.randint(1, 4)) + "\n"
                edits.append((path, first, last, block))
                deltas.setdefault(path, []).append((last, block.count("\n") - (last - first + 1)))
    frame = spark.createDataFrame(functions, "path string, name string, start_line int, docstring_start_line int, docstring_end_line int, end_line int")
    got = renumber(frame, spark.createDataFrame(edits, "path string, first_line int, last_line int, block string")).collect()
    assert len(got) == len(functions)
    for r in got:
        d = deltas.get(r["path"], [])
        assert (r["new_start_line"], r["new_docstring_start_line"], r["new_docstring_end_line"], r["new_end_line"]) == (
            line_after(r["start_line"], False, d), line_after(r["docstring_start_line"], False, d),
            line_after(r["docstring_end_line"], True, d), line_after(r["end_line"], True, d))


def test_renumbering_ten_thousand_functions_with_as_many_edits_in_one_file(spark):
    def seconds(n):
        spans = spark.range(n).select(F.lit("p").alias("path"), (F.col("id") * 4 + 1).cast("int").alias("at"))
        functions = spans.select("path", *[(F.col("at") + i).alias(name) for i, name in enumerate(("start_line", "docstring_start_line", "docstring_end_line", "end_line"))])
        edits = spans.select("path", (F.col("at") + 1).alias("first_line"), (F.col("at") + 2).alias("last_line"), F.lit("a\nb\nc\n").alias("block"))
        began = time.time()
        r = renumber(functions, edits).agg(F.sum(F.col("new_end_line") - F.col("end_line"))).first()[0]
        assert r == n * (n + 1) // 2
        return time.time() - began

    seconds(100)
    assert seconds(10_000) < 20 * max(seconds(1_000), 0.3)


@pytest.fixture(scope="module")
def tables(spark):
    g = random.Random(8)
    versions = [(f"v{i}", f"def f(x):\n    return {i}", f"doc {i}", True, i % 2 == 0, 0.5, 0.5, f"f{i % 40}", f"v{i - 1}" if g.random() < 0.8 else None) for i in range(900)]
    columns = "id string, code string, docstring string, code_updated boolean, docstring_updated boolean, code_similarity double, docstring_similarity double, function string, last_version string"
    functions = spark.createDataFrame([(f"f{i}", f"name{i}", f"p{i % 12}") for i in range(40)], schemas.FUNCTION)
    files = spark.createDataFrame([(f"p{i}", f"{i}.py", f"r{i % 5}") for i in range(12)], schemas.FILE)
    repositories = spark.createDataFrame([(f"r{i}", f"o/{i}", *[None if i == 4 else 7] * 7) for i in range(5)], schemas.REPOSITORY)
    return spark.createDataFrame(versions, columns), functions, files, repositories


@pytest.mark.parametrize("asked", [{}, {"n": 100}, {"share": 0.25}])
def test_cutting_entities_equals_cutting_the_wide_table(tables, asked):
    wide = relations.wide_table(*tables, complete_only=True)
    one, two = dataset.cut_dataset(wide, **asked), dataset.cut_entities(*tables, **asked)
    for part in ("held_out", "train", "test"):
        a, b = getattr(one, part), getattr(two, part)
        assert sorted(map(str, a.select(*schemas.WIDE_COLUMNS).collect())) == sorted(map(str, b.select(*schemas.WIDE_COLUMNS).collect())), part
    with pytest.raises(ValueError):
        dataset.cut_entities(*tables, n=1, share=0.5)


def test_pair_histogram_equals_brute_force(spark):
    g = random.Random(4)
    rows = [(g.choice([None, g.gauss(0, 1)]), float(g.randint(0, 5)), 3.0 if i % 2 else None, None) for i in range(300)]
    names = ["a", "b", "c", "d"]
    got = {tuple(r[:4]): r["rows"] for r in profile.pair_density(spark.createDataFrame(rows, "a double, b double, c double, d double"), names, 10).collect()}
    expected = Counter()
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            both = [(r[i], r[j]) for r in rows if i != j and r[i] is not None and r[j] is not None]
            for values in both:
                cell = []
                for k in (0, 1):
                    low, high = min(b[k] for b in both), max(b[k] for b in both)
                    cell.append(min(math.floor((values[k] - low) / ((high - low) / 10)), 9) if high > low else 9)   # a constant lies at the upper end
                expected[(x, y, *cell)] += 1
    assert got == expected


def test_pairs_are_spelled_out_once(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    plan = profile.pair_density(rows, ["a", "b", "c"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(array(struct(metric_x, a") == 1


def test_draws_with_replacement_add_up_and_repeat(spark):
    rows = spark.range(200).withColumn("g", F.col("id") % 3)
    drawn = hashorder.draws_with_replacement(rows, ["id"], 1000)
    got = drawn.agg(F.sum("copies"), F.max("copies"), F.count(F.lit(1))).first()
    assert got[0] == 1000 and 8 <= got[1] <= 20 and 190 <= got[2] <= 200
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, hashorder.draws_with_replacement(rows.repartition(7), ["id"], 1000).collect()))
    assert hashorder.draws_with_replacement(rows.limit(0), ["id"], 5).count() == 0
    assert hashorder.balanced_sample(rows, "g", ["id"], 333, replace=True).count() == 333
    assert hashorder.balanced_sample(rows, "g", ["id"], 200, replace=True).count() == 200
    with pytest.raises(ValueError):
        hashorder.balanced_sample(rows, "g", ["id"], 333)


def test_united_sketches_are_within_their_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 4).alias("shard"), (F.col("id") % 2).alias("g"), (F.col("id") % 20_000).alias("v"), F.lit(None).cast("string").alias("none"))
    kept = profile.distinct_sketches(rows, ["shard", "g"], {"v": "v", "none": "none"})
    got = {r["g"]: r for r in profile.united_sketches(kept, ["g"], ["v", "none"]).collect()}
    assert all(abs(r["v"] - 10_000) <= 3 * profile.sketch_error() * 10_000 and r["none"] == 0 for r in got.values())
