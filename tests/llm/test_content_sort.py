import hashlib
import re

import duckdb
from cases import empty, odd, rows

from driftwood.llm.content_sort import exact_duplicates, without_duplicates
from driftwood.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def by_force(made):
    groups = {}
    for i, t in made:
        t = t or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i is None, i))
    return sorted((i, min(g)[2] if min(g)[2] is not None else None, len(g), hashlib.sha256(c.encode()).hexdigest())
                  for c, g in groups.items() for _, _, i in g if i is not None)


def test_odd_rows_equal_brute_force(spark):
    frame = exact_duplicates(odd(spark))
    got = frame.collect()
    assert len(got) == len(rows())
    assert sorted((r["id"], r["keep_id"], r["group_size"], r["digest"]) for r in got if r["id"] is not None) == by_force([r[:2] for r in rows()])
    assert all(r["kept"] == (r["id"] == r["keep_id"]) for r in got)


def test_the_longest_original_stays_then_the_smallest_id(spark):
    made = [(3, "ab"), (1, "a b"), (9, "a  b"), (2, "a\n\nb"), (None, "a   b"), (4, "b")]
    got = {r["id"]: r["keep_id"] for r in exact_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {3: None, 1: None, 9: None, 2: None, None: None, 4: 4}
    got = {r["id"]: r["keep_id"] for r in exact_duplicates(spark.createDataFrame(made[:4], "doc_id long, text string")).collect()}
    assert got == {3: 2, 1: 2, 9: 2, 2: 2}


def test_a_run_longer_than_a_partition_is_one_group(spark):
    made = [(i, "same text " * 5) for i in range(5000)] + [(i, f"text {i}") for i in range(5000, 5200)]
    got = exact_duplicates(spark.createDataFrame(made, "doc_id long, text string").repartition(7)).collect()
    assert {(r["keep_id"], r["group_size"]) for r in got if r["id"] < 5000} == {(0, 5000)}
    assert sum(r["kept"] for r in got) == 201


def test_two_equal_runs_over_several_partitions(spark):
    """Each of two texts fills several partitions, another lies between them, and long texts share their beginning."""
    made = [(i, "a" * 100 + "x" * (i % 2)) for i in range(3000)] + [(9000, "a" * 100 + "w"), (9001, "a" * 100), (9002, " a" * 100)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(9)
    got = exact_duplicates(docs)
    found = {r["id"]: (r["keep_id"], r["group_size"]) for r in got.collect()}
    assert {found[i] for i in range(0, 3000, 2)} | {found[9001], found[9002]} == {(9002, 1502)}
    assert {found[i] for i in range(1, 3000, 2)} == {(1, 1500)} and found[9000] == (9000, 1)
    assert sorted(r["doc_id"] for r in without_duplicates(docs).collect()) == [1, 9000, 9002]


def test_groups_come_from_runs_not_from_the_digest(spark):
    plan = exact_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    keys = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert not any("digest" in line.split("]")[0] for line in keys)


def test_one_whole_row_stays_for_each_text(spark):
    stays = without_duplicates(odd(spark))
    assert stays.columns == odd(spark).columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in stays.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows()})


def test_empty(spark):
    assert exact_duplicates(empty(spark)).count() == 0 and without_duplicates(empty(spark)).count() == 0


def test_query_equals_sql(spark):
    name = "op7_content_sort_dedup"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    wanted = duck.execute(ORACLES[name]).fetchall()
    frame = QUERIES[name](spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, frame.collect())) == sorted(wanted)
