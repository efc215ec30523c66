"""Findings of the third round: whole jobs, bounded memory of the Python functions, narrow shuffles."""

import tracemalloc

import pyarrow as pa

import __spark_entry__ as entry_points
from driftwood.catalog import views
from driftwood.functions import similarity as characters
from driftwood.functions.batches import SLICE_BYTES, SLICE_ROWS, slices
from driftwood.operators import chains, extract, lookup, relations
from driftwood.plans import corpus_profile, dataset

SF = "/root/testdata/sf0.001"


def test_each_turn_meets_all_texts_of_its_conversation(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").groupBy("conv_id").count().collect()
    got = entry_points.queries()["j4_items_with_generations"](spark, SF).groupBy("item_idx").count().collect()
    assert {tuple(r) for r in got} == {(conv, n * n) for conv, n in turns}


def test_slices_hold_all_rows_and_few_bytes():
    column = pa.array([None, "", "x" * 3 * SLICE_BYTES, *["é" * 1000] * 5000])
    parts = list(slices([column, column]))
    assert [begin for begin, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
    assert sum(n for _, n in parts) == len(column) and max(n for _, n in parts) <= SLICE_ROWS
    assert all(n == 1 or sum(len((t or "").encode()) for t in column.slice(begin, n).to_pylist()) * 2 <= SLICE_BYTES for begin, n in parts)


def test_functions_are_handed_on_before_the_whole_batch_is_parsed():
    batch = pa.array([f'def f_{n}(x):\n    """{"d" * 1000}"""\n    return x\n' for n in range(3000)])
    parts = list(extract.parse_functions.func(iter([batch])))
    assert sum(map(len, parts)) == 3000 and max(part.nbytes for part in parts) < 5 * SLICE_BYTES
    assert [f["name"] for part in parts for found in part.to_pylist() for f in found] == [f"f_{n}" for n in range(3000)]


def test_similarity_of_a_batch_takes_no_multiple_of_its_texts():
    batch = pa.array([("abc" * 700) + str(n) for n in range(5000)])
    tracemalloc.start()
    got = characters.similarity.func(batch, batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [1.0] * 5000 and peak < 60e6


def test_long_texts_are_counted_by_stretches(monkeypatch):
    texts = ["abcabd" * 50, "", "é😀z" * 33, "q"]
    keys, counts = characters._character_counts(texts)
    monkeypatch.setattr(characters, "STRETCH", 7)
    by_stretches = characters._character_counts(texts)
    assert keys.tolist() == by_stretches[0].tolist() and counts.tolist() == by_stretches[1].tolist()


def test_looking_back_hands_on_slices():
    rows = pa.RecordBatch.from_pydict({"k": [n // 7 for n in range(4000)], "text": [str(n) + "x" * 1000 for n in range(4000)]})
    parts = list(chains._shifted(iter([rows, rows.slice(0, 0)]), ["k"], ["text"]))
    assert max(part.num_rows for part in parts) <= SLICE_BYTES // 1000 + 1
    got = [row for part in parts for row in part.to_pylist()]
    assert [r["text"] for r in got] == rows.column("text").to_pylist()
    assert [r["_prev_text"] for r in got] == [None if n % 7 == 0 else str(n - 1) + "x" * 1000 for n in range(4000)]
    assert [n for n, r in enumerate(got) if r["_first"]] == [0] and [n for n, r in enumerate(got) if r["_last"]] == [3999]


def test_versions_are_shuffled_once_and_before_their_texts_are_made(spark):
    wide = relations.wide_table(*views.chain_tables(spark, SF))
    plan = wide._jdf.queryExecution().executedPlan().toString().split("Window [lag")[1].split("SortMergeJoin")[0]
    assert plan.count("Exchange hashpartitioning(function") <= 2   # of the versions, and of the functions they meet
    assert "def f_" not in plan


def test_no_text_is_written_to_be_profiled(spark):
    profiled = corpus_profile.profiled_table(*views.chain_tables(spark, SF))
    assert not {"code", "docstring", "filename"} & set(profiled.columns) and {"code_lengths", "docstring_lengths"} <= set(profiled.columns)


def test_no_version_is_shuffled_to_find_its_drawn_id(spark, monkeypatch):
    plans, write = {}, dataset.materialise

    def watched(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(dataset, "materialise", watched)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = dataset.cut_entities(*views.chain_tables(spark, SF), share=1 / 3)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert "hashpartitioning(id" not in plans["sample"]
    assert cut.train.count() + cut.test.count() == cut.train.unionByName(cut.test).select("id").distinct().count() > 0


def test_weights_are_multiplied_behind_the_shuffle_by_text(spark):
    plan = entry_points.queries()["w7_normalised_weights"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Window [")[1].split("Exchange")[0]
    assert "POWER(" in above.upper()


def test_a_key_of_one_row_in_ten_thousand_is_looked_up_where_it_lies(spark):
    counts = spark.createDataFrame([("rare", 1), ("some", 10), ("often", 99_989)], "token string, frequency long")
    frequent, others = lookup.split_by_frequency(counts, "frequency")
    assert {r["token"] for r in frequent.collect()} == {"some", "often"} and [r["token"] for r in others.collect()] == ["rare"]
